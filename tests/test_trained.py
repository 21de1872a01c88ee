"""The properties of right fits turn false for broken models."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from checks import trained
from tidemark.functions.durable import durable
from tidemark.models import churn, segments
from tidemark.operators.features import feature_base
from tidemark.sources.star import AS_OF, tables_from_star


@pytest.fixture(scope="module")
def matrix(spark):
    return durable(feature_base(tables_from_star(spark, "/root/testdata/sf0.001"), AS_OF))


@pytest.fixture(scope="module")
def fitted(matrix):
    return churn.train_churn_model(matrix, num_trees=5, max_depth=4)


def flags(df, name):
    return {r[name] for r in df.select(name).collect()}


def test_slopes(matrix, fitted):
    good = fitted.models["LogisticRegression"]
    assert flags(trained.stationary(matrix, good), "stationary") == {True}
    ready = good.transform(matrix.withColumn("label", F.col("is_churned").cast("double"))).select("label", "features")
    early = LogisticRegression(maxIter=1, featuresCol="features", labelCol="label").fit(ready)
    bad = PipelineModel([*good.stages[:-1], early])
    assert False in flags(trained.stationary(matrix, bad), "stationary")


def test_centres(matrix):
    good = segments.train_segmentation(matrix, restarts=1).model
    found = trained.settled(matrix, good)
    assert flags(found, "nearest") == flags(found, "centred") == {True}
    ready = good.transform(matrix).select("scaled")
    early = KMeans(k=4, maxIter=1, seed=1, featuresCol="scaled", predictionCol="segment").fit(ready)
    assert False in flags(trained.settled(matrix, PipelineModel([*good.stages[:-1], early])), "centred")


def test_reloaded_models(matrix, fitted):
    forest, line = fitted.models["RandomForest"], fitted.models["LogisticRegression"]
    assert flags(trained.same_predictions(matrix, [(forest, forest)], ["probability"]), "same") == {True}
    assert False in flags(trained.same_predictions(matrix, [(forest, line)], ["probability"]), "same")


def test_constant_predictor(matrix, fitted):
    model = fitted.models["RandomForest"]
    assert flags(trained.beats_constant(matrix, model, "is_churned", "is_churned"), "better") == {True}
    turned = matrix.withColumn("is_churned", 1 - F.col("is_churned"))
    assert flags(trained.beats_constant(turned, model, "is_churned", "is_churned"), "better") == {False}


def test_importances(spark):
    frame = lambda rows: spark.createDataFrame(rows, "feature string, importance double")
    assert flags(trained.sound_importances(frame([("a", 0.25), ("b", 0.75)])), "sound") == {True}
    assert flags(trained.sound_importances(frame([("a", 0.25), ("b", 0.5)])), "sound") == {False}
    assert False in flags(trained.sound_importances(frame([("a", 1.25), ("b", -0.25)])), "sound")


def test_best_model(fitted):
    assert flags(trained.best_is_higher(fitted), "right") == {True}
    other = {"RandomForest": "LogisticRegression", "LogisticRegression": "RandomForest"}[fitted.best_model]
    areas = {r.auc_roc for r in fitted.metrics.collect()}
    assert len(areas) == 1 or False in flags(trained.best_is_higher(fitted._replace(best_model=other)), "right")
