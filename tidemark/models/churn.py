"""Churn classifiers: a random forest and a logistic regression, the better one kept."""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import dealt_by, durable, partitions_for
from tidemark.models.importance import importance_rows, vector_names
from tidemark.models.metrics import churn_metrics, classification_report
from tidemark.models.parallel import fit_all
from tidemark.models.scaling import scaling_stages
from tidemark.models.split import test_part, train_part, train_test_split
from tidemark.operators.decisions import score_columns
from tidemark.operators.features import NUMERIC_FEATURES

# Target, encoded columns with their prefixes, published score columns.
LABEL = "is_churned"
CATEGORIES = {"acquisition_channel": "channel", "country": "country"}
SCORE_COLUMNS = [
    "customer_id",
    "churn_probability",
    "risk_tier",
    "is_churned",
    "total_spend",
    "current_mrr",
    "tenure_days",
    "events_last_30d",
    "days_since_last_event",
]


class ChurnTraining(NamedTuple):
    models: dict[str, PipelineModel]
    best_model: str
    metrics: DataFrame
    reports: dict[str, DataFrame]
    feature_importances: DataFrame | None


def encoder_stages() -> list:
    """Category levels get one 0/1 slot each plus a slot for levels unseen in training."""
    indexed = [f"{name}_index" for name in CATEGORIES]
    encoded = [f"{prefix}_vector" for prefix in CATEGORIES.values()]
    return [
        StringIndexer(
            inputCols=list(CATEGORIES), outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False),
        VectorAssembler(inputCols=[*NUMERIC_FEATURES, *encoded], outputCol="raw_features"),
    ]


def balanced_weight(sizes: dict[int, int]) -> Column:
    """n / (2 * n_class), so that both classes weigh the same in total."""
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for value, size in sizes.items():
        weight = F.when(F.col(LABEL) == value, total / (len(sizes) * size)).otherwise(weight)
    return weight


def classifiers(rows: int, num_trees: int, max_depth: int, max_iter: int, seed: int) -> dict:
    shared = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        # Kept node ids spare every row the way down all trees at each level; the few levels need no checkpoint.
        "RandomForest": RandomForestClassifier(
            numTrees=num_trees, maxDepth=max_depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1, **shared
        ),
        # An L2 penalty of C = 1 on the summed loss is 1 / rows on the mean loss.
        "LogisticRegression": LogisticRegression(
            maxIter=max_iter, regParam=1.0 / rows, elasticNetParam=0.0, standardization=False, **shared
        ),
    }


def train_churn_model(
    features: DataFrame,
    num_trees: int = 200,
    max_depth: int = 10,
    max_iter: int = 1000,
    seed: int = 42,
    partitions: int = 8,
    folder: str | None = None,
) -> ChurnTraining:
    """Fit both classifiers on the training share of ``features`` and evaluate on the rest.

    ``features`` is read several times: pass a materialised frame.  The split and the
    test scores are materialised in ``folder``, as every fit and metric reads them again.
    The training rows are dealt over ``partitions`` by customer, or over more where these
    would be too large, so the models depend on the rows, the seed and this number, not on
    the cluster or the input's layout.
    """
    parts = durable(train_test_split(features, LABEL, seed=seed), folder)
    train, test = train_part(parts), test_part(parts)

    encoders = Pipeline(stages=encoder_stages()).fit(train)
    prepared = encoders.transform(train)
    scaling = scaling_stages(prepared, "raw_features", "features")
    preparation = PipelineModel([encoders, *scaling])
    sizes = {row[LABEL]: row["count"] for row in train.groupBy(LABEL).count().collect()}
    labelled = train.withColumns({"label": F.col(LABEL).cast("double"), "weight": balanced_weight(sizes)})
    ready = dealt_by(
        preparation.transform(labelled).select("customer_id", "label", "weight", "features"),
        "customer_id",
        partitions_for(sum(sizes.values()), partitions),
    )

    estimators = classifiers(sum(sizes.values()), num_trees, max_depth, max_iter, seed)
    fitted = fit_all(features.sparkSession, [partial(e.fit, ready) for e in estimators.values()])
    models = {name: PipelineModel([preparation, model]) for name, model in zip(estimators, fitted)}
    metrics, reports = [], {}
    for name in models:
        scored = durable(models[name].transform(test).select(LABEL, "probability", "prediction"), folder)
        metrics.append(churn_metrics(scored, name))
        reports[name] = classification_report(scored)
    evaluated = metrics[0].unionByName(metrics[1])

    best = select_best_model(evaluated)
    importances = feature_importances(models[best], features) if best == "RandomForest" else None
    return ChurnTraining(models, best, evaluated, reports, importances)


def feature_importances(forest: PipelineModel, features: DataFrame) -> DataFrame:
    """Importance of every slot of the forest's input vector."""
    names = vector_names(forest.transform(features), "raw_features")
    return importance_rows(features, names, forest.stages[-1].featureImportances)


def select_best_model(metrics: DataFrame) -> str:
    """Name of the model with the higher AUC; the forest wins a tie."""
    areas = {row["model"]: row["auc_roc"] for row in metrics.collect()}
    return max(["RandomForest", "LogisticRegression"], key=lambda name: areas[name])


def predict_churn(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Churn probability and risk tier of every customer."""
    probability = vector_to_array("probability")[1]
    return model.transform(features).withColumns(score_columns(probability)).select(*SCORE_COLUMNS)
