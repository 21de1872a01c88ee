import numpy as np
import pytest
from conftest import rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions.durable import durable, work_folder
from tidemark.models import churn, lifetime, metrics, segments
from tidemark.models.scaling import fit_scaler
from tidemark.models.split import train_test_split
from tidemark.models.store import load_model, save_model
from tidemark.operators.features import feature_base
from tidemark.plans.pipeline import run_pipeline
from tidemark.sources.star import AS_OF, tables_from_star

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix(spark):
    return durable(feature_base(tables_from_star(spark, SF_DIR), AS_OF))


@pytest.fixture(scope="module")
def trained(matrix):
    return churn.train_churn_model(matrix, num_trees=20, max_depth=5)


def test_durable_uses_the_folder_of_the_session(spark):
    folder = work_folder(spark)
    df = durable(spark.range(10))
    assert folder.rsplit("/", 1)[1] in df.inputFiles()[0]
    assert work_folder(spark) == folder


@pytest.mark.parametrize("size", [1, 4, 5, 100_003])
def test_split_shares_are_exact(spark, size):
    df = spark.range(size).select(
        F.col("id").alias("customer_id"), (F.col("id") % 5 == 0).cast("bigint").alias("label")
    )
    counts = train_test_split(df, "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("train")
    )
    for row in counts.collect():
        assert row.train == int(row.n * 0.8)
    assert train_test_split(df).where("is_train").count() == int(size * 0.8)


def test_split_does_not_depend_on_row_order(spark):
    df = spark.range(5000).select(F.col("id").alias("customer_id"))
    first = train_test_split(df).where("is_train")
    second = train_test_split(df.orderBy(F.rand(7)).repartition(5)).where("is_train")
    assert first.exceptAll(second).count() == 0 and first.count() == 4000


def test_seeds_split_apart(spark):
    df = spark.range(20_000).select(F.col("id").alias("customer_id"))
    one, two = (train_test_split(df, seed=s).where("not is_train") for s in (42, 43))
    shared = one.intersect(two).count()
    assert one.count() == two.count() == 4000 and 700 < shared < 900


def test_strided_keys_spread_over_the_buckets(spark):
    from tidemark.functions.hashing import seeded_number
    from tidemark.models.split import BUCKETS

    keys = spark.range(20_000).select((F.col("id") * BUCKETS).alias("k"))
    fullest = keys.groupBy(seeded_number("k", 42) % BUCKETS).count().agg(F.max("count")).first()[0]
    assert fullest < 10


def test_models_do_not_depend_on_the_layout(matrix):
    few, many = matrix.coalesce(1), matrix.repartition(7, F.rand(3))
    fits = [churn.train_churn_model(df, num_trees=5, max_depth=4, max_iter=20) for df in (few, many)]
    a, b = (f.models["RandomForest"].stages[-1].featureImportances.toArray() for f in fits)
    assert np.allclose(a, b, atol=1e-6)
    centres = [
        np.array(segments.train_segmentation(df, restarts=2).model.stages[-1].clusterCenters()) for df in (few, many)
    ]
    assert np.allclose(*centres, atol=1e-6)


def test_scaler_uses_population_deviation(spark):
    values = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0], [9.0, 5.0]])
    df = spark.createDataFrame([tuple(map(float, v)) for v in values], "a double, b double")
    scaled = fit_scaler(df, ["a", "b"]).transform(df).select(vector_to_array("scaled").alias("v")).collect()
    expected = (values[:, 0] - values[:, 0].mean()) / values[:, 0].std()
    assert np.allclose([r.v[0] for r in scaled], expected)
    assert [r.v[1] for r in scaled] == [0.0] * 4


def test_auc_counts_ties_half(spark):
    scored = spark.createDataFrame(
        [(1, 0.9, 1.0), (0, 0.9, 1.0), (1, 0.4, 0.0), (0, 0.1, 0.0)],
        "is_churned bigint, probability double, prediction double",
    )
    (row,) = rows(metrics.churn_metrics(scored, "m"))
    assert row == {"model": "m", "auc_roc": 0.625, "f1": 0.5}


def test_report_without_positive_predictions(spark):
    scored = spark.createDataFrame([(1, 0.0), (0, 0.0), (0, 0.0)], "is_churned bigint, prediction double")
    report = {r["class"]: r for r in rows(metrics.classification_report(scored))}
    assert report["1"]["precision"] == 0.0 and report["1"]["f1"] == 0.0 and report["1"]["support"] == 1
    assert report["0"]["recall"] == 1.0 and report["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert report["weighted avg"]["support"] == 3


def test_best_model_tie_goes_to_the_forest(spark):
    tied = spark.createDataFrame([("LogisticRegression", 0.9), ("RandomForest", 0.9)], "model string, auc_roc double")
    assert churn.select_best_model(tied) == "RandomForest"
    better = spark.createDataFrame([("LogisticRegression", 0.91), ("RandomForest", 0.9)], "model string, auc_roc double")
    assert churn.select_best_model(better) == "LogisticRegression"


def test_churn_models_learn_and_score_everyone(matrix, trained):
    assert {r["model"]: r["auc_roc"] > 0.5 for r in rows(trained.metrics)} == {
        "RandomForest": True,
        "LogisticRegression": True,
    }
    if trained.best_model == "RandomForest":
        found = {r["feature"]: r["importance"] for r in rows(trained.feature_importances)}
        assert sum(found.values()) == pytest.approx(1.0) and "tenure_days" in found
    else:
        assert trained.feature_importances is None
    scores = churn.predict_churn(matrix, trained.models["RandomForest"])
    assert scores.columns == churn.SCORE_COLUMNS and scores.count() == matrix.count()


def test_saved_model_scores_alike_and_takes_new_levels(matrix, trained, tmp_path):
    for name, model in trained.models.items():
        save_model(model, str(tmp_path / name))
        loaded = load_model(str(tmp_path / name))
        before = churn.predict_churn(matrix, model)
        after = churn.predict_churn(matrix, loaded)
        assert before.exceptAll(after).count() == 0
        moved = churn.predict_churn(matrix.withColumn("country", F.lit("Atlantis")), loaded)
        assert moved.where("churn_probability is null").count() == 0


def test_same_seed_same_metrics(matrix, trained):
    again = churn.train_churn_model(matrix, num_trees=20, max_depth=5)
    assert rows(again.metrics) == rows(trained.metrics)


def test_segmentation(matrix):
    result = segments.train_segmentation(matrix, restarts=2)
    profiles = rows(result.profiles)
    assert sum(p["size"] for p in profiles) == matrix.count() and len(profiles) == 4
    assert -1.0 <= rows(result.silhouette)[0]["silhouette_score"] <= 1.0


def test_segment_names_use_rounded_values(spark):
    profiles = spark.createDataFrame(
        [(0, 10.0, 0.1), (1, 20.0, 0.2), (2, 30.0, 0.2), (3, 40.0, 0.19)],
        "segment int, avg_spend double, churn_rate double",
    )
    assert [r["segment_name"] for r in rows(segments.name_segments(profiles))] == [
        "Growth Potential",
        "Low-Value Churning",
        "High-Value At Risk",
        "High-Value Loyal",
    ]
    people = spark.createDataFrame(
        [(i, 0, 1.0, 1, 1.0, 1 if i < 196 else 0, 1) for i in range(1000)],
        "customer_id bigint, segment int, total_spend double, total_events bigint, current_mrr double, "
        "is_churned bigint, tenure_days bigint",
    )
    (named,) = rows(segments.name_segments(segments.segment_profiles(people)))
    assert named["churn_rate"] == 0.2 and named["segment_name"] == "Low-Value Churning"


def test_lifetime_model(matrix):
    result = lifetime.train_ltv_model(matrix, rounds=5)
    (found,) = rows(result.metrics)
    assert found["mae"] > 0 and found["r2"] < 1
    assert [r["feature"] for r in rows(result.feature_importances)] == lifetime.LTV_FEATURES


def test_pipeline_writes_everything(spark, tmp_path):
    result = run_pipeline(
        tables_from_star(spark, SF_DIR), str(tmp_path), AS_OF, num_trees=5, ltv_rounds=2, restarts=1
    )
    written = {p.name for p in tmp_path.iterdir()}
    assert written == {"features", "models", "scores", "recommendations", "summary", "work"}
    assert result.recommendations.count() == result.scores.count() == 150
    stages = {r["stage"] for r in rows(result.summary)}
    assert stages == {"churn", "segmentation", "ltv", "report"}
