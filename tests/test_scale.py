"""What a task holds follows a fixed number of rows or bytes, not the size of the tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from tidemark.functions import durable as kept
from tidemark.models import churn, lifetime, parallel, segments
from tidemark.operators.features import NUMERIC_FEATURES
from tidemark.plans import pipeline

NUMBER, ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture(scope="module")
def matrix(spark):
    numbers = {name: (F.col("customer_id") * (i + 3) % 97).cast("double") for i, name in enumerate(NUMERIC_FEATURES)}
    return kept.durable(
        spark.range(1, 401)
        .select(F.col("id").alias("customer_id"))
        .withColumns(numbers)
        .withColumns(
            {
                "is_churned": (F.col("customer_id") % 3 == 0).cast("bigint"),
                "country": F.lit("US"),
                "acquisition_channel": F.lit("organic"),
            }
        )
    )


@pytest.mark.parametrize("rows, wanted", [(0, 8), (480_000, 8), (480_001, 9), (5_400_000, 90)])
def test_partitions_follow_the_rows(rows, wanted):
    assert kept.partitions_for(rows, 8) == wanted


def test_training_rows_of_a_task_are_bounded(matrix, monkeypatch):
    monkeypatch.setattr(kept, "PARTITION_ROWS", 20)
    dealt = []
    for module in (churn, lifetime, segments):
        monkeypatch.setattr(
            module, "dealt_by", lambda df, key, n, deal=module.dealt_by: dealt.append(n) or deal(df, key, n)
        )
    fitted = churn.train_churn_model(matrix, num_trees=2, max_depth=2, max_iter=5)
    lifetime.train_ltv_model(matrix, rounds=1, max_depth=2)
    segments.train_segmentation(matrix, restarts=1)
    assert dealt == [16, 16, 20]
    assert fitted.models["RandomForest"].stages[-1].getCacheNodeIds()


def test_a_k_means_fit_keeps_vectors_of_its_own(matrix, monkeypatch):
    seen = []

    def fit(self, df, *more, fit=segments.KMeans.fit):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((df.columns, df.storageLevel.useMemory, "InMemoryTableScan" in plan))
        return fit(self, df, *more)

    monkeypatch.setattr(segments.KMeans, "fit", fit)
    segments.train_segmentation(matrix, restarts=2)
    assert seen == [(["scaled"], False, True)] * 2


@pytest.mark.parametrize("rows, wanted", [(0, 4), (1_000_000, 4), (1_400_000, 2), (5_400_000, 1)])
def test_fits_side_by_side_hold_a_bounded_number_of_rows(rows, wanted):
    assert parallel.fits_at_once(rows) == wanted


def test_shuffles_follow_the_input_and_settings_come_back(spark, matrix, monkeypatch):
    size = kept.input_bytes(matrix)
    assert size > 0 and kept.input_bytes(spark.range(5)) == 0
    monkeypatch.setattr(kept, "PARTITION_BYTES", -(-size // 40))
    before = spark.conf.get(NUMBER), spark.conf.get(ADVISORY)
    with pytest.raises(ZeroDivisionError):
        with kept.shuffles_by_input(matrix):
            assert 38 <= int(spark.conf.get(NUMBER)) <= 40
            assert spark.conf.get(ADVISORY) == str(kept.ADVISORY_BYTES)
            raise ZeroDivisionError
    assert (spark.conf.get(NUMBER), spark.conf.get(ADVISORY)) == before
    with kept.shuffles_by_input(spark.range(5)):
        assert (spark.conf.get(NUMBER), spark.conf.get(ADVISORY)) == before


def test_the_feature_matrix_is_written_that_way(spark, monkeypatch):
    monkeypatch.setattr(kept, "PARTITION_BYTES", 100)
    seen = []

    def watched(df, *more):
        seen.append(int(spark.conf.get(NUMBER)))
        return df

    monkeypatch.setattr(entries, "durable", watched)
    monkeypatch.setattr(entries, "_opened", {})
    entries._training_features(spark, entries.SMOKE_DIR)

    def stop(df, *more):
        watched(df)
        raise InterruptedError

    monkeypatch.setattr(pipeline, "_written", stop)
    with pytest.raises(InterruptedError):
        pipeline.run_pipeline(entries._tables(spark, entries.SMOKE_DIR), "unused")
    assert len(seen) == 2 and min(seen) > 100
