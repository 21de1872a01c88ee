"""Drift of scored rows, scoring from disk, and facts in a folder per month."""

import datetime
import math

import pytest
from conftest import rows
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemark.models import drift, lifetime, segments
from tidemark.sources import months

SCHEMA = "customer_id long, total_spend double, country string"


def customers(spark, numbers, levels):
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(zip(numbers, levels))], SCHEMA)


def report(profile, df):
    return {r["feature"]: r for r in rows(drift.drift_report(profile, df, ["total_spend"], ["country"]))}


def test_index_against_plain_counts(spark):
    trained = customers(spark, [float(i % 10) for i in range(100)], ["US"] * 60 + ["DE"] * 40)
    scored = customers(spark, [float(i % 5) for i in range(50)], ["US"] * 10 + ["DE"] * 40)
    profile = drift.feature_profile(trained, ["total_spend"], ["country"])
    got = report(profile, scored)
    p, q = [60.5 / 101, 40.5 / 101], [10.5 / 51, 40.5 / 51]
    want = sum((b - a) * math.log(b / a) for a, b in zip(p, q))
    assert got["country"]["stability_index"] == pytest.approx(want, abs=1e-6) and got["country"]["verdict"] == "shifted"
    p, q = [10.5 / 105] * 10, [10.5 / 55] * 5 + [0.5 / 55] * 5
    want = sum((b - a) * math.log(b / a) for a, b in zip(p, q))
    assert got["total_spend"]["stability_index"] == pytest.approx(want, abs=1e-6)
    same = report(profile, trained)
    assert {r["verdict"] for r in same.values()} == {"stable"} and not any(r["unseen_rows"] for r in same.values())


def test_unseen_missing_and_empty(spark):
    trained = customers(spark, [1.0, 2.0, None, 9.0], ["US", "DE", None, "US"])
    profile = drift.feature_profile(trained, ["total_spend"], ["country"])
    got = report(profile, customers(spark, [-5.0, 400.0, None, 2.0], ["Atlantis", "Lemuria", None, "US"]))
    assert (got["total_spend"]["unseen_rows"], got["country"]["unseen_rows"]) == (2, 2)
    assert all(r["trained_rows"] == r["scored_rows"] == 4 for r in got.values())
    empty = report(profile, trained.limit(0))
    assert all(r["stability_index"] is None and r["verdict"] is None and r["scored_rows"] == 0 for r in empty.values())
    assert drift.feature_profile(trained.limit(0), ["total_spend"], ["country"]).count() == 0
    constant = customers(spark, [3.0] * 4, ["US"] * 4)
    assert report(drift.feature_profile(constant, ["total_spend"], ["country"]), constant)["total_spend"]["verdict"] == "stable"


def test_scoring_from_disk(spark, tmp_path):
    trained = customers(spark, [1.0, 2.0, 101.0, 102.0], ["US"] * 4).withColumn("age", F.col("total_spend") / 2)
    assembler = VectorAssembler(inputCols=["age"], outputCol="features")
    clusters = Pipeline(stages=[assembler, KMeans(k=2, seed=1, predictionCol="segment")]).fit(trained)
    drift.save_scorer(clusters, drift.feature_profile(trained, ["total_spend"], ["country"]), str(tmp_path))
    loaded, profile = drift.load_scorer(spark, str(tmp_path))
    assert report(profile, trained)["total_spend"]["verdict"] == "stable"
    # Whatever their numbers, the clusters get the names of the profiles.
    low = clusters.transform(trained).where("customer_id = 0").first().segment
    names = spark.createDataFrame([(low, "low"), (1 - low, "high")], "segment int, segment_name string")
    later = customers(spark, [0.5, 90.0, 0.0], ["US"] * 3).withColumn("age", F.col("total_spend") / 2)
    got = segments.assign_segments(later, loaded, names)
    assert {r["customer_id"]: r["segment_name"] for r in rows(got)} == {0: "low", 1: "high", 2: "low"}
    assert segments.assign_segments(later.limit(0), loaded, names).count() == 0
    value = Pipeline(stages=[assembler, LinearRegression(labelCol="total_spend")]).fit(trained)
    got = {r["customer_id"]: r for r in rows(lifetime.predict_ltv(later.withColumn("age", F.col("age") - 1), value))}
    assert [got[i]["predicted_ltv"] for i in range(3)] == pytest.approx([0.0, 88.0, 0.0], abs=0.01)
    assert got[1]["expected_growth"] == pytest.approx(-2.0, abs=0.01)


EVENT = "event_id long, customer_id long, event_date date, event_type string, event_detail string"


def test_months_read_are_those_asked_for(spark, tmp_path):
    start, path = datetime.date(2023, 1, 1), str(tmp_path / "events")
    data = [(i, i % 7, start + datetime.timedelta(i), "login", None) for i in range(700)] + [(700, 1, None, "login", None)]
    months.save_by_month(spark.createDataFrame(data, EVENT), "events", path, shards=3)
    assert sorted(rows(months.load_by_month(spark, "events", path).drop("month")), key=lambda r: r["event_id"]) == [
        dict(zip(("event_id", "customer_id", "event_date", "event_type", "event_detail"), r)) for r in data
    ]
    observed = {1: datetime.date(2023, 5, 10), 2: datetime.date(2024, 2, 1), 3: None, 99: datetime.date(2024, 2, 1)}
    asked = spark.createDataFrame(list(observed.items()), "customer_id long, obs_date date")
    got = months.load_until(spark, "events", path, asked, 30)
    want = {
        r[0] for r in data
        if r[2] and observed.get(r[1]) and 0 <= (observed[r[1]] - r[2]).days <= 30
    }
    assert {r["event_id"] for r in rows(got)} == want and got.count() == len(want)
    files = {name.split("month=")[1][:7] for name in got.inputFiles()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(m in plan for m in ("2023-04", "2023-05", "2024-01", "2024-02"))
    assert "2023-06" not in plan and files
    assert months.load_until(spark, "events", path, asked.limit(0), 30).count() == 0


def test_a_month_is_spread_over_files(spark, tmp_path):
    day, path = datetime.date(2023, 1, 1), str(tmp_path / "events")
    data = [(i, 1, day, "login", None) for i in range(1000)]
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # of so small shards
    spark.conf.set(merging, "false")
    try:
        months.save_by_month(spark.createDataFrame(data, EVENT), "events", path, shards=4)
    finally:
        spark.conf.unset(merging)
    per_file = months.load_by_month(spark, "events", path).groupBy(F.input_file_name()).count()
    assert 2 <= per_file.count() <= 4 and per_file.agg(F.max("count")).first()[0] < 1000
