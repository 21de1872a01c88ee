"""Features at many dates, stored distinct counts, sketches and versioned tables."""

import datetime
import random
import re

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from tidemark.functions.sketches import daily_sketches, merged_quantiles, rank_error
from tidemark.operators import audience, features, history
from tidemark.sources import star, versioned

SF_DIR = "/root/testdata/sf0.001"


# --- features at many dates -------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_at_the_observation_dates_it_is_the_feature_base(spark):
    t = star.tables_from_star(spark, SF_DIR)
    observed = features.observation_points(t.customers, star.AS_OF)
    got = history.feature_history(t, observed).drop("obs_date")
    want = features.feature_base(t, star.AS_OF)
    order = sorted(want.columns)
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))


def test_facts_never_meet_dates_in_a_join(spark, make_tables):
    people = [{"customer_id": 1, "signup_date": "2024-01-05"}]
    t = make_tables(people, [{"customer_id": 1}], [{"customer_id": 1}], [{"customer_id": 1}])
    plan = plan_of(history.feature_history(t, as_of="2024-06-30"))
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert len(re.findall(r"hashpartitioning\(customer_id#\d+L?, \d+\)", plan)) == 1


def test_history_of_one_customer_by_hand(spark, make_tables):
    t = make_tables(
        [{"customer_id": 1, "signup_date": "2024-01-10"}, {"customer_id": 2, "signup_date": "2024-03-31"}],
        [
            {"customer_id": 1, "plan": "starter", "mrr": "19.00", "start_date": "2024-01-10"},
            {"customer_id": 1, "plan": "pro", "mrr": "49.00", "start_date": "2024-02-29"},
            {"customer_id": 1, "plan": "free", "mrr": "0.00", "start_date": "2024-02-29", "subscription_id": 1},
        ],
        [
            {"customer_id": 1, "amount": "10.00", "transaction_date": "2024-01-31"},
            {"customer_id": 1, "amount": "5.00", "transaction_date": "2024-02-01"},
            {"customer_id": 9, "amount": "99.00"},
            {"customer_id": None, "amount": "98.00"},
        ],
        [
            {"customer_id": 1, "event_date": "2024-01-30"},
            {"customer_id": 1, "event_date": "2024-02-29", "event_type": "support_ticket"},
            {"customer_id": None, "event_date": "2024-02-29"},
        ],
    )
    got = {(r["customer_id"], str(r["obs_date"])): r for r in rows(history.feature_history(t, as_of="2024-04-15"))}
    assert sorted(got) == [(1, "2024-01-31"), (1, "2024-02-29"), (1, "2024-03-31"), (2, "2024-03-31")]
    names = [
        "total_spend", "num_transactions", "plan_encoded", "current_mrr", "total_events", "support_ticket_count",
        "events_last_30d", "events_last_7d", "days_since_last_event", "tenure_days",
    ]
    pick = lambda key: [got[key][n] for n in names]
    assert pick((1, "2024-01-31")) == [10.0, 1, 1, 19.0, 1, 0, 1, 1, 1, 21]
    assert pick((1, "2024-02-29")) == [15.0, 2, 2, 49.0, 2, 1, 2, 1, 0, 50]
    assert pick((1, "2024-03-31")) == [15.0, 2, 2, 49.0, 2, 1, 0, 0, 31, 81]
    assert pick((2, "2024-03-31")) == [0.0, 0, 0, 0.0, 0, 0, 0, 0, features.NO_EVENT_DAYS, 0]


def test_dates_without_a_customer_repeats_and_no_dates(spark, make_tables):
    t = make_tables([{"customer_id": 1, "signup_date": "2024-01-10"}], (), [{"customer_id": 1, "transaction_date": "2024-02-02"}])
    asked = [(1, day("2024-02-02")), (1, day("2024-02-02")), (1, day("2023-12-01")), (7, day("2024-02-02")), (None, None), (1, None)]
    dates = spark.createDataFrame(asked, "customer_id long, obs_date date")
    got = [(r["customer_id"], str(r["obs_date"]), r["num_transactions"]) for r in rows(history.feature_history(t, dates))]
    assert sorted(got) == [(1, "2023-12-01", 0), (1, "2024-02-02", 1), (1, "2024-02-02", 1)]
    assert history.feature_history(t, dates.limit(0)).count() == 0
    assert history.feature_history(make_tables(), as_of="2024-04-15").count() == 0


# --- distinct counts --------------------------------------------------------------------

@pytest.fixture(scope="module")
def visits():
    draw = random.Random(7)
    start = datetime.date(2024, 1, 1)
    days = [*range(0, 40), *range(95, 120)]  # a gap longer than the widest window
    ids = [*range(1, 60), *range(32_760, 32_775), 5_000_000_000, -3, 0]
    return [(draw.choice(ids), start + datetime.timedelta(draw.choice(days))) for _ in range(1500)]


def visit_frame(spark, visits):
    return spark.createDataFrame([*visits, (None, visits[0][1]), (1, None)], "customer_id long, event_date date")


def test_rolling_users_are_distinct_counts(spark, visits):
    bitmaps = audience.daily_bitmaps(visit_frame(spark, visits))
    first, last = min(d for _, d in visits), max(d for _, d in visits)
    want = []
    for n in range((last - first).days + 1):
        today = first + datetime.timedelta(n)
        counts = [len({i for i, d in visits if 0 <= (today - d).days < width}) for width in (7, 30)]
        if counts[1]:
            want.append((today, *counts))
    assert sorted(map(tuple, audience.rolling_users(bitmaps).select("date", "users_7d", "users_30d").collect())) == want
    assert audience.rolling_users(bitmaps.limit(0)).count() == 0


def test_late_events_merge_into_stored_bitmaps(spark, visits):
    whole = audience.daily_bitmaps(visit_frame(spark, visits))
    early, late = (audience.daily_bitmaps(visit_frame(spark, part)) for part in (visits[:900], visits[700:]))
    both = audience.merged(early, late)
    as_rows = lambda df: sorted((r.date, r.bucket, bytes(r.users)) for r in df.collect())
    assert as_rows(both) == as_rows(whole)
    assert {(r.date, r.users) for r in audience.daily_users(both).collect()} == {
        (d, len({i for i, e in visits if e == d})) for _, d in visits
    }
    assert {r.month: r.users for r in audience.monthly_users(both).collect()} == {
        f"{d:%Y-%m}": len({i for i, e in visits if (e.year, e.month) == (d.year, d.month)}) for _, d in visits
    }
    inside = {i for i, d in visits if datetime.date(2024, 1, 5) <= d <= datetime.date(2024, 2, 3)}
    assert audience.users_between(both, "2024-01-05", "2024-02-03").first().users == len(inside)
    assert audience.users_between(both, "1999-01-01", "1999-02-03").first().users == 0


# --- sketches ---------------------------------------------------------------------------

def test_merged_sketches_keep_their_bound(spark):
    n, k = 200_000, 200
    values = spark.range(n).select(
        (F.col("id") % 50).alias("day"), F.lit("a").alias("kind"), (F.xxhash64("id") % 1_000_000).alias("v")
    )
    daily = daily_sketches(values, ["day", "kind"], "v", k)
    assert daily.count() == 50
    ranked = sorted(r.v for r in values.collect())
    got = merged_quantiles(daily, {"kind": F.col("kind")}, [0.01, 0.25, 0.5, 0.75, 0.99], k).collect()
    assert {r.rows for r in got} == {n}
    import bisect

    for r in got:
        at = bisect.bisect_left(ranked, r.quantile) / n, bisect.bisect_right(ranked, r.quantile) / n
        assert at[0] - rank_error(k) <= r.p <= at[1] + rank_error(k)
    assert rank_error(4096) < 0.0013 < rank_error(2048)


def test_small_sketches_are_exact_and_skip_nulls(spark):
    values = spark.createDataFrame([(i % 3, float(i)) for i in range(99)] + [(0, None), (5, None)], "day int, v double")
    daily = daily_sketches(values, ["day"], "v")
    got = {r.p: (r.quantile, r.rows) for r in merged_quantiles(daily, {"all": F.lit(1)}, [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: (0.0, 99), 0.5: (49.0, 99), 1.0: (98.0, 99)}
    assert merged_quantiles(daily.limit(0), {"day": F.col("day")}, [0.5]).count() == 0


# --- versioned tables -------------------------------------------------------------------

def table(spark, pairs):
    return spark.createDataFrame(pairs, "id long, v string")


def batch(spark, triples):
    return spark.createDataFrame(triples, "id long, v string, seq int")


def contents(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_are_whole_and_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(i, f"a{i}") for i in range(300)] + [(None, "x"), (None, "y")]
    assert versioned.create(table(spark, first), path, "id", buckets=16) == 1
    assert contents(versioned.read_version(spark, path)) == sorted(first, key=repr)
    assert versioned.upsert(spark, path, batch(spark, [(5, "old", 1), (5, "new", 2), (1000, "z", 1), (None, "w", 1)]), "seq") == 2
    second = [(i, v) for i, v in first if i != 5] + [(5, "new"), (1000, "z"), (None, "w")]
    assert contents(versioned.read_version(spark, path)) == sorted(second, key=repr)
    assert contents(versioned.read_version(spark, path, 1)) == sorted(first, key=repr)

    before, after = (versioned.manifest(spark, path, n)["files"] for n in (1, 2))
    changed = [b for b in before if before[b] != after.get(b)]
    assert 1 <= len(changed) <= 3  # the buckets of three keys
    assert versioned.upsert(spark, path, batch(spark, []), "seq") == 2
    with pytest.raises(ValueError, match="no version 9"):
        versioned.read_version(spark, path, 9)
    with pytest.raises(versioned.VersionConflict):
        versioned.create(table(spark, first), path, "id")


@pytest.mark.parametrize("step", ["_write_buckets", "_write_text", "_publish"])
def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    versioned.create(table(spark, [(1, "a"), (2, "b")]), path, "id", buckets=4)
    whole = getattr(versioned, step)

    def dies(*args):
        if step != "_publish":
            whole(*args)  # its work is done, then the writer is gone
        raise RuntimeError("killed")

    monkeypatch.setattr(versioned, step, dies)
    with pytest.raises(RuntimeError, match="killed"):
        versioned.upsert(spark, path, batch(spark, [(2, "c", 1)]), "seq")
    assert contents(versioned.read_version(spark, path)) == [(1, "a"), (2, "b")]
    assert len(versioned.unreferenced(spark, path)) == 1  # its files are named by no version
    monkeypatch.undo()
    assert versioned.upsert(spark, path, batch(spark, [(2, "c", 1)]), "seq") == 2
    assert contents(versioned.read_version(spark, path)) == [(1, "a"), (2, "c")]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versioned.create(table(spark, [(1, "a")]), path, "id", buckets=4)
    whole = versioned._write_buckets

    def overtaken(*args):
        monkeypatch.setattr(versioned, "_write_buckets", whole)
        versioned.upsert(spark, path, batch(spark, [(1, "faster", 1)]), "seq")
        return whole(*args)

    monkeypatch.setattr(versioned, "_write_buckets", overtaken)
    with pytest.raises(versioned.VersionConflict):
        versioned.upsert(spark, path, batch(spark, [(1, "slower", 1)]), "seq")
    assert contents(versioned.read_version(spark, path)) == [(1, "faster")]


def test_an_empty_table_can_grow(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.create(table(spark, []), path, "id")
    assert versioned.read_version(spark, path).count() == 0
    versioned.upsert(spark, path, batch(spark, [(1, "a", None)]), "seq")
    assert contents(versioned.read_version(spark, path)) == [(1, "a")]
    clash = table(spark, [(1, "a")]).withColumn("_bucket", F.lit(1))
    with pytest.raises(ValueError, match="_bucket"):
        versioned.create(clash, str(tmp_path / "u"), "id")


def test_the_seed_of_the_observation_dates_reaches_the_features(spark, monkeypatch, tmp_path):
    from tidemark.plans import pipeline

    seen = []
    monkeypatch.setattr(pipeline.features, "feature_base", lambda t, as_of, seed: seen.append(seed) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.run_pipeline(star.tables_from_star(spark, SF_DIR), str(tmp_path), observation_seed=7)
    assert seen == [7]


# --- silhouette, bins, stages -----------------------------------------------------------

def test_euclidean_silhouette_of_points(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tidemark.models import spread

    draw = random.Random(9)
    points = [(i, [draw.gauss(0, 1) + 3 * (i % 3), draw.gauss(0, 1)], i % 3) for i in range(1, 150)] + [(150, [9.0, 9.0], 7)]
    frame = spark.createDataFrame([(i, Vectors.dense(x), s) for i, x, s in points], ["customer_id", "scaled", "segment"])

    def plain(i, x, s):
        away = lambda o: sum((a - b) ** 2 for a, b in zip(x, o)) ** 0.5
        mean = {k: [away(o) for j, o, t in points if t == k and j != i] for k in {t for _, _, t in points}}
        if not mean[s]:
            return 0.0
        a = sum(mean[s]) / len(mean[s])
        b = min(sum(v) / len(v) for k, v in mean.items() if k != s)
        return (b - a) / max(a, b)

    monkeypatch.setattr(spread, "BLOCK", 7)  # several blocks of asked rows
    got = {r.customer_id: r.silhouette for r in spread.silhouette_samples(frame, F.col("customer_id") % 5 == 0).collect()}
    want = {i: plain(i, x, s) for i, x, s in points if i % 5 == 0}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert got[150] == 0.0
    assert spread.silhouette_samples(frame, F.lit(False)).count() == 0
    one = frame.withColumn("segment", F.lit(1))
    assert {r.silhouette for r in spread.silhouette_samples(one, F.col("customer_id") % 50 == 0).collect()} == {0.0}


def test_nice_bins_by_hand_and_in_two_scans(spark, tmp_path):
    from tidemark.operators import bins

    values = [(0.0, 3, None), (12.0, 3, None), (99.0, 3, None), (47.5, None, None)]
    spark.createDataFrame(values, "a double, b int, c double").write.parquet(str(tmp_path / "p"))
    frame = spark.read.parquet(str(tmp_path / "p"))
    found = bins.nice_histograms(frame, ["a", "b", "c"], 10)
    got = sorted((r["metric"], r["bin_start"], r["bin_end"], r["rows"]) for r in found.collect())
    counts = [1, 1, 0, 0, 1, 0, 0, 0, 0, 1]
    assert got == [("a", 10.0 * i, 10.0 * i + 10, n) for i, n in enumerate(counts)] + [("b", 3.0, 4.0, 3)]
    # The widths come from one scan, which their two uses share, and the counts from another.
    assert plan_of(found).split("Initial Plan")[0].count("FileScan parquet") == 2
    assert bins.nice_histograms(frame.limit(0), ["a"]).count() == 0
    wide = spark.createDataFrame([(v,) for v in (0.001, 0.0199, 123456.0)], "a double")
    rows_of = bins.nice_histograms(wide, ["a"], 20).collect()
    assert {round(r.bin_end - r.bin_start, 6) for r in rows_of} == {10000.0} and sum(r.rows for r in rows_of) == 3


def test_committed_stages_are_not_repeated(spark, tmp_path):
    from tidemark.plans.stages import Stages, table_fingerprint

    folder = str(tmp_path / "job")
    spark.range(10).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))

    def job(upto=9, seed=1):
        stages, built = Stages(spark, folder), []

        def step(name, df):
            built.append(name)
            if len(built) > upto:
                raise RuntimeError("killed")
            return df

        one, mark = stages.run("one", lambda: step("one", source.withColumn("x", F.col("id") + seed)), {"seed": seed}, {"in": table_fingerprint(source)})
        two, _ = stages.run("two", lambda: step("two", one.agg(F.sum("x").alias("x"))), {}, {"one": mark})
        return two.first().x, stages.ran

    with pytest.raises(RuntimeError, match="killed"):
        job(upto=1)
    assert job() == (55, ["two"])  # the first stage was committed
    assert job() == (55, [])
    assert job(seed=2) == (65, ["one", "two"])  # other arguments, and all that depends on them
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    assert job() == (78, ["one", "two"])  # other inputs
