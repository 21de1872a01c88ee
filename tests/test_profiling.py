import numpy as np
import pytest
from conftest import rows

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import profiling, quality, views


@pytest.mark.parametrize("size", [1, 2, 10, 20000])
@pytest.mark.parametrize("kind", ["spread", "skewed", "constant"])
def test_exact_quantiles(spark, size, kind):
    rng = np.random.default_rng(size)
    values = {
        "spread": rng.normal(size=size).round(3),
        "skewed": np.where(rng.random(size) < 0.4, 7.0, rng.pareto(1.0, size).round(2)),
        "constant": np.full(size, 3.0),
    }[kind]
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", None), ("b", 5.0)], "g string, v double")
    found = exact_quantiles(df, ["g"], "v", probs, accuracy=200).collect()
    by_key = {(r.g, r.p): r.quantile for r in found}
    for p in probs:
        assert by_key["a", p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
        assert by_key["b", p] == 5.0


def test_histogram_bins(make_tables):
    t = make_tables([{"age": a} for a in (20, 20, 29, 30, 50)])
    found = [(r["bin"], r["bin_start"], r["rows"]) for r in rows(profiling.histogram(t.customers, "age", 3))]
    assert found == [(0, 20.0, 3), (1, 30.0, 1), (2, 40.0, 1)]
    single = make_tables([{"age": 20}, {"age": 20}])
    assert [(r["bin"], r["rows"]) for r in rows(profiling.histogram(single.customers, "age", 3))] == [(0, 2)]


def test_unused_plan_stays_as_null_row(make_tables):
    t = make_tables(subscriptions=[{"customer_id": 1, "plan": "pro"}, {"customer_id": 1, "plan": "other"}])
    found = rows(profiling.plan_distribution(t))
    assert [r["plan"] for r in found] == ["free", "starter", "pro", "enterprise"]
    assert [r["subscriptions"] for r in found] == [None, None, 1, None]


def test_null_counts_lists_only_columns_with_nulls(make_tables):
    t = make_tables([{}], [{"customer_id": 1}], [{"customer_id": 1}], [{"customer_id": 1}])
    found = {(r["table_name"], r["column_name"]) for r in rows(profiling.null_counts(t))}
    assert found == {("customers", "churn_date"), ("subscriptions", "end_date"), ("events", "event_detail")}
    assert rows(profiling.total_nulls(t.transactions)) == [{"missing": 0}]
    counts = {r["table_name"]: r["row_count"] for r in rows(profiling.table_counts(t))}
    assert counts == dict.fromkeys(["customers", "subscriptions", "transactions", "events"], 1)


def test_customer_360_fills_zero(make_tables):
    t = make_tables([{}, {"is_churned": 1}], transactions=[{"customer_id": 1, "amount": 9}])
    found = {r["customer_id"]: r for r in rows(profiling.customer_360(t, "2024-01-11"))}
    assert found[1]["total_spend"] == 9.0 and found[1]["total_events"] == 0 and found[1]["tenure_days"] == 10
    assert found[2]["total_spend"] == 0.0 and found[2]["status"] == "Churned"


def test_box_whiskers_exclude_outliers(make_tables):
    events = [{"customer_id": c} for c in range(1, 6) for _ in range(c if c < 5 else 50)]
    t = make_tables([{} for _ in range(5)], events=events)
    (box,) = [
        r
        for r in rows(profiling.event_box_stats(profiling.customer_event_profile(t)))
        if r["event_type"] == "logins"
    ]
    assert (box["q1"], box["median"], box["q3"]) == (2.0, 3.0, 4.0)
    assert (box["lower_fence"], box["upper_fence"], box["outliers"]) == (1.0, 4.0, 1)


def test_correlation_matrix_is_symmetric(make_tables):
    t = make_tables([{"age": 20 + i, "is_churned": i % 2, "signup_date": f"2024-01-{10 + i}"} for i in range(6)])
    matrix = profiling.correlation_matrix(profiling.customer_360(t, "2024-06-01"))
    cells = {(r["a"], r["b"]): r["r"] for r in rows(matrix)}
    assert len(cells) == 64
    assert cells["age", "tenure_days"] == pytest.approx(-1.0)
    assert cells["age", "is_churned"] == cells["is_churned", "age"]
    assert cells["total_spend", "age"] is None  # constant column
    features = [r["feature"] for r in rows(profiling.churn_correlation(matrix))]
    assert "is_churned" not in features and len(features) == 7


def test_integrity_checks_find_each_kind(make_tables):
    t = make_tables(
        customers=[{"customer_id": 1, "email": "a@x"}, {"customer_id": 2, "email": "a@x"}, {"customer_id": 2, "name": None}],
        transactions=[
            {"customer_id": 9},
            {"customer_id": 9},
            {"customer_id": 2, "payment_method": None},
            {"customer_id": None},
        ],
    )
    found = {
        (r["table_name"], r["column_name"], r["rule"]): r["violations"] for r in rows(quality.integrity_checks(t))
    }
    assert found["customers", "customer_id", "primary_key"] == 1
    assert found["customers", "email", "unique"] == 1
    assert found["customers", "name", "not_null"] == 1
    assert found["transactions", "customer_id", "foreign_key"] == 2
    assert found["transactions", "payment_method", "not_null"] == 1
    assert found["transactions", "customer_id", "not_null"] == 1
    assert sum(found.values()) == 7
    assert ("customers", "churn_date", "not_null") not in found


def test_upsert_last_row_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1), (3, "z", 0)], "id bigint, v string, seq int")
    found = quality.upsert_by_key(base, batch, "id", "seq").orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, "a"), (2, "y"), (3, None)]


def test_upsert_loses_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id bigint, v string")
    batch = spark.createDataFrame(
        [(2, "x", None), (3, "y", None), (None, "p", 1), (None, "q", 2), (4, "s", 5), (4, "t", 5), (4, "z", None)],
        "id bigint, v string, seq int",
    )
    found = quality.upsert_by_key(base, batch, "id", "seq").collect()
    want = [(1, "a"), (2, "x"), (3, "y"), (4, "t"), (None, "n"), (None, "p"), (None, "q")]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_kpis_use_latest_month_and_plain_mean(spark):
    monthly = spark.createDataFrame(
        [("2024-02", 20.5, 5.0), ("2024-03", 10.25, -50.0)], "month string, revenue double, mom_growth_pct double"
    )
    segments = spark.createDataFrame([(10, 20.0), (90, 40.0)], "total_customers bigint, churn_rate_pct double")
    (kpi,) = rows(views.executive_kpis(monthly, segments))
    assert kpi == {
        "total_revenue": 30.75,
        "latest_month_revenue": 10.25,
        "latest_growth_pct": -50.0,
        "total_customers": 100,
        "avg_churn_rate_pct": 30.0,
    }
