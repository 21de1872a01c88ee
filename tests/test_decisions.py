from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import decisions, views

SCHEMA = (
    "customer_id bigint, p double, is_churned bigint, total_spend double, current_mrr double, "
    "tenure_days bigint, events_last_30d bigint, days_since_last_event bigint"
)


def scored(spark, *people):
    filled = [(i, p, 0, spend, mrr, tenure, 0, 0) for i, (p, spend, mrr, tenure) in enumerate(people, start=1)]
    return (
        spark.createDataFrame(filled, SCHEMA).withColumns(decisions.score_columns(F.col("p"))).drop("p")
    )


def test_tier_bounds(spark):
    df = scored(spark, *[(p, 0.0, 0.0, 0) for p in (0.0, 0.3, 0.30004, 0.6, 0.60001, 1.0)])
    found = [(r["churn_probability"], r["risk_tier"]) for r in rows(df.orderBy("customer_id"))]
    assert found == [(0.0, None), (0.3, "Low"), (0.3, "Medium"), (0.6, "Medium"), (0.6, "High"), (1.0, "High")]


def test_recommendation_prices(spark, make_tables):
    df = scored(spark, (0.8, 500.0, 49.0, 90), (0.5, 300.0, 0.0, 60), (0.5, 300.0, 0.0, 10), (0.0, 300.0, 20.0, 10))
    recs = decisions.recommendations(df, make_tables([{}, {}, {}]).customers)
    assert len(recs.columns) == 19
    found = {r["customer_id"]: r for r in rows(recs)}
    high = found[1]
    assert high["annual_risk_value"] == 470.4 and high["expected_save_value"] == 164.64
    assert high["expected_roi"] == 2.29 and high["recommended_action"] == "Personal outreach + 20% discount"
    assert found[2]["monthly_value"] == 150.0 and found[2]["intervention_cost"] == 15.0
    assert found[3]["monthly_value"] == 300.0
    untiered = found[4]
    assert untiered["recommended_action"] == "No intervention needed"
    assert untiered["intervention_cost"] == 0.0 and untiered["expected_roi"] == 0.0
    assert untiered["name"] is None  # left join keeps scores of unknown customers


def test_summary_adds_up(spark, make_tables):
    df = scored(spark, (0.8, 0.0, 10.0, 90), (0.7, 0.0, 20.0, 90), (0.5, 0.0, 30.0, 90), (0.1, 0.0, 40.0, 90), (0.0, 0.0, 50.0, 90))
    recs = decisions.recommendations(df, make_tables([{}]).customers)
    (report,) = rows(decisions.summary_report(recs))
    assert report["total_customers"] == 5
    assert (report["high_risk_count"], report["medium_risk_count"], report["low_risk_count"]) == (2, 1, 1)
    acting = [r for r in rows(recs) if r["risk_tier"] in ("High", "Medium")]
    for total, column in [
        ("total_revenue_at_risk", "annual_risk_value"),
        ("total_intervention_cost", "intervention_cost"),
        ("total_expected_savings", "expected_save_value"),
    ]:
        assert report[total] == round(sum(r[column] for r in acting), 2)
    assert report["high_risk_avg_value"] == 132.0
    tiers = {r["risk_tier"]: r["customers"] for r in rows(views.risk_tier_counts(df))}
    assert sum(tiers.values()) + 1 == report["total_customers"]


def test_summary_without_anyone_at_risk(spark, make_tables):
    recs = decisions.recommendations(scored(spark, (0.1, 0.0, 10.0, 90)), make_tables([{}]).customers)
    (report,) = rows(decisions.summary_report(recs))
    assert report["net_roi_pct"] == 0.0 and report["total_revenue_at_risk"] == 0.0
    assert report["high_risk_avg_value"] == 0.0 and report["medium_risk_avg_value"] == 0.0
    assert {r["risk_tier"]: r["customers"] for r in rows(views.risk_tier_counts(recs))} == {
        "High": 0,
        "Medium": 0,
        "Low": 1,
    }


def test_views(spark, make_tables):
    df = scored(spark, (1.0, 0.0, 10.0, 90), (0.5, 0.0, 20.0, 90), (0.0, 0.0, 30.0, 90))
    recs = decisions.recommendations(df, make_tables([{"name": "Ann"}, {"name": "Bo"}, {"name": "Cy"}]).customers)
    assert [r["customer_id"] for r in rows(views.risk_filter(df, ["High", "Low"], 0.2))] == [1]
    assert [(r["bin"], r["customers"]) for r in rows(views.risk_histogram(df))] == [(0, 1), (20, 1), (39, 1)]
    labels = [r["label"] for r in rows(views.customer_lookup(recs))]
    assert labels == ["1 — Ann (High risk)", "2 — Bo (Medium risk)", "3 — Cy (nan risk)"]
    assert [r["label"] for r in rows(views.customer_lookup(recs, "High"))] == labels[:1]
    assert rows(views.customer_profile(recs, 2))[0]["name"] == "Bo"
    assert views.recommendation_table(recs).columns == views.RECOMMENDATION_COLUMNS
    assert [r["customer_id"] for r in rows(views.top_roi(recs, 1))] == [2]
