from conftest import rows

from tidemark.operators import analytics


def by(df, key):
    return {r[key]: r for r in rows(df)}


def test_growth_skips_missing_months_and_zero_revenue(make_tables):
    t = make_tables(
        transactions=[
            {"customer_id": 1, "transaction_date": "2024-01-05", "amount": 100},
            {"customer_id": 1, "transaction_date": "2024-04-05", "amount": 150},
            {"customer_id": 1, "transaction_date": "2024-05-05", "amount": 5},
            {"customer_id": 2, "transaction_date": "2024-05-06", "amount": -5},
            {"customer_id": 1, "transaction_date": "2024-06-05", "amount": 7},
        ]
    )
    found = by(analytics.monthly_revenue(t), "month")
    assert found["2024-01"]["mom_growth_pct"] is None
    assert found["2024-04"]["mom_growth_pct"] == 50.0
    assert found["2024-05"]["mom_growth_pct"] == -100.0
    assert found["2024-05"]["paying_customers"] == 2
    assert found["2024-06"]["mom_growth_pct"] is None


def test_customers_without_transactions(make_tables):
    t = make_tables(
        customers=[{}, {}, {"acquisition_channel": "paid", "is_churned": 1}],
        transactions=[{"customer_id": 1, "amount": 10}, {"customer_id": 1, "amount": 15.01}],
    )
    top = rows(analytics.top_customers(t))
    assert [r["customer_id"] for r in top] == [1, 2, 3]
    assert top[0]["total_spend"] == 25.01 and top[0]["avg_order_value"] == 12.51
    assert top[1]["total_spend"] is None and top[1]["num_transactions"] == 0 and top[1]["avg_order_value"] is None
    assert top[2]["status"] == "Churned"
    assert len(rows(analytics.top_customers(t, 2))) == 2
    assert [r["customer_id"] for r in rows(analytics.customer_lifetime_value(t))] == [1]
    segments = by(analytics.customer_segments(t), "segment")
    assert segments["organic"]["avg_spend"] == 25.01 and segments["organic"]["total_customers"] == 2
    assert segments["paid"]["avg_spend"] is None and segments["paid"]["churn_rate_pct"] == 100.0


def test_lifetime_value_is_total_spend(make_tables):
    t = make_tables(
        customers=[{}],
        transactions=[
            {"customer_id": 1, "transaction_date": "2024-01-01", "amount": 10},
            {"customer_id": 1, "transaction_date": "2024-01-09", "amount": 10},
            {"customer_id": 1, "transaction_date": "2024-03-01", "amount": 0.01},
            {"customer_id": 1, "transaction_date": "2024-05-01", "amount": 0.01},
        ],
    )
    (row,) = rows(analytics.customer_lifetime_value(t))
    assert (row["active_months"], row["avg_monthly_revenue"], row["estimated_ltv"]) == (3, 6.67, 20.02)


def test_cohort_periods(make_tables):
    t = make_tables(
        customers=[
            {"signup_date": "2024-01-31"},
            {"signup_date": "2024-01-02"},
            {"signup_date": "2024-01-15"},
            {"signup_date": "2024-03-01"},
        ],
        events=[
            {"customer_id": 1, "event_date": "2024-02-01"},
            {"customer_id": 1, "event_date": "2024-02-28"},
            {"customer_id": 2, "event_date": "2023-12-31"},
            {"customer_id": 2, "event_date": "2025-01-31"},
            {"customer_id": 2, "event_date": "2025-02-01"},
        ],
    )
    found = [(r["cohort"], r["period"], r["retained_customers"], r["cohort_size"], r["retention_rate"]) for r in rows(analytics.cohort_retention(t))]
    assert found == [("2024-01", 1, 1, 3, 33.33), ("2024-01", 12, 1, 3, 33.33)]


def test_funnel_counts_each_stage_on_its_own(make_tables):
    t = make_tables(
        customers=[{}, {}, {}],
        events=[{"customer_id": 1, "event_type": "feature_use"}, {"customer_id": 1, "event_type": "feature_use"}],
        transactions=[{"customer_id": 2}, {"customer_id": 3}],
    )
    found = [(r["stage"], r["users"], r["pct_of_signups"]) for r in rows(analytics.conversion_funnel(t))]
    assert found == [
        ("Signed Up", 3, 100.0),
        ("Logged In", 0, 0.0),
        ("Viewed Pages", 0, 0.0),
        ("Used Features", 1, 33.33),
        ("Made Purchase", 2, 66.67),
    ]


def test_funnel_without_signups(make_tables):
    found = rows(analytics.conversion_funnel(make_tables(transactions=[{"customer_id": 2}])))
    assert [r["pct_of_signups"] for r in found] == [None] * 5
    assert found[4]["users"] == 1


def test_daily_active_users_has_no_zero_days(make_tables):
    t = make_tables(
        events=[
            {"customer_id": 1, "event_date": "2024-01-01"},
            {"customer_id": 1, "event_date": "2024-01-01"},
            {"customer_id": 2, "event_date": "2024-01-03"},
        ]
    )
    assert [(str(r["date"]), r["dau"]) for r in rows(analytics.daily_active_users(t))] == [
        ("2024-01-01", 1),
        ("2024-01-03", 1),
    ]


def test_engagement_skips_silent_customers(make_tables):
    t = make_tables(
        customers=[{}, {}, {"is_churned": 1}],
        events=[{"customer_id": 1}, {"customer_id": 1, "event_type": "support_ticket"}],
    )
    found = by(analytics.engagement_by_churn_status(t), "status")
    assert found["Active"]["avg_events"] == 2.0 and found["Active"]["avg_support_tickets"] == 1.0
    assert found["Churned"]["avg_events"] is None


def test_churn_by_segment_counts_matches_and_keeps_null_plan(make_tables):
    people = [{"is_churned": 1}] + [{} for _ in range(4)] + [{"country": "UK"} for _ in range(5)]
    subs = [
        {"customer_id": 1, "plan": "pro", "status": "active"},
        {"customer_id": 1, "plan": "pro", "status": "cancelled"},
    ]
    subs += [{"customer_id": c, "plan": "pro"} for c in range(2, 6)]
    subs += [{"customer_id": c, "plan": "pro", "status": "upgraded"} for c in range(6, 11)]
    found = by(analytics.churn_by_segment(make_tables(people, subs)), "country")
    assert (found["US"]["plan"], found["US"]["total"], found["US"]["churned"], found["US"]["churn_rate"]) == ("pro", 5, 2, 40.0)
    assert (found["UK"]["plan"], found["UK"]["total"], found["UK"]["churned"]) == (None, 5, 0)
    assert rows(analytics.churn_by_segment(make_tables(people, subs), 6)) == []


def test_revenue_by_plan_counts_active_only(make_tables):
    t = make_tables(
        subscriptions=[
            {"customer_id": 1, "mrr": 49},
            {"customer_id": 1, "mrr": 49.01},
            {"customer_id": 2, "mrr": 10, "status": "upgraded"},
        ]
    )
    (row,) = rows(analytics.revenue_by_plan(t))
    assert (row["customers"], row["total_mrr"], row["avg_mrr"]) == (1, 98.01, 49.01)
