from datetime import date, timedelta

import pytest
from conftest import rows

from tidemark.operators import features


def one(df):
    (row,) = rows(df)
    return row


@pytest.mark.parametrize("window, low, high", [(30, 10, 10), (31, 14, 15), (200, 14, 60), (2, 1, 1), (0, 1, 1)])
def test_offset_range(make_tables, window, low, high):
    churned_on = date(2024, 1, 1) + timedelta(days=window)
    people = [
        {"customer_id": i, "is_churned": 1, "signup_date": "2024-01-01", "churn_date": churned_on}
        for i in range(1, 120)
    ]
    found = features.observation_points(make_tables(people).customers, "2025-03-31").collect()
    offsets = {(churned_on - r.obs_date).days for r in found}
    assert min(offsets) == low and max(offsets) == high


def test_active_or_undated_customers_are_seen_at_the_as_of_date(make_tables):
    t = make_tables([{}, {"is_churned": 1, "churn_date": None}])
    found = {r.obs_date for r in features.observation_points(t.customers, "2025-03-31").collect()}
    assert found == {date(2025, 3, 31)}


AS_OF = "2024-06-30"


def test_event_windows_are_inclusive(make_tables):
    days = ["2024-05-30", "2024-05-31", "2024-06-22", "2024-06-23", "2024-06-30", "2024-07-01"]
    t = make_tables([{}], events=[{"customer_id": 1, "event_date": d} for d in days])
    row = one(features.feature_base(t, AS_OF))
    assert (row["total_events"], row["events_last_30d"], row["events_last_7d"]) == (5, 4, 2)
    assert row["days_since_last_event"] == 0


def test_customer_without_any_fact(make_tables):
    row = one(features.feature_base(make_tables([{"signup_date": "2024-06-27"}]), AS_OF))
    assert row["current_mrr"] == 0.0 and row["plan_encoded"] == 0
    assert row["days_since_last_event"] == 999 and row["total_spend"] == 0.0 and row["num_transactions"] == 0
    assert row["avg_events_per_week"] == 0.0 and row["support_ticket_ratio"] == 0.0


def test_short_tenure_counts_as_a_week(make_tables):
    t = make_tables(
        [{"signup_date": "2024-06-27"}],
        events=[
            {"customer_id": 1, "event_date": "2024-06-28", "event_type": k}
            for k in ("login", "login", "support_ticket")
        ],
    )
    row = one(features.feature_base(t, AS_OF))
    assert row["tenure_days"] == 3 and row["avg_events_per_week"] == 3.0 and row["support_ticket_ratio"] == 0.3333


def test_latest_subscription_and_tie(make_tables):
    t = make_tables(
        [{}],
        subscriptions=[
            {"customer_id": 1, "plan": "starter", "mrr": 19, "start_date": "2024-02-01"},
            {"customer_id": 1, "plan": "pro", "mrr": 49, "start_date": "2024-02-01"},
            {"customer_id": 1, "plan": "free", "mrr": 0, "start_date": "2024-01-01"},
            {"customer_id": 1, "plan": "enterprise", "mrr": 149, "start_date": "2024-07-01"},
        ],
    )
    observed = features.observation_points(t.customers, AS_OF)
    assert one(features.latest_subscription_asof(t.subscriptions, observed)) == {
        "customer_id": 1,
        "plan": "pro",
        "mrr": 49.0,
    }
    row = one(features.feature_base(t, AS_OF))
    assert row["plan_encoded"] == 2 and row["current_mrr"] == 49.0


def test_unknown_plan_is_coded_zero(make_tables):
    t = make_tables([{}], subscriptions=[{"customer_id": 1, "plan": "legacy", "mrr": 5}])
    assert one(features.feature_base(t, AS_OF))["plan_encoded"] == 0


def test_later_facts_change_nothing(make_tables):
    people = [{}, {"is_churned": 1, "churn_date": "2024-05-01"}]
    past = dict(
        subscriptions=[{"customer_id": 1}, {"customer_id": 2, "plan": "starter"}],
        transactions=[{"customer_id": 1, "amount": 5}, {"customer_id": 2, "amount": 7}],
        events=[{"customer_id": 1}, {"customer_id": 2}],
    )
    future = dict(
        subscriptions=[{"customer_id": c, "start_date": "2024-08-01", "plan": "enterprise"} for c in (1, 2)],
        transactions=[{"customer_id": c, "transaction_date": "2024-08-01"} for c in (1, 2)],
        events=[{"customer_id": c, "event_date": "2024-08-01"} for c in (1, 2)],
    )
    both = {name: past[name] + future[name] for name in past}
    before = rows(features.feature_base(make_tables(people, **past), AS_OF).orderBy("customer_id"))
    after = rows(features.feature_base(make_tables(people, **both), AS_OF).orderBy("customer_id"))
    assert before == after


def test_matrix_is_numeric_with_all_levels(make_tables):
    t = make_tables([{"country": "US"}, {"country": "New Zealand", "acquisition_channel": "paid"}])
    matrix = features.feature_matrix(t, AS_OF)
    assert all(kind in ("bigint", "double") for _, kind in matrix.dtypes)
    assert matrix.columns[-4:] == ["channel_organic", "channel_paid", "country_New Zealand", "country_US"]
    found = {r.customer_id: (r.channel_paid, r["country_New Zealand"], r.country_US) for r in matrix.collect()}
    assert found == {1: (0, 0, 1), 2: (1, 1, 0)}


def test_any_number_of_levels(make_tables):
    t = make_tables([{"customer_id": i, "country": str(i)} for i in range(1500)])
    assert len(features.category_levels(t.customers, ["country"])["country"]) == 1500
    assert len(features.one_hot(t.customers, "country", "country", [str(i) for i in range(1500)]).columns) == 1509
    assert features.category_levels(t.customers, ["gender", "acquisition_channel"]) == {
        "gender": ["F"],
        "acquisition_channel": ["organic"],
    }


def test_counts_are_nested_on_generated_data(spark):
    from tidemark.sources.star import AS_OF as STAR_AS_OF
    from tidemark.sources.star import tables_from_star

    base = features.feature_base(tables_from_star(spark, "/root/testdata/sf0.001"), STAR_AS_OF)
    wrong = base.where("events_last_7d > events_last_30d or events_last_30d > total_events or tenure_days < 0")
    assert base.count() == 150 and wrong.count() == 0
