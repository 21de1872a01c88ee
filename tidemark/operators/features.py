"""Point-in-time features: one row per customer, nothing later than its observation date.

Facts are first rolled up to one row per customer and day.  That combines on the map
side, bounds a customer's rows by the calendar, and is all the as-of logic needs: the
rollups meet the observation dates in one join on customer_id and are folded by one
aggregation in the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_number
from tidemark.functions.rounding import dollars, round_even, total_cents
from tidemark.sources.tables import Tables

# Plan codes, days reported without any event, default as-of date, and the
# columns of the matrix in order.
PLAN_CODES = {"free": 0, "starter": 1, "pro": 2, "enterprise": 3}
NO_EVENT_DAYS = 999
DEFAULT_AS_OF = "2025-03-31"

NUMERIC_FEATURES = [
    "tenure_days",
    "age",
    "total_spend",
    "avg_order_value",
    "num_transactions",
    "current_mrr",
    "total_events",
    "login_count",
    "feature_use_count",
    "support_ticket_count",
    "page_view_count",
    "events_last_30d",
    "events_last_7d",
    "days_since_last_event",
    "plan_encoded",
    "avg_events_per_week",
    "support_ticket_ratio",
]
EVENT_COUNTS = {
    "login_count": "login",
    "feature_use_count": "feature_use",
    "support_ticket_count": "support_ticket",
    "page_view_count": "page_view",
}


def observation_date(as_of: str, seed: int = 123) -> Column:
    """The as-of date, or for a churned customer a day 14 to 60 days before the churn.

    The offset is a hash of the customer id and the seed, so it does not depend on row order; the
    earliest half of a short life is never reached.
    """
    window = F.datediff("churn_date", "signup_date")
    spread = F.least(F.lit(60), (window / 2).cast("int")) - 13
    hashed = F.pmod(seeded_number("customer_id", seed), spread).cast("int") + 14
    offset = F.when(window > 30, hashed).otherwise(F.greatest(F.lit(1), F.floor(window / 3).cast("int")))
    churned = (F.col("is_churned") == 1) & F.col("churn_date").isNotNull()
    return F.when(churned, F.date_sub("churn_date", offset)).otherwise(F.lit(as_of).cast("date"))


def observation_points(customers: DataFrame, as_of: str = DEFAULT_AS_OF, seed: int = 123) -> DataFrame:
    return customers.select("customer_id", observation_date(as_of, seed).alias("obs_date"))


def daily_spend(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("customer_id", F.col("transaction_date").alias("day")).agg(
        total_cents("amount").alias("spend"), F.count("transaction_id").alias("purchases")
    )


def daily_plan(subscriptions: DataFrame) -> DataFrame:
    """The plan a customer ended each day with; the higher subscription id wins within a day."""
    return subscriptions.groupBy("customer_id", F.col("start_date").alias("day")).agg(
        F.max_by("plan", "subscription_id").alias("plan"), F.max_by("mrr", "subscription_id").alias("mrr")
    )


def daily_events(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id", F.col("event_date").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in EVENT_COUNTS.items()],
    )


def _spend_aggregates() -> list[Column]:
    return [F.sum("spend").alias("spend"), F.sum("purchases").alias("num_transactions")]


def _plan_aggregates() -> list[Column]:
    """Plan and revenue of the latest day that has a subscription."""
    subscribed = F.when(F.col("plan").isNotNull(), F.col("day"))
    return [F.max_by("plan", subscribed).alias("plan"), F.max_by("mrr", subscribed).alias("mrr")]


def _event_aggregates() -> list[Column]:
    age = F.datediff("obs_date", "day")
    return [
        F.sum("events").alias("total_events"),
        *[F.sum(name).alias(name) for name in EVENT_COUNTS],
        F.sum(F.when(age <= 30, F.col("events")).otherwise(0)).alias("events_last_30d"),
        F.sum(F.when(age <= 7, F.col("events")).otherwise(0)).alias("events_last_7d"),
        F.max(F.when(F.col("events").isNotNull(), F.col("day"))).alias("last_event_date"),
    ]


def _until_observed(daily: DataFrame, observed: DataFrame) -> DataFrame:
    return daily.join(observed, "customer_id").where(F.col("day") <= F.col("obs_date"))


def _mean_spend() -> Column:
    return dollars(F.col("spend")) / F.col("num_transactions")


def txn_features_asof(transactions: DataFrame, observed: DataFrame) -> DataFrame:
    """Spend, mean order value and number of transactions up to the observation date."""
    return (
        _until_observed(daily_spend(transactions), observed)
        .groupBy("customer_id")
        .agg(*_spend_aggregates())
        .select(
            "customer_id",
            dollars(F.col("spend")).alias("total_spend"),
            _mean_spend().alias("avg_order_value"),
            "num_transactions",
        )
    )


def latest_subscription_asof(subscriptions: DataFrame, observed: DataFrame) -> DataFrame:
    """Plan and recurring revenue in force at the observation date.

    Plans go through the aggregations as numbers, which keeps those hash-based, and get
    their names back from the short list of plans.
    """
    number = F.xxhash64("plan")
    names = subscriptions.where(F.col("plan").isNotNull()).select(number.alias("number"), "plan").distinct()
    coded = subscriptions.withColumn("plan", F.when(F.col("plan").isNotNull(), number))
    latest = (
        _until_observed(daily_plan(coded), observed)
        .groupBy("customer_id")
        .agg(*_plan_aggregates())
        .select("customer_id", F.col("plan").alias("number"), F.col("mrr").cast("double").alias("mrr"))
    )
    return latest.join(names, "number", "left").select("customer_id", "plan", "mrr")


def event_features_asof(events: DataFrame, observed: DataFrame) -> DataFrame:
    """Activity counts up to the observation date, overall, per type and for 30 and 7 days."""
    return (
        _until_observed(daily_events(events), observed).groupBy("customer_id").agg(*_event_aggregates())
    )


def plan_code(plan: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in PLAN_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, plan), F.lit(0)).cast("bigint")


def events_per_week(events: Column, tenure_days: Column) -> Column:
    return round_even(events / (F.greatest(tenure_days, F.lit(7)) / F.lit(7.0)), 2)


def ticket_ratio(tickets: Column, events: Column) -> Column:
    return round_even(tickets / F.greatest(events, F.lit(1)).cast("double"), 4)


def feature_base(t: Tables, as_of: str = DEFAULT_AS_OF, seed: int = 123) -> DataFrame:
    """All features of every customer, with channel and country still as text.

    The plan enters as its code: fixed-width values keep both aggregations hash-based,
    where text would make Spark sort the facts.
    """
    people = t.customers.withColumn("obs_date", observation_date(as_of, seed))
    attributes = ["obs_date", "signup_date", "age", "country", "acquisition_channel", "is_churned"]
    coded = t.subscriptions.withColumn("plan", plan_code(F.col("plan")))
    facts = (
        daily_spend(t.transactions)
        .unionByName(daily_plan(coded), allowMissingColumns=True)
        .unionByName(daily_events(t.events), allowMissingColumns=True)
    )
    known = F.col("f.day") <= F.col("c.obs_date")
    folded = (
        people.select("customer_id", *attributes)
        .alias("c")
        .join(facts.alias("f"), (F.col("c.customer_id") == F.col("f.customer_id")) & known, "left")
        .drop(F.col("f.customer_id"))
        .groupBy("customer_id", *attributes)
        .agg(
            *_spend_aggregates(),
            *_plan_aggregates(),
            *_event_aggregates(),
        )
    )
    zero = F.lit(0)
    counts = ["total_events", *EVENT_COUNTS, "events_last_30d", "events_last_7d"]
    base = folded.select(
        "customer_id",
        F.datediff("obs_date", "signup_date").cast("bigint").alias("tenure_days"),
        F.col("age").cast("bigint").alias("age"),
        "country",
        "acquisition_channel",
        F.coalesce(dollars(F.col("spend")), F.lit(0.0)).alias("total_spend"),
        F.coalesce(_mean_spend(), F.lit(0.0)).alias("avg_order_value"),
        F.coalesce("num_transactions", zero).alias("num_transactions"),
        F.coalesce(F.col("mrr").cast("double"), F.lit(0.0)).alias("current_mrr"),
        *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce(F.datediff("obs_date", "last_event_date"), F.lit(NO_EVENT_DAYS))
        .cast("bigint")
        .alias("days_since_last_event"),
        F.col("is_churned").cast("bigint").alias("is_churned"),
        F.coalesce("plan", F.lit(PLAN_CODES["free"])).alias("plan_encoded"),
    )
    return base.withColumns(
        {
            "avg_events_per_week": events_per_week(F.col("total_events"), F.col("tenure_days")),
            "support_ticket_ratio": ticket_ratio(F.col("support_ticket_count"), F.col("total_events")),
        }
    )


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The sorted levels of category columns: they become column names, so the driver holds them."""
    found = (
        df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in columns])))
        .where(F.col("level").isNotNull())
        .distinct()
        .collect()
    )
    return {c: sorted(row["level"] for row in found if row["name"] == c) for c in columns}


def one_hot(df: DataFrame, column: str, prefix: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per level, named ``<prefix>_<level>``, replacing ``column``."""
    dummies = {
        f"{prefix}_{level}": F.coalesce((F.col(column) == level).cast("bigint"), F.lit(0)) for level in levels
    }
    return df.withColumns(dummies).drop(column) if dummies else df.drop(column)


def feature_matrix(
    t: Tables,
    as_of: str = DEFAULT_AS_OF,
    seed: int = 123,
    channels: Sequence[str] | None = None,
    countries: Sequence[str] | None = None,
) -> DataFrame:
    """The numeric matrix: ids, features and one-hot columns, text columns dropped.

    Levels that are not given are read from the customers table.
    """
    given = {"acquisition_channel": channels, "country": countries}
    missing = [column for column, levels in given.items() if levels is None]
    if missing:
        given |= category_levels(t.customers, missing)
    channels, countries = given.values()
    matrix = feature_base(t, as_of, seed)
    matrix = one_hot(matrix, "acquisition_channel", "channel", channels)
    return one_hot(matrix, "country", "country", countries)
