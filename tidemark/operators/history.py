"""Features at many dates per customer, point in time at each of them.

The daily roll-ups of the facts and the dates that are asked for become one stream per
customer, ordered by day.  Running sums, sliding counts and the last values seen are
carried along it, and what they are at a date is the answer there.  Facts meet no list of
dates in a join, so they are never multiplied by them, however many dates a customer has.
A customer's stream has one row per day with facts and one per date, so the calendar
bounds it even for a customer who has a third of all facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import dollars
from tidemark.operators.features import (
    DEFAULT_AS_OF,
    EVENT_COUNTS,
    NO_EVENT_DAYS,
    PLAN_CODES,
    daily_events,
    daily_plan,
    daily_spend,
    events_per_week,
    plan_code,
    ticket_ratio,
)
from tidemark.sources.tables import Tables

SUMS = ["spend", "purchases", "events", *EVENT_COUNTS]


def month_ends(customers: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """(customer_id, obs_date): the last day of each month from the sign-up to the as-of date, the latter included.

    A customer without a sign-up date, or with one after the as-of date's month, has none.
    """
    months = F.sequence(
        F.trunc("signup_date", "month"), F.trunc(F.lit(as_of).cast("date"), "month"), F.expr("interval 1 month")
    )
    open_account = F.trunc("signup_date", "month") <= F.trunc(F.lit(as_of).cast("date"), "month")
    dates = customers.where(open_account).select("customer_id", F.explode(months).alias("month"))
    return dates.select("customer_id", F.last_day("month").alias("obs_date")).where(
        F.col("obs_date") <= F.lit(as_of).cast("date")
    )


def facts_by_day(t: Tables) -> DataFrame:
    """One row per customer, day and kind of fact, with fixed-width values only."""
    coded = t.subscriptions.withColumn("plan", F.when(F.col("plan").isNotNull(), plan_code(F.col("plan"))))
    daily = (
        daily_spend(t.transactions)
        .unionByName(daily_plan(coded), allowMissingColumns=True)
        .unionByName(daily_events(t.events), allowMissingColumns=True)
    )
    return daily.where(F.col("customer_id").isNotNull() & F.col("day").isNotNull())


def carried(stream: DataFrame) -> DataFrame:
    """``stream`` with the sums, sliding counts and last values up to and including each row's day.

    Rows of one day see each other, so the order within a day doesn't matter.
    """
    by_day = Window.partitionBy("customer_id").orderBy("day_number")
    so_far = by_day.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def within(days: int) -> Column:
        return F.sum("events").over(by_day.rangeBetween(-days, Window.currentRow))

    subscribed = F.when(F.col("plan").isNotNull(), F.struct("plan", "mrr"))
    active = F.when(F.col("events").isNotNull(), F.col("day_number"))
    numbered = stream.withColumn("day_number", F.unix_date("day"))
    return numbered.select(
        *stream.columns,
        "day_number",
        *[F.sum(c).over(so_far).alias(f"all_{c}") for c in SUMS],
        within(30).alias("events_last_30d"),
        within(7).alias("events_last_7d"),
        F.last(subscribed, ignorenulls=True).over(so_far).alias("subscription"),
        F.max(active).over(so_far).alias("last_active"),
    )


def feature_history(t: Tables, dates: DataFrame | None = None, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """The features of ``feature_base`` for each customer and date, one row per row of ``dates``.

    ``dates`` has customer_id and obs_date, by default all month ends; rows whose customer
    isn't in the customers table or whose date is missing are left out, repeated rows are
    answered once each.  Facts on the date count, later ones don't.  Rows are one shuffle
    by customer; the attributes travel with the dates.
    """
    people = t.customers.select("customer_id", "signup_date", "age", "country", "acquisition_channel", "is_churned")
    wanted = (month_ends(t.customers, as_of) if dates is None else dates.select("customer_id", "obs_date")).where(
        F.col("obs_date").isNotNull()
    )
    asked = wanted.select("customer_id", F.col("obs_date").alias("day"), F.lit(True).alias("asked")).unionByName(
        people.select("customer_id", F.struct(*people.columns[1:]).alias("person")), allowMissingColumns=True
    )
    # The customer's own row has no day: it comes first in the stream and is seen by all others.
    stream = asked.unionByName(facts_by_day(t), allowMissingColumns=True)
    rows = carried(stream.where(F.col("customer_id").isNotNull()))
    known = Window.partitionBy("customer_id").orderBy("day_number").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = (
        rows.withColumn("of", F.first("person", ignorenulls=True).over(known))
        .where(F.col("asked") & F.col("of").isNotNull())
        .select("*", "of.signup_date", "of.age", "of.country", "of.acquisition_channel", "of.is_churned")
    )
    zero = F.lit(0).cast("long")
    spend, purchases = F.col("all_spend"), F.col("all_purchases")
    base = found.select(
        "customer_id",
        F.col("day").alias("obs_date"),
        F.datediff("day", "signup_date").cast("bigint").alias("tenure_days"),
        F.col("age").cast("bigint").alias("age"),
        "country",
        "acquisition_channel",
        F.coalesce(dollars(spend), F.lit(0.0)).alias("total_spend"),
        F.coalesce(dollars(spend) / purchases, F.lit(0.0)).alias("avg_order_value"),
        F.coalesce(purchases, zero).alias("num_transactions"),
        F.coalesce(F.col("subscription.mrr").cast("double"), F.lit(0.0)).alias("current_mrr"),
        F.coalesce("all_events", zero).alias("total_events"),
        *[F.coalesce(f"all_{c}", zero).alias(c) for c in EVENT_COUNTS],
        F.coalesce("events_last_30d", zero).alias("events_last_30d"),
        F.coalesce("events_last_7d", zero).alias("events_last_7d"),
        F.coalesce(F.col("day_number") - F.col("last_active"), F.lit(NO_EVENT_DAYS))
        .cast("bigint")
        .alias("days_since_last_event"),
        F.col("is_churned").cast("bigint").alias("is_churned"),
        F.coalesce("subscription.plan", F.lit(PLAN_CODES["free"])).cast("bigint").alias("plan_encoded"),
    )
    return base.withColumns(
        {
            "avg_events_per_week": events_per_week(F.col("total_events"), F.col("tenure_days")),
            "support_ticket_ratio": ticket_ratio(F.col("support_ticket_count"), F.col("total_events")),
        }
    )
