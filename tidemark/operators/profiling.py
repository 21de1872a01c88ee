"""Exploratory profiles of the four tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import churn_status, month_label, month_start
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.rounding import dollars, round_even, total_cents
from tidemark.sources.tables import Tables

# Plan order and the measures of the profile tables.
PLAN_ORDER = ["free", "starter", "pro", "enterprise"]
EVENT_MEASURES = ["logins", "feature_uses", "support_tickets", "page_views"]
COMPARED = {
    "avg_spend": "total_spend",
    "avg_transactions": "num_transactions",
    "avg_events": "total_events",
    "avg_logins": "logins",
    "avg_feature_uses": "feature_uses",
    "avg_tenure": "tenure_days",
    "avg_age": "age",
}
CORRELATED = [
    "is_churned",
    "total_spend",
    "num_transactions",
    "total_events",
    "logins",
    "feature_uses",
    "tenure_days",
    "age",
]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(t: Tables) -> DataFrame:
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in t._asdict().items()
        ]
    )


def table_preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    return df.orderBy(key).limit(rows)


def _per_column(df: DataFrame, measure, name: str) -> DataFrame:
    wide = df.agg(*[measure(F.col(c)).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", name)


def table_info(t: Tables) -> DataFrame:
    """Type and number of non-null values per column."""
    frames = []
    for name, df in t._asdict().items():
        kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
        frames.append(
            _per_column(df, F.count, "non_null").select(
                F.lit(name).alias("table_name"),
                "column_name",
                kinds[F.col("column_name")].alias("data_type"),
                "non_null",
            )
        )
    return union_all(frames)


def null_counts(t: Tables) -> DataFrame:
    """Missing values of the columns that have any."""
    return union_all(
        [
            _per_column(df, lambda c: F.count_if(c.isNull()), "missing")
            .where(F.col("missing") > 0)
            .select(F.lit(name).alias("table_name"), "column_name", "missing")
            for name, df in t._asdict().items()
        ]
    )


def total_nulls(df: DataFrame) -> DataFrame:
    """Missing values of a whole table, as one number."""
    missing = reduce(Column.__add__, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(missing.alias("missing"))


def overall_churn(t: Tables) -> DataFrame:
    churned, customers = F.sum("is_churned"), F.count("is_churned")
    return t.customers.agg(
        (churned / F.nullif(customers, F.lit(0))).alias("churn_rate"),
        churned.alias("churned"),
        customers.alias("customers"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "value")
    )


def value_counts_by_dimension(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """``value_counts`` of several columns in one pass, with the column's name as ``dimension``."""
    cells = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _bin_columns(df: DataFrame, value: str, bins: int) -> tuple[Column, Column]:
    """Equal-width bin number of ``value`` and the bin's lower edge.

    The range is one scalar subquery: a pair of numbers, no join.
    """
    ends = df.agg(
        F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("ends")
    ).scalar()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / F.lit(float(bins))
    number = F.floor((F.col(value).cast("double") - lo) / F.nullif(width, F.lit(0.0)))
    slot = F.least(F.coalesce(number, F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return slot, lo + width * slot


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between the column's minimum and maximum; empty bins are absent."""
    rows = df.select(column).where(F.col(column).isNotNull())
    slot, edge = _bin_columns(rows, column, bins)
    return (
        rows.select(slot.alias("bin"), edge.alias("bin_start"))
        .groupBy("bin", "bin_start")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("bin")
    )


def histogram_by_status(profile: DataFrame, metrics: list[str], bins: int = 40) -> DataFrame:
    """Per metric and churn status, rows per bin; the statuses of a metric share its bins.

    ``profile`` is read twice: pass a materialised frame.
    """
    cells = []
    for metric in metrics:
        slot, edge = _bin_columns(profile, metric, bins)
        cells.append(F.struct(F.lit(metric).alias("metric"), slot.alias("bin"), edge.alias("bin_start")))
    return (
        profile.select("status", F.inline(F.array(*cells)))
        .groupBy("metric", "status", "bin", "bin_start")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def churn_by_dimensions(t: Tables, dimensions: list[str]) -> DataFrame:
    """Churn rate per value of each column, in one pass, with the column's name as ``dimension``."""
    cells = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in dimensions]
    return (
        t.customers.select("is_churned", F.inline(F.array(*cells)))
        .groupBy("dimension", "value")
        .agg(
            (F.sum("is_churned") / F.count("is_churned")).alias("churn_rate"),
            F.count("is_churned").alias("total"),
        )
    )


def churn_by_dimension(t: Tables, dimension: str) -> DataFrame:
    """Churn rate per value of one column, the highest first."""
    return churn_by_dimensions(t, [dimension]).drop("dimension").orderBy(F.desc("churn_rate"), "value")


def monthly_transactions(t: Tables) -> DataFrame:
    revenue = dollars(total_cents("amount"))
    return (
        t.transactions.groupBy(month_start(F.col("transaction_date")).alias("first_day"))
        .agg(
            revenue.alias("revenue"),
            F.count("amount").alias("transactions"),
            (revenue / F.count("amount")).alias("avg_amount"),
        )
        .select(month_label(F.col("first_day")).alias("month"), "revenue", "transactions", "avg_amount")
        .orderBy("month")
    )


def category_revenue(t: Tables) -> DataFrame:
    return (
        t.transactions.groupBy("product_category")
        .agg(dollars(total_cents("amount")).alias("revenue"))
        .orderBy(F.desc("revenue"), "product_category")
    )


def plan_distribution(t: Tables, plans: list[str] = PLAN_ORDER) -> DataFrame:
    """Subscriptions of any status per listed plan, in list order; an unused plan shows NULLs."""
    total = dollars(total_cents("mrr"))
    found = (
        t.subscriptions.where(F.col("plan").isin(*plans))
        .groupBy("plan")
        .agg(
            F.count("subscription_id").alias("subscriptions"),
            (total / F.count("mrr")).alias("avg_mrr"),
            total.alias("total_mrr"),
        )
    )
    listed = t.subscriptions.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(p) for p in plans])).alias("position", "plan")
    )
    return listed.join(found, "plan", "left").orderBy("position").drop("position")


def active_customer_count(t: Tables) -> DataFrame:
    return t.events.agg(F.count_distinct("customer_id").alias("customers_with_events"))


def _event_counts(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.groupBy("customer_id").agg(
        F.count("event_id").alias("total_events"),
        F.count_if(kind == "login").alias("logins"),
        F.count_if(kind == "feature_use").alias("feature_uses"),
        F.count_if(kind == "support_ticket").alias("support_tickets"),
        F.count_if(kind == "page_view").alias("page_views"),
    )


def customer_event_profile(t: Tables) -> DataFrame:
    """Event counts by type of the customers that have events."""
    people = t.customers.select("customer_id", churn_status(F.col("is_churned")).alias("status"))
    return people.join(_event_counts(t.events), "customer_id")


def event_means_by_status(profile: DataFrame) -> DataFrame:
    measures = ["total_events", *EVENT_MEASURES]
    return profile.groupBy("status").agg(
        *[round_even(F.sum(m) / F.count(m), 1).alias(m) for m in measures]
    )


def event_box_stats(profile: DataFrame) -> DataFrame:
    """Box-plot numbers per event type and status: exact quartiles and 1.5-IQR whiskers.

    ``profile`` is read three times: pass a materialised frame.
    """
    keys = ["event_type", "status"]
    long = profile.unpivot("status", EVENT_MEASURES, "event_type", "value")
    quartiles = (
        exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75])
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name)
                for p, name in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]
            ]
        )
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col("value").cast("double")
    inside = (value >= F.col("q1") - reach) & (value <= F.col("q3") + reach)
    # Eight rows (four types, two statuses) are broadcast.
    return (
        long.join(F.broadcast(quartiles), keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.min(F.when(inside, value)).alias("lower_fence"),
            F.max(F.when(inside, value)).alias("upper_fence"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def customer_360(t: Tables, as_of: str) -> DataFrame:
    """Every customer with spend, transaction and event totals (0 where none) and tenure to a fixed day."""
    spend = t.transactions.groupBy("customer_id").agg(
        dollars(total_cents("amount")).alias("total_spend"),
        F.count("transaction_id").alias("num_transactions"),
    )
    activity = _event_counts(t.events).select("customer_id", "total_events", "logins", "feature_uses")
    filled = ["total_spend", "num_transactions", "total_events", "logins", "feature_uses"]
    return (
        t.customers.join(spend, "customer_id", "left")
        .join(activity, "customer_id", "left")
        .fillna(0, subset=filled)
        .withColumn("status", churn_status(F.col("is_churned")))
        .withColumn("tenure_days", F.datediff(F.lit(as_of).cast("date"), "signup_date").cast("bigint"))
    )


def status_comparison(profile: DataFrame) -> DataFrame:
    """Key metrics as rows, one column per churn status, one decimal.

    ``profile`` is read three times: pass a materialised frame.
    """

    def mean(column: str) -> Column:
        # Exact decimal sums, so the last digit does not depend on partitioning.
        return F.sum(F.col(column).cast("decimal(28,2)")).cast("double") / F.count(column)

    wide = profile.groupBy("status").agg(
        F.count("customer_id").cast("double").alias("count"),
        *[round_even(mean(column), 1).alias(name) for name, column in COMPARED.items()],
    )
    means = wide.unpivot("status", ["count", *COMPARED], "metric", "value")
    medians = exact_quantiles(profile, ["status"], "total_spend", [0.5]).select(
        "status", F.lit("median_spend").alias("metric"), round_even(F.col("quantile"), 1).alias("value")
    )
    return (
        means.unionByName(medians).groupBy("metric").pivot("status", ["Active", "Churned"]).agg(F.max("value"))
    )


def correlation_matrix(profile: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every ordered pair, in long form; one pass over the rows.

    NULL where a column is constant (the built-in ``corr`` divides by zero there).
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = profile.agg(
        *[F.stddev_pop(a).alias(a) for a in columns],
        *[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs],
    )
    cells = [
        F.struct(
            F.lit(x).alias("a"),
            F.lit(y).alias("b"),
            (F.col(f"{a}|{b}") / F.nullif(F.col(a) * F.col(b), F.lit(0.0))).alias("r"),
        )
        for a, b in pairs
        for x, y in sorted({(a, b), (b, a)})
    ]
    return wide.select(F.inline(F.array(*cells)))


def churn_correlation(matrix: DataFrame) -> DataFrame:
    others = (F.col("a") == "is_churned") & (F.col("b") != "is_churned")
    return matrix.where(others).select(F.col("b").alias("feature"), "r").orderBy("r")


def spend_vs_events(profile: DataFrame) -> DataFrame:
    return profile.select("customer_id", "total_spend", "total_events", "status")
