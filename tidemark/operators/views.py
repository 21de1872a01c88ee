"""The tables behind the dashboard pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import percent_2dp
from tidemark.operators.decisions import TIERS

# Bins, melted measures and table columns of the dashboard.
HISTOGRAM_BINS = 40
ENGAGEMENT_MEASURES = ["avg_logins", "avg_feature_uses", "avg_support_tickets"]
RECOMMENDATION_COLUMNS = [
    "customer_id",
    "name",
    "country",
    "risk_tier",
    "churn_probability",
    "monthly_value",
    "annual_risk_value",
    "recommended_action",
    "intervention_cost",
    "expected_save_value",
    "expected_roi",
]


def executive_kpis(monthly: DataFrame, segments: DataFrame) -> DataFrame:
    """One row from the monthly revenue and the channel segments; churn is the plain channel mean."""
    exact = "decimal(38,2)"
    both = monthly.select("month", "revenue", "mom_growth_pct").unionByName(
        segments.select("total_customers", "churn_rate_pct"), allowMissingColumns=True
    )
    return both.agg(
        F.sum(F.col("revenue").cast(exact)).cast("double").alias("total_revenue"),
        F.max_by("revenue", "month").alias("latest_month_revenue"),
        F.max_by("mom_growth_pct", "month").alias("latest_growth_pct"),
        F.sum("total_customers").alias("total_customers"),
        (
            F.sum(F.col("churn_rate_pct").cast("decimal(18,2)")).cast("double")
            / F.nullif(F.count("churn_rate_pct"), F.lit(0))
        ).alias("avg_churn_rate_pct"),
    )


def plan_revenue_share(by_plan: DataFrame) -> DataFrame:
    """Each plan's share of the recurring revenue.  The input has one row per plan."""
    whole = F.round(F.col("total_mrr") * 100).cast("bigint")
    return (
        by_plan.withColumn("mrr_cents", whole)
        .withColumn("all_cents", F.sum("mrr_cents").over(Window.partitionBy()))
        .select("plan", "total_mrr", percent_2dp(F.col("mrr_cents"), F.col("all_cents")).alias("share_pct"))
    )


def retention_matrix(retention: DataFrame, periods: int = 12) -> DataFrame:
    """Cohorts as rows, periods 0..``periods`` as columns, absent cells NULL."""
    return (
        retention.groupBy("cohort")
        .pivot("period", list(range(periods + 1)))
        .agg(F.avg("retention_rate"))
        .orderBy("cohort")
    )


def engagement_long(engagement: DataFrame) -> DataFrame:
    return engagement.unpivot("status", ENGAGEMENT_MEASURES, "metric", "average")


def risk_filter(scores: DataFrame, tiers: Sequence[str] = TIERS, min_probability: float = 0.0) -> DataFrame:
    chosen = F.col("risk_tier").isin(*tiers) & (F.col("churn_probability") >= min_probability)
    return scores.where(chosen).orderBy(F.desc("churn_probability"), "customer_id")


def risk_tier_counts(scores: DataFrame) -> DataFrame:
    """Customers per tier, an absent tier counting 0."""
    counts = scores.agg(*[F.count_if(F.col("risk_tier") == tier).alias(tier) for tier in TIERS])
    rows = [F.struct(F.lit(tier).alias("risk_tier"), F.col(tier).alias("customers")) for tier in TIERS]
    return counts.select(F.inline(F.array(*rows)))


def risk_histogram(scores: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Customers per probability bin and tier; bins are equal parts of [0, 1]."""
    slot = F.least(F.floor(F.col("churn_probability") * bins), F.lit(bins - 1))
    return (
        scores.groupBy(slot.cast("bigint").alias("bin"), "risk_tier")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("bin", "risk_tier")
    )


def top_roi(recs: DataFrame, limit: int = 50) -> DataFrame:
    return (
        recs.where(F.col("expected_roi") > 0)
        .orderBy(F.desc("expected_roi"), F.desc("annual_risk_value"), "customer_id")
        .limit(limit)
    )


def recommendation_table(recs: DataFrame, tiers: Sequence[str] = ("High", "Medium")) -> DataFrame:
    return (
        recs.where(F.col("risk_tier").isin(*tiers))
        .select(*RECOMMENDATION_COLUMNS)
        .orderBy(F.desc("annual_risk_value"), "customer_id")
    )


def customer_lookup(recs: DataFrame, tier: str | None = None) -> DataFrame:
    """Pick-list of customers, most likely to churn first."""
    chosen = recs if tier is None else recs.where(F.col("risk_tier") == tier)
    label = F.format_string("%d — %s (%s risk)", "customer_id", "name", F.coalesce("risk_tier", F.lit("nan")))
    return chosen.orderBy(F.desc("churn_probability"), "customer_id").select(
        "customer_id", "churn_probability", label.alias("label")
    )


def customer_profile(recs: DataFrame, customer_id: int) -> DataFrame:
    return recs.where(F.col("customer_id") == customer_id)
