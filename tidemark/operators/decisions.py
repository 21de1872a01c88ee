"""From churn scores to priced retention actions.

Every function takes a scores frame (customer_id, churn_probability, risk_tier,
is_churned, total_spend, current_mrr, tenure_days, ...) of any origin.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import round_even

TIERS = ["High", "Medium", "Low"]


class Intervention(NamedTuple):
    action: str
    cost: float
    success_rate: float


# The intervention offered per risk tier.
INTERVENTIONS = {
    "High": Intervention("Personal outreach + 20% discount", 50.0, 0.35),
    "Medium": Intervention("Automated email + 10% discount", 15.0, 0.25),
    "Low": Intervention("No intervention needed", 0.0, 0.0),
}


def risk_tier(probability: Column) -> Column:
    """(0, 0.3] Low, (0.3, 0.6] Medium, (0.6, 1] High; exactly 0 has no tier."""
    return (
        F.when((probability > 0) & (probability <= 0.3), "Low")
        .when((probability > 0.3) & (probability <= 0.6), "Medium")
        .when((probability > 0.6) & (probability <= 1), "High")
    )


def score_columns(probability: Column) -> dict[str, Column]:
    """The published probability (4 decimals) and the tier, which uses the unrounded one."""
    return {"churn_probability": round_even(probability, 4), "risk_tier": risk_tier(probability)}


def customer_context(scores: DataFrame, customers: DataFrame) -> DataFrame:
    context = customers.select("customer_id", "name", "country", "acquisition_channel", "signup_date")
    return scores.join(context, "customer_id", "left")


def monthly_value() -> Column:
    months = F.greatest(F.col("tenure_days") / F.lit(30.0), F.lit(1.0))
    return F.when(F.col("current_mrr") > 0, F.col("current_mrr")).otherwise(F.col("total_spend") / months)


def annual_risk_value() -> Column:
    return round_even(F.col("monthly_value") * 12 * F.col("churn_probability"), 2)


def _by_tier(field: str) -> Column:
    offers = {tier: getattr(offer, field) for tier, offer in INTERVENTIONS.items()}
    tier = F.col("risk_tier")
    return F.when(tier == "High", offers["High"]).when(tier == "Medium", offers["Medium"]).otherwise(offers["Low"])


def with_intervention(df: DataFrame) -> DataFrame:
    """Action, cost and success rate of the tier; no tier is treated as Low."""
    return df.withColumns(
        {
            "recommended_action": _by_tier("action"),
            "intervention_cost": _by_tier("cost"),
            "success_rate": _by_tier("success_rate"),
        }
    )


def expected_save_value() -> Column:
    return round_even(F.col("annual_risk_value") * F.col("success_rate"), 2)


def expected_roi() -> Column:
    cost = F.col("intervention_cost")
    gain = (F.col("expected_save_value") - cost) / F.nullif(cost, F.lit(0.0))
    return F.when(cost > 0, round_even(gain, 2)).otherwise(0.0)


def priced(scores: DataFrame, customers: DataFrame) -> DataFrame:
    """One priced recommendation per scored customer, in no order."""
    return (
        with_intervention(
            customer_context(scores, customers)
            .withColumn("monthly_value", monthly_value())
            .withColumn("annual_risk_value", annual_risk_value())
        )
        .withColumn("expected_save_value", expected_save_value())
        .withColumn("expected_roi", expected_roi())
        .drop("success_rate")
    )


def recommendations(scores: DataFrame, customers: DataFrame) -> DataFrame:
    """One priced recommendation per scored customer, the largest value at risk first."""
    return priced(scores, customers).orderBy(F.desc("annual_risk_value"), "customer_id")


def summary_report(recs: DataFrame) -> DataFrame:
    """One row: tier counts, value at risk, cost, savings and net return of acting."""
    tier = F.col("risk_tier")
    actionable = tier.isin("High", "Medium")

    def total(column: str, rows: Column) -> Column:
        exact = F.sum(F.when(rows, F.col(column).cast("decimal(28,2)")))
        return F.coalesce(exact.cast("double"), F.lit(0.0))

    def mean_risk(name: str) -> Column:
        rows = F.count_if(tier == name)
        return F.when(
            rows > 0, round_even(total("annual_risk_value", tier == name) / F.nullif(rows, F.lit(0)), 2)
        ).otherwise(0.0)

    sums = recs.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(tier == "High").alias("high_risk_count"),
        F.count_if(tier == "Medium").alias("medium_risk_count"),
        F.count_if(tier == "Low").alias("low_risk_count"),
        total("annual_risk_value", actionable).alias("total_revenue_at_risk"),
        total("intervention_cost", actionable).alias("total_intervention_cost"),
        total("expected_save_value", actionable).alias("total_expected_savings"),
        mean_risk("High").alias("high_risk_avg_value"),
        mean_risk("Medium").alias("medium_risk_avg_value"),
    )
    cost, savings = F.col("total_intervention_cost"), F.col("total_expected_savings")
    net = (savings - cost) / F.greatest(cost, F.lit(1.0)) * 100
    return sums.withColumn("net_roi_pct", round_even(net, 2))
