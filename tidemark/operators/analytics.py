"""The named analytics reports.

Facts are reduced to one row per customer (and month, plan, type ...) before they meet
the customers table, so a customer holding a large share of the facts is combined on
the map side and never reaches a join as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import churn_status, month_index, month_label, month_start
from tidemark.functions.rounding import dollars, mean_dollars, percent_2dp, ratio_2dp, total_cents
from tidemark.sources.tables import Tables

# Stage names in funnel order.
FUNNEL_STAGES = ["Signed Up", "Logged In", "Viewed Pages", "Used Features", "Made Purchase"]


def monthly_revenue(t: Tables) -> DataFrame:
    """Revenue, payers and growth per month; growth compares with the previous month present."""
    monthly = t.transactions.groupBy(month_start(F.col("transaction_date")).alias("first_day")).agg(
        total_cents("amount").alias("total"),
        F.count_distinct("customer_id").alias("paying_customers"),
    )
    # One row per month: the only place where an unpartitioned window is harmless.
    before = F.lag("total").over(Window.orderBy("first_day"))
    return (
        monthly.withColumn("before", before)
        .select(
            month_label(F.col("first_day")).alias("month"),
            dollars(F.col("total")).alias("revenue"),
            "paying_customers",
            mean_dollars(F.col("total"), F.col("paying_customers")).alias("avg_revenue_per_customer"),
            percent_2dp(
                F.col("total").cast("decimal(38,0)") - F.col("before"), F.col("before")
            ).alias("mom_growth_pct"),
        )
        .orderBy("month")
    )


def revenue_by_plan(t: Tables) -> DataFrame:
    """Customers and recurring revenue of the active subscriptions per plan."""
    total = total_cents("mrr")
    return (
        t.subscriptions.where(F.col("status") == "active")
        .groupBy("plan")
        .agg(
            F.count_distinct("customer_id").alias("customers"),
            dollars(total).alias("total_mrr"),
            mean_dollars(total, F.count("mrr")).alias("avg_mrr"),
        )
        .orderBy(F.desc("total_mrr"), "plan")
    )


def revenue_by_category(t: Tables) -> DataFrame:
    total = total_cents("amount")
    return (
        t.transactions.groupBy("product_category")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            dollars(total).alias("total_revenue"),
            mean_dollars(total, F.count("amount")).alias("avg_transaction"),
        )
        .orderBy(F.desc("total_revenue"), "product_category")
    )


def cohort_retention(t: Tables, periods: int = 12) -> DataFrame:
    """Share of each signup month's customers active 0..``periods`` calendar months later."""
    signup = t.customers.select(
        "customer_id",
        month_start(F.col("signup_date")).alias("first_day"),
        month_index(F.col("signup_date")).alias("signup_month"),
    )
    active = t.events.select("customer_id", month_index(F.col("event_date")).alias("active_month")).distinct()
    # (customer, month) is distinct and a customer has one cohort, so counting rows
    # counts customers without a second distinct.
    retained = (
        active.join(signup, "customer_id")
        .withColumn("period", F.col("active_month") - F.col("signup_month"))
        .where(F.col("period").between(0, periods))
        .groupBy("first_day", "period")
        .agg(F.count(F.lit(1)).alias("retained_customers"))
    )
    sizes = signup.groupBy("first_day").agg(F.count(F.lit(1)).alias("cohort_size"))
    return (
        retained.join(sizes, "first_day")
        .select(
            month_label(F.col("first_day")).alias("cohort"),
            F.col("period").cast("bigint").alias("period"),
            "retained_customers",
            "cohort_size",
            percent_2dp(F.col("retained_customers"), F.col("cohort_size")).alias("retention_rate"),
        )
        .orderBy("cohort", "period")
    )


def _spend_per_customer(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("customer_id").agg(
        total_cents("amount").alias("spend"), F.count("transaction_id").alias("purchases")
    )


def top_customers(t: Tables, limit: int = 20) -> DataFrame:
    """The ``limit`` customers with the highest spend; customers without purchases come last."""
    return (
        t.customers.join(_spend_per_customer(t.transactions), "customer_id", "left")
        .select(
            "customer_id",
            "name",
            "country",
            "signup_date",
            "acquisition_channel",
            dollars(F.col("spend")).alias("total_spend"),
            F.coalesce("purchases", F.lit(0)).alias("num_transactions"),
            mean_dollars(F.col("spend"), F.col("purchases")).alias("avg_order_value"),
            churn_status(F.col("is_churned")).alias("status"),
        )
        .orderBy(F.desc_nulls_last("total_spend"), "customer_id")
        .limit(limit)
    )


def customer_lifetime_value(t: Tables) -> DataFrame:
    """Mean revenue per active month times the number of active months, per buyer."""
    monthly = t.transactions.groupBy(
        "customer_id", month_index(F.col("transaction_date")).alias("month")
    ).agg(total_cents("amount").alias("month_total"))
    buyers = monthly.groupBy("customer_id").agg(
        F.sum("month_total").alias("total"), F.count(F.lit(1)).alias("active_months")
    )
    # mean per active month x active months is the total itself, to the cent.
    return (
        t.customers.join(buyers, "customer_id")
        .select(
            "customer_id",
            "name",
            "signup_date",
            "acquisition_channel",
            mean_dollars(F.col("total"), F.col("active_months")).alias("avg_monthly_revenue"),
            "active_months",
            dollars(F.col("total")).alias("estimated_ltv"),
            churn_status(F.col("is_churned")).alias("status"),
        )
        .orderBy(F.desc("estimated_ltv"), "customer_id")
    )


def customer_segments(t: Tables) -> DataFrame:
    """Size, churn and mean spend (buyers only) per acquisition channel."""
    members = F.count(F.lit(1))
    churned = F.sum("is_churned")
    return (
        t.customers.join(_spend_per_customer(t.transactions), "customer_id", "left")
        .groupBy(F.col("acquisition_channel").alias("segment"))
        .agg(
            members.alias("total_customers"),
            churned.alias("churned"),
            percent_2dp(churned, members).alias("churn_rate_pct"),
            mean_dollars(F.sum("spend"), F.count("spend")).alias("avg_spend"),
        )
        .orderBy(F.desc_nulls_last("avg_spend"), "segment")
    )


def conversion_funnel(t: Tables) -> DataFrame:
    """Distinct customers per stage, each stage counted on its own, and the share of signups."""
    event_stage = F.expr("CASE event_type WHEN 'login' THEN 2 WHEN 'page_view' THEN 3 WHEN 'feature_use' THEN 4 END")
    reached = (
        t.customers.select(F.lit(1).alias("stage"), "customer_id")
        .unionByName(
            t.events.where(F.col("event_type").isin("login", "page_view", "feature_use")).select(
                event_stage.alias("stage"), "customer_id"
            )
        )
        .unionByName(t.transactions.select(F.lit(5).alias("stage"), "customer_id"))
        .distinct()
    )
    # One row with five counts, then five rows: an empty stage still shows with 0 users.
    counts = reached.agg(
        *[F.count_if(F.col("stage") == i).alias(f"users_{i}") for i in range(1, len(FUNNEL_STAGES) + 1)]
    )
    stages = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("stage_order"),
                F.lit(name).alias("stage"),
                F.col(f"users_{i}").alias("users"),
                percent_2dp(F.col(f"users_{i}"), F.col("users_1")).alias("pct_of_signups"),
            )
            for i, name in enumerate(FUNNEL_STAGES, start=1)
        ]
    )
    return counts.select(F.inline(stages)).orderBy("stage_order")


def daily_active_users(t: Tables) -> DataFrame:
    return (
        t.events.groupBy(F.col("event_date").alias("date"))
        .agg(F.count_distinct("customer_id").alias("dau"))
        .orderBy("date")
    )


def engagement_by_churn_status(t: Tables) -> DataFrame:
    """Mean activity per churn status over the customers that have any event."""
    per_customer = t.events.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "login").alias("logins"),
        F.count_if(F.col("event_type") == "feature_use").alias("feature_uses"),
        F.count_if(F.col("event_type") == "support_ticket").alias("support_tickets"),
    )
    measures = ["events", "logins", "feature_uses", "support_tickets"]
    return (
        t.customers.select("customer_id", churn_status(F.col("is_churned")).alias("status"))
        .join(per_customer, "customer_id", "left")
        .groupBy("status")
        .agg(*[ratio_2dp(F.sum(m), F.count(m)).alias(f"avg_{m}") for m in measures])
    )


def churn_by_segment(t: Tables, min_customers: int = 5) -> DataFrame:
    """Churn per country, channel and plan of the active or cancelled subscriptions.

    ``total`` counts customers once; ``churned`` counts a churned customer once per
    matching subscription.  Customers without a matching subscription form the group
    with plan NULL.
    """
    plans = (
        t.subscriptions.where(F.col("status").isin("active", "cancelled"))
        .groupBy("customer_id", "plan")
        .agg(F.count(F.lit(1)).alias("matches"))
    )
    total = F.count(F.lit(1))
    churned = F.sum(F.col("is_churned") * F.coalesce("matches", F.lit(1)))
    return (
        t.customers.join(plans, "customer_id", "left")
        .groupBy("country", "acquisition_channel", "plan")
        .agg(
            total.alias("total"),
            churned.alias("churned"),
            percent_2dp(churned, total).alias("churn_rate"),
        )
        .where(F.col("total") >= min_customers)
        .orderBy(F.desc("churn_rate"), "country", "acquisition_channel", "plan")
    )
