"""The four input tables derived from an order/lineitem star schema.

Every order opens a subscription and is a transaction, every lineitem is an event.  So
that some customers have no transactions or no events (the outer-join cases), every
17th account is billed through the account after it and every 13th has its activity
recorded there; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import CUSTOMERS, EVENTS, SUBSCRIPTIONS, TRANSACTIONS, Tables, conform

AS_OF = "2001-08-01"
CHURN_CUTOFF = "2000-08-01"
# Declared, so that opening a table reads no file footers; unused columns are left out.
STAR_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_returnflag STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "nation": "n_nationkey INT, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
}
# Plans and their list prices.
PLAN_NAMES = ["free", "starter", "pro", "enterprise"]
PLAN_PRICES = [0, 19, 49, 149]


def _pick(options: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def _account(key: Column, every: int) -> Column:
    return key + F.when(key % every == 0, 1).otherwise(0)


def customers(customer: DataFrame, orders: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    history = orders.groupBy("o_custkey").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    churned = F.col("last_day") < F.lit(CHURN_CUTOFF).cast("date")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    key = F.col("c_custkey")
    derived = (
        customer.join(history, key == F.col("o_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.col("first_day").alias("signup_date"),
            F.col("r_name").alias("country"),
            (key % 48 + 18).alias("age"),
            _pick(["M", "F", "Other"], key % 3).alias("gender"),
            F.col("c_mktsegment").alias("acquisition_channel"),
            churned.cast("int").alias("is_churned"),
            F.when(churned, F.col("last_day")).alias("churn_date"),
        )
    )
    return conform(derived, CUSTOMERS)


def subscriptions(orders: DataFrame) -> DataFrame:
    """One row per order; it ends when the customer's next order starts.

    The next order is found in two steps, so that a customer with a large share of all
    orders is spread over its days: first within (customer, day), then, for the last
    order of each day only, across the customer's days.  The second step sees at most
    one row per calendar day and customer; other rows keep lanes of their own day.  Each
    step is one shuffle.
    """
    day = F.col("o_orderdate").cast("date")
    in_day = Window.partitionBy("o_custkey", "day").orderBy("o_orderkey")
    across = Window.partitionBy("o_custkey", "lane").orderBy("day", "o_orderkey")
    closes_day = F.col("next_in_day").isNull()
    rows = (
        orders.select("o_custkey", "o_orderkey", day.alias("day"))
        .select(
            "*",
            F.lead("o_orderkey").over(in_day).alias("next_in_day"),
            F.first("o_orderkey").over(in_day).alias("first_in_day"),
        )
        .withColumn("lane", F.when(~closes_day, F.col("day")))
        .select("*", F.lead("day").over(across).alias("later_day"), F.lead("first_in_day").over(across).alias("later_key"))
        .withColumns(
            {
                "next_day": F.when(closes_day, F.col("later_day")).otherwise(F.col("day")),
                "next_key": F.when(closes_day, F.col("later_key")).otherwise(F.col("next_in_day")),
            }
        )
    )

    tier = F.col("o_orderkey") % 4
    is_last = F.col("next_key").isNull()
    churned = F.col("day") < F.lit(CHURN_CUTOFF).cast("date")
    list_cents = _pick(PLAN_PRICES, tier) * (F.col("o_orderkey") % 21 + 90)
    derived = rows.select(
        F.col("o_orderkey").alias("subscription_id"),
        F.col("o_custkey").alias("customer_id"),
        _pick(PLAN_NAMES, tier).alias("plan"),
        (list_cents.cast("decimal(14,2)") / 100).alias("mrr"),
        F.col("day").alias("start_date"),
        F.when(is_last & churned, F.col("day")).when(~is_last, F.col("next_day")).alias("end_date"),
        F.when(is_last & churned, "cancelled")
        .when(is_last, "active")
        .when(F.col("next_key") % 4 >= tier, "upgraded")
        .otherwise("downgraded")
        .alias("status"),
    )
    return conform(derived, SUBSCRIPTIONS)


def transactions(orders: DataFrame) -> DataFrame:
    derived = orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        _account(F.col("o_custkey"), 17).alias("customer_id"),
        F.col("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("product_category"),
        F.col("o_orderstatus").alias("payment_method"),
    )
    return conform(derived, TRANSACTIONS)


def events(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    part_class = F.col("l_partkey") % 10
    kind = (
        F.when(part_class <= 2, "login")
        .when(part_class <= 5, "page_view")
        .when(part_class <= 7, "feature_use")
        .when(part_class == 8, "support_ticket")
        .otherwise("feedback")
    )
    derived = lineitem.join(
        orders.select("o_orderkey", _account(F.col("o_custkey"), 13).alias("customer_id")),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
        "customer_id",
        F.col("l_shipdate").alias("event_date"),
        kind.alias("event_type"),
        F.when(kind != "login", F.col("l_returnflag")).alias("event_detail"),
    )
    return conform(derived, EVENTS)


def click_events(native: DataFrame) -> DataFrame:
    """The click-stream table in the shape of ``events``."""
    names = {
        "view": "page_view",
        "click": "feature_use",
        "error": "support_ticket",
        "signup": "login",
        "purchase": "feedback",
    }
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    derived = native.select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("event_date"),
        kind.alias("event_type"),
        F.lit(None).alias("event_detail"),
    )
    return conform(derived, EVENTS)


def read_star(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{base_dir}/{name}.parquet")


def tables_from_star(spark: SparkSession, base_dir: str) -> Tables:
    def read(name: str) -> DataFrame:
        return read_star(spark, base_dir, name)

    orders = read("orders")
    return Tables(
        customers(read("customer"), orders, read("nation"), read("region")),
        subscriptions(orders),
        transactions(orders),
        events(read("lineitem"), orders),
    )
