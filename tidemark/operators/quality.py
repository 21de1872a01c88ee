"""Integrity checks and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.profiling import union_all
from tidemark.sources.tables import Tables

PRIMARY_KEYS = {
    "customers": "customer_id",
    "subscriptions": "subscription_id",
    "transactions": "transaction_id",
    "events": "event_id",
}
NULLABLE = {"churn_date", "end_date", "event_detail"}


def _duplicate_keys(name: str, df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Key values that occur more than once, for all of a table's keys in one aggregation."""
    if len(rules) == 1:  # one key keeps its own type
        (key,) = rules
        keys = df.select(F.lit(key).alias("column_name"), F.col(key).alias("value"))
    else:
        values = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in rules]
        keys = df.select(F.inline(F.array(*values)))
    keys = keys.where(F.col("value").isNotNull())
    repeated = keys.groupBy("column_name", "value").agg((F.count(F.lit(1)) > 1).alias("again"))
    counts = repeated.agg(*[F.count_if(F.col("again") & (F.col("column_name") == c)).alias(c) for c in rules])
    return _as_rows(name, counts, {c: (c, rule) for c, rule in rules.items()})


def _required(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NULLABLE]


def _as_rows(name: str, counts: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """One wide row of violation counts as (table, column, rule, violations) rows."""
    cells = [
        F.struct(F.lit(column).alias("column_name"), F.lit(rule).alias("rule"), F.col(c).alias("violations"))
        for c, (column, rule) in rules.items()
    ]
    return counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*cells)))


def _missing_values(name: str, df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _required(df)])
    return _as_rows(name, counts, {c: (c, "not_null") for c in _required(df)})


def _missing_values_and_orphans(name: str, df: DataFrame, customers: DataFrame) -> DataFrame:
    """Both rules in one scan: counts per customer, so that a hot customer joins as one row."""
    required = _required(df)
    per_customer = df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
    )
    known = customers.select("customer_id").distinct().withColumn("known", F.lit(True))
    orphan = F.col("customer_id").isNotNull() & F.col("known").isNull()
    counts = per_customer.join(known, "customer_id", "left").agg(
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in required],
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphans"),
    )
    rules = {f"null_{c}": (c, "not_null") for c in required}
    return _as_rows(name, counts, rules | {"orphans": ("customer_id", "foreign_key")})


def integrity_checks(t: Tables) -> DataFrame:
    """One row per rule with the number of violations (key values, rows or orphan rows)."""
    tables = t._asdict()
    unique = {"customers": {"email": "unique"}}
    checks = [
        _duplicate_keys(n, df, {PRIMARY_KEYS[n]: "primary_key"} | unique.get(n, {})) for n, df in tables.items()
    ]
    checks.append(_missing_values("customers", t.customers))
    checks += [
        _missing_values_and_orphans(n, df, t.customers) for n, df in tables.items() if n != "customers"
    ]
    return union_all(checks)


def upsert_by_key(base: DataFrame, batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """``base`` with the rows of ``batch`` inserted or replaced by ``key``.

    Of several batch rows with one key the highest ``sequence`` wins, a missing one counts
    as lowest, and of equal ones the row with the larger values, column by column.  Rows
    without a key match nothing and are all inserted.  The sequence column is not part of
    the result.  Spark cuts each key to its first row before the shuffle too.
    """
    order = [F.desc_nulls_last(sequence), *[F.desc_nulls_last(c) for c in base.columns]]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    latest = (
        batch.where(F.col(key).isNotNull()).withColumn("_place", place).where("_place = 1").select(base.columns)
    )
    unkeyed = batch.where(F.col(key).isNull()).select(base.columns)
    return base.join(latest.select(key), key, "left_anti").unionByName(latest).unionByName(unkeyed)
