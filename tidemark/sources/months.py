"""Facts in a folder per month, and reads of the months that dates ask for.

A point-in-time feature over the last days before its date needs few months of a long history.
The folders of the other months are not listed as input of the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.sources.tables import SCHEMAS, conform

MONTH = "month"
DAYS = {"events": "event_date", "transactions": "transaction_date"}


def save_by_month(df: DataFrame, table: str, path: str, shards: int = 8, mode: str = "errorifexists") -> None:
    """Write events or transactions below ``path``, a folder per month and up to ``shards`` files in each.

    Rows are dealt by month and a hash of their key, so a month with a third of the rows is
    ``shards`` tasks, which adaptive execution puts together where they are small; raise it with
    the data.
    Rows without a date are in a folder of their own.
    """
    key, day = SCHEMAS[table][0].name, DAYS[table]
    rows = conform(df, SCHEMAS[table]).withColumn(MONTH, F.date_format(day, "yyyy-MM"))
    shard = F.pmod(F.xxhash64(key), F.lit(shards))
    rows.repartition(MONTH, shard).write.mode(mode).partitionBy(MONTH).parquet(path)


def load_by_month(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table's declared columns and its month; a filter on the month leaves out folders."""
    return spark.read.schema(StructType([*SCHEMAS[table], StructField(MONTH, StringType())])).parquet(path)


def load_until(spark: SparkSession, table: str, path: str, observed: DataFrame, days: int) -> DataFrame:
    """The rows of the ``days`` days up to each customer's ``obs_date``, that day included, from the
    months in which such days lie.

    ``observed`` has a row per customer with ``obs_date`` and is read twice.  The months are
    found by one aggregation; the driver gets one row for each, as many as the calendar has.
    Customers without a date, and rows without one, are in no window.
    """
    first, last = F.date_sub("obs_date", days), F.col("obs_date")
    each = F.explode(F.sequence(F.trunc(first, "MM"), last, F.expr("INTERVAL 1 MONTH"))).alias("start")
    asked = observed.where(last.isNotNull()).select(each).select(F.date_format("start", "yyyy-MM").alias(MONTH)).distinct()
    months = sorted(row[MONTH] for row in asked.collect())
    day = F.col(DAYS[table])
    found = load_by_month(spark, table, path).where(F.col(MONTH).isin(months)).drop(MONTH)
    return found.join(observed.select("customer_id", "obs_date"), "customer_id").where(
        (day >= F.date_sub("obs_date", days)) & (day <= F.col("obs_date"))
    )
