"""Exact distinct counts that can be stored, merged and rolled over days.

The customers of a day are bitmaps: one row per day and bucket of 32,768 ids, with a bit
per id.  Bitmaps of several days, or of a late batch of events, are merged by OR, so a
count over any days comes from the stored rows and never from the events again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_bitmaps(events: DataFrame, day: str = "event_date", key: str = "customer_id") -> DataFrame:
    """(date, bucket, users): one row per day and bucket of ids; rows without a day or an id don't count.

    Bits are set on the map side, so a frequent id or day is one row per task and bucket.
    """
    known = events.where(F.col(day).isNotNull() & F.col(key).isNotNull())
    return known.groupBy(F.col(day).alias("date"), F.bitmap_bucket_number(key).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("users")
    )


def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The bitmaps of two sets of events, as if they had been counted together."""
    return stored.unionByName(batch).groupBy("date", "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def _count(rows: DataFrame, period: Column, name: str, users: str) -> DataFrame:
    """Distinct ids per period: bits per bucket, summed up."""
    return (
        rows.groupBy(period.alias(name), "bucket")
        .agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n"))
        .groupBy(name)
        .agg(F.sum("n").alias(users))
    )


def daily_users(bitmaps: DataFrame) -> DataFrame:
    return _count(bitmaps, F.col("date"), "date", "users")


def monthly_users(bitmaps: DataFrame) -> DataFrame:
    """Distinct ids per calendar month."""
    return _count(bitmaps, F.date_format("date", "yyyy-MM"), "month", "users")


def users_between(bitmaps: DataFrame, first: str, last: str) -> DataFrame:
    """One row: distinct ids from ``first`` to ``last``, both included; 0 if there are none."""
    inside = bitmaps.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    per_bucket = inside.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n"))
    return per_bucket.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("users"))


def rolling_users(bitmaps: DataFrame, widths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per calendar day, the distinct ids of the last ``widths`` days, the day included.

    A bucket's days are one ordered stream with the days between filled in; windows of
    different width slide along it together.  Its rows are bounded by the calendar, and a
    bitmap is shuffled once, whatever the widths.  Days on which no window holds anybody
    have no row; nothing is reported after the last day with an event.
    """
    longest = max(widths)
    last_day = bitmaps.agg(F.max("date").alias("last")).scalar()
    days = bitmaps.groupBy("bucket").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    until = F.least(F.date_add("last", longest - 1), last_day)
    asked = days.select("bucket", F.explode(F.sequence("first", until)).alias("date"), F.lit(True).alias("asked"))
    stream = bitmaps.unionByName(asked, allowMissingColumns=True).withColumn("day", F.unix_date("date"))
    by_day = Window.partitionBy("bucket").orderBy("day")
    rolled = stream.select(
        "date",
        "asked",
        *[
            F.bitmap_count(F.bitmap_or_agg("users").over(by_day.rangeBetween(1 - width, 0))).alias(f"users_{width}d")
            for width in widths
        ],
    )
    counted = rolled.where("asked").groupBy("date").agg(*[F.sum(f"users_{w}d").alias(f"users_{w}d") for w in widths])
    return counted.where(F.col(f"users_{longest}d") > 0)
