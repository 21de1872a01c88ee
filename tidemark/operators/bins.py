"""Histograms of several metrics with readable edges, in two scans whatever their number.

The first scan finds the range of every metric; from it each gets a bin width of 1, 2 or 5
times a power of ten.  The second counts rows per metric and bin.  Widths are joined as one
row per metric, and empty bins between the first and the last are shown with 0 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = (1, 2, 5, 10)


def nice_width(spread: Column, bins: int) -> Column:
    """The least of 1, 2 and 5 times a power of ten that covers ``spread`` in ``bins`` steps; 1 for no spread."""
    exact = spread / F.lit(float(bins))
    power = F.pow(F.lit(10.0), F.floor(F.log10(exact)))
    fitting = F.coalesce(*[F.when(power * F.lit(float(s)) >= exact, power * F.lit(float(s))) for s in STEPS])
    return F.when(spread > 0, fitting).otherwise(F.lit(1.0))


def bin_widths(rows: DataFrame, metrics: list[str], bins: int) -> DataFrame:
    """(metric, width, first_bin, last_bin) of the metrics that have values; one scan for all."""
    numbers = {m: F.col(m).cast("double") for m in metrics}
    ends = rows.agg(
        *[F.min(value).alias(f"low_{m}") for m, value in numbers.items()],
        *[F.max(value).alias(f"high_{m}") for m, value in numbers.items()],
    )
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"low_{m}").alias("low"), F.col(f"high_{m}").alias("high")) for m in metrics]
    widths = ends.select(F.inline(F.array(*cells))).where(F.col("low").isNotNull())
    sized = widths.withColumn("width", nice_width(F.col("high") - F.col("low"), bins))
    return sized.select(
        "metric",
        "width",
        F.floor(F.col("low") / F.col("width")).alias("first_bin"),
        F.floor(F.col("high") / F.col("width")).alias("last_bin"),
    )


def nice_histograms(rows: DataFrame, metrics: list[str], bins: int = 20) -> DataFrame:
    """(metric, bin_start, bin_end, rows): rows per bin of all metrics, empty bins included.

    A bin holds its lower edge and not its upper one.  There are at most ``bins`` + 1 bins
    a metric.  Missing values are in no bin; a metric without values has no row.  ``rows``
    is read twice: pass a materialised frame.
    """
    # One row per metric, so the widths may be broadcast.
    widths = F.broadcast(bin_widths(rows, metrics, bins))
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    values = rows.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    counted = (
        values.join(widths, "metric")
        .groupBy("metric", F.floor(F.col("value") / F.col("width")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("found"))
    )
    listed = widths.select("metric", "width", F.explode(F.sequence("first_bin", "last_bin")).alias("bin"))
    return listed.join(counted, ["metric", "bin"], "left").select(
        "metric",
        (F.col("bin") * F.col("width")).alias("bin_start"),
        ((F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("found", F.lit(0)).cast("long").alias("rows"),
    )
