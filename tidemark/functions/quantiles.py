"""Exact quantiles that never bring a whole group into one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation
buffer.  With a handful of groups over all customers that buffer is the whole table.
Here a mergeable sketch first brackets each wanted rank; a second pass counts the rows
below the bracket, keeps the values inside it (a few hundredths of a percent of the
rows) and reads the exact order statistics from those counts.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BELOW, INSIDE, ABOVE = 0, 1, 2


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated quantiles: one row (``*keys``, ``p``, ``quantile``) per group and prob.

    ``keys`` must be enumerated columns (a status, a metric name): the bracket table has
    one row per key combination and is broadcast.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("exact_quantiles needs at least one key")
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())

    margin = 2.0 / accuracy
    low = [max(p - margin, 0.0) for p in probs]
    high = [min(p + margin, 1.0) for p in probs]
    brackets = (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("v", low, accuracy).alias("lows"),
            F.percentile_approx("v", high, accuracy).alias("highs"),
        )
        .withColumn("probs", F.array(*[F.lit(float(p)) for p in probs]))
        .select(*keys, "n", F.explode(F.arrays_zip("probs", "lows", "highs")).alias("b"))
        .select(
            *[F.col(k).alias(f"b_{k}") for k in keys],
            "n",
            F.col("b.probs").alias("p"),
            F.col("b.lows").alias("lo"),
            F.col("b.highs").alias("hi"),
        )
    )

    same_group = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    zone = F.when(F.col("v") < F.col("lo"), BELOW).when(F.col("v") > F.col("hi"), ABOVE).otherwise(INSIDE)
    counted = (
        rows.join(F.broadcast(brackets), same_group)
        .withColumn("zone", zone)
        .withColumn("slot", F.when(F.col("zone") == INSIDE, F.col("v")))
        .groupBy(*keys, "p", "n", "zone", "slot")
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    )

    # Row r covers the 0-based ranks [first, last] of its group.  Below the bracket only
    # the last rank has a known value, above it only the first one.
    running = Window.partitionBy(*keys, "p").orderBy("zone", "slot").rowsBetween(Window.unboundedPreceding, 0)
    position = (F.col("n") - 1) * F.col("p")
    ranked = (
        counted.withColumn("last", F.sum("c").over(running) - 1)
        .withColumn("first", F.col("last") - F.col("c") + 1)
        .withColumn("position", position)
    )

    def value_at(rank):
        here = (F.col("first") <= rank) & (rank <= F.col("last"))
        known = (
            F.when(F.col("zone") == INSIDE, F.col("slot"))
            .when((F.col("zone") == BELOW) & (rank == F.col("last")), F.col("v_max"))
            .when((F.col("zone") == ABOVE) & (rank == F.col("first")), F.col("v_min"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        )
        return F.max(F.when(here, known))

    return (
        ranked.groupBy(*keys, "p")
        .agg(
            value_at(F.floor(F.col("position"))).alias("lower"),
            value_at(F.ceil(F.col("position"))).alias("upper"),
            F.max("position").alias("position"),
        )
        .select(
            *keys,
            "p",
            (
                F.col("lower")
                + (F.col("upper") - F.col("lower")) * (F.col("position") - F.floor("position"))
            ).alias("quantile"),
        )
    )
