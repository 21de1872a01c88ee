"""Quantile sketches that can be stored per day and merged, beside the exact quantiles.

A KLL sketch of size ``k`` holds a few multiples of k values, whatever it has seen.  While
it has seen at most k values it is exact; beyond that the rank of what it returns is off
by at most about ``rank_error(k)`` of the rows, with 99 % certainty, also after merges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_K = 4096


def rank_error(k: int = DEFAULT_K) -> float:
    """The sketch's published bound for the rank of one quantile, as a share of the rows."""
    return 2.296 / k**0.9021


def daily_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = DEFAULT_K) -> DataFrame:
    """One row per combination of ``keys`` (such as a day and a category): ``sketch`` and its ``rows``.

    Sketches are built on the map side and merged, so a large group is one row per task.
    Missing values don't count.
    """
    number = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.kll_sketch_agg_double(number, k).alias("sketch"), F.count(F.lit(1)).alias("rows")
    )


def merged_quantiles(
    sketches: DataFrame, keys: dict[str, Column], probs: Sequence[float], k: int = DEFAULT_K
) -> DataFrame:
    """(keys, rows, p, quantile) of stored sketches, merged by ``keys`` (named columns of theirs).

    A quantile is the smallest value whose share of rows up to it is ``p`` or more, as far
    as the sketch can tell.
    """
    named = [column.alias(name) for name, column in keys.items()]
    whole = sketches.groupBy(*named).agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("rows").alias("rows")
    )
    ranks = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probs]
    return whole.select(*keys, "rows", F.inline(F.array(*ranks)))
