"""Fitting independent models side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

HELD_ROWS = 4_000_000  # that fits side by side may keep as objects, each all of its rows


def fit_all(spark: SparkSession, fits: Iterable[Callable], threads: int = 4) -> list:
    """Run the fits as concurrent Spark jobs; late stages of one fill the gaps of another."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda fit: fit()), list(fits))


def fits_at_once(rows: int, most: int = 4) -> int:
    """``most``, or as many as keep HELD_ROWS rows; large fits keep all cores busy one by one."""
    return max(1, min(most, HELD_ROWS // max(rows, 1)))
