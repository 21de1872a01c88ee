from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.rounding import divide_half_up, mean_dollars, percent_2dp, ratio_2dp, round_even


def _half_up(value: Decimal, step: str) -> Decimal:
    return value.quantize(Decimal(step), rounding=ROUND_HALF_UP)


def test_integer_ratios_round_half_away_from_zero(spark):
    pairs = [(n, d) for n in range(-45, 46) for d in (-7, -4, -2, 1, 2, 3, 8, 200)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint").select(
        "n",
        "d",
        divide_half_up(F.col("n"), F.col("d")).alias("q"),
        ratio_2dp(F.col("n"), F.col("d")).alias("r"),
        percent_2dp(F.col("n"), F.col("d")).alias("p"),
    )
    for row in df.collect():
        exact = Decimal(row.n) / Decimal(row.d)
        assert row.q == int(_half_up(exact, "1")), row
        assert row.r == float(_half_up(exact, "0.01")), row
        assert row.p == float(_half_up(exact * 100, "0.01")), row


def test_zero_divisor_is_null(spark):
    df = spark.createDataFrame([(5, 0), (None, 3)], "n bigint, d bigint")
    found = df.select(mean_dollars(F.col("n"), F.col("d")).alias("x")).collect()
    assert [r.x for r in found] == [None, None]


def test_large_totals_do_not_overflow(spark):
    df = spark.createDataFrame([(3 * 10**17, 2 * 10**17)], "n bigint, d bigint")
    assert df.select(percent_2dp(F.col("n"), F.col("d")).alias("x")).first().x == 150.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=50), st.sampled_from([0, 1, 2, 4]))
def test_round_even_is_array_rounding(spark, values, digits):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r.x for r in df.select(round_even(F.col("v"), digits).alias("x")).collect()]
    assert found == list(np.round(np.array(values), digits))
