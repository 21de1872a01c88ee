"""Exact rounding and money arithmetic.

Two rules, used everywhere:

* Reports round ratios half away from zero.  They are computed on whole cents and
  counts, so no binary fraction ever decides a tie.
* Frame-style columns (features, scores, decisions) round the scaled double half to
  even, which is what array libraries do.

Money is summed as DECIMAL or integer cents and turned into DOUBLE only at the end, so
a result does not depend on how the rows were partitioned.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """A money amount with two decimals, as whole cents."""
    return (amount * 100).cast("bigint")


def total_cents(column: str) -> Column:
    """Sum of a money column in cents.

    The rows are converted before the sum: adding BIGINTs is about twice as fast as
    adding DECIMAL(22,2) and shuffles 8 bytes.  A total beyond BIGINT raises an error
    under ANSI mode.
    """
    return F.sum(cents(F.col(column)))


def dollars(whole_cents: Column) -> Column:
    return whole_cents.cast("double") / F.lit(100.0)


def divide_half_up(num: Column, den: Column) -> Column:
    """Integer quotient rounded half away from zero; NULL for a zero divisor.

    Works on DECIMAL(38,0): at full scale a month of revenue in cents times 10,000 no
    longer fits a BIGINT.
    """
    n = num.cast("decimal(38,0)")
    d = F.nullif(den.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    size = F.call_function("div", F.abs(n) * 2 + F.abs(d), F.abs(d) * 2)
    return F.when((n < 0) != (d < 0), -size).otherwise(size)


def mean_dollars(total_cents: Column, count: Column) -> Column:
    """Money mean, two decimals."""
    return dollars(divide_half_up(total_cents, count))


def ratio_2dp(num: Column, den: Column) -> Column:
    """``num / den`` of two integers, two decimals."""
    return divide_half_up(num.cast("decimal(38,0)") * 100, den).cast("double") / F.lit(100.0)


def percent_2dp(num: Column, den: Column) -> Column:
    """``num / den`` of two integers as a percentage, two decimals."""
    return divide_half_up(num.cast("decimal(38,0)") * 10000, den).cast("double") / F.lit(100.0)


def round_even(value: Column, digits: int) -> Column:
    """Half-to-even rounding of the scaled double."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)
