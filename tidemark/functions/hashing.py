"""Hashes that depend on the value and a seed alone, and that other engines can compute too."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_number(key: str, seed: int) -> Column:
    """The first 32 bits of the MD5 of ``key:seed`` as a number."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
