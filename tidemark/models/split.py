"""Exact train/test shares without ranking a whole class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_number

BUCKETS = 65_521  # prime; also the bound on histogram rows per class


def train_test_split(
    df: DataFrame, label: str | None = None, share: float = 0.8, seed: int = 42, key: str = "customer_id"
) -> DataFrame:
    """Add ``is_train``: exactly floor(share * n) rows of each class of ``label``.

    Rows are ordered by (bucket of a hash of key and seed, key).  A histogram over the buckets
    finds the bucket that holds the cut, only that bucket is ranked, and the resulting
    cut (one row per class) decides every row without shuffling the table.  ``label``
    must be a class column; None means one class.
    """
    stratum = F.lit(0) if label is None else F.col(label)
    bucket = F.coalesce(F.pmod(seeded_number(key, seed), F.lit(BUCKETS)), F.lit(0))
    rows = df.withColumns({"_stratum": stratum, "_bucket": bucket})

    so_far = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.floor(F.sum("n").over(Window.partitionBy("_stratum")) * F.lit(share))
    cut_bucket = (
        rows.groupBy("_stratum", "_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"upto": F.sum("n").over(so_far), "wanted": wanted})
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select(
            "_stratum",
            F.col("_bucket").alias("cut_bucket"),
            (F.col("wanted") - F.col("upto") + F.col("n")).alias("take"),
        )
    )
    within = rows.select("_stratum", "_bucket", F.col(key).alias("cut_key")).join(
        F.broadcast(cut_bucket), "_stratum"
    ).where(F.col("_bucket") == F.col("cut_bucket"))
    cut = (
        within.withColumn(
            "position", F.row_number().over(Window.partitionBy("_stratum").orderBy("cut_key"))
        )
        .where(F.col("position") == F.col("take"))
        .select("_stratum", "cut_bucket", "cut_key")
    )
    below = (F.col("_bucket") < F.col("cut_bucket")) | (
        (F.col("_bucket") == F.col("cut_bucket")) & (F.col(key) <= F.col("cut_key"))
    )
    return (
        rows.join(F.broadcast(cut), "_stratum", "left")
        .withColumn("is_train", F.coalesce(below, F.lit(False)))
        .drop("_stratum", "_bucket", "cut_bucket", "cut_key")
    )


def train_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_train")).drop("is_train")


def test_part(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_train")).drop("is_train")
