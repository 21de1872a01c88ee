"""What a model was trained on, kept beside it, and how far scored rows have moved from it.

A profile counts rows per feature and part: a bin of a number, a level of a category.  It has a
bounded number of rows whatever the number of customers, is one scan for the ranges and one for
the counts, and is stored with the model.  A report counts the scored rows in the same parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.store import load_model, save_model
from tidemark.operators.bins import bin_widths

MISSING = "(missing)"
UNSEEN = "(unseen)"
# The usual limits of the stability index.
SHIFTED, MOVING = 0.25, 0.1


def _cells(rows: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(feature, value, level): a row per customer and feature."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("level"))
        for c in numbers
    ] + [
        F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("level"))
        for c in categories
    ]
    return rows.select(F.inline(F.array(*cells)))


def _part() -> Column:
    """The part a cell is in; a number beyond the ranges of the training is unseen."""
    place = F.floor(F.col("value") / F.col("width"))
    inside = place.between(F.col("first_bin"), F.col("last_bin"))
    number = F.when(inside, place.cast("string")).when(place.isNotNull(), F.lit(UNSEEN))
    return F.coalesce(number, "level", F.lit(MISSING))


def feature_profile(rows: DataFrame, numbers: Sequence[str], categories: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(feature, width, first_bin, last_bin, part, rows) of the rows a model is trained on.

    Numbers have at most ``bins`` + 1 bins of a readable width; missing values and levels are
    parts of their own.  ``rows`` is read twice: pass a materialised frame.  Without rows
    there is no profile.
    """
    # One row per number, so the widths may be broadcast.
    widths = F.broadcast(bin_widths(rows, list(numbers), bins).withColumnRenamed("metric", "feature"))
    cells = _cells(rows, numbers, categories).join(widths, "feature", "left")
    return cells.groupBy("feature", "width", "first_bin", "last_bin", _part().alias("part")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def drift_report(profile: DataFrame, rows: DataFrame, numbers: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """(feature, trained_rows, scored_rows, unseen_rows, stability_index, verdict), a row per feature.

    The stability index adds up (q - p) ln(q / p) over the parts of a feature, half a row added to
    each part so that empty ones count.  Unseen are levels and numbers that the profile's rows
    did not have.  Without scored rows the index is null.
    """
    # As many rows as there are numbers.
    widths = F.broadcast(
        profile.where(F.col("width").isNotNull()).select("feature", "width", "first_bin", "last_bin").distinct()
    )
    counted = (
        _cells(rows, numbers, categories)
        .join(widths, "feature", "left")
        .groupBy("feature", _part().alias("part"))
        .agg(F.count(F.lit(1)).alias("scored"))
    )
    known = profile.where(F.col("feature").isin([*numbers, *categories])).select(
        "feature", "part", F.col("rows").alias("trained")
    )
    parts = known.join(counted, ["feature", "part"], "full").na.fill(0, ["trained", "scored"])
    # A level the training lacks is one of the unseen, whatever its name.
    merged = (
        parts.withColumn("part", F.when(F.col("trained") == 0, F.lit(UNSEEN)).otherwise(F.col("part")))
        .groupBy("feature", "part")
        .agg(F.sum("trained").alias("trained"), F.sum("scored").alias("scored"))
    )
    totals = merged.groupBy("feature").agg(
        F.sum("trained").alias("trained_rows"),
        F.sum("scored").alias("scored_rows"),
        F.sum(F.when(F.col("trained") == 0, F.col("scored")).otherwise(0)).alias("unseen_rows"),
        F.count(F.lit(1)).alias("parts"),
    )
    p = (F.col("trained") + 0.5) / (F.col("trained_rows") + 0.5 * F.col("parts"))
    q = (F.col("scored") + 0.5) / (F.col("scored_rows") + 0.5 * F.col("parts"))
    index = F.when(F.first("scored_rows") > 0, F.round(F.sum((q - p) * F.log(q / p)), 6))
    return (
        merged.join(totals, "feature")
        .groupBy("feature")
        .agg(
            F.first("trained_rows").alias("trained_rows"),
            F.first("scored_rows").alias("scored_rows"),
            F.first("unseen_rows").alias("unseen_rows"),
            index.alias("stability_index"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("stability_index") >= SHIFTED, "shifted")
            .when(F.col("stability_index") >= MOVING, "moving")
            .when(F.col("stability_index").isNotNull(), "stable"),
        )
    )


def save_scorer(model: PipelineModel, profile: DataFrame, folder: str) -> None:
    """The model and the profile of its training rows, in one folder."""
    save_model(model, f"{folder}/model")
    profile.write.mode("overwrite").parquet(f"{folder}/profile")


def load_scorer(spark: SparkSession, folder: str) -> tuple[PipelineModel, DataFrame]:
    return load_model(f"{folder}/model"), spark.read.parquet(f"{folder}/profile")
