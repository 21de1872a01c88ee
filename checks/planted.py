"""Models trained on planted answers: every customer's best prediction is known and SQL can state it.

What is planted lies far outside the rest of a feature: a remainder of the customer's own value for
groups, the feature's number for trees, where a rare value beside a split could fall to either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models import churn, lifetime, segments
from tidemark.models.store import load_model, save_model
from tidemark.operators.features import NUMERIC_FEATURES

ROUNDS = 10  # of boosting; the first tree already finds the planted value


def _numbered(rows: DataFrame, names: list[str], step: Column) -> DataFrame:
    """Each named feature is ``step`` plus its place in the list, in its own type."""
    own = rows.schema
    return rows.withColumns({n: (step + F.lit(i)).cast(own[n].dataType) for i, n in enumerate(names)})


def churn_rows(rows: DataFrame) -> DataFrame:
    """Every third customer churns, and each feature tells."""
    leaves = F.col("customer_id") % 3 == 0
    marked = _numbered(rows, NUMERIC_FEATURES, F.when(leaves, 100).otherwise(0))
    level = F.when(leaves, "gone").otherwise("here")
    return marked.withColumns(
        {"is_churned": leaves.cast(rows.schema["is_churned"].dataType)} | {name: level for name in churn.CATEGORIES}
    )


def segment_rows(rows: DataFrame) -> DataFrame:
    """Four groups of customers, a thousand apart in each feature."""
    own, step = rows.schema, F.col("customer_id") % 4 * 1000
    remainder = {n: F.floor(F.abs(F.coalesce(n, F.lit(0)))) % 5 for n in segments.SEGMENT_FEATURES}
    return rows.withColumns({n: (step + rest).cast(own[n].dataType) for n, rest in remainder.items()})


def value_rows(rows: DataFrame) -> DataFrame:
    """Eight levels of spend, and each feature tells the level."""
    level = F.col("customer_id") % 8
    spend = (level * 100 + 25).cast(rows.schema["total_spend"].dataType)
    return _numbered(rows, lifetime.LTV_FEATURES, level * 100).withColumn("total_spend", spend)


def churn_scores(rows: DataFrame, result: churn.ChurnTraining, path: str) -> DataFrame:
    """Published scores of the chosen model, saved and loaded again."""
    save_model(result.models[result.best_model], path)
    return churn.predict_churn(rows, load_model(path))


def churn_ratings(result: churn.ChurnTraining) -> DataFrame:
    """Metrics of both models, and which is chosen."""
    return result.metrics.withColumn("chosen", F.col("model") == result.best_model)


def segments_of_customers(rows: DataFrame, path: str) -> DataFrame:
    """Each customer's segment name and that segment's profile, by a model loaded from disk."""
    result = segments.train_segmentation(rows)
    save_model(result.model, path)
    named = segments.assign_segments(rows, load_model(path), result.profiles)
    profiles = result.profiles.drop("segment_name")
    return named.join(F.broadcast(profiles), "segment").drop("segment")  # one row per cluster


def value_scores(rows: DataFrame, result: lifetime.LifetimeTraining, path: str) -> DataFrame:
    """Predicted value and growth by a model loaded from disk."""
    save_model(result.model, path)
    return lifetime.predict_ltv(rows, load_model(path))
