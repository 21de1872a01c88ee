"""Customer segments by k-means on behaviour and value."""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.durable import dealt_by, partitions_for
from tidemark.functions.rounding import round_even
from tidemark.models.parallel import fit_all, fits_at_once
from tidemark.models.scaling import fit_scaler

# Clustered features and, in name_segments, the segment names.
SEGMENT_FEATURES = [
    "tenure_days",
    "total_spend",
    "num_transactions",
    "total_events",
    "login_count",
    "feature_use_count",
    "events_last_30d",
    "current_mrr",
]


class Segmentation(NamedTuple):
    model: PipelineModel
    silhouette: DataFrame
    profiles: DataFrame


def train_segmentation(
    features: DataFrame, n_clusters: int = 4, restarts: int = 10, seed: int = 42, partitions: int = 8
) -> Segmentation:
    """Best of ``restarts`` k-means runs on all customers, with its silhouette and profiles.

    ``features`` is read several times: pass a materialised frame.  ``partitions`` is that
    of ``train_churn_model``.
    """
    scaler = fit_scaler(features, SEGMENT_FEATURES)
    rows = features.count()
    scaled = dealt_by(
        scaler.transform(features).select("customer_id", "scaled"),
        "customer_id",
        partitions_for(rows, partitions),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    shared = {"k": n_clusters, "maxIter": 300, "tol": 1e-4, "featuresCol": "scaled", "predictionCol": "segment"}
    starts = [KMeans(seed=seed + i, **shared) for i in range(restarts)]
    # A frame that is not kept itself: each fit then keeps its vectors as objects and decodes the table once, not in each pass.
    vectors = scaled.select("scaled")
    runs = fit_all(
        features.sparkSession, [partial(start.fit, vectors) for start in starts], threads=fits_at_once(rows)
    )
    best = min(runs, key=lambda run: run.summary.trainingCost)
    scaled.unpersist()
    model = PipelineModel([scaler, best])
    labelled = model.transform(features)
    return Segmentation(model, silhouette(labelled), name_segments(segment_profiles(labelled)))


def silhouette(labelled: DataFrame) -> DataFrame:
    """Mean silhouette with squared Euclidean distances, whose cost is linear in the rows."""
    value = ClusteringEvaluator(
        featuresCol="scaled", predictionCol="segment", distanceMeasure="squaredEuclidean"
    ).evaluate(labelled)
    return labelled.sparkSession.createDataFrame([(round(value, 4),)], "silhouette_score double")


def segment_profiles(labelled: DataFrame) -> DataFrame:
    """Size and mean spend, events, revenue, churn and tenure per segment, two decimals."""

    def mean(column: str):
        # Exact decimal sums, so the last digit does not depend on partitioning.
        return round_even(F.sum(F.col(column).cast("decimal(28,2)")).cast("double") / F.count(column), 2)

    return labelled.groupBy("segment").agg(
        F.count("customer_id").alias("size"),
        mean("total_spend").alias("avg_spend"),
        mean("total_events").alias("avg_events"),
        mean("current_mrr").alias("avg_mrr"),
        mean("is_churned").alias("churn_rate"),
        mean("tenure_days").alias("avg_tenure"),
    )


def name_segments(profiles: DataFrame) -> DataFrame:
    """Name each segment by spend against the median segment and churn against 20 %.

    Both comparisons use the rounded profile; two segments may get one name.
    """
    # One row per segment, so the unpartitioned window is a handful of rows.
    typical = F.median("avg_spend").over(Window.partitionBy())
    rich, leaving = F.col("avg_spend") > F.col("typical_spend"), F.col("churn_rate") >= 0.2
    name = (
        F.when(rich & ~leaving, "High-Value Loyal")
        .when(rich & leaving, "High-Value At Risk")
        .when(~rich & ~leaving, "Growth Potential")
        .otherwise("Low-Value Churning")
    )
    return (
        profiles.withColumn("typical_spend", typical)
        .withColumn("segment_name", name)
        .drop("typical_spend")
        .orderBy("segment")
    )


def assign_segments(features: DataFrame, model: PipelineModel, profiles: DataFrame) -> DataFrame:
    """(customer_id, segment, segment_name) of every customer, also of ones the model never saw.

    ``profiles`` are the named profiles of the training, one row per cluster.  Ids stay as
    they are, repeated ones too.
    """
    names = F.broadcast(profiles.select("segment", "segment_name"))  # one row per cluster
    return model.transform(features).select("customer_id", "segment").join(names, "segment", "left").select(
        "customer_id", "segment", "segment_name"
    )
