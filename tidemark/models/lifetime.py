"""Lifetime-value regression by gradient-boosted trees."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import dealt_by, durable, partitions_for
from tidemark.functions.rounding import round_even
from tidemark.models.importance import importance_rows
from tidemark.models.metrics import regression_metrics
from tidemark.models.split import test_part, train_part, train_test_split

# Regression features.
LTV_FEATURES = [
    "tenure_days",
    "age",
    "num_transactions",
    "total_events",
    "login_count",
    "feature_use_count",
    "current_mrr",
    "plan_encoded",
    "events_last_30d",
]


class LifetimeTraining(NamedTuple):
    model: PipelineModel
    metrics: DataFrame
    feature_importances: DataFrame


def train_ltv_model(
    features: DataFrame,
    rounds: int = 200,
    max_depth: int = 5,
    rate: float = 0.1,
    seed: int = 42,
    partitions: int = 8,
    folder: str | None = None,
) -> LifetimeTraining:
    """Predict total spend; ``features`` is read several times: pass a materialised frame.

    ``partitions`` and ``folder`` are those of ``train_churn_model``.
    """
    rows = features.select("customer_id", "total_spend", *LTV_FEATURES)
    parts = durable(train_test_split(rows, seed=seed), folder)
    train, test = train_part(parts), test_part(parts)
    assembler = VectorAssembler(inputCols=LTV_FEATURES, outputCol="features")
    boosted = GBTRegressor(
        labelCol="total_spend", maxIter=rounds, maxDepth=max_depth, stepSize=rate, seed=seed
    ).fit(
        dealt_by(
            assembler.transform(train).select("customer_id", "total_spend", "features"),
            "customer_id",
            partitions_for(train.count(), partitions),
        )
    )
    model = PipelineModel([assembler, boosted])
    return LifetimeTraining(
        model,
        regression_metrics(model.transform(test)),
        importance_rows(features, LTV_FEATURES, boosted.featureImportances),
    )


def predict_ltv(features: DataFrame, model: PipelineModel) -> DataFrame:
    """(customer_id, total_spend, predicted_ltv, expected_growth): predictions in cents, none below zero."""
    predicted = round_even(F.greatest(F.col("prediction"), F.lit(0.0)), 2)
    return (
        model.transform(features)
        .select("customer_id", "total_spend", predicted.alias("predicted_ltv"))
        .withColumn("expected_growth", round_even(F.col("predicted_ltv") - F.col("total_spend"), 2))
    )
