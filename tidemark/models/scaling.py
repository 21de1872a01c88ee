"""Standardisation with the population standard deviation."""

from __future__ import annotations

from math import sqrt

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame


def scaling_stages(train: DataFrame, input_col: str, output_col: str) -> list:
    """Fitted stages that centre and scale ``input_col``.

    MLlib divides by the sample deviation; the product with sqrt(n / (n - 1)) turns that
    into the population deviation and, unlike a refit, can be saved in a pipeline.
    """
    n = train.count()
    sample_col = f"{output_col}_sample"
    scaler = StandardScaler(inputCol=input_col, outputCol=sample_col, withMean=True, withStd=True).fit(train)
    factor = sqrt(n / (n - 1)) if n > 1 else 1.0
    population = ElementwiseProduct(
        inputCol=sample_col, outputCol=output_col, scalingVec=Vectors.dense([factor] * scaler.mean.size)
    )
    return [scaler, population]


def fit_scaler(train: DataFrame, columns: list[str], output_col: str = "scaled") -> PipelineModel:
    assembler = VectorAssembler(inputCols=columns, outputCol="raw")
    return PipelineModel([assembler, *scaling_stages(assembler.transform(train), "raw", output_col)])
