"""Feature importances as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def vector_names(df: DataFrame, column: str) -> list[str]:
    """Names of a vector column's slots, from the metadata the assembler left."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"].values()
    return [slot["name"] for slot in sorted((s for g in groups for s in g), key=lambda s: s["idx"])]


def importance_rows(df: DataFrame, names: list[str], importances) -> DataFrame:
    rows = [(name, float(value)) for name, value in zip(names, importances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")
