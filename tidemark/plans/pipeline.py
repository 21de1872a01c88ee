"""The whole job: features, three models, scores, recommendations and the report.

    spark-submit --py-files ... tidemark/plans/pipeline.py --input DIR --output DIR

The feature matrix, the scores and the recommendations are written once and read back,
so every later step starts from files that outlive any executor.  Splits and test scores
go to ``<output>/work``.
"""

from __future__ import annotations

import argparse
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durable import shuffles_by_input
from tidemark.models import churn, lifetime, segments
from tidemark.models.store import save_model
from tidemark.operators import decisions, features
from tidemark.sources.tables import Tables, load_tables, save_table


class PipelineResult(NamedTuple):
    features: DataFrame
    scores: DataFrame
    recommendations: DataFrame
    report: DataFrame
    churn: churn.ChurnTraining
    segmentation: segments.Segmentation
    lifetime: lifetime.LifetimeTraining
    summary: DataFrame


def _written(df: DataFrame, path: str) -> DataFrame:
    save_table(df, path, mode="overwrite")
    return df.sparkSession.read.parquet(path)


def _long(df: DataFrame, stage: str, prefix: str | None = None) -> DataFrame:
    """One row per numeric column of a report: (stage, metric, value)."""
    names = [c for c, kind in df.dtypes if kind in ("double", "bigint", "int")]
    label = F.lit("") if prefix is None else F.concat(F.col(prefix).cast("string"), F.lit("."))
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names]
    return df.select(label.alias("prefix"), F.inline(F.array(*cells))).select(
        F.lit(stage).alias("stage"), F.concat("prefix", "name").alias("metric"), "value"
    )


def run_pipeline(
    tables: Tables,
    output: str,
    as_of: str = features.DEFAULT_AS_OF,
    seed: int = 42,
    num_trees: int = 200,
    ltv_rounds: int = 200,
    restarts: int = 10,
    observation_seed: int = 123,
) -> PipelineResult:
    """``seed`` is that of the splits and models, ``observation_seed`` that of the observation dates."""
    base = features.feature_base(tables, as_of, observation_seed)
    with shuffles_by_input(base):
        matrix = _written(base, f"{output}/features")

    work = f"{output}/work"
    churned = churn.train_churn_model(matrix, num_trees=num_trees, seed=seed, folder=work)
    best = churned.models[churned.best_model]
    save_model(best, f"{output}/models/churn")
    segmented = segments.train_segmentation(matrix, restarts=restarts, seed=seed)
    save_model(segmented.model, f"{output}/models/segmentation")
    valued = lifetime.train_ltv_model(matrix, rounds=ltv_rounds, seed=seed, folder=work)
    save_model(valued.model, f"{output}/models/ltv")

    scores = _written(churn.predict_churn(matrix, best), f"{output}/scores")
    recs = _written(decisions.recommendations(scores, tables.customers), f"{output}/recommendations")
    report = decisions.summary_report(recs)
    # Two segments may share a name, so the label starts with the number.
    named = segmented.profiles.withColumn("label", F.concat_ws(" ", "segment", "segment_name"))
    summary = (
        _long(churned.metrics, "churn", "model")
        .unionByName(_long(segmented.silhouette, "segmentation"))
        .unionByName(_long(named.drop("segment"), "segmentation", "label"))
        .unionByName(_long(valued.metrics, "ltv"))
        .unionByName(_long(report, "report"))
    )
    summary = _written(summary, f"{output}/summary")
    return PipelineResult(matrix, scores, recs, report, churned, segmented, valued, summary)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True, help="folder with the four tables")
    parser.add_argument("--output", required=True, help="folder for models and results")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--as-of", default=features.DEFAULT_AS_OF)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--trees", type=int, default=200)
    parser.add_argument("--ltv-rounds", type=int, default=200)
    parser.add_argument("--restarts", type=int, default=10)
    parser.add_argument("--observation-seed", type=int, default=123)
    options = parser.parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    result = run_pipeline(
        load_tables(spark, options.input, options.format),
        options.output,
        options.as_of,
        options.seed,
        options.trees,
        options.ltv_rounds,
        options.restarts,
        options.observation_seed,
    )
    result.summary.show(200, truncate=False)


if __name__ == "__main__":
    main()
