"""Properties that a right fit has, as rows that SQL can state: every flag is computed from the
full fit on all rows, and turns false for a model that lacks the property."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models import churn, lifetime, metrics, segments
from tidemark.models.importance import vector_names
from tidemark.models.split import test_part, train_part, train_test_split
from tidemark.operators import decisions

GRADIENT = 1e-3  # of the mean loss, per coefficient on standardised features
CENTRE = 1e-2  # in standard deviations


def same_predictions(rows: DataFrame, pairs: list[tuple[PipelineModel, PipelineModel]], outputs: list[str]) -> DataFrame:
    """(customer_id, same): whether every two models give a row the same outputs."""

    def value(name: str):
        return vector_to_array(name) if name == "probability" else F.col(name).cast("double")

    judged = rows.select("customer_id")
    for number, ((first, second), output) in enumerate(zip(pairs, outputs)):
        a = first.transform(rows).select("customer_id", value(output).alias(f"a{number}"))
        b = second.transform(rows).select("customer_id", value(output).alias(f"b{number}"))
        judged = judged.join(a, "customer_id").join(b, "customer_id")
    same = reduce(lambda x, y: x & y, [F.col(f"a{i}") == F.col(f"b{i}") for i in range(len(pairs))])
    return judged.select("customer_id", same.alias("same"))


def stationary(rows: DataFrame, model: PipelineModel, seed: int = 42) -> DataFrame:
    """(feature, stationary): the penalised mean loss has no slope along the coefficient."""
    train = train_part(train_test_split(rows, churn.LABEL, seed=seed))
    sizes = {row[churn.LABEL]: row["count"] for row in train.groupBy(churn.LABEL).count().collect()}
    weighed = train.withColumns({"label": F.col(churn.LABEL).cast("double"), "weight": churn.balanced_weight(sizes)})
    scored = model.transform(weighed)
    names = vector_names(scored, "raw_features")
    fitted = model.stages[-1]
    error = F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))
    slopes = (
        scored.select(error.alias("error"), F.posexplode(vector_to_array("features")).alias("place", "x"))
        .groupBy("place")
        .agg((F.sum(F.col("error") * F.col("x")) / F.lit(float(sum(sizes.values())))).alias("slope"))
    )
    known = [(i, name, float(b)) for i, (name, b) in enumerate(zip(names, fitted.coefficients.toArray()))]
    table = rows.sparkSession.createDataFrame(known, "place int, feature string, coefficient double")
    slope = F.col("slope") + F.lit(fitted.getRegParam()) * F.col("coefficient")
    return table.join(slopes, "place").select("feature", (F.abs(slope) < GRADIENT).alias("stationary"))


def beats_constant(rows: DataFrame, model: PipelineModel, label: str, stratum: str | None, seed: int = 42) -> DataFrame:
    """(test_rows, better): on the test part the model's squared error is below that of the training mean."""
    parts = train_test_split(rows, stratum, seed=seed)
    mean = train_part(parts).agg(F.avg(label)).first()[0]
    scored = model.transform(test_part(parts))
    guess = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.agg(
        F.count(F.lit(1)).alias("test_rows"),
        (F.sum(F.pow(F.col(label) - guess, 2)) < F.sum(F.pow(F.col(label) - F.lit(mean), 2))).alias("better"),
    )


def settled(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """(customer_id, nearest, centred): the row's centre is the nearest, and is the mean of its rows."""
    centres = [[float(v) for v in centre] for centre in model.stages[-1].clusterCenters()]
    labelled = model.transform(rows).select("customer_id", "segment", vector_to_array("scaled").alias("x"))
    table = F.array(*[F.array(*map(F.lit, centre)) for centre in centres])

    def distance(centre):
        return F.aggregate(F.zip_with("x", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    least = F.array_min(F.transform(table, distance))
    means = (
        labelled.select("segment", F.posexplode("x").alias("place", "v"))
        .groupBy("segment", "place")
        .agg(F.avg("v").alias("mean"))
        .groupBy("segment")
        .agg(F.max(F.abs(F.col("mean") - table[F.col("segment")][F.col("place")])).alias("off"))
    )
    return labelled.join(F.broadcast(means), "segment").select(
        "customer_id",
        (distance(table[F.col("segment")]) <= least + 1e-9).alias("nearest"),
        (F.col("off") < CENTRE).alias("centred"),
    )


def sound_importances(importances: DataFrame) -> DataFrame:
    """(feature, sound): not negative, and all of them add up to one."""
    total = importances.agg(F.sum("importance")).first()[0]
    return importances.select("feature", ((F.col("importance") >= 0) & F.lit(abs(total - 1) < 1e-6)).alias("sound"))


def tiers_agree(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """(customer_id, agrees): the published tier is that of the model's unrounded probability."""
    raw = model.transform(rows).select("customer_id", vector_to_array("probability")[1].alias("p"))
    published = churn.predict_churn(rows, model).select("customer_id", "risk_tier", "churn_probability")
    right = F.col("risk_tier").eqNullSafe(decisions.risk_tier(F.col("p"))) & (
        F.abs(F.col("churn_probability") - F.col("p")) <= 0.00005 + 1e-12
    )
    return published.join(raw, "customer_id").select("customer_id", right.alias("agrees"))


def best_is_higher(result: churn.ChurnTraining) -> DataFrame:
    """(model, right): the better area under the curve is that of the chosen model."""
    top = result.metrics.agg(F.max("auc_roc")).first()[0]
    chosen = F.col("model") == result.best_model
    return result.metrics.select("model", (~chosen | (F.col("auc_roc") == top)).alias("right"))


def recomputed(rows: DataFrame, result: lifetime.LifetimeTraining, seed: int = 42) -> DataFrame:
    """(metric, agrees): the training's figures are those of the model on the test part."""
    test = test_part(train_test_split(rows.select("customer_id", "total_spend", *lifetime.LTV_FEATURES), seed=seed))
    again = metrics.regression_metrics(result.model.transform(test)).first()
    return result.metrics.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), (F.abs(F.col(m) - again[m]) < 1e-6).alias("agrees"))
                    for m in ("mae", "r2")
                ]
            )
        )
    )


def complete_profiles(result: segments.Segmentation) -> DataFrame:
    """(segments, customers, named): number of segments, their sizes' sum, all have a name."""
    return result.profiles.agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("size").alias("customers"),
        (F.count_if(F.col("segment_name").isNull()) == 0).alias("named"),
    )


def report_agrees(result) -> DataFrame:
    """(metric, agrees): figures of the pipeline's report against sums over its recommendations."""
    at_risk = F.col("risk_tier").isin("High", "Medium")

    def total(name: str):
        return F.coalesce(F.sum(F.when(at_risk, F.col(name))), F.lit(0.0))

    sums = result.recommendations.agg(
        F.count(F.lit(1)).cast("double").alias("total_customers"),
        F.count_if(F.col("risk_tier") == "High").cast("double").alias("high_risk_count"),
        total("annual_risk_value").alias("total_revenue_at_risk"),
        total("intervention_cost").alias("total_intervention_cost"),
        total("expected_save_value").alias("total_expected_savings"),
    )
    long = sums.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("want")) for c in sums.columns]))
    )
    found = result.summary.where("stage = 'report'").select("metric", "value")
    return long.join(found, "metric", "left").select(
        "metric", F.coalesce(F.abs(F.col("value") - F.col("want")) < 0.01, F.lit(False)).alias("agrees")
    )
