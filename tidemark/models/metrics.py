"""Evaluation of scored rows, as DataFrames."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import round_even


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def _confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    return scored.agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )


def classification_report(scored: DataFrame, label: str = "is_churned", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    counts = _confusion(scored, label, prediction)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    negatives, positives, rows = tn + fp, tp + fn, tp + fp + fn + tn
    zero = [_safe_ratio(tn, tn + fn), _safe_ratio(tn, negatives), _safe_ratio(2 * tn, 2 * tn + fn + fp)]
    one = [_safe_ratio(tp, tp + fp), _safe_ratio(tp, positives), _safe_ratio(2 * tp, 2 * tp + fp + fn)]
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [_safe_ratio(a * negatives + b * positives, rows) for a, b in zip(zero, one)]
    accuracy = [_safe_ratio(tp + tn, rows)] * 3

    def line(name: str, scores: list[Column], support: Column) -> Column:
        precision, recall, f1 = scores
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    lines = [
        line("0", zero, negatives),
        line("1", one, positives),
        line("accuracy", accuracy, rows),
        line("macro avg", macro, rows),
        line("weighted avg", weighted, rows),
    ]
    return counts.select(F.inline(F.array(*lines)))


def auc_roc(scored: DataFrame, label: str = "is_churned", score: str = "probability") -> float:
    """Exact area under the curve (no down-sampling of the thresholds)."""
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0
    )
    return evaluator.evaluate(scored.withColumn(label, F.col(label).cast("double")))


def churn_metrics(
    scored: DataFrame,
    model: str,
    label: str = "is_churned",
    prediction: str = "prediction",
    score: str = "probability",
) -> DataFrame:
    """AUC and the F1 of the churned class, four decimals."""
    area = auc_roc(scored, label, score)
    f1 = _safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return _confusion(scored, label, prediction).select(
        F.lit(model).alias("model"),
        round_even(F.lit(area), 4).alias("auc_roc"),
        round_even(f1, 4).alias("f1"),
    )


def regression_metrics(scored: DataFrame, label: str = "total_spend", prediction: str = "prediction") -> DataFrame:
    """Mean absolute error (2 decimals) and R squared (4 decimals)."""
    error = F.col(label) - F.col(prediction)
    fit = F.lit(1.0) - F.sum(error * error) / F.nullif(F.var_pop(label) * F.count(label), F.lit(0.0))
    return scored.agg(
        round_even(F.avg(F.abs(error)), 2).alias("mae"),
        round_even(fit, 4).alias("r2"),
    )
