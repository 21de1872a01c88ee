"""Entry points of the checker: a flagship query, all queries, and their SQL twins."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from checks import oracle, planted, trained
from tidemark.functions.durable import durable, shuffles_by_input, work_folder
from tidemark.functions.dates import month_label, month_start
from tidemark.functions.rounding import round_even
from tidemark.functions.sketches import daily_sketches, merged_quantiles
from tidemark.models import churn, drift, lifetime, metrics, scaling, segments, split, spread
from tidemark.models.store import load_model, save_model
from tidemark.operators import analytics, audience, bins, decisions, features, history, profiling, quality, views
from tidemark.plans.pipeline import run_pipeline
from tidemark.sources import months, star, versioned
from tidemark.sources.tables import Tables

try:
    import corpus_pipeline
    import tidemark.llm.registry as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tidemark.llm", "tidemark.llm.registry"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

PROFILED = 42  # the customer of the one-customer profile
SMOKE_DIR = "/root/testdata/sf0.001"

_opened: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, build: Callable[[], object]):
    """Open tables and fitted models are shared by the queries of one session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _opened:
        _opened[key] = build()
    return _opened[key]


# --- inputs ------------------------------------------------------------------------

def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The (lazy) tables, opened once per session and data set."""
    return _once("tables", spark, sf_dir, lambda: star.tables_from_star(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_base(_tables(spark, sf_dir), star.AS_OF)


def _fixed_probability() -> Column:
    spot = F.col("customer_id") % 50
    return (
        F.when(spot == 0, F.lit(0.0))
        .when(spot == 1, F.lit(0.3))
        .when(spot == 2, F.lit(0.6))
        .otherwise((F.col("customer_id") * 37 % 1001) / F.lit(1000.0))
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with a deterministic score instead of a model's."""
    scored = _features(spark, sf_dir).withColumns(decisions.score_columns(_fixed_probability()))
    return scored.select(*churn.SCORE_COLUMNS)


def _recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.recommendations(_scores(spark, sf_dir), _tables(spark, sf_dir).customers)


def _priced(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        recs = decisions.priced(_scores(spark, sf_dir), _tables(spark, sf_dir).customers)
        return recs.select("customer_id", *columns)

    return query


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _fixed_probability()
    return _features(spark, sf_dir).select(
        "customer_id", "is_churned", p.alias("probability"), (p > 0.5).cast("double").alias("prediction")
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).withColumn("segment", F.col("customer_id") % 4)


def _profile_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.customer_360(_tables(spark, sf_dir), star.AS_OF)


def _training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = _features(spark, sf_dir)
        with shuffles_by_input(rows):
            return durable(rows)

    return _once("features", spark, sf_dir, build)


def _churn(spark: SparkSession, sf_dir: str) -> churn.ChurnTraining:
    return _once("churn", spark, sf_dir, lambda: churn.train_churn_model(_training_features(spark, sf_dir)))


def _segmentation(spark: SparkSession, sf_dir: str) -> segments.Segmentation:
    return _once(
        "segments", spark, sf_dir, lambda: segments.train_segmentation(_training_features(spark, sf_dir))
    )


DRIFTING = ["tenure_days", "total_spend", "num_transactions", "total_events", "events_last_30d"]


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churned customers against a profile of those who stay."""
    rows, levels = _training_features(spark, sf_dir), ["country", "acquisition_channel"]
    profile = durable(drift.feature_profile(rows.where("is_churned = 0"), DRIFTING, levels))
    return drift.drift_report(profile, rows.where("is_churned = 1"), DRIFTING, levels)


def _recent_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the 30 days up to each observation date, from the months they are in."""
    tables = _tables(spark, sf_dir)
    path = f"{work_folder(spark)}/events-{uuid.uuid4().hex}"
    months.save_by_month(tables.events, "events", path)
    observed = durable(features.observation_points(tables.customers, star.AS_OF))
    recent = months.load_until(spark, "events", path, observed, 30)
    counts = recent.groupBy("customer_id").agg(F.count(F.lit(1)).alias("events_last_30d"))
    return observed.join(counts, "customer_id", "left").select(
        "customer_id", F.coalesce("events_last_30d", F.lit(0)).cast("long").alias("events_last_30d")
    )


def _lifetime(spark: SparkSession, sf_dir: str) -> lifetime.LifetimeTraining:
    return _once(
        "lifetime",
        spark,
        sf_dir,
        lambda: lifetime.train_ltv_model(_training_features(spark, sf_dir)),
    )


# --- queries that need more than one call ---------------------------------------------

def _with_double_money(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("double"))


def _clicks_dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = star.click_events(star.read_star(spark, sf_dir, "events"))
    return analytics.daily_active_users(_tables(spark, sf_dir)._replace(events=clicks))


def _one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _tables(spark, sf_dir).customers
    prefixes = {"acquisition_channel": "channel", "country": "country"}
    wide = people.select("customer_id", *prefixes)
    for column, levels in features.category_levels(people, list(prefixes)).items():
        wide = features.one_hot(wide, column, prefixes[column], levels)
    return wide


def _plan_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    plans = features.latest_subscription_asof(
        t.subscriptions, features.observation_points(t.customers, star.AS_OF)
    )
    plan = F.coalesce("plan", F.lit("free"))
    return (
        t.customers.select("customer_id")
        .join(plans, "customer_id", "left")
        .select("customer_id", plan.alias("plan"), features.plan_code(plan).alias("plan_encoded"))
    )


def _stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.train_test_split(_training_features(spark, sf_dir), "is_churned")
    return parts.select("customer_id", "is_churned", "is_train")


def _standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = _training_features(spark, sf_dir)
    train = split.train_part(split.train_test_split(rows, "is_churned"))
    names = segments.SEGMENT_FEATURES
    scaled = scaling.fit_scaler(train, names).transform(rows)
    values = vector_to_array("scaled")
    # Adding 0.0 turns a negative zero into zero.
    return scaled.select(
        "customer_id", *[(round_even(values[i], 6) + F.lit(0.0)).alias(n) for i, n in enumerate(names)]
    )


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _churn(spark, sf_dir).models["RandomForest"]
    return trained.beats_constant(_training_features(spark, sf_dir), model, "is_churned", "is_churned")


def _logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trained.stationary(_training_features(spark, sf_dir), _churn(spark, sf_dir).models["LogisticRegression"])


def _churn_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the forest, whether or not it was the better model."""
    forest = _churn(spark, sf_dir).models["RandomForest"]
    return trained.sound_importances(churn.feature_importances(forest, _training_features(spark, sf_dir)))


def _predict_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _churn(spark, sf_dir)
    return trained.tiers_agree(_training_features(spark, sf_dir), result.models[result.best_model])


def _fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training_features(spark, sf_dir)
    scaled = scaling.fit_scaler(rows, segments.SEGMENT_FEATURES).transform(rows)
    return scaled.withColumn("segment", (F.col("customer_id") % 4).cast("int"))


def _silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fixed labels, whose silhouette has a closed form."""
    return segments.silhouette(_fixed_segments(spark, sf_dir))


def _euclidean_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the customers whose id is divisible by 100 against all."""
    return spread.euclidean_silhouette(_fixed_segments(spark, sf_dir), F.col("customer_id") % 100 == 0)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three models against what is saved of them and loaded again."""
    result = _churn(spark, sf_dir)
    fitted = [
        result.models[result.best_model],
        _segmentation(spark, sf_dir).model,
        _lifetime(spark, sf_dir).model,
    ]
    pairs = []
    for model in fitted:
        path = _scratch(spark, "model")
        save_model(model, path)
        pairs.append((model, load_model(path)))
    outputs = ["probability", "segment", "prediction"]
    return trained.same_predictions(_training_features(spark, sf_dir), pairs, outputs)


def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.col("total_spend") * (F.lit(0.9) + (F.col("customer_id") % 21) / F.lit(100.0))
    return metrics.regression_metrics(_features(spark, sf_dir).withColumn("prediction", guess))


def _ltv_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _lifetime(spark, sf_dir).model
    return trained.beats_constant(_training_features(spark, sf_dir), model, "total_spend", None)


def _customer_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trained.settled(_training_features(spark, sf_dir), _segmentation(spark, sf_dir).model)


def _planted_churn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, churn.ChurnTraining]:
    def fit() -> tuple[DataFrame, churn.ChurnTraining]:
        rows = durable(planted.churn_rows(_training_features(spark, sf_dir)))
        return rows, churn.train_churn_model(rows)

    return _once("planted churn", spark, sf_dir, fit)


def _planted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(planted.segment_rows(_training_features(spark, sf_dir)))
    return planted.segments_of_customers(rows, _scratch(spark, "model"))


def _planted_value(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, lifetime.LifetimeTraining]:
    def fit() -> tuple[DataFrame, lifetime.LifetimeTraining]:
        rows = durable(planted.value_rows(_training_features(spark, sf_dir)))
        return rows, lifetime.train_ltv_model(rows, planted.ROUNDS)

    return _once("planted value", spark, sf_dir, fit)


def _monthly_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("customer_id", decisions.monthly_value().alias("monthly_value"))


def _intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.with_intervention(_scores(spark, sf_dir)).select(
        "customer_id", "risk_tier", "recommended_action", "intervention_cost", "success_rate"
    )


def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return views.executive_kpis(analytics.monthly_revenue(t), analytics.customer_segments(t))


def _value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    columns = [
        (t.customers, ["gender", "country", "acquisition_channel"]),
        (t.subscriptions, ["status"]),
        (t.events, ["event_type"]),
    ]
    return profiling.union_all([profiling.value_counts_by_dimension(df, names) for df, names in columns])


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    age = profiling.histogram(t.customers, "age", 30).withColumn("metric", F.lit("age"))
    amount = profiling.histogram(t.transactions, "amount", 50).withColumn("metric", F.lit("amount"))
    return age.unionByName(amount)


def _churn_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.churn_by_dimensions(_tables(spark, sf_dir), ["country", "acquisition_channel", "gender"])


def _rounded_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = profiling.correlation_matrix(_profile_360(spark, sf_dir))
    return matrix.withColumn("r", round_even(F.col("r"), 6) + F.lit(0.0))


def _corrections(base: DataFrame) -> DataFrame:
    """Urgent orders corrected twice (the second correction stays), a copy of the high ones added."""
    urgent = base.where(F.col("product_category") == "1-URGENT")
    raised = [
        urgent.withColumns({"amount": (F.col("amount") + step).cast("decimal(12,2)"), "seq": F.lit(step)})
        for step in (1, 2)
    ]
    added = base.where(F.col("product_category") == "2-HIGH").withColumns(
        {"transaction_id": -1 - F.col("transaction_id"), "seq": F.lit(1)}
    )
    return profiling.union_all([*raised, added])


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _tables(spark, sf_dir).transactions
    batch = _corrections(base)
    return _with_double_money(quality.upsert_by_key(base, batch, "transaction_id", "seq"), "amount")


def _upsert_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows out of a table on disk, in its second version."""
    base = _tables(spark, sf_dir).transactions
    path = _scratch(spark, "versioned")
    versioned.create(base, path, "transaction_id")
    versioned.upsert(spark, path, _corrections(base), "seq")
    return _with_double_money(versioned.read_version(spark, path), "amount")


def _stored_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(audience.daily_bitmaps(_tables(spark, sf_dir).events))


def _amount_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stored daily sketches, merged by month."""
    daily = durable(daily_sketches(_tables(spark, sf_dir).transactions, ["transaction_date"], "amount"))
    month = month_label(month_start(F.col("transaction_date")))
    return merged_quantiles(daily, {"month": month}, [0.25, 0.5, 0.75, 0.95])


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trained.report_agrees(run_pipeline(_tables(spark, sf_dir), _scratch(spark, "pipeline"), as_of=star.AS_OF))


# --- the contract ----------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    return analytics.monthly_revenue(_tables(spark, SMOKE_DIR))


def queries() -> dict[str, Query]:
    def on_tables(operator: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(_tables(spark, sf_dir))

    def on_scores(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(_scores(spark, sf_dir))

    def on_recs(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(_recommendations(spark, sf_dir))

    def on_profile(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(_profile_360(spark, sf_dir))

    def on_stored_profile(operator: Callable[[DataFrame], DataFrame]) -> Query:
        """For operators that read the customer profile more than once."""
        return lambda spark, sf_dir: operator(durable(_profile_360(spark, sf_dir)))

    def on_features(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(_features(spark, sf_dir))

    def on_events(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return on_tables(lambda t: operator(profiling.customer_event_profile(t)))

    observed = lambda t: features.observation_points(t.customers, star.AS_OF)

    return _llm_queries() | {
        "load_customers": on_tables(lambda t: t.customers),
        "load_subscriptions": on_tables(lambda t: _with_double_money(t.subscriptions, "mrr")),
        "load_transactions": on_tables(lambda t: _with_double_money(t.transactions, "amount")),
        "load_events": on_tables(lambda t: t.events),
        # reports
        "monthly_revenue": on_tables(analytics.monthly_revenue),
        "revenue_by_plan": on_tables(analytics.revenue_by_plan),
        "revenue_by_category": on_tables(analytics.revenue_by_category),
        "cohort_retention": on_tables(analytics.cohort_retention),
        "top_customers": on_tables(analytics.top_customers),
        "customer_lifetime_value": on_tables(analytics.customer_lifetime_value),
        "customer_segments": on_tables(analytics.customer_segments),
        "conversion_funnel": on_tables(analytics.conversion_funnel),
        "daily_active_users": on_tables(analytics.daily_active_users),
        "daily_active_users_clicks": _clicks_dau,
        "rolling_active_users": lambda spark, d: audience.rolling_users(_stored_bitmaps(spark, d)),
        "monthly_active_users": lambda spark, d: audience.monthly_users(_stored_bitmaps(spark, d)),
        "monthly_amount_quantiles": _amount_quantiles,
        "engagement_by_churn_status": on_tables(analytics.engagement_by_churn_status),
        "churn_by_segment": on_tables(analytics.churn_by_segment),
        # features
        "observation_points": on_tables(observed),
        "txn_features_asof": on_tables(lambda t: features.txn_features_asof(t.transactions, observed(t))),
        "latest_subscription_asof": on_tables(
            lambda t: features.latest_subscription_asof(t.subscriptions, observed(t))
        ),
        "event_features_asof": on_tables(lambda t: features.event_features_asof(t.events, observed(t))),
        "feature_matrix": on_tables(lambda t: features.feature_matrix(t, star.AS_OF)),
        "feature_history": on_tables(lambda t: history.feature_history(t, as_of=star.AS_OF)),
        "plan_encoded": _plan_encoded,
        "avg_events_per_week": on_features(lambda f: f.select("customer_id", "avg_events_per_week")),
        "support_ticket_ratio": on_features(lambda f: f.select("customer_id", "support_ticket_ratio")),
        "one_hot": _one_hot,
        # models on fixed scores, labels and predictions
        "stratified_split": _stratified_split,
        "standard_scale": _standard_scale,
        "risk_tier": on_scores(lambda s: s.select("customer_id", "churn_probability", "risk_tier")),
        "churn_metrics": lambda spark, d: metrics.churn_metrics(_judged(spark, d), "fixed"),
        "classification_report": lambda spark, d: metrics.classification_report(_judged(spark, d)),
        "segment_profiles": lambda spark, d: segments.segment_profiles(_labelled(spark, d)),
        "segment_names": lambda spark, d: segments.name_segments(segments.segment_profiles(_labelled(spark, d))),
        "ltv_metrics": _regression,
        # trained models
        "churn_random_forest": _forest,
        "churn_logistic": _logistic,
        "select_best_model": lambda spark, d: trained.best_is_higher(_churn(spark, d)),
        "churn_feature_importance": _churn_importance,
        "predict_churn": _predict_churn,
        "save_load_models": _save_load,
        "customer_segmentation": _customer_segmentation,
        "silhouette": _silhouette,
        "euclidean_silhouette": _euclidean_silhouette,
        "trained_segment_profiles": lambda spark, d: trained.complete_profiles(_segmentation(spark, d)),
        "ltv_model": _ltv_model,
        "trained_ltv_metrics": lambda spark, d: trained.recomputed(_training_features(spark, d), _lifetime(spark, d)),
        "ltv_feature_importance": lambda spark, d: trained.sound_importances(_lifetime(spark, d).feature_importances),
        # models trained on planted answers
        "planted_churn_scores": lambda spark, d: planted.churn_scores(
            *_planted_churn(spark, d), _scratch(spark, "model")
        ),
        "planted_churn_metrics": lambda spark, d: planted.churn_ratings(_planted_churn(spark, d)[1]),
        "planted_segments": _planted_segments,
        "planted_ltv_scores": lambda spark, d: planted.value_scores(*_planted_value(spark, d), _scratch(spark, "model")),
        "planted_ltv_metrics": lambda spark, d: _planted_value(spark, d)[1].metrics,
        # decisions
        "customer_context": lambda spark, d: decisions.customer_context(
            _scores(spark, d), _tables(spark, d).customers
        ),
        "monthly_value": _monthly_value,
        "annual_risk_value": _priced("annual_risk_value"),
        "intervention_lookup": _intervention,
        "expected_save_value": _priced("expected_save_value"),
        "expected_roi": _priced("expected_roi"),
        "recommendations": _recommendations,
        "summary_report": on_recs(decisions.summary_report),
        # views
        "executive_kpis": _kpis,
        "plan_revenue_share": on_tables(lambda t: views.plan_revenue_share(analytics.revenue_by_plan(t))),
        "retention_matrix": on_tables(lambda t: views.retention_matrix(analytics.cohort_retention(t))),
        "engagement_long": on_tables(lambda t: views.engagement_long(analytics.engagement_by_churn_status(t))),
        "risk_filter": on_scores(lambda s: views.risk_filter(s, ["High", "Medium"], 0.35)),
        "risk_tier_counts": on_scores(views.risk_tier_counts),
        "risk_histogram": on_scores(views.risk_histogram),
        "top_roi": on_recs(views.top_roi),
        "recommendation_table": on_recs(views.recommendation_table),
        "customer_lookup": on_recs(views.customer_lookup),
        "customer_lookup_tier": on_recs(lambda r: views.customer_lookup(r, "High")),
        "customer_profile": on_recs(lambda r: views.customer_profile(r, PROFILED)),
        # profiles
        "table_counts": on_tables(profiling.table_counts),
        "table_preview": on_tables(lambda t: profiling.table_preview(t.customers, "customer_id")),
        "table_info": on_tables(profiling.table_info),
        "null_counts": on_tables(profiling.null_counts),
        "total_nulls": on_tables(lambda t: profiling.total_nulls(t.transactions)),
        "overall_churn": on_tables(profiling.overall_churn),
        "value_counts": _value_counts,
        "histogram": _histograms,
        "histogram_by_status": on_stored_profile(
            lambda p: profiling.histogram_by_status(
                p, ["total_spend", "total_events", "num_transactions", "tenure_days"]
            )
        ),
        "drift_report": _drift,
        "recent_events_by_month": _recent_by_month,
        "nice_histograms": on_stored_profile(
            lambda p: bins.nice_histograms(p, ["total_spend", "total_events", "num_transactions", "tenure_days"])
        ),
        "churn_by_dimension": _churn_by_dimension,
        "monthly_transactions": on_tables(profiling.monthly_transactions),
        "category_revenue": on_tables(profiling.category_revenue),
        "plan_distribution": on_tables(profiling.plan_distribution),
        "active_customer_count": on_tables(profiling.active_customer_count),
        "customer_event_profile": on_tables(profiling.customer_event_profile),
        "event_means_by_status": on_events(profiling.event_means_by_status),
        "event_box_stats": on_events(lambda p: profiling.event_box_stats(durable(p))),
        "customer_360": _profile_360,
        "status_comparison": on_stored_profile(profiling.status_comparison),
        "correlation_matrix": _rounded_correlations,
        "churn_correlation": lambda spark, d: profiling.churn_correlation(_rounded_correlations(spark, d)),
        "spend_vs_events": on_profile(profiling.spend_vs_events),
        # data management
        "integrity_checks": on_tables(quality.integrity_checks),
        "upsert_by_key": _upsert,
        "upsert_versioned": _upsert_versioned,
        "run_pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    if llm is None:
        return oracle.oracle_sql()
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return oracle.oracle_sql() | llm.oracle_sql() | whole


def _llm_queries() -> dict[str, Query]:
    """The training-data operators, where their subpackage is present."""
    if llm is None:
        return {}

    def importable(query: Query) -> Query:
        """Python workers import the operators' helpers from this folder, whatever theirs is."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
            return query(spark, sf_dir)

        return run

    return {name: importable(q) for name, q in (llm.queries() | {"pipeline": corpus_pipeline.run}).items()}
