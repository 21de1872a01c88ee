"""What the plans of the registered queries hold and what not."""

import re

import pytest

import __spark_entry__ as registered
from checks.oracle import oracle_sql

SF_DIR = "/root/testdata/sf0.001"
TRAINED = {
    "churn_random_forest", "churn_logistic", "select_best_model", "churn_feature_importance", "predict_churn",
    "save_load_models", "customer_segmentation", "silhouette", "trained_segment_profiles", "ltv_model",
    "trained_ltv_metrics", "ltv_feature_importance", "run_pipeline", "stratified_split", "standard_scale",
}
QUERIES = registered.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def count(text, node):
    return len(re.findall(rf"\b{node}\b", text))


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - TRAINED))
def test_no_pair_joins_and_no_python(spark, name):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow", "ArrowEvalPython", "BatchEvalPython"):
        assert not count(text, node), node


@pytest.mark.parametrize("name", ["latest_subscription_asof", "plan_encoded", "upsert_by_key", "feature_matrix"])
def test_aggregations_are_hashed(spark, name):
    assert not count(plan(spark, name), "SortAggregate")


def test_subscriptions_shuffle_orders_twice(spark):
    text = plan(spark, "load_subscriptions")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert len(re.findall(r"Window \[", text)) == 2


@pytest.mark.parametrize("name, scans", [("churn_by_dimension", 1), ("integrity_checks", 6)])
def test_customers_are_planned_once(spark, name, scans):
    assert len(re.findall(r"Scan parquet.*c_custkey", plan(spark, name))) + len(
        re.findall(r"FileScan parquet \[c_custkey", plan(spark, name))
    ) <= 2 * scans


@pytest.mark.parametrize("name", ["annual_risk_value", "expected_save_value", "expected_roi"])
def test_priced_columns_are_not_sorted(spark, name):
    assert "rangepartitioning" not in plan(spark, name)
