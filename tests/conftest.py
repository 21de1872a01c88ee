import os
import sys
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.sources.tables import SCHEMAS, Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "name": "Ada",
    "country": "US",
    "age": 30,
    "gender": "F",
    "acquisition_channel": "organic",
    "is_churned": 0,
    "signup_date": date(2024, 1, 1),
    "plan": "pro",
    "mrr": Decimal("49.00"),
    "start_date": date(2024, 1, 1),
    "status": "active",
    "transaction_date": date(2024, 1, 1),
    "amount": Decimal("10.00"),
    "product_category": "addon",
    "payment_method": "paypal",
    "event_date": date(2024, 1, 1),
    "event_type": "login",
}


def day(text):
    return date.fromisoformat(text)


def frame(spark, table, rows):
    """Rows given as partial dicts, completed with defaults and running ids."""
    schema = SCHEMAS[table]
    key = schema[0].name
    full = []
    for number, row in enumerate(rows, start=1):
        base = {f.name: DEFAULTS.get(f.name) for f in schema}
        base[key] = number
        if table == "customers":
            base["email"] = f"user{row.get('customer_id', number)}@example.com"
        base.update({k: day(v) if k.endswith("_date") and isinstance(v, str) else v for k, v in row.items()})
        for money in ("mrr", "amount"):
            if money in base:
                base[money] = Decimal(str(base[money]))
        full.append(tuple(base[f.name] for f in schema))
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def make_tables(spark):
    def build(customers=(), subscriptions=(), transactions=(), events=()):
        return Tables(
            frame(spark, "customers", customers),
            frame(spark, "subscriptions", subscriptions),
            frame(spark, "transactions", transactions),
            frame(spark, "events", events),
        )

    return build


def rows(df):
    return [row.asDict() for row in df.collect()]
