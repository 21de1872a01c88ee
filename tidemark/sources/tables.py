"""The four input tables: schemas, loaders and writers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CUSTOMERS = _schema(
    customer_id=T.LongType(),
    name=T.StringType(),
    email=T.StringType(),
    signup_date=T.DateType(),
    country=T.StringType(),
    age=T.IntegerType(),
    gender=T.StringType(),
    acquisition_channel=T.StringType(),
    is_churned=T.IntegerType(),
    churn_date=T.DateType(),
)
SUBSCRIPTIONS = _schema(
    subscription_id=T.LongType(),
    customer_id=T.LongType(),
    plan=T.StringType(),
    mrr=MONEY,
    start_date=T.DateType(),
    end_date=T.DateType(),
    status=T.StringType(),
)
TRANSACTIONS = _schema(
    transaction_id=T.LongType(),
    customer_id=T.LongType(),
    transaction_date=T.DateType(),
    amount=MONEY,
    product_category=T.StringType(),
    payment_method=T.StringType(),
)
EVENTS = _schema(
    event_id=T.LongType(),
    customer_id=T.LongType(),
    event_date=T.DateType(),
    event_type=T.StringType(),
    event_detail=T.StringType(),
)
SCHEMAS = {
    "customers": CUSTOMERS,
    "subscriptions": SUBSCRIPTIONS,
    "transactions": TRANSACTIONS,
    "events": EVENTS,
}


class Tables(NamedTuple):
    customers: DataFrame
    subscriptions: DataFrame
    transactions: DataFrame
    events: DataFrame


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the declared columns, in order."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])


def load_tables(spark: SparkSession, base_dir: str, fmt: str = "parquet", **options: str) -> Tables:
    """Read ``<base_dir>/<table>`` for the four tables and cast them to the declared types.

    Files may hold other types, such as DOUBLE money, BIGINT ages or ISO text dates.  CSV
    and JSON values are read as text and cast.
    """

    def read(name: str, schema: T.StructType) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        if fmt in ("csv", "json"):
            reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
        return conform(reader.load(f"{base_dir}/{name}"), schema)

    return Tables(*[read(name, schema) for name, schema in SCHEMAS.items()])


def load_tables_jdbc(
    spark: SparkSession, url: str, bounds: dict[str, tuple[int, int]], partitions: int, **options: str
) -> Tables:
    """Read the four tables from a database, each in parallel ranges of its primary key.

    ``bounds`` has the lowest and highest key of each table; a customer with many rows is
    so spread over the ranges.
    """

    def read(name: str, schema: T.StructType) -> DataFrame:
        lower, upper = bounds[name]
        reader = spark.read.format("jdbc").options(
            url=url,
            dbtable=name,
            partitionColumn=schema[0].name,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
            **options,
        )
        return conform(reader.load(), schema)

    return Tables(*[read(name, schema) for name, schema in SCHEMAS.items()])


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(fmt).mode(mode).save(path)


def save_tables(tables: Tables, base_dir: str, fmt: str = "parquet") -> None:
    for name, df in tables._asdict().items():
        save_table(df, f"{base_dir}/{name}", fmt)
