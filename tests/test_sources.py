"""Loading, saving and the star-schema mapping, with one customer holding most orders."""

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.sources import star
from tidemark.sources.tables import SCHEMAS, load_tables, save_tables


def test_round_trip(spark, make_tables, tmp_path):
    t = make_tables([{}], [{"customer_id": 1}], [{"customer_id": 1, "amount": 1.25}], [{"customer_id": 1}])
    for fmt in ("parquet", "orc", "json"):
        save_tables(t, str(tmp_path / fmt), fmt)
        back = load_tables(spark, str(tmp_path / fmt), fmt)
        for name, df in back._asdict().items():
            assert df.columns == [f.name for f in SCHEMAS[name]]
            assert rows(df) == rows(t._asdict()[name])


def test_other_column_types(spark, make_tables, tmp_path):
    t = make_tables([{}], [{"customer_id": 1}], [{"customer_id": 1, "amount": 1.25}], [{"customer_id": 1}])
    for name, df in t._asdict().items():
        loose = df.select(
            *[
                F.col(c).cast({"decimal(12,2)": "double", "int": "bigint", "date": "string"}.get(kind, kind)).alias(c)
                for c, kind in df.dtypes
            ]
        )
        loose.write.parquet(str(tmp_path / "loose" / name))
        loose.write.option("header", True).csv(str(tmp_path / "csv" / name))
    for fmt, options in (("parquet", {}), ("csv", {"header": "true"})):
        back = load_tables(spark, str(tmp_path / ("loose" if fmt == "parquet" else fmt)), fmt, **options)
        for name, df in back._asdict().items():
            assert df.schema.simpleString() == t._asdict()[name].schema.simpleString()
            assert rows(df) == rows(t._asdict()[name])


def _orders(spark, customers, per_customer, hot):
    start = datetime(1999, 1, 1)
    listed, key = [], 0
    for customer in range(customers):
        for i in range(hot if customer == 0 else per_customer):
            key += 1
            # Few days and shuffled keys, so that days hold many orders in no key order.
            listed.append(((key * 7919) % 100_003, customer, "F", 10.0 + i, start + timedelta(days=(i * 37) % 60), "5-LOW"))
    return spark.createDataFrame(
        listed,
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string",
    )


def test_next_order_of_a_hot_customer(spark):
    orders = _orders(spark, 30, 8, 3000)
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    plain = orders.withColumn("day", F.col("o_orderdate").cast("date")).select(
        F.col("o_orderkey").alias("subscription_id"),
        F.lead("day").over(w).alias("next_day"),
        F.lead("o_orderkey").over(w).alias("next_key"),
    )
    joined = star.subscriptions(orders).join(plain, "subscription_id")
    assert joined.count() == 3000 + 29 * 8
    wrong = joined.where(
        ~F.col("end_date").eqNullSafe(F.coalesce("next_day", "start_date"))
        | ((F.col("status") == "cancelled") != F.col("next_key").isNull())
        | ((F.col("status") == "upgraded") & (F.col("next_key") % 4 < F.col("subscription_id") % 4))
    )
    assert wrong.count() == 0


def test_no_row_is_left_out(spark):
    t = star.tables_from_star(spark, "/root/testdata/sf0.001")
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").count()
    assert t.customers.count() == read("customer")
    assert t.subscriptions.count() == t.transactions.count() == read("orders")
    assert t.events.count() == read("lineitem")
    without = t.customers.join(t.transactions, "customer_id", "left_anti").count()
    assert 0 < without < t.customers.count()
