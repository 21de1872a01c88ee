"""The corpus pipeline: its stages one by one against plain versions, and on odd rows."""

import collections

import corpus_pipeline
import pytest
from llm.helpers import documents
from llm.test_texts import ODD, plain_counts, plain_links
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(spark, real):
    assert list(STAGES) == ["quality_rules", "exact_dedup", "near_dedup", "pseudonyms", "packing"]
    for name in list(STAGES)[:-1]:
        assert STAGES[name](spark, real, SF_DIR).columns == NAMES


def test_quality_drops_what_it_should(spark, real):
    kept = set(ids(STAGES["quality_rules"](spark, real, SF_DIR)))
    for r in real.collect():
        n = plain_counts(r.text)
        assert r.doc_id not in kept or not (n[0] < 50 or 100 * n[4] > 50 * n[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    long = {r.doc_id for r in real.collect() if plain_counts(r.text)[0] >= 50}
    assert all(d in kept for d, q in labels.items() if q == 1 and d in long)


def test_exact_dedup_keeps_the_largest(spark, real):
    docs = real.union(real.withColumn("doc_id", F.col("doc_id") + 1000))
    best = {}
    for r in docs.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert ids(STAGES["exact_dedup"](spark, docs, SF_DIR)) == sorted(best.values())


def test_exact_dedup_keeps_one_of_repeated_rows(spark, real):
    """Rows that repeat a doc_id, or have none, with one text: one stays, the same in every run."""
    other = real.withColumn("source", F.concat(F.lit("~"), "source"))
    nameless = documents(spark, ["no key", "no key", None, ""]).withColumn("doc_id", F.lit(None).cast("long"))
    docs = other.unionByName(real).unionByName(real).unionByName(nameless.select(NAMES))
    got = STAGES["exact_dedup"](spark, docs, SF_DIR).select("doc_id", "text", "source").collect()
    texts = [r.text or "" for r in got]
    assert sorted(texts) == sorted({r.text or "" for r in docs.collect()})
    sources = {r.doc_id: r.source for r in real.collect()}
    assert all(r.source == sources[r.doc_id] for r in got if r.doc_id is not None)


def test_near_dedup_keeps_one_of_each_group(spark, real):
    want = plain_links([(r.doc_id, r.text) for r in real.collect()])
    assert ids(STAGES["near_dedup"](spark, real, SF_DIR)) == sorted(key for key, group, _, _ in want if key == group)


def test_run_is_its_stages(spark, real):
    docs = real
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    want = docs.select("doc_id", "start", "length", F.crc32("ids").alias("crc")).collect()
    got = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "start", "length", F.crc32("ids").alias("crc")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))
    assert {r.doc_id for r in got} < set(ids(real))


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows_and_none(spark, name):
    docs = documents(spark, ODD)
    odd = docs.union(docs).union(documents(spark, ["no key", None]).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({c: F.lit("clash") for c in ("kept", "score", "class_id", "ids", "n_links", "keep_id")})
    got = STAGES[name](spark, odd, SF_DIR)
    assert name == "packing" or (got.columns == odd.columns and got.count() <= odd.count())
    got.collect()
    if name in ("near_dedup", "pseudonyms"):
        assert got.where("doc_id is null").count() == 2
    assert STAGES[name](spark, odd.limit(0), SF_DIR).count() == 0
