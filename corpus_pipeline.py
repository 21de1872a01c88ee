"""From raw documents to packed token windows: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durable import durable, work_folder
from tidemark.llm import bfd_packing, chosen_path, feistel, ngram_ratio, registry, trie_dedup
from tidemark.llm.common import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a counted rule or the likelihood ratio go; null and empty texts fail.

    Repeated rows share a verdict; texts of any length are judged whole; an empty table stays empty.
    """
    model = ngram_ratio.fit(docs, read_table(spark, sf_dir, "labels"))
    return ngram_ratio.quality(docs, model).where("kept").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, null and empty texts being equal.

    Rows that repeat that doc_id, or have none, are one row too: the smallest by their columns
    in order.  Texts of any length count whole; an empty table stays empty.
    """
    stays = durable(trie_dedup.exact_duplicates(docs, keep="largest").where("kept"))
    row = F.struct(*docs.columns)
    several = stays.where("group_size > 1").groupBy("text_sha256").agg(F.min(row).alias("row")).select("row.*")
    return stays.where("group_size = 1").select(docs.columns).unionByName(several)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the smallest doc_id stays.

    Rows without a doc_id can't be told apart and stay.
    """
    others = chosen_path.near_duplicates(docs).where(F.col("doc_id") != F.col("class_id"))
    return docs.join(others.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced; no document goes."""
    return feistel.pseudonymise(docs, registry.PSEUDONYM_KEY).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, span, token ids, sequence and offset.

    A null or empty text is the end id alone; repeated rows and rows without a doc_id are packed
    each; long texts are cut into full windows; an empty table gives no piece.
    """
    return bfd_packing.pack(docs, registry.tokenizer_path(), registry.WINDOW)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

# The ratio's model, the join and the token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is a table that the next stage reads."""
    folder = f"{work_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
