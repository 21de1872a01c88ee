"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durable import work_folder
from tidemark.llm import (
    bfd_packing,
    chosen_path,
    feistel,
    fm_toxicity,
    lattice,
    merkle_manifest,
    mincut_html,
    ngram_ratio,
    orc_tokens,
    pivotal_grams,
    trie_dedup,
    twins,
    url_model,
    warc_zstd,
)
from tidemark.llm.common import read_table

WINDOW = 1024
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
# A deployment gives its own secret; this one only makes the registered results repeatable.
PSEUDONYM_KEY = b"registered-queries"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_model.filter_urls(pages, URL_RULES).drop("url")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = trie_dedup.exact_duplicates(docs, keep="largest")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return mincut_html.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    machine = fm_toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(fold != 0))
    scored = fm_toxicity.score(docs, machine)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_ratio.fit(docs, read_table(spark, sf_dir, "labels"))
    return ngram_ratio.quality(docs, model).drop("text")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    records = warc_zstd.round_trip(read_table(spark, sf_dir, "pages"), folder)
    return records.select(
        F.col("record_id").try_cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
        "error",
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    docs = read_table(spark, sf_dir, "documents")
    encoded = lattice.encode(docs, pieces, lattice.file_blocks(docs), verify=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        "round_trip",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    placed = bfd_packing.pack(docs, tokenizer_path(), WINDOW)
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    text = F.when(tampered, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    current = merkle_manifest.leaf_hash(fields, {"text": text})
    proven = merkle_manifest.manifest(docs, fields, "lang", "doc_id", {"current": current})
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle_manifest.siblings_digest(F.col("siblings")).alias("proof_sha256"),
        merkle_manifest.fold(F.col("current"), F.col("siblings")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{work_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    return orc_tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), folder)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_grams.spelling_variants(read_table(spark, sf_dir, "documents"), one_in=97)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_filter,
            op2_exact_dedup,
            op3_main_text,
            op4_toxicity,
            op5_quality_rules,
            op6_pseudonyms,
            op7_warc,
            op8_sentencepiece,
            op9_packing,
            op10_ngram_jaccard,
            op11_merkle_manifest,
            op12_token_files,
            op13_spelling_variants,
        )
    }


OP2_SQL = """
    SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op11_merkle_manifest": twins.OP11_SQL,
        "op13_spelling_variants": twins.OP13_SQL,
    }
