"""Keyed tables that are written in versions: readers see a whole version or the one before.

A table's rows are dealt into buckets by a hash of the key.  A version is a manifest that
names the data files of each bucket; files are never changed.  An upsert reads and rewrites
only the buckets that its batch has keys for, then puts down a new manifest under a
temporary name and renames it.  That rename publishes the version; a writer that dies
before it leaves files that no manifest names, and two writers can't publish one number.

The driver handles names of buckets and files only; rows are read and written by Spark.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import upsert_by_key

BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another writer has published the version first."""


# --- files, through Hadoop's interface, so that any store of Spark's will do ----------------

def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    files = _files(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    return [status.getPath().getName() for status in files.listStatus(_path(spark, folder))]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _files(spark, path).create(_path(spark, path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    files, jvm = _files(spark, path), spark._jvm
    stream = files.open(_path(spark, path))
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _publish(spark: SparkSession, made: str, final: str) -> None:
    """Rename without replacing: the second of two writers fails."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, final).toUri(), spark._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = getattr(rename, "NONE")
    try:
        context.rename(_path(spark, made), _path(spark, final), options)
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            raise VersionConflict(final) from error
        raise


# --- versions ------------------------------------------------------------------------------

def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, ascending."""
    names = _names(spark, f"{path}/versions")
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version's manifest, by default the latest: key, number of buckets, schema, files by bucket."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {'' if version is None else version}".rstrip())
    return json.loads(_read_text(spark, f"{path}/versions/{known[-1] if version is None else version}.json"))


def _put(spark: SparkSession, path: str, version: int, content: dict) -> None:
    made = f"{path}/versions/.{version}-{uuid.uuid4().hex}"
    _write_text(spark, made, json.dumps(content))
    _publish(spark, made, f"{path}/versions/{version}.json")


def _bucket(key: str, columns: list[str], buckets: int) -> Column:
    """Rows without a key are dealt by all their values, so they don't share one bucket."""
    dealt = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*columns))
    return F.pmod(dealt, F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> dict[str, list[str]]:
    """Write ``df`` by bucket; the new files of each, relative to ``path``."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    placed = df.withColumn(BUCKET, _bucket(key, df.columns, buckets))
    # A bucket is a rebalanced partition: adaptive execution splits large ones and joins small ones.
    placed.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    found = {}
    for name in _names(spark, f"{path}/{folder}"):
        if name.startswith(f"{BUCKET}="):
            own = [n for n in _names(spark, f"{path}/{folder}/{name}") if n.endswith(".parquet")]
            found[name.split("=", 1)[1]] = [f"{folder}/{name}/{n}" for n in sorted(own)]
    return found


def _rows(spark: SparkSession, path: str, state: dict, buckets: set[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    names = [f for b, own in state["files"].items() if buckets is None or b in buckets for f in own]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in names]).select(*schema.names)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the latest; later writes don't change them."""
    return _rows(spark, path, manifest(spark, path, version))


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> int:
    """Write ``df`` as the first version of a table; its number is returned.

    ``buckets`` is fixed for the table: take the rewritten share of a usual batch and the
    size of a file into account.
    """
    spark = df.sparkSession
    if versions(spark, path):
        raise VersionConflict(path)
    if BUCKET in df.columns:
        raise ValueError(f"{BUCKET} is not free for a column")
    files = _write_buckets(df, path, key, buckets)
    _put(spark, path, 1, {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "files": files})
    return 1


def upsert(spark: SparkSession, path: str, batch: DataFrame, sequence: str) -> int:
    """Publish the next version: the rows of ``batch`` inserted or replaced by key, as ``upsert_by_key`` does.

    Only buckets that the batch touches are read and written again; all others keep their
    files.  An empty batch publishes nothing.  The version's number is returned.
    """
    current = versions(spark, path)[-1:] or [0]
    state = manifest(spark, path)
    key, buckets, columns = state["key"], state["buckets"], T.StructType.fromJson(state["schema"]).names
    numbers = batch.select(_bucket(key, columns, buckets).alias(BUCKET)).distinct()
    touched = {str(row[0]) for row in numbers.collect()}  # at most as many as there are buckets
    if not touched:
        return current[0]
    merged = upsert_by_key(_rows(spark, path, state, touched), batch, key, sequence)
    written = _write_buckets(merged, path, key, buckets)
    files = {b: own for b, own in state["files"].items() if b not in touched} | written
    _put(spark, path, current[0] + 1, state | {"files": files})
    return current[0] + 1


def unreferenced(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Data folders that none of the last ``keep`` versions name: left by dead writers, or outdated."""
    used = set()
    for version in versions(spark, path)[-keep:]:
        for own in manifest(spark, path, version)["files"].values():
            used |= {name.split("/")[1] for name in own}
    return sorted(set(_names(spark, f"{path}/data")) - used)
