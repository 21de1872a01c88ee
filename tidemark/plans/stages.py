"""Stages of a job that are not repeated once they are done.

A stage writes its table to a folder of its own and then a commit record with a fingerprint
of what went into it: its name, its arguments and the fingerprints of the stages it reads.
A run that finds the record reads the table back; a table without a record is what a dead
run has left and is written anew elsewhere.  Other arguments or inputs are another
fingerprint, so they never meet old results.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import versioned


def table_fingerprint(df: DataFrame) -> str:
    """Of a frame read from files: their names, sizes and times, and the columns."""
    spark = df.sparkSession
    found = []
    for name in sorted(df.inputFiles()):
        path = versioned._path(spark, name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return _digest({"files": found, "schema": df.schema.json()})


def _digest(content: Mapping) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()


class Stages:
    """Committed stages below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ran: list[str] = []

    def fingerprint(self, name: str, arguments: Mapping, inputs: Mapping[str, str]) -> str:
        return _digest({"stage": name, "arguments": dict(arguments), "inputs": dict(inputs)})

    def _record(self, name: str, mark: str) -> str:
        return f"{self.folder}/commits/{name}-{mark}.json"

    def committed(self, name: str, mark: str) -> dict | None:
        """The commit record of a stage with this fingerprint."""
        if f"{name}-{mark}.json" not in versioned._names(self.spark, f"{self.folder}/commits"):
            return None
        return json.loads(versioned._read_text(self.spark, self._record(name, mark)))

    def run(
        self, name: str, build: Callable[[], DataFrame], arguments: Mapping, inputs: Mapping[str, str]
    ) -> tuple[DataFrame, str]:
        """The stage's table, built only if no commit has its fingerprint; and that fingerprint."""
        mark = self.fingerprint(name, arguments, inputs)
        record = self.committed(name, mark)
        if record is None:
            table = f"tables/{name}-{uuid.uuid4().hex}"
            df = build()
            df.write.parquet(f"{self.folder}/{table}")
            self.ran.append(name)
            record = {"stage": name, "table": table, "arguments": dict(arguments), "inputs": dict(inputs)}
            made = f"{self.folder}/commits/.{name}-{uuid.uuid4().hex}"
            versioned._write_text(self.spark, made, json.dumps(record, default=str))
            try:
                versioned._publish(self.spark, made, self._record(name, mark))
            except versioned.VersionConflict:  # another run has committed the same stage
                record = self.committed(name, mark)
        return self.spark.read.parquet(f"{self.folder}/{record['table']}"), mark
