"""The silhouette with plain Euclidean distances, exact for a stated set of rows against all rows.

Its cost is the number of asked rows times all rows.  The asked rows come in blocks of a
fixed size; for each block one pass over all rows adds up, per asked row and cluster, the
distances and the rows.  No pair of rows is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.functions.rounding import round_even

BLOCK = 4096  # asked rows that every task holds at a time


def _distance_sums(rows: DataFrame, keys: list, points: np.ndarray) -> DataFrame:
    """(customer_id, cluster, distance, rows) of some points against all ``rows`` (segment, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            segment = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            for cluster in np.unique(segment).tolist():
                own = x[segment == cluster]
                total, n = sums.get(cluster, (np.zeros(len(points)), 0))
                for at in range(0, len(own), 256):
                    part = own[at : at + 256]
                    total = total + np.sqrt(((points[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)).sum(axis=1)
                sums[cluster] = total, n + len(own)
        for cluster, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([cluster] * len(keys), pa.int64()),
                    pa.array(total, pa.float64()),
                    pa.array([n] * len(keys), pa.int64()),
                ],
                names=["customer_id", "cluster", "distance", "rows"],
            )

    return rows.mapInArrow(run, "customer_id long, cluster long, distance double, rows long")


def silhouette_samples(labelled: DataFrame, asked: Column, folder: str | None = None) -> DataFrame:
    """(customer_id, segment, a, b, silhouette) of the rows that ``asked`` picks, against all rows.

    ``labelled`` has customer_id, segment and the vector ``scaled``; rows without one of
    them are left out.  ``a`` is the mean distance to the other rows of the own cluster,
    ``b`` the least mean distance to another cluster.  A row alone in its cluster has 0, as
    have all rows where there is only one cluster.
    """
    known = labelled.where(
        F.col("customer_id").isNotNull() & F.col("segment").isNotNull() & F.col("scaled").isNotNull()
    )
    table = durable(
        known.select(
            "customer_id",
            F.col("segment").cast("long").alias("segment"),
            vector_to_array("scaled").alias("x"),
            asked.alias("asked"),
        ),
        folder,
    )
    queries = durable(table.where("asked").select("customer_id", "segment", "x"), folder)
    parts = queries.count()
    blocks = max(1, -(-parts // BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("customer_id"), F.lit(blocks)))
    sums = None
    for number in range(blocks):
        block = dealt.where(F.col("block") == number).collect()  # about BLOCK rows
        if not block:
            continue
        points = np.array([row.x for row in block], dtype=float)
        part = _distance_sums(table.select("segment", "x"), [row.customer_id for row in block], points)
        part = part.groupBy("customer_id", "cluster").agg(F.sum("distance").alias("distance"), F.sum("rows").alias("rows"))
        part = durable(part, folder)
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return queries.select(
            "customer_id", "segment", *[F.lit(0.0).alias(name) for name in ("a", "b", "silhouette")]
        )
    own = F.col("cluster") == F.col("segment")
    means = (
        sums.join(queries.select("customer_id", "segment").distinct(), "customer_id")
        .groupBy("customer_id", "segment")
        .agg(
            F.max(F.when(own & (F.col("rows") > 1), F.col("distance") / (F.col("rows") - 1))).alias("a"),
            F.min(F.when(~own, F.col("distance") / F.col("rows"))).alias("b"),
        )
    )
    value = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return means.select("customer_id", "segment", "a", "b", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def euclidean_silhouette(labelled: DataFrame, asked: Column, folder: str | None = None) -> DataFrame:
    """One row: the mean silhouette of the asked rows, four decimals, and their number."""
    samples = silhouette_samples(labelled, asked, folder)
    return samples.agg(
        round_even(F.avg("silhouette"), 4).alias("silhouette_score"), F.count(F.lit(1)).alias("sampled")
    )
