"""Tables between jobs: written to a folder that driver and executors share, read back."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Training rows of a partition, input bytes (compressed files) of a shuffle
# partition and the size up to which adaptive execution joins small ones.
PARTITION_ROWS = 60_000
PARTITION_BYTES = 4 << 20
ADVISORY_BYTES = 8 << 20


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or the context's own.

    Where neither is set, a local session gets a temporary folder, set once for the
    session; a cluster without a shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in ``folder`` (by default the session's work folder), read it back.

    Later passes start from files that outlive the executors, and read only the columns
    they use.  The tables stay until the folder's owner clears it.
    """
    path = f"{folder or work_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` is read from; 0 where it is not read from files."""
    spark = df.sparkSession
    configuration, total = spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(configuration).getFileStatus(path).getLen()
    return total


@contextmanager
def shuffles_by_input(df: DataFrame) -> Iterator[None]:
    """What runs inside shuffles into a number of partitions that follows ``df``'s input.

    A task's rows are then bounded whatever the size of the tables; the session's own number
    is the least.  The session has its settings back at the end.
    """
    conf = df.sparkSession.conf
    number, advisory = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {name: conf.get(name) for name in (number, advisory)}
    needed = -(-input_bytes(df) // PARTITION_BYTES)
    try:
        if needed > int(before[number]):
            conf.set(number, str(needed))
            conf.set(advisory, str(ADVISORY_BYTES))
        yield
    finally:
        for name, value in before.items():
            conf.set(name, value)


def partitions_for(rows: int, least: int) -> int:
    """``least``, or as many as keep a partition at PARTITION_ROWS rows; depends on the rows alone."""
    return max(least, -(-rows // PARTITION_ROWS))


def dealt_by(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """A layout that depends on the rows alone: hashed by ``key``, sorted within partitions."""
    return df.repartition(partitions, key).sortWithinPartitions(key)
