"""Token ids of documents in ORC files, in order of the documents' ids.

Texts are range partitioned by id, encoded, and written by Spark's ORC writer: ids are
arrays of integers, which ORC keeps run-length encoded, in stripes with row indexes and
Bloom filters on the document id.  A reader takes the stripes of a file in parallel, and a
search for some documents reads only the row groups that may hold them.

A long document has several rows, its pieces, so a row has a bounded size.  Each row tells
its file, where its document starts in the file and where the piece starts in the document;
the documents' places in the whole follow from the files' sums.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 4096  # ids of a row at most
LONGEST_KEPT = 64  # bytes; longer units are encoded whenever they come
MOST_KEPT = 1 << 19  # units that a worker remembers
TEXTS = 256  # encoded at once
CRC_POLYNOMIAL = 0xEDB88320

# The rules of a tokenizer file whose texts can be cut at white space.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Composed letters and marks after them: by these rules one piece each, whatever stands beside them.
WORD_AND_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

_encoders: dict[str, Callable[[list[bytes]], list[bytes]]] = {}


# --- encoding ------------------------------------------------------------------------

def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


def cut_at_spaces(path: str) -> bool:
    """Whether the file drops white space and looks at nothing beyond it.

    By these rules no normal form, no split and no added token reaches over a space.
    """
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    splits = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        (rules["normalizer"] or {}).get("normalizers") == NORMALIZERS
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and rules["model"]["type"] == "BPE"
        and not rules["model"]["dropout"]
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
        and all(t["content"].split() == [t["content"]] for t in rules["added_tokens"])
        and not any(WORD_AND_MARKS.fullmatch(t["content"]) for t in rules["added_tokens"])
    )


class Units(dict):
    """Ids of units between white space, found when first asked for.

    A unit that is a word of Latin letters and marks is split here and its two pieces go to
    the tokenizer's model; all others go through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.pieces = tokenizer, tokenizer.model, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        # Byte-level models write bytes as printable characters.
        self.characters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}

    def __missing__(self, unit: bytes) -> bytes:
        text = unit.decode()
        simple = WORD_AND_MARKS.fullmatch(text)
        if simple:
            ids = self.piece(simple[1].lower()) + (self.piece(simple[2]) if simple[2] else b"")
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(unit) <= LONGEST_KEPT:
            self[unit] = ids
        return ids

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            written = text if text.isascii() else text.encode().decode("latin-1").translate(self.characters)
            ids = _packed([token.id for token in self.model.tokenize(written)])
            if len(text) <= LONGEST_KEPT:
                self.pieces[text] = ids
        return ids

    def tidy(self) -> None:
        """Forget what is remembered, once it is too much."""
        if len(self) > MOST_KEPT:
            self.clear()
        if len(self.pieces) > MOST_KEPT:
            self.pieces.clear()


def text_encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """The ids of UTF-8 texts by the tokenizer file, as little-endian unsigned 32-bit numbers.

    Where the file's rules allow it, a text is cut at white space and each different unit is
    encoded once; the worker keeps units between tasks.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[bytes]) -> list[bytes]:
        found = tokenizer.encode_batch_fast([text.decode() for text in texts], add_special_tokens=False)
        return [_packed(e.ids) for e in found]

    units = Units(tokenizer)

    def by_units(texts: list[bytes]) -> list[bytes]:
        units.tidy()
        return [b"".join(map(units.__getitem__, text.split())) for text in texts]

    _encoders[path] = by_units if cut_at_spaces(path) else whole
    return _encoders[path]


def encode_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The rows of the files: key, ``file``, ``file_start`` of the document, its ``n_tokens``,
    ``piece_start`` and ``ids``.

    Documents are ordered by key, nulls first; those with equal keys by a hash of their
    texts, equal ones among them as they come.  Every document ends with ``end_id``; a null
    text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer_path)
        file, start = TaskContext.get().partitionId(), 0
        end = _packed([end_id])
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                encoded = encode([value or b"" for value in part.column(1).to_pylist()])
                rows, starts, totals, places, sizes = [], [], [], [], []
                for row, ids in enumerate(encoded):
                    total = len(ids) // 4 + 1
                    for at in range(0, total, PIECE):
                        rows.append(row)
                        starts.append(start)
                        totals.append(total)
                        places.append(at)
                        sizes.append(min(PIECE, total - at))
                    start += total
                values = np.frombuffer(b"".join([x for ids in encoded for x in (ids, end)]), dtype="<i4")
                offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([file] * len(rows), pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(places, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    names=[key, "file", "file_start", "n_tokens", "piece_start", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, file long, file_start long, n_tokens long, piece_start long, ids array<int>"
    # The row's own number parts rows that share a key, so that none of them gather in one task.
    order = [F.col(key), F.xxhash64(text), F.col("_own")]
    rows = docs.select(key, text).withColumn("_own", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


# --- files ---------------------------------------------------------------------------

def write_files(
    pieces: DataFrame, folder: str, key: str = "doc_id", stripe_bytes: int = 64 << 20, index_rows: int = 1024
) -> None:
    """One ORC file per partition, with an index entry every ``index_rows`` rows."""
    options = {
        "orc.bloom.filter.columns": key,
        "orc.bloom.filter.fpp": "0.01",
        "orc.stripe.size": str(stripe_bytes),
        "orc.row.index.stride": str(index_rows),
        "orc.create.index": "true",
        "compression": "zstd",
    }
    pieces.write.options(**options).orc(folder)


def read_files(spark: SparkSession, folder: str, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """The pieces as they were written, stripes in parallel; filters on the key go to the files."""
    schema = f"{key} {key_type}, file long, file_start long, n_tokens long, piece_start long, ids array<int>"
    return spark.read.schema(schema).orc(folder)


def file_starts(pieces: DataFrame) -> DataFrame:
    """One row per file that has documents: the ids of all files before it."""
    sums = pieces.where(F.col("piece_start") == 0).groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def placed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows with ``start``, the ids of all documents before theirs."""
    known = rows.join(starts, "file", "left").withColumn("start", F.col("before") + F.col("file_start"))
    return known.drop("file", "file_start", "before")


def lookup(spark: SparkSession, folder: str, keys: list, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """The whole ids of some documents, from the row groups that may hold them."""
    found = read_files(spark, folder, key_type, key).where(F.col(key).isin(keys))
    pieces = F.array_sort(F.collect_list(F.struct("piece_start", "ids")))
    return found.groupBy(key, "file", "file_start", "n_tokens").agg(
        F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids")
    )


# --- checksums -----------------------------------------------------------------------

def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of the checksum, lowest power in the highest bit."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return product


def moved(crc: int, n_bytes: int) -> int:
    """What a checksum adds to that of a text which goes on for ``n_bytes`` more bytes."""
    power, factor = 1 << 31, 1 << 23  # one, and the eighth power of x: a byte
    while n_bytes:
        if n_bytes & 1:
            power = _times(power, factor)
        factor = _times(factor, factor)
        n_bytes >>= 1
    return _times(crc, power)


def digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``file``, ``file_start``, ``n_tokens`` and ``ids_crc32`` of all its ids.

    The checksum of a whole is the exclusive or of its pieces' checksums, each moved by the
    bytes that follow; so pieces are summed up in any order and none are gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(5)
            offsets = 4 * ids.offsets.to_numpy().astype(np.int64)
            values = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            totals, places = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            sums, sizes = [], []
            for at, end, total, place in zip(offsets[:-1].tolist(), offsets[1:].tolist(), totals, places):
                crc, size = zlib.crc32(values[at:end]), (end - at) // 4
                rest = total - place - size
                sums.append(moved(crc, 4 * rest) if rest else crc)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums, pa.int64()), pa.array(sizes, pa.int64())],
                names=[key, "file", "file_start", "n_tokens", "crc", "size"],
            )

    kind = pieces.schema[key].dataType.simpleString()
    place = [key, "file", "file_start", "n_tokens"]
    parts = pieces.select(*place, "piece_start", "ids").mapInArrow(
        run, f"{key} {kind}, file long, file_start long, n_tokens long, crc long, size long"
    )
    whole = parts.groupBy(*place).agg(F.bit_xor("crc").alias("crc"), F.sum("size").alias("size"))
    lost = F.raise_error(F.lit("pieces of a document are missing in the files")).cast("long")
    return whole.select(*place, F.when(F.col("size") == F.col("n_tokens"), F.col("crc")).otherwise(lost).alias("ids_crc32"))


def round_trip(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Write all of ``docs`` to ``folder``; from the files, per document: key, ``start`` (ids of
    all documents before it), ``n_tokens`` and ``ids_crc32``.

    Null and empty texts have the end id alone; a text of any length is one document in
    pieces; null keys come first and stay null; repeated rows are written once each; an
    empty table gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    write_files(encode_pieces(docs, tokenizer_path, end_id, text, key), folder, key)
    pieces = read_files(docs.sparkSession, folder, docs.schema[key].dataType.simpleString(), key)
    found = placed(digests(pieces, key), file_starts(pieces))
    return found.select(key, "start", "n_tokens", "ids_crc32")
