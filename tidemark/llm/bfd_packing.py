"""Packing of documents into token windows by best-fit decreasing.

A document becomes its token ids and an end id.  Overlong documents are first cut into
full windows; what is left of each is placed, longest first, into the open window with
the least room that still takes it.  Rows arrive sorted by falling length, so a piece is
placed once and emitted at once: a task holds only the room of its open windows.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_encodings: dict[str, object] = {}
_markers: dict[str, tuple[re.Pattern | None, dict[str, int]]] = {}

PIECE = "{id} {type}, start long, length long, doc_tokens long, ids binary"
PLACED = PIECE + ", sequence_id long, offset long"


def byte_pair_encoder(path: str):
    """The ids of ``tokenizers`` for text between added tokens, by the same vocabulary as ranks.

    ``path`` names the JSON file of a byte-level BPE; the ranks lie beside it.  Strings of
    special tokens are ordinary text here; ``text_encoder`` gives them their ids.
    """
    import public_tokenizers
    import tiktoken

    if path not in _encodings:
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[path].encode_ordinary


def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern that finds the added tokens of a JSON file, the longest first, and their ids."""
    if path not in _markers:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)["added_tokens"]
        odd = [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd:
            raise ValueError(f"added tokens that take more than their own characters: {odd}")
        ids = {t["content"]: t["id"] for t in found}
        longest_first = sorted(ids, key=len, reverse=True)
        _markers[path] = re.compile("|".join(map(re.escape, longest_first))) if ids else None, ids
    return _markers[path]


def text_encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of ``tokenizers`` without special tokens of its own: added tokens that stand in the
    text have their ids, what lies between is encoded piece by piece."""
    ordinary, (marker, added) = byte_pair_encoder(path), added_tokens(path)

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for match in marker.finditer(text) if marker else ():
            ids += ordinary(text[at : match.start()])
            ids.append(added[match[0]])
            at = match.end()
        return ids + ordinary(text[at:]) if at else ordinary(text)

    return encode


class RoomTree:
    """Open windows by remaining room: a segment tree whose leaves are the rooms 0 to ``most``.

    A node counts the open windows below it; the tightest window with at least ``length``
    left is the first non-empty leaf from ``length`` on.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.windows[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:  # up, until a right sibling holds a window; then down to its first leaf
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per full window and per remainder of every document, with its ids as
    little-endian unsigned 32-bit numbers.  A null text is empty: its piece is the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, starts, lengths, totals, pieces = [], [], [], [], []
                for number, value in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(value or ""), end_id], dtype="<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        keys.append(number)
                        starts.append(start)
                        lengths.append(len(piece))
                        totals.append(len(ids))
                        pieces.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keys, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(pieces, pa.binary()),
                    ],
                    names=[key, "start", "length", "doc_tokens", "ids"],
                )

    schema = PIECE.format(id=key, type=docs.schema[key].dataType.simpleString())
    return docs.select(key, text).mapInArrow(run, schema)


def place(pieces: DataFrame, window: int = 1024, key: str = "doc_id") -> DataFrame:
    """Give every piece its sequence and its offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = RoomTree(window)
        # Sequences are numbered within the task; the task's number keeps them apart.
        first = TaskContext.get().partitionId() << 40
        opened = 0
        for batch in batches:
            sequences, offsets = [], []
            for length in batch.column(2).to_pylist():
                room = tree.tightest(length) if length < window else None
                if room is None:
                    number, room, opened = opened, window, opened + 1
                else:
                    number = tree.take(room)
                sequences.append(first + number)
                offsets.append(window - room)
                if room > length:
                    tree.add(room - length, number)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    schema = PLACED.format(id=key, type=pieces.schema[key].dataType.simpleString())
    # Dealt by content: no key gathers its rows in one task, and a lost task finds the same rows again.
    dealt = pieces.repartition(key, "start", F.xxhash64("ids"))
    return dealt.sortWithinPartitions(F.col("length").desc(), key, "start", "ids").mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Pack all of ``docs``: one row per piece with its document, span, ids, sequence and offset.

    Null and empty texts make a piece of one id; a text of any length is cut into full
    windows; a null key stays null; repeated rows are packed once each; an empty table
    gives no rows; other columns of ``docs`` are ignored, whatever their names.  Ties in
    length are placed in order of (key, start, ids).  Tasks pack alone, each ends with at
    most a few windows that are not full.
    """
    return place(cut_pieces(docs, tokenizer_path, window, end_id, text, key), window, key)


def padded_lengths(placed: DataFrame, window: int = 1024) -> DataFrame:
    """Used and padded length per sequence: padded to ``window``, except at a power of two."""
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    # A power of two has one set bit.
    return used.withColumn("padded", F.when(F.bit_count("used") == 1, F.col("used")).otherwise(F.lit(window)))
