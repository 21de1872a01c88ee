"""Exact duplicates by Patricia tries: each terminal node stores the owner of its text.

Rows are dealt out by text length and content hash; every task inserts whole byte strings
into a compressed radix trie, once per input partition (so a third of all rows being one
text leaves one row per task) and once per dealt partition.  Equality is that of the full
strings.  A trie that outgrows its bound writes its heaviest subtree to a temporary file
of the task and goes on; spilled subtrees are built one at a time afterwards.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OWNERS = {"largest": max, "smallest": min}


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    __slots__ = ("label", "children", "owner", "count", "spilled", "weight")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.owner, self.count = None, 0
        self.spilled, self.weight = None, 0


class PatriciaTrie:
    """Byte strings with an owner and a count; ``limit`` bounds the bytes held in labels."""

    def __init__(self, better: Callable = min, limit: int = 64 << 20):
        self.better, self.limit = better, limit
        self.root, self.held = Node(b""), 0

    def insert(self, text: bytes, owner, count: int = 1) -> None:
        node, at, top = self.root, 0, None
        while True:
            if node.spilled is not None:
                pickle.dump((text[at:], owner, count), node.spilled)
                return
            if at == len(text):
                break
            child = node.children.get(text[at])
            if child is None:
                leaf = Node(text[at:])
                node.children[text[at]] = leaf
                self._grow(top or leaf, len(leaf.label))
                node = leaf
                break
            rest = text[at : at + len(child.label)]
            shared = len(rest) if rest == child.label else common_prefix(rest, child.label)
            if shared < len(child.label):  # split the edge
                middle = Node(child.label[:shared])
                middle.weight = child.weight
                child.label = child.label[shared:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = child = middle
            node, at = child, at + shared
            top = top or child
        node.owner = owner if node.count == 0 else self._better(node.owner, owner)
        node.count += count
        if self.held > self.limit:
            self._spill()

    def _better(self, a, b):
        return b if a is None else a if b is None else self.better(a, b)

    def _grow(self, top: Node, size: int) -> None:
        top.weight += size
        self.held += size

    def _spill(self) -> None:
        """Write out the heaviest subtree below the root, keep its edge."""
        top = max((n for n in self.root.children.values() if n.spilled is None), key=lambda n: n.weight, default=None)
        if top is None:
            return
        out, below = tempfile.TemporaryFile(), []
        for row in self._walk(top, b"", below):
            pickle.dump(row, out)
        # An edge that was split after its spill lies below: its rows move to the new file.
        for node, before in below:
            for text, owner, count in self._spilled_rows(node):
                pickle.dump((before + text, owner, count), out)
        self.held -= top.weight
        top.children, top.owner, top.count, top.weight, top.spilled = {}, None, 0, 0, out

    @staticmethod
    def _spilled_rows(node: Node) -> Iterator[tuple]:
        """Rows of a spilled node's file, their texts after the node's edge; the file is used up."""
        with node.spilled as rows:
            rows.seek(0)
            while True:
                try:
                    row = pickle.load(rows)
                except EOFError:
                    return
                yield row

    def _walk(self, top: Node, prefix: bytes, spilled: list) -> Iterator[tuple]:
        """Terminals below ``top``, their texts after ``prefix``; spilled nodes are put aside."""
        todo = [(top, prefix)]
        while todo:
            node, before = todo.pop()
            if node.spilled is not None:
                spilled.append((node, before))
                continue
            if node.count:
                yield before, node.owner, node.count
            todo += [(child, before + child.label) for child in node.children.values()]

    def terminals(self) -> Iterator[tuple[bytes, object, int]]:
        """Every distinct string with its owner and count; the trie is used up."""
        spilled: list = []
        yield from self._walk(self.root, b"", spilled)
        self.root = Node(b"")
        for node, before in spilled:
            below = PatriciaTrie(self.better, self.limit)
            for row in self._spilled_rows(node):
                below.insert(*row)
            for text, owner, count in below.terminals():
                yield before + text, owner, count


def _tries(better: Callable, limit: int, key_type: pa.DataType) -> Callable:
    """Arrow batches of (text bytes, owner, count) to one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(better, limit)
        for batch in batches:
            for text, owner, count in zip(*(column.to_pylist() for column in batch.columns)):
                trie.insert(text, owner, count)
        rows, size = [], 0
        for row in trie.terminals():
            rows.append(row)
            size += len(row[0])
            if size > 4 << 20:
                yield _batch(rows, key_type)
                rows, size = [], 0
        if rows:
            yield _batch(rows, key_type)

    return run


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    texts, owners, counts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.binary()), pa.array(owners, key_type), pa.array(counts, pa.int64())],
        names=["bytes", "keep_id", "group_size"],
    )


def text_owners(
    docs: DataFrame, keep: str = "smallest", text: str = "text", key: str = "doc_id", limit: int = 64 << 20
) -> DataFrame:
    """One row per distinct text: its bytes, the key that owns it and the number of rows."""
    run = _tries(OWNERS[keep], limit, pa.int64())
    schema = "bytes binary, keep_id long, group_size long"
    rows = docs.select(
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"),
        F.col(key).cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    )
    local = rows.mapInArrow(run, schema)
    dealt = local.repartition(F.length("bytes"), F.xxhash64("bytes"))
    return dealt.mapInArrow(run, schema)


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", text: str = "text", key: str = "doc_id", limit: int = 64 << 20
) -> DataFrame:
    """``docs`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``, one row per row.

    Texts are equal if their bytes are; a null text counts as empty.  The owner is the
    ``keep`` key of a text; null keys own a text only if all its keys are null.  Rows
    that share the owner's key (repeated rows) are all kept.  Columns of ``docs`` that
    have the names of the new ones are replaced.  An empty table gives an empty result.
    """
    owners = text_owners(docs, keep, text, key, limit).select(
        F.sha2("bytes", 256).alias("text_sha256"), "keep_id", "group_size"
    )
    marked = docs.drop("keep_id", "group_size", "kept").withColumn(
        "text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    )
    # Every text has an owner; were one missing, its rows must not vanish in the join.
    lost = F.raise_error(F.lit("a text has no owner")).cast("boolean")
    kept = F.when(F.col("group_size").isNull(), lost).otherwise(F.col(key).eqNullSafe(F.col("keep_id")))
    return marked.join(owners, "text_sha256", "left").withColumn("kept", kept)
