"""Jaccard join of word shingle sets by chosen paths.

Each set starts at the root of a tree, once per run.  At a node it follows every token
whose hash, which depends on the node, falls below 1 / (t * size): a pair with similarity
t or more shares at least one child on average, whatever its sizes, while unlike sets part.
A bucket is a node reached by two sets or more; one of more than ``leaf`` sets is split by
the next token, down to ``DEPTH`` tokens.  Within a bucket all pairs are compared on 128-bit
sketches, in blocks where it is still large, so no pair is lost to a cap.  Runs repeat until
the recall asked for, in two parts: what the first runs have brought together is one
cluster, and the other runs leave out nodes that hold sets of one cluster only, so a large
group of near copies is split by a few runs and not by all.  Sets that sketches bring
together form clusters, in which every pair is compared on the whole sets, again in blocks.  Groups give each set's links as a number
and a representative, never as a list of pairs.  Rows with the same shingle set form one
class first, which is never expanded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidemark.functions.durable import durable
from tidemark.llm.words import mix, shingles, text_blocks, words

DEPTH = 3
FIRST_RUNS = 5  # after which clusters are known
SKETCH_BITS = 128
SKETCH_SIGMAS = 4.5  # margin of the sketch test, in standard deviations at the threshold


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs so that a pair at the threshold is found with probability ``recall``.

    With Poisson(1) shared children a node's chance to reach depth k is 1 - exp(-chance at k - 1).
    """
    reach = 1.0
    for _ in range(depth):
        reach = 1 - math.exp(-reach)
    return math.ceil(math.log(1 - recall) / math.log(1 - reach))


def _seeds(count: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _below(share: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(share * 2**64)))


def _children(tokens: np.ndarray, nodes: np.ndarray, used: list[np.ndarray], threshold: float):
    """For every node the tokens that its set follows: (node number, token number, child node)."""
    left = len(tokens) - len(used)
    if left <= 0 or not len(nodes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    limit = _below(1 / (threshold * left))
    parents, places = [], []
    step = max(1, 4_000_000 // len(tokens))
    for at in range(0, len(nodes), step):
        hit = mix(tokens[None, :] ^ nodes[at : at + step, None]) < limit
        for places_used in used:
            hit[np.arange(len(hit)), places_used[at : at + step]] = False
        row, column = np.nonzero(hit)
        parents.append(row + at)
        places.append(column)
    parent, place = np.concatenate(parents), np.concatenate(places)
    return parent, place, mix(tokens[place] * np.uint64(0xD6E8FEB86659FD93) + nodes[parent])


def chosen_paths(tokens: np.ndarray, roots: np.ndarray, threshold: float):
    """First nodes of a set's paths with their runs, and for each the flat list of its (second, third) nodes.

    A third node of 0 means that the path ends at the second.
    """
    run, place1, node1 = _children(tokens, roots, [], threshold)
    up1, place2, node2 = _children(tokens, node1, [place1], threshold)
    up2, _, node3 = _children(tokens, node2, [place1[up1], place2], threshold)
    ends = np.setdiff1d(np.arange(len(node2)), up2)
    second = np.concatenate((up2, ends))
    third = np.concatenate((node3, np.zeros(len(ends), np.uint64)))
    order = np.argsort(up1[second], kind="stable")
    second, third = second[order], third[order]
    kids = np.stack((node2[second], third), axis=1).ravel()
    return node1, run, 2 * np.bincount(up1[second], minlength=len(node1)), kids


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    for block in text_blocks(column):
        found = words(block)
        row, value = shingles(found, size)
        counts = np.bincount(found.row, minlength=block.rows)
        for short in range(1, size):
            few = counts == short
            if few.any():
                at = np.isin(found.row, np.flatnonzero(few))
                part = type(found)(*(x[at] for x in found))
                more_row, more = shingles(part, short)
                row, value = np.concatenate((row, more_row)), np.concatenate((value, more))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        bounds = np.searchsorted(row, np.arange(block.rows + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            one = value[a:b]
            yield one[np.concatenate(([True], one[1:] != one[:-1]))] if b > a else one


def set_id(tokens: np.ndarray) -> bytes:
    """128 bits that depend on the set of tokens only; empty for no tokens."""
    if not len(tokens):
        return b""
    return np.array(
        [mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)]
    ).tobytes()


def sketch(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One bit of the minimum under each of ``SKETCH_BITS`` hash functions, in two numbers.

    Tokens are mixed already: the product with an odd number is hash enough.
    """
    step = max(1, 4_000_000 // len(tokens))
    odd = seeds | np.uint64(1)
    low = [(tokens[None, :] * odd[at : at + step, None]).min(axis=1) for at in range(0, len(odd), step)]
    bits = (mix(np.concatenate(low)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame, size: int, threshold: float, runs: int) -> DataFrame:
    """(row_key, key, set_id, n, low, high, paths) of every row of ``docs`` (row_key, key, text)."""
    roots, odd = _seeds(runs, 1), _seeds(SKETCH_BITS, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, sizes, sketches, first, runs_of, counts, kids, ends = [], [], [], [], [], [], [], [0]
                for tokens in shingle_sets(part.column(2), size):
                    ids.append(set_id(tokens))
                    sizes.append(len(tokens))
                    sketches.append(sketch(tokens, odd) if len(tokens) else np.zeros(2, np.int64))
                    if len(tokens):
                        node1, run_of, count, kid = chosen_paths(tokens, roots, threshold)
                        first.append(node1)
                        runs_of.append(run_of)
                        counts.append(count)
                        kids.append(kid)
                        ends.append(ends[-1] + len(node1))
                    else:
                        ends.append(ends[-1])
                join = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
                bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))))
                nodes = pa.StructArray.from_arrays(
                    [
                        pa.array(join(first)),
                        pa.array(np.concatenate([np.zeros(0, np.int64), *runs_of]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(join(kids))),
                    ],
                    names=["node", "run", "kids"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(ids, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array([pair[0] for pair in sketches], pa.int64()),
                        pa.array([pair[1] for pair in sketches], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes),
                    ],
                    names=["row_key", "key", "set_id", "n", "low", "high", "paths"],
                )

    return docs.mapInArrow(
        run,
        "row_key long, key long, set_id binary, n long, low long, high long,"
        " paths array<struct<node: long, run: int, kids: array<long>>>",
    )


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` (row_key, set_id, ...) with the ``tokens`` of its sets; rows that share a key may repeat one."""
    extra = [c for c in wanted.columns if c not in ("row_key", "set_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep, sets = [], []
                for row, tokens in enumerate(shingle_sets(part.column(0), size)):
                    if set_id(tokens) == part.column(1)[row].as_py():  # else another row of the same key
                        keep.append(row)
                        sets.append(tokens.view(np.int64))
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in part.columns[1:]), pa.array(sets, pa.list_(pa.int64()))],
                    names=["set_id", *extra, "tokens"],
                )

    rows = docs.join(wanted, "row_key").select("text", "set_id", *extra)
    return rows.mapInArrow(run, rows.drop("text").schema.add("tokens", ArrayType(LongType())))


def _shared(nodes: DataFrame) -> DataFrame:
    """Rows of nodes that sets of two clusters or more have reached, with the node's number of sets.

    Clusters are told by a hash: were two to collide, a pair would lose one node of its many.
    """
    sizes = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("sets"), F.min("cluster").alias("_low"), F.max("cluster").alias("_high")
    )
    mixed = sizes.where((F.col("sets") > 1) & (F.col("_low") != F.col("_high")))
    return nodes.join(mixed.select("node", "sets"), "node")


def buckets(classes: DataFrame, leaf: int) -> DataFrame:
    """(node, set_id, sets): for every path the first node with at most ``leaf`` sets, else its third.

    ``classes`` has set_id, paths and the ``cluster`` that a set is known to belong to; nodes
    within one cluster have nothing new.  A path that ends before it comes to a small
    bucket is left; the recall counts paths of full depth alone.
    """
    start = classes.select("set_id", "cluster", F.inline("paths")).drop("run")
    level1 = durable(_shared(start))
    pair = lambda i: F.transform(
        F.filter(F.sequence(F.lit(0), F.size("kids") - 1), lambda k: (k % 2) == 0),
        lambda k: F.element_at("kids", (k + 1 + i).cast("int")),
    )
    split = level1.where((F.col("sets") > leaf) & (F.size("kids") > 0)).select(
        "set_id", "cluster", F.inline(F.arrays_zip(pair(0).alias("second"), pair(1).alias("third")))
    )
    second = split.groupBy("set_id", "cluster", F.col("second").alias("node")).agg(F.collect_list("third").alias("kids"))
    level2 = durable(_shared(durable(second)))
    third = level2.where(F.col("sets") > leaf).select("set_id", "cluster", F.explode("kids").alias("node"))
    # A table first: nodes are counted and then joined, which would expand the paths twice.
    level3 = _shared(durable(third.where("node != 0").distinct())).select("node", "set_id", "sets")
    small = lambda level: level.where(F.col("sets") <= leaf).select("node", "set_id", "sets")
    return small(level1).unionByName(small(level2)).unionByName(level3)


def in_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Deal the rows of each ``group`` into ``blocks`` blocks and repeat them, so that any two
    blocks meet in one (group, i, j); ``own`` is a row's block."""
    number = rows.withColumn("_blocks", blocks.cast("int"))
    own = number.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("_blocks")).cast("int"))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = met.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")})
    placed = placed.drop("_blocks", "_other")
    return placed.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.Table]:
    """The groups of sorted rows by their first ``keys`` integer columns, across batches."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(values[:, a])
            if key != last and pending:
                yield pa.Table.from_batches(pending)
                pending = []
            last = key
            pending.append(batch.slice(a, b - a))
    if pending:
        yield pa.Table.from_batches(pending)


def _representatives(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its connected component."""
    first = np.full(len(near), -1)
    for row in range(len(near)):
        if first[row] < 0:
            first[row] = row
            reached = np.array([row])
            while len(reached):
                reached = np.flatnonzero(near[reached].any(axis=0) & (first < 0))
                first[reached] = row
    return first


def sketch_stars(found: DataFrame, classes: DataFrame, block: int, threshold: float) -> DataFrame:
    """(a, b): each set of a bucket with a set near to it by size and sketch, and the first
    set of those that it hangs together with."""
    agree = (1 + threshold) / 2
    deviation = math.sqrt(SKETCH_BITS * agree * (1 - agree))
    limit = SKETCH_BITS * (1 - agree) + SKETCH_SIGMAS * deviation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, firsts = [], []
        for group in whole_groups(batches):
            if len(group) < 2:
                continue
            # In order of ids, so that groups of the same sets name the same representative.
            group = group.sort_by("set_id")
            n, low, high = (group.column(c).to_numpy() for c in ("n", "low", "high"))
            near = np.zeros((len(n), len(n)), dtype=bool)
            for at in range(0, len(n), 256):
                rows = slice(at, at + 256)
                apart = np.bitwise_count((low[rows, None] ^ low).view(np.uint64)).astype(np.int16)
                apart += np.bitwise_count((high[rows, None] ^ high).view(np.uint64))
                near[rows] = (apart <= limit) & (
                    np.minimum(n[rows, None], n) >= threshold * np.maximum(n[rows, None], n)
                )
            np.fill_diagonal(near, False)
            first = _representatives(near)
            rows = np.flatnonzero(first != np.arange(len(n)))
            if len(rows):
                ids = group.column("set_id").combine_chunks()
                members += ids.take(pa.array(rows)).to_pylist()
                firsts += ids.take(pa.array(first[rows])).to_pylist()
            if len(members) > 5000:
                yield pa.RecordBatch.from_pydict({"a": members, "b": firsts})
                members, firsts = [], []
        if members:
            yield pa.RecordBatch.from_pydict({"a": members, "b": firsts})

    rows = found.join(classes.select("set_id", "n", "low", "high"), "set_id")
    dealt = in_blocks(rows, "node", F.ceil(F.col("sets") / block))
    return (
        dealt.select("node", "i", "j", "set_id", "n", "low", "high").mapInArrow(run, "a binary, b binary").distinct()
    )


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of the 0/1 incidence matrix in slices."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[shared][order], token[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    tokens = int(token[-1]) + 1 if len(token) else 0
    width = min(tokens, max(1, 8_000_000 // len(sets)))
    for at in range(0, tokens, max(1, width)):
        a, b = np.searchsorted(token, (at, at + width))
        slab = np.zeros((len(sets), width), dtype=np.float32)
        slab[row[a:b], token[a:b] - at] = 1
        common += slab @ slab.T
    return common


def cluster_links(members: DataFrame, block: int, block_tokens: int, threshold: float) -> DataFrame:
    """(a, b, links): a set, the first set that it hangs together with in one group of blocks,
    and the copies of the sets there whose similarity to it is ``threshold`` or more.

    ``members``: cluster, sets and set_tokens of the cluster, set_id, copies, tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches):
            group = group.sort_by("set_id")
            ids = group.column("set_id").to_pylist()
            once = sorted({key: row for row, key in enumerate(ids)}.values())  # repeated rows repeat a set
            if len(once) < 2:
                continue
            own = group.column("own").to_numpy()[once]
            copies = group.column("copies").to_numpy()[once].astype(float)
            tokens = group.column("tokens").combine_chunks()
            sets = [tokens[row].values.to_numpy() for row in once]
            n = np.array([len(s) for s in sets], dtype=float)
            common = common_tokens(sets)
            linked = common >= threshold * (n[:, None] + n - common) - 1e-9
            if own.min() != own.max():  # two blocks: pairs within one are met elsewhere
                linked &= own[:, None] != own
            np.fill_diagonal(linked, False)
            first = _representatives(linked)
            rows = np.flatnonzero(linked.any(axis=1))
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[once[r]] for r in rows], pa.binary()),
                        pa.array([ids[once[r]] for r in first[rows]], pa.binary()),
                        pa.array((linked[rows] @ copies).astype(np.int64)),
                    ],
                    names=["a", "b", "links"],
                )

    blocks = F.greatest(F.ceil(F.col("sets") / block), F.ceil(F.col("set_tokens") / block_tokens))
    dealt = in_blocks(members, "cluster", blocks)
    columns = ["cluster", "i", "j", "own", "set_id", "copies", "tokens"]
    return dealt.select(columns).mapInArrow(run, "a binary, b binary, links long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(set_id, root): the smallest set id of each connected component of ``links`` (a, b).

    Every round each node takes the least label around it, then the label of that label,
    so paths shrink geometrically.  Each round is a table; only a count comes to the driver.
    """
    edges = durable(
        links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    )
    labels = durable(edges.groupBy(F.col("a").alias("set_id")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(most_rounds):
        near = (
            edges.join(labels.select(F.col("set_id").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("set_id"))
            .agg(F.min("root").alias("around"))
        )
        pulled = labels.join(near, "set_id").select(
            "set_id", F.col("root").alias("old"), F.least("root", "around").alias("low")
        )
        jumped = pulled.join(
            labels.select(F.col("set_id").alias("low"), F.col("root").alias("far")), "low", "left"
        )
        step = durable(
            jumped.select("set_id", "old", F.least("low", F.coalesce("far", "low")).alias("root"))
        )
        labels = step.select("set_id", "root")
        if step.where(F.col("old") != F.col("root")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    size: int = 5,
    recall: float = 0.999,
    leaf: int = 256,
    block: int = 1024,
    block_tokens: int = 1 << 19,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: key, ``class_id``, ``copy_id`` and ``n_links``.

    ``copy_id`` is the smallest key with the same set of ``size``-word shingles, ``class_id``
    the smallest key that is reached over links, ``n_links`` the number of other rows whose
    similarity is ``threshold`` or more (rows without words have none).  A text of fewer
    words than ``size`` is one shingle.  Null texts are empty; a row without words is a
    class of its own; a null key stays null, and is a class's id only if the class has no
    other; repeated rows count as copies of each other; other columns of ``docs`` are
    ignored; an empty table gives an empty result.
    """
    number = F.col(key).cast("long")
    # Rows without a key are found again by a hash of their text.
    row_key = F.coalesce(number, F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63))))
    rows = docs.select(row_key.alias("row_key"), number.alias("key"), F.col(text).alias("text"))
    marked = durable(signatures(rows, size, threshold, runs_for(recall)))
    classes = durable(
        marked.where("n > 0")
        .groupBy("set_id")
        .agg(
            F.min("row_key").alias("row_key"),
            F.min("key").alias("first"),
            F.count(F.lit(1)).alias("copies"),
            *[F.first(c).alias(c) for c in ("n", "low", "high", "paths")],
        )
    )

    def stars(known: DataFrame, runs: Callable[[Column], Column]) -> DataFrame:
        """Links of the paths of some runs; ``known`` has a set's cluster so far."""
        paths = F.filter("paths", lambda path: runs(path["run"]))
        found = buckets(known.select("set_id", "cluster", paths.alias("paths")), leaf)
        return durable(sketch_stars(found, classes, block, threshold))

    alone = F.xxhash64("set_id")
    early = stars(classes.withColumn("cluster", alone), lambda run: run < FIRST_RUNS)
    together = components(early).select("set_id", F.xxhash64("root").alias("known"))
    labelled = classes.join(together, "set_id", "left").withColumn("cluster", F.coalesce("known", alone))
    clusters = components(early.unionByName(stars(labelled, lambda run: run >= FIRST_RUNS)))
    sizes = clusters.join(classes.select("set_id", "row_key", "copies", "n"), "set_id")
    totals = sizes.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("set_tokens"))
    wanted = sizes.join(totals, "root").select(
        "row_key", "set_id", "copies", F.xxhash64("root").alias("cluster"), "sets", "set_tokens"
    )
    members = whole_sets(rows.select("row_key", "text"), wanted, size)
    links = durable(cluster_links(members, block, block_tokens, threshold))

    partners = links.groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("partners"))
    reached = components(links.where("a != b").select("a", "b")).join(classes.select("set_id", "first"), "set_id")
    lowest = reached.groupBy("root").agg(F.min("first").alias("class_id"))
    linked = reached.join(lowest, "root").select("set_id", "class_id").join(partners, "set_id", "left")
    known = durable(
        classes.join(linked, "set_id", "left").select(
            "set_id",
            F.coalesce("class_id", "first").alias("class_id"),
            F.col("first").alias("copy_id"),
            (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
        )
    )
    result = marked.select("key", "set_id").join(known, "set_id", "left")
    return result.select(
        F.col("key").alias(key),
        F.coalesce("class_id", "key").alias("class_id"),
        F.coalesce("copy_id", "key").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
