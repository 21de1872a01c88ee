"""A Merkle manifest of a data set: a digest per row, per group and of the whole, with proofs.

Rows are the leaves of their group's tree, in order of a key; the groups' roots are the
leaves of one more tree.  While a tree has several nodes, every run of eight (the last may
be shorter, even one) becomes the digest of its hexadecimal digests, set one after another.

Leaves are numbered by a range partitioning, so a group may hold any share of the rows.
Aligned blocks of 8^3 nodes are one row each, which keeps each of its levels as one
hexadecimal string: fixed-width substrings of a level are the runs, whose digests are the
next level, and the substrings left and right of a node in its run are its siblings.  What
blocks come to are the nodes of the next round of blocks, until one is left per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.durable import durable

FAN = 8
DIGEST = 64  # hexadecimal digits of a digest
LEVELS = 3  # folded within a block
BLOCK = FAN**LEVELS
SIBLINGS = "array<struct<left:string,right:string>>"
HIGHEST = 20  # 8^20 rows are more than a long can count in practice


def leaf_hash(columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row's fields: ``-`` for a null, else UTF-8 length, a colon and the value.

    ``changed`` puts other values in the place of some columns'.
    """
    fields = []
    for name in columns:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        framed = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        fields.append(F.coalesce(framed, F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings, lowest level first, come to."""
    return F.aggregate(siblings, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings_digest(siblings: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(level: Column) -> Column:
    """A level's runs of eight digests, cut at fixed widths."""
    width = FAN * DIGEST
    numbers = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.transform(numbers, lambda i: F.substring(level, i * width + 1, F.lit(width)))


def _parents(level: Column) -> Column:
    return F.array_join(F.transform(_runs(level), lambda run: F.sha2(run, 256)), "")


def _height(rows: Column) -> Column:
    """How often ``rows`` nodes are folded until one is left."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(HIGHEST)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), 3 * k))
    return F.size(F.filter(powers, lambda power: power < rows))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` within their ``grp`` by ``order`` and the ``height`` of its tree.

    Rows are range partitioned by group, order and a number of their own, so neither a
    large group nor a row that is repeated over and over lands in one task; what is summed
    up over partitions is one row per partition and group.
    """
    dealt = (
        rows.withColumn("_own", F.monotonically_increasing_id())
        .repartitionByRange("grp", *order, "_own")
        .sortWithinPartitions("grp", *order, "_own")
    )
    table = durable(
        dealt.drop("_own").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    earlier = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        table.groupBy("grp", "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .select(
            F.col("grp").alias("_grp"),
            F.col("_part").alias("_span"),
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
            _height(F.sum("_rows").over(Window.partitionBy("grp"))).alias("height"),
        )
    )
    same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_part") == F.col("_span"))
    return (
        table.join(spans, same)
        .withColumn("position", F.col("_at") + F.col("_shift"))
        .drop("_grp", "_span", "_shift", "_part", "_at")
    )


def _blocks(nodes: DataFrame, below: int, carried: list[str]) -> DataFrame:
    """One row per block: its nodes, its levels as strings, and the digest it comes to.

    ``below`` levels of the trees have been folded before.
    """
    node = F.struct("position", "hash", *carried)
    grouped = nodes.groupBy("grp", F.floor(F.col("position") / BLOCK).alias("block")).agg(
        F.first("height").alias("height"), F.array_sort(F.collect_list(node)).alias("nodes")
    )
    level = F.array_join(F.transform("nodes", lambda x: x["hash"]), "")
    blocks = grouped.withColumn("level0", level).withColumn(
        "folds", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.col("height") - below))
    )
    for k in range(LEVELS):
        folded = F.when(F.col("folds") > k, _let(F.col(f"level{k}"), _parents)).otherwise(F.col(f"level{k}"))
        blocks = blocks.withColumn(f"level{k + 1}", folded)
    kept = [f"level{k}" for k in range(LEVELS)]
    return blocks.select("grp", "block", "height", "folds", "nodes", *kept, F.col(f"level{LEVELS}").alias("top"))


def _forest(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The tables of blocks, lowest first, until every group has come to one digest."""
    tables = []
    while True:
        folded = LEVELS * len(tables)
        table = durable(_blocks(nodes, folded, carried if not tables else []))
        tables.append(table)
        open_groups = table.where(F.col("height") > folded + LEVELS)
        if open_groups.isEmpty():
            return tables
        nodes = open_groups.select("grp", F.col("block").alias("position"), "height", F.col("top").alias("hash"))


def _roots(tables: list[DataFrame]) -> DataFrame:
    """One row per group with the digest it comes to."""
    tops = [
        table.where(F.col("height") <= LEVELS * (number + 1)).select("grp", F.col("top").alias("hash"))
        for number, table in enumerate(tables)
    ]
    whole = tops[0]
    for part in tops[1:]:
        whole = whole.unionByName(part)
    return whole


def _flank(run: Column, at: Column) -> Column:
    """The substrings of a run on both sides of its node ``at``."""
    rest = F.lit(FAN * DIGEST)
    return F.struct(
        F.substring(run, F.lit(1), at * DIGEST).alias("left"),
        F.substring(run, (at + 1) * DIGEST + 1, rest).alias("right"),
    )


def _paths(tables: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Every leaf with its siblings up to the last root.

    ``above`` has a row per group: ``subroot``, ``root`` and the ``siblings`` over the group.
    """
    upper = None
    for number in range(len(tables) - 1, -1, -1):
        own = [*carried] if number == 0 else []
        last = tables[number].where(F.col("height") <= LEVELS * (number + 1))
        over = above.select(F.col("grp").alias("_grp"), "subroot", "root", "siblings")
        blocks = last.join(over, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
        if upper is not None:
            inner = tables[number].where(F.col("height") > LEVELS * (number + 1))
            over = upper.select(
                F.col("grp").alias("_grp"), F.col("position").alias("_block"), "subroot", "root", "siblings"
            )
            same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block"))
            blocks = blocks.unionByName(inner.join(over, same).drop("_grp", "_block"))

        def leaf(x: Column, i: Column, runs: list[Column]) -> Column:
            flanks = [
                _flank(
                    F.element_at(runs[k], F.floor(i / FAN ** (k + 1)).cast("int") + 1),
                    F.floor(i / FAN**k).cast("int") % FAN,
                )
                for k in range(LEVELS)
            ]
            inside = F.concat(*[F.when(F.col("folds") > k, F.array(f)).otherwise(F.array().cast(SIBLINGS)) for k, f in enumerate(flanks)])
            return F.struct(
                x["position"].alias("position"),
                x["hash"].alias("leaf"),
                *[x[name].alias(name) for name in own],
                F.concat(inside, F.col("siblings")).alias("siblings"),
            )

        # Runs are cut once per block.  A level above the block's own top has one run, which nobody reads.
        leaves = _let(
            _runs(F.col("level0")),
            lambda r0: _let(
                _runs(F.col("level1")),
                lambda r1: _let(
                    _runs(F.col("level2")),
                    lambda r2: F.transform("nodes", lambda x, i: leaf(x, i, [r0, r1, r2])),
                ),
            ),
        )
        upper = blocks.select("grp", "subroot", "root", F.inline(leaves))
    return upper


def manifest(
    docs: DataFrame,
    columns: list[str],
    group: str = "lang",
    order: str = "doc_id",
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``grp``, the order key, ``leaf``, ``subroot`` of its group,
    ``root`` of all, ``siblings`` (array of left and right digests, lowest level first, through
    the subroot to the root) and the ``carried`` columns, which are computed from ``docs``.

    ``columns`` go into a leaf in this order.  Nulls in them have a mark of their own, so a
    null and an empty text differ.  Groups are ordered bytewise, null first, and so are leaves
    by the key; rows with equal keys are ordered by their leaves, and equal rows are leaves of
    their own.  A text of any length is one leaf.  Other columns of ``docs`` are ignored,
    whatever their names; a carried column must not have one of the result's names.  An
    empty table gives an empty result.
    """
    extra = carried or {}
    fixed = ["grp", "position", "leaf", "hash", "siblings", "subroot", "root", "height", order]
    if clash := set(extra) & set(fixed):
        raise ValueError(f"carried columns clash with columns of the result: {sorted(clash)}")
    leaves = durable(
        docs.select(
            F.col(group).alias("grp"),
            F.col(order).alias("_key"),
            leaf_hash(columns).alias("hash"),
            *[value.alias(name) for name, value in extra.items()],
        )
    )
    kept = ["_key", *extra]
    tables = _forest(numbered(leaves, ["_key", "hash"]), kept)
    subroots = _roots(tables).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "hash")
    upper = _forest(numbered(subroots, ["name"]), ["name"])
    top = _roots(upper).select("grp", F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    above = _paths(upper, top.withColumn("siblings", F.array().cast(SIBLINGS)), ["name"]).select(
        F.col("name").alias("grp"), F.col("leaf").alias("subroot"), "root", "siblings"
    )
    found = _paths(tables, durable(above), kept)
    return found.select("grp", F.col("_key").alias(order), "leaf", "subroot", "root", "siblings", *extra)


def verified(leaf: Column, siblings: Column, root: Column) -> Column:
    """Whether a leaf's digest and its siblings come to the root."""
    return fold(leaf, siblings) == root
