"""Quality rules: counted rules, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams (orders 1 and 2) are compared: one of trusted
text, one of the whole corpus.  A document's score is the mean log ratio over its
n-grams; a document is kept if its score reaches a fixed threshold.  The corpus counts
cover every document, trusted text and the threshold every labelled one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm.words import TextBlock, Words, shingles, text_blocks, words

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

SLOTS_LOG2 = 16
LABEL_BITS_LOG2 = 26  # of the bitmap that finds labelled rows
ORDERS = (1, 2)
BIN = 0.005  # width of a threshold's step
PRIOR = 1000.0
LOSS = 20  # rejecting one trusted document costs as much as keeping so many bad ones

BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Model(NamedTuple):
    """Counts of each n-gram slot (trusted documents, all documents), and the threshold."""

    counts: np.ndarray
    threshold: float


def slots(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every n-gram of a block."""
    rows, hashed = [], []
    for order in ORDERS:
        row, value = shingles(found, order)
        rows.append(row)
        hashed.append((value >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(hashed)


def repeated_windows(found: Words, rows: int, size: int = 3) -> np.ndarray:
    """Words per row that lie in a window of ``size`` words found twice or more in the row."""
    row, value = shingles(found, size)
    if not len(row):
        return np.zeros(rows, dtype=np.int64)
    order = np.lexsort((value, row))
    same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    twice = np.zeros(len(row), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # Windows are numbered without those that cross rows: find the first word of each.
    first = np.flatnonzero(found.row[: len(found.row) - size + 1] == found.row[size - 1 :])
    covered = np.zeros(len(found.row), dtype=bool)
    for k in range(size):
        covered[first[twice] + k] = True
    return np.bincount(found.row[covered], minlength=rows)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def base_counts(block: TextBlock, found: Words) -> dict[str, np.ndarray]:
    """The counts of ``BASE_COLUMNS`` for every row of a block."""
    data, rows = block.data, block.rows
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    chars = points[found.end] - points[found.start]
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[data])))
    raw = data.tobytes()
    bounds = block.offsets
    return {
        "n_words": np.bincount(found.row, minlength=rows),
        "word_chars": np.bincount(found.row, weights=chars, minlength=rows).astype(np.int64),
        "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]],
        "n_dup_lines": np.array(
            [repeated_lines(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], dtype=np.int64
        ),
        "n_repeat_words": repeated_windows(found, rows),
    }


def sampled_labels(labels: DataFrame, label: str, max_labelled: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of about ``max_labelled`` labelled keys at most, drawn by a hash; a key with
    several labels has its largest.  Small by that bound, so it may be broadcast."""
    known = all_labels(labels, label, key)
    share = min(1.0, max_labelled / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    return F.broadcast(drawn)


def all_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(key, label) of every labelled key; a key with several labels has its largest."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(key).agg(F.max(label).alias(label))


def with_labels(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` that have a label, with it.

    A bitmap of hashed keys, of 8 MB at most whatever the number of labels, keeps most texts
    without a label out of the shuffle.  The join is by shuffle at every size, so a plan doesn't
    turn with the number of labels.
    """
    slot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << LABEL_BITS_LOG2))
    place = {"_bucket": F.bitmap_bucket_number(slot), "_bit": F.bitmap_bit_position(slot)}
    bits = known.withColumns(place).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    maybe = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    likely = docs.withColumns(place).join(F.broadcast(bits), "_bucket").where(maybe).select(*docs.columns)
    return likely.join(known.hint("merge"), key)


def ngram_counts(docs: DataFrame, text: str = "text", trusted: str = "trusted") -> np.ndarray:
    """Counts of every slot, row 0 of the trusted documents, row 1 of all; added up by Spark."""
    size = 1 << SLOTS_LOG2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            for block in text_blocks(batch.column(0)):
                row, slot = slots(words(block))
                counts[1] += np.bincount(slot, minlength=size)
                counts[0] += np.bincount(slot[good[block.first + row]], minlength=size)
        used = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["slot", "good", "all"]
        )

    partial = docs.select(text, trusted).mapInArrow(run, "slot long, good long, all long")
    total = np.zeros((2, size), dtype=np.int64)
    for row in partial.groupBy("slot").agg(F.sum("good"), F.sum("all")).collect():  # at most 2^16 rows
        total[:, row[0]] = row[1:]
    return total


def scores(counts: np.ndarray, row: np.ndarray, slot: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
    """Mean log of trusted over corpus probability over the n-grams of each row, 0 without any.

    ``PRIOR`` n-grams of the corpus are mixed into the trusted text.  Where ``own`` is set
    the row is itself trusted text: its n-grams are taken out before it is scored, else
    labelled rows would look better than equally good rows without a label.
    """
    corpus = (counts[1] + 1.0) / (counts[1].sum() + counts.shape[1])
    n = np.bincount(row, minlength=rows)
    key, inverse, times = np.unique(row * counts.shape[1] + slot, return_inverse=True, return_counts=True)
    mine = np.where(own[row], times[inverse], 0)
    good = counts[0][slot] - mine + PRIOR * corpus[slot]
    total = counts[0].sum() - np.where(own, n, 0)[row] + PRIOR
    ratio = np.log(good / total) - np.log(corpus[slot])
    return np.bincount(row, weights=ratio, minlength=rows) / np.maximum(n, 1)


def judge(docs: DataFrame, counts: np.ndarray, text: str = "text", trusted: str | None = None) -> DataFrame:
    """``docs`` with the columns of ``BASE_COLUMNS`` and ``score``.

    ``trusted`` names a boolean column of the rows that the counts hold as trusted text.
    """
    keep = [c for c in docs.columns if c not in (*BASE_COLUMNS, "score")]
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            own = np.zeros(batch.num_rows, dtype=bool)
            if trusted:
                own |= batch.column(keep.index(trusted)).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for block in text_blocks(batch.column(place)):
                found = words(block)
                row, slot = slots(found)
                mine = own[block.first : block.first + block.rows]
                score = scores(counts, row, slot, mine, block.rows)
                parts.append([*base_counts(block, found).values(), score])
            new = [np.concatenate(column) for column in zip(*parts)] if parts else [np.zeros(0)] * 6
            types = [pa.int64()] * len(BASE_COLUMNS) + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, t) for v, t in zip(new, types))],
                names=[*batch.schema.names, *BASE_COLUMNS, "score"],
            )

    schema = docs.select(keep).schema
    for name in BASE_COLUMNS:
        schema = schema.add(name, "long")
    return docs.select(keep).mapInArrow(run, schema.add("score", "double"))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def fit_threshold(scored: DataFrame, label: str) -> float:
    """The step with the least cost on labelled documents that pass the counted rules.

    The threshold lies halfway from that step to the next score.  A step under every score,
    which keeps all, wins ties: documents go only where that pays.
    """
    step = F.floor(F.col("score") / BIN)
    rows = scored.where(~base_failed()).groupBy(step.alias("step"), label).count().collect()  # few steps, two labels
    if not rows:
        return float("-inf")
    steps = sorted({row["step"] for row in rows})
    good, bad = ({row["step"]: row["count"] for row in rows if row[label] == v} for v in (1, 0))
    best, cost, saved = None, 0, 0
    for step in steps:  # threshold above this step
        saved += bad.get(step, 0) - LOSS * good.get(step, 0)
        if saved > cost:
            best, cost = step + 1, saved
    if best is None:
        return float("-inf")
    above = min((step for step in steps if step >= best), default=best)
    return (best + above) / 2 * BIN


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    key: str = "doc_id",
) -> Model:
    """Count the corpus and all trusted texts, then set the threshold on every labelled document.

    The corpus is counted where it lies; only labelled texts meet their labels, and are kept
    as a table, as they are read twice.  Without trusted rows every score is 0 and all pass.
    """
    known = all_labels(labels.select(key, label), label, key)
    met = with_labels(docs.select(key, text), known, key)
    labelled = durable(met.select(text, label, (F.col(label) == 1).alias("trusted")))
    counts = ngram_counts(docs.select(text).withColumn("trusted", F.lit(False)), text)
    counts[0] = ngram_counts(labelled.where("trusted"), text)[1]
    if not counts[0].any():
        return Model(counts[[1, 1]], float("-inf"))
    return Model(counts, fit_threshold(judge(labelled, counts, text, "trusted"), label))


def quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``score`` and ``kept``, one row per row.

    A null text has no words and fails; so does an empty one.  Equal texts get equal
    verdicts; columns of ``docs`` that have the names of the new ones are replaced; an
    empty table gives an empty result.
    """
    judged = judge(docs.drop("base_failed", "kept"), model.counts, text)
    return judged.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold))
    )
