"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and, of longer words, the first bytes; a document is the set
of its terms' hash slots.  The machine adds to a bias the weight of each present slot and,
for every two slots, the product of their factor vectors: an insult beside a mention of a
group weighs more than both alone.  It is fitted on at most ``max_labelled`` labelled
documents, drawn by a hash of the key.  It takes every slot that bears on the labels,
alone or, by a first fit over all slots, together with others; every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngram_ratio import sampled_labels
from tidemark.llm.words import TextBlock, span_hashes, text_blocks

SLOTS_LOG2 = 20
PREFIX_BYTES = 5
MIN_DOCUMENTS = 4
FACTORS = 4
BATCH, RATE, PENALTY = 64, 0.1, 1e-5
START = 0.02  # spread of the factors before a fit
SHORT = 32  # slots; the pairs of a row with n slots weigh SHORT / (SHORT + n), else long rows drown all others
# Epochs, and the squared gradients that a parameter starts with: many hold back what is rare.
SCREEN_EPOCHS, SCREEN_CALM = 5, 10.0
EPOCHS, CALM = 30, 1e-8
ALONE = 2.0  # times the log of the number of slots: the chi-square from which a slot's own effect counts
JOINT = 16  # times the median of the screened factors' squares, from which a slot's pairs count


class Machine(NamedTuple):
    """``place`` gives each hash slot's row in the parameters, -1 for slots without any."""

    place: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def terms(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every different term of a block, rows rising."""
    data = block.data.copy()
    upper = (data >= 65) & (data <= 90)
    # In UTF-8 a Latin capital with an accent differs from its small letter by the same 32.
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    upper |= after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data[upper] += 32
    letter = np.zeros(len(data) + 2, dtype=bool)
    letter[1:-1] = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[block.offsets] = True
    start = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
    end = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
    row = np.searchsorted(block.offsets, start, side="right") - 1
    long = end - start > PREFIX_BYTES
    prefix = span_hashes(data, start[long], start[long] + PREFIX_BYTES) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    value = np.concatenate((span_hashes(data, start, end), prefix)) >> np.uint64(64 - SLOTS_LOG2)
    key = np.unique(np.concatenate((row, row[long])) << SLOTS_LOG2 | value.astype(np.int64))
    return key >> SLOTS_LOG2, key & ((1 << SLOTS_LOG2) - 1)


def labelled_terms(docs: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(label, slots) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                row, slot = terms(block)
                ends = np.searchsorted(row, np.arange(block.rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), lists], names=["label", "slots"]
                )

    return docs.select(F.col(label).cast("int").alias("label"), text).mapInArrow(run, "label int, slots array<int>")


def _row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values of each row; rows rise."""
    out = np.zeros((rows, *values.shape[1:]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def pair_weight(row: np.ndarray, rows: int) -> np.ndarray:
    return SHORT / (SHORT + np.bincount(row, minlength=rows))


def margins(machine: Machine, row: np.ndarray, place: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each row, and its summed factors."""
    factor = machine.factor[place]
    total = _row_sums(factor, row, rows)
    squares = _row_sums(factor**2, row, rows)
    linear = np.bincount(row, weights=machine.weight[place], minlength=rows)
    pairs = 0.5 * (total**2 - squares).sum(axis=1)
    return machine.bias + linear + pair_weight(row, rows) * pairs, total


def alone(label: np.ndarray, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For each slot, whether its presence and the label go together, by chi-square.

    The bar rises with the number of slots that are tried, so that few pass it by chance.
    """
    n, toxic = len(label), label.sum()
    seen = np.bincount(slot, minlength=1 << SLOTS_LOG2).astype(float)
    with_label = np.bincount(slot, weights=label[row], minlength=1 << SLOTS_LOG2)
    expected = seen * toxic / max(n, 1)
    spread = expected * (1 - toxic / max(n, 1)) * (1 - seen / max(n, 1)) + 1e-9
    return (with_label - expected) ** 2 / spread > ALONE * np.log(max(2, np.count_nonzero(seen >= MIN_DOCUMENTS)))


def descend(
    label: np.ndarray, row: np.ndarray, slot: np.ndarray, chosen: np.ndarray, epochs: int, calm: float, seed: int
) -> Machine:
    """Logistic loss, mini-batches, AdaGrad, over the chosen slots; rows rise."""
    place = np.full(1 << SLOTS_LOG2, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    known = place[slot] >= 0
    row, spot = row[known], place[slot[known]]
    random = np.random.default_rng(seed)
    share = (label.sum() + 1) / (len(label) + 2)
    start = random.normal(0, START, (len(chosen), FACTORS))
    machine = Machine(place, float(np.log(share / (1 - share))), np.zeros(len(chosen)), start)
    if not len(chosen):
        return machine
    starts = np.searchsorted(row, np.arange(len(label) + 1))
    bias, bias_sum = machine.bias, calm
    weight_sum, factor_sum = np.full(len(chosen), calm), np.full(machine.factor.shape, calm)
    for _ in range(epochs):
        order = random.permutation(len(label))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            sizes = starts[picked + 1] - starts[picked]
            member = np.repeat(np.arange(len(picked)), sizes)
            offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            here = spot[np.repeat(starts[picked], sizes) + offsets]
            margin, total = margins(machine._replace(bias=bias), member, here, len(picked))
            error = 1 / (1 + np.exp(-np.clip(margin, -700, 700))) - label[picked]
            bias_sum += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(bias_sum)
            if not len(here):  # rows without any of the slots
                continue
            touched, inverse = np.unique(here, return_inverse=True)
            d_weight = np.bincount(inverse, weights=error[member], minlength=len(touched))
            pull = (error * pair_weight(member, len(picked)))[member][:, None] * (total[member] - machine.factor[here])
            d_factor = np.stack([np.bincount(inverse, weights=p, minlength=len(touched)) for p in pull.T], axis=1)
            d_weight += PENALTY * machine.weight[touched]
            d_factor += PENALTY * machine.factor[touched]
            weight_sum[touched] += d_weight**2
            factor_sum[touched] += d_factor**2
            machine.weight[touched] -= RATE * d_weight / np.sqrt(weight_sum[touched])
            machine.factor[touched] -= RATE / 2 * d_factor / np.sqrt(factor_sum[touched])
    return machine._replace(bias=float(bias))


def train(label: np.ndarray, row: np.ndarray, slot: np.ndarray, seed: int = 7) -> Machine:
    """A short, damped fit over every slot in ``MIN_DOCUMENTS`` rows or more, then the machine.

    The machine has the slots with an effect of their own and those whose factors grew in the
    first fit: a pair counts whose slots say nothing alone.  With one label or none only a bias
    is learnt.
    """
    seen = np.bincount(slot, minlength=1 << SLOTS_LOG2) >= MIN_DOCUMENTS
    if len(np.unique(label)) < 2 or not seen.any():
        return descend(label, row, slot, np.zeros(0, np.int64), 0, CALM, seed)
    usual = np.flatnonzero(seen)
    grown = (descend(label, row, slot, usual, SCREEN_EPOCHS, SCREEN_CALM, seed).factor ** 2).sum(axis=1)
    kept = alone(label, row, slot)[usual] | (grown > JOINT * np.median(grown))
    return descend(label, row, slot, usual[kept], EPOCHS, CALM, seed)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    max_labelled: int = 20_000,
    text: str = "text",
    key: str = "doc_id",
) -> Machine:
    """A machine fitted on a bounded sample of labelled documents; null texts are empty."""
    known = sampled_labels(labels.select(key, label), label, max_labelled, key)
    rows = labelled_terms(docs.select(key, text).join(known, key), label, text).toArrow().combine_chunks()
    slots = rows.column("slots").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(slots, pa.ChunkedArray):
        slots = pa.concat_arrays(slots.chunks)
    y = np.asarray(rows.column("label").to_numpy(), dtype=float)
    sizes = np.diff(slots.offsets.to_numpy()) if len(slots) else np.zeros(0, np.int64)
    # In an order of their own, so the fit doesn't depend on how Spark dealt the rows.
    flat = slots.flatten().to_numpy() if len(slots) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(y)), sizes)
    mark = np.bincount(row, weights=flat.astype(float), minlength=len(y))
    order = np.lexsort((y, sizes, mark))
    rank = np.empty(len(y), np.int64)
    rank[order] = np.arange(len(y))
    arranged = np.argsort(rank[row], kind="stable")
    return train(y[order], rank[row][arranged], flat[arranged])


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), one row per row.

    Null and empty texts get the bias alone; equal texts get equal scores; columns of
    ``docs`` that have the names of the new ones are replaced; an empty table gives an
    empty result.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for block in text_blocks(batch.column(at)):
                row, slot = terms(block)
                place = machine.place[slot]
                known = place >= 0
                margin, _ = margins(machine, row[known], place[known], block.rows)
                parts.append(1 / (1 + np.exp(-np.clip(margin, -700, 700))))
            value = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = docs.select(keep).schema.add("score", "double").add("predicted", "integer")
    return docs.select(keep).mapInArrow(run, schema)
