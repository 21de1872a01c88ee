"""Spelling variants: words that one inserted, deleted or replaced letter turns into another.

Words come from whole texts with their counts.  Bigrams are ranked, the rarest first.  A
word's prefix is its three first bigrams in that ranking (and all that are equal to the
third); its pivots are two disjoint ones of them, the rarest two that dynamic programming
finds.  One edit spoils at most one of two disjoint bigrams, so of two near words the one
whose prefix ends earlier in the ranking keeps a pivot in the other's prefix, and all on
one side of that pivot stays as it is.

The index therefore joins pivots with prefixes on the bigram, its position from the side
that stays, and that side; of the other side the half that the edit leaves alone is part of
the key too, for each length that the other word may have.  What shares a key is verified.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.durable import durable

# Letters: A-Z, a-z and U+00C0 to U+00FF, which Latin-1 keeps in one byte each.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)
PREFIX = 3  # bigrams of a prefix: one edit spoils two of a word's bigrams at most
SHORT = 64  # bytes; longer runs get their checksums one by one
BLOCK_WORDS = 1 << 19
MOST_WORDS, MOST_BYTES = 1 << 20, 128 << 20  # that a task holds before it hands on counts
CRC_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


# --- words ---------------------------------------------------------------------------

class _Runs(dict):
    """Numbers for different runs, with the checksum and the byte length of their UTF-8 form."""

    def __init__(self):
        super().__init__()
        self.words, self.bytes = [], 0
        self.crc, self.size = array("I"), array("I")

    def __missing__(self, run: bytes) -> int:
        text = run if run.isascii() else run.decode("latin-1").encode()
        number = self[run] = len(self.words)
        self.words.append(run)
        self.crc.append(zlib.crc32(text))
        self.size.append(len(text))
        self.bytes += len(run)
        return number


def _after(first: np.ndarray, upto: int) -> np.ndarray:
    """Row k: the checksums as ``k`` more bytes move them."""
    rows = np.empty((upto + 1, len(first)), dtype=np.uint32)
    rows[0] = first
    for k in range(upto):
        rows[k + 1] = (rows[k] >> np.uint32(8)) ^ CRC_TABLE[rows[k] & np.uint32(255)]
    return rows


class _Counter:
    """Counts of the words of a task's documents."""

    def __init__(self, one_in: int, shortest: int):
        self.one_in, self.shortest = one_in, shortest
        self.runs, self.counts = _Runs(), np.zeros(1 << 16, dtype=np.int64)

    def add(self, keys: list[bytes], found: list[list[int]]) -> None:
        """Runs of some documents, by number, and the documents' keys."""
        runs = self.runs
        at = np.fromiter((n for numbers in found for n in numbers), dtype=np.int64)
        if len(self.counts) < len(runs.words):
            self.counts = np.concatenate([self.counts, np.zeros(len(runs.words), dtype=np.int64)])
        if self.one_in:
            first = np.array([zlib.crc32(key + b":") for key in keys], dtype=np.uint32)
            doc = np.repeat(np.arange(len(keys)), [len(numbers) for numbers in found])
            size = np.array(runs.size, dtype=np.int64)[at]
            moved = _after(first, SHORT)[np.minimum(size, SHORT), doc]
            crc = moved ^ np.array(runs.crc, dtype=np.uint32)[at]
            for i in np.flatnonzero(size > SHORT).tolist():
                text = runs.words[at[i]].decode("latin-1").encode()
                crc[i] = zlib.crc32(text, int(first[doc[i]]))
            hit = crc % np.uint32(self.one_in) == 0
            numbers, crcs = at[hit].tolist(), crc[hit].tolist()
            changed = []
            for number, value in zip(numbers, crcs):
                run = runs.words[number]
                place = value % len(run)
                changed.append(runs[run[:place] + run[place + 1 :]])
            at = np.concatenate([at[~hit], np.array(changed, dtype=np.int64)])
            if len(self.counts) < len(runs.words):
                self.counts = np.concatenate([self.counts, np.zeros(len(runs.words), dtype=np.int64)])
        np.add.at(self.counts, at, 1)

    def full(self) -> bool:
        return len(self.runs.words) > MOST_WORDS or self.runs.bytes > MOST_BYTES

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The counts so far; they are forgotten here."""
        words, counts = self.runs.words, self.counts
        self.runs, self.counts = _Runs(), np.zeros(1 << 16, dtype=np.int64)
        kept = [i for i, word in enumerate(words) if counts[i] and len(word) >= self.shortest]
        for first in range(0, len(kept), 1 << 16):
            some = kept[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i].decode("latin-1") for i in some]), pa.array(counts[some], pa.int64())],
                names=["word", "n"],
            )


def word_counts(
    docs: DataFrame, one_in: int = 0, shortest: int = 5, least: int = 3, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``word`` and ``n``: words of at least ``shortest`` letters that occur ``least`` times or more.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are
    lower-cased.  ``one_in`` plants misspellings: a run loses the letter at ``h % length``
    where ``one_in`` divides h, the CRC-32 of ``<key>:<run>`` (a null key is empty there).
    Every task counts its own documents first, so a frequent word is one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(one_in, shortest)
        for batch in batches:
            keys, found, words = [], [], 0
            for key_value, value in zip(batch.column(0), batch.column(1)):
                number = counter.runs.__getitem__
                runs = (value.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split()
                # A very long text is counted in parts.
                for first in range(0, len(runs), BLOCK_WORDS):
                    part = list(map(number, runs[first : first + BLOCK_WORDS]))
                    keys.append((key_value.as_py() or "").encode())
                    found.append(part)
                    words += len(part)
                    if words >= BLOCK_WORDS:
                        counter.add(keys, found)
                        keys, found, words = [], [], 0
                if counter.full():
                    if keys:
                        counter.add(keys, found)
                        keys, found, words = [], [], 0
                    yield from counter.batches()
            if keys:
                counter.add(keys, found)
        yield from counter.batches()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- pivots --------------------------------------------------------------------------

def _grams(word: Column) -> Column:
    places = F.sequence(F.lit(0), F.length(word) - 2)
    return F.transform(places, lambda p: F.struct(F.substring(word, p + 1, F.lit(2)).alias("gram"), p.alias("pos")))


def gram_ranks(words: DataFrame) -> DataFrame:
    """One row per bigram: in how many words it stands, and its rank, the rarest first.

    There are at most as many bigrams as pairs of letters: 86 squared for these words.
    """
    each = words.select(F.explode(F.array_distinct(F.transform(_grams(F.col("word")), lambda g: g["gram"]))).alias("gram"))
    counted = each.groupBy("gram").agg(F.count("*").alias("weight"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy("weight", "gram")))


SINGLE = "struct<weight:bigint,pos:int>"
PAIR = "struct<weight:bigint,first:int,second:int>"


def _pivots(prefix: Column) -> Column:
    """The disjoint pair of least weight, by dynamic programming over places from left to right.

    The state holds the best single bigram that is disjoint from the next place
    (``ready``), the last one seen (``held``) and the best pair so far.
    """
    start = F.struct(
        F.lit(None).cast(SINGLE).alias("ready"), F.lit(None).cast(SINGLE).alias("held"), F.lit(None).cast(PAIR).alias("pair")
    )

    def step(state: Column, gram: Column) -> Column:
        apart = state["held"]["pos"] <= gram["pos"] - 2
        single = F.when(apart, F.least(state["ready"], state["held"])).otherwise(state["ready"])
        pair = F.struct(
            (single["weight"] + gram["weight"]).alias("weight"), single["pos"].alias("first"), gram["pos"].alias("second")
        ).cast(PAIR)
        better = F.when(single.isNull(), state["pair"]).otherwise(F.least(state["pair"], pair))
        held = F.struct(gram["weight"].alias("weight"), gram["pos"].alias("pos")).cast(SINGLE)
        return F.struct(F.least(state["ready"], state["held"]).alias("ready"), held.alias("held"), better.alias("pair"))

    return F.aggregate(F.array_sort(prefix), start, step)["pair"]


def pivoted(words: DataFrame) -> DataFrame:
    """``words`` with ``last`` (the rank where the prefix ends), ``prefix`` (places) and pivots ``p1`` < ``p2``."""
    each = words.select("word", "n", F.inline(_grams(F.col("word"))))
    ranked = each.join(F.broadcast(gram_ranks(words)), "gram")  # at most 86 * 86 rows
    gathered = ranked.groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "pos", "weight"))).alias("grams"))
    last = gathered.withColumn("last", F.element_at("grams", PREFIX)["rank"])
    prefix = F.transform(
        F.filter("grams", lambda g: g["rank"] <= F.col("last")),
        lambda g: F.struct(g["pos"].alias("pos"), g["weight"].alias("weight")),
    )
    chosen = last.select("word", "n", "last", prefix.alias("prefix")).withColumn("pair", _pivots(F.col("prefix")))
    return chosen.select(
        "word",
        "n",
        "last",
        F.transform("prefix", lambda g: g["pos"]).alias("prefix"),
        F.col("pair")["first"].alias("p1"),
        F.col("pair")["second"].alias("p2"),
    )


# --- the index -----------------------------------------------------------------------

def _merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides at every size.

    Spark takes an explode's rows for those of the compressed table below it, and would
    send the driver a table many times the size that it allows for a broadcast.
    """
    return left.join(right.hint("merge"), on, how)



def _key(side: str, half: str, kept: Column, length: Column, part: Column) -> Column:
    """A number for all that must agree; what collides is told apart when pairs are verified."""
    return F.xxhash64(F.lit(side + half), kept, length, part)


def _sides(word: Column, left: Column, right: Column) -> list[tuple[str, Column, Column]]:
    """What an edit leaves alone and what it changes, for one right of ``left`` or left of ``right``.

    Bigrams are told by their places; each is part of what stays, and the number of
    letters there is its position from that end.
    """
    size = F.length(word)
    return [
        ("r", F.substring(word, F.lit(1), left + 2), F.substring(word, left + 3, size)),
        ("l", F.substring(word, right + 1, size), F.substring(word, F.lit(1), right)),
    ]


def _halves(text: Column, length: Column) -> tuple[Column, Column]:
    """The beginning and the end of ``text`` that make up a text of ``length``."""
    half = F.floor(length / 2).cast("int")
    tail = length - half
    return F.substring(text, F.lit(1), half), F.substring(text, F.length(text) - tail + 1, tail)


def pivot_keys(words: DataFrame) -> DataFrame:
    """A row per key of each word's pivots, for partners up to a letter shorter or longer."""
    keys = []
    for side, kept, rest in _sides(F.col("word"), F.col("p1"), F.col("p2")):
        for step in (-1, 0, 1):
            length = F.length(rest) + step
            head, tail = _halves(rest, length)
            fits = length - F.floor(length / 2) <= F.length(rest)
            keys.append(F.when(length >= 0, _key(side, "h", kept, length, head)))
            keys.append(F.when((length >= 0) & fits, _key(side, "t", kept, length, tail)))
    found = words.select("word", "n", "last", F.explode(F.array(*keys)).alias("key"))
    return found.where(F.col("key").isNotNull())


def prefix_keys(words: DataFrame) -> DataFrame:
    """A row per key of each bigram in a word's prefix."""

    def of(place: Column) -> Column:
        keys = []
        for side, kept, rest in _sides(F.col("word"), place, place):
            length = F.length(rest)
            head, tail = _halves(rest, length)
            keys += [_key(side, "h", kept, length, head), _key(side, "t", kept, length, tail)]
        return F.array(*keys)

    return words.select("word", "n", "last", F.explode(F.array_distinct(F.flatten(F.transform("prefix", of)))).alias("key"))


def near_pairs(counts: DataFrame) -> DataFrame:
    """Each pair of words that exactly one edit parts, once: ``word``, ``n``, ``other``, ``other_n``.

    ``counts`` has different words of at least four letters; shorter ones need not have
    two disjoint bigrams and are an error.
    """
    short = F.raise_error(F.lit("words of fewer than four letters have no two disjoint bigrams")).cast("string")
    words = counts.select(F.when(F.length("word") >= 4, F.col("word")).otherwise(short).alias("word"), "n")
    table = durable(pivoted(words))
    a = pivot_keys(table).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"))
    b = prefix_keys(table).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"))
    found = _merged(a, b, "key").where(
        (F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    )
    first = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"))
    second = F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"))
    pair = found.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).distinct()
    return pair.select(
        F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("other"), F.col("y.n").alias("other_n")
    )


# --- groups --------------------------------------------------------------------------

def _roots(links: DataFrame, rounds: int) -> DataFrame:
    """``word`` and the last word that its forms lead to; each round doubles the steps."""
    links = durable(links)
    for _ in range(rounds):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = durable(_merged(links, onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return links


def variants(counts: DataFrame, times: int = 2) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    ``counts`` has one row per word (``word``, ``n``; other columns are ignored).  A word's
    form is the near word with the largest n, of equal ones the first in code-point order,
    if it has at least ``times`` the word's n; ``times`` must be 2 or more, so that forms
    lead on to an end.  Words without near ones have 0, nulls and themselves as root.  Case
    and accents count as letters of their own.  An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    words = durable(counts.select("word", "n"))
    pairs = durable(near_pairs(words))
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    nearest = F.min(F.struct((-F.col("other_n")).alias("minus_n"), F.col("other").alias("form")))
    near = pairs.unionByName(back).groupBy("word").agg(F.count("*").alias("n_near"), nearest.alias("best"))
    best_n = -F.col("best.minus_n")
    strong = best_n >= times * F.col("n")
    table = durable(
        _merged(words, near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(strong, F.col("best.form")).alias("form"),
            F.when(strong, best_n).alias("form_n"),
        )
    )
    # Every step at least doubles n, so the largest n bounds the steps and those the rounds.
    most = words.agg(F.max("n")).first()[0] or 1
    roots = _roots(
        table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")),
        most.bit_length().bit_length(),
    )
    return _merged(table, roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, one_in: int = 0, shortest: int = 5, least: int = 3, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``variants`` of the ``word_counts`` of ``docs``.

    Null and empty texts have no words; a text of any length is counted whole; repeated
    rows count once each; an empty table gives no rows; other columns are ignored.
    """
    return variants(word_counts(docs, one_in, shortest, least, text, key))
