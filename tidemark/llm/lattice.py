"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units wherever two characters meet that no piece has side by side, so no
piece spans a cut; each different unit is encoded once.  All its substrings of bounded length are exploded and joined with the piece table;
the matches are the edges of the unit's lattice, and a fold over them in order of their
ends keeps for every place the best path there (Viterbi).  Units over ``MOST_ROWED``
characters (rules, padding, letters of DNA) are folded place by place by the task that
holds them, in time that grows with their length.  Unit encodings then go back to
the blocks of documents that hold the unit, and each document's ids are put together from
its own block's dictionary.

The score of a segmentation is the sum of its pieces' scores (the unigram rule); of equal
sums the one whose last piece is longest wins, then the one whose last but one is, and so on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType

from tidemark.llm.words import text_blocks

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MOST_ROWED = 256  # characters; the rows and arrays of a unit's lattice grow with the square of its length


class Pieces(NamedTuple):
    """Text pieces with id and score, the ids of the 256 bytes, the length of the longest piece.

    The table is a fixed file (32,000 pieces), so it may be broadcast.
    """

    pieces: list[tuple[str, int, float]]
    bytes: list[int]
    longest: int

    @property
    def unknown_score(self) -> float:
        return min(score for _, _, score in self.pieces) - UNKNOWN_PENALTY


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, fallback = [], [0] * 256
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            fallback[int(piece[3:5], 16)] = number
        elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
            texts.append((piece, number, model.get_score(number)))
    longest = max(len(piece) for piece, _, _ in texts)
    return Pieces(texts, fallback, longest)


class Cutter:
    """Cuts whole Arrow columns into units."""

    def __init__(self, pieces: Pieces):
        pairs = {piece[i : i + 2] for piece, _, _ in pieces.pieces for i in range(len(piece) - 1)}
        characters = sorted({c for pair in pairs for c in pair})
        self.kind = np.zeros(0x110000, dtype=np.uint16)  # 0: in no pair
        self.kind[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.joined = np.zeros((len(characters) + 1, len(characters) + 1), dtype=bool)
        for a, b in pairs:
            self.joined[self.kind[ord(a)], self.kind[ord(b)]] = True

    def units(self, column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """For some rows at a time their units and each row's number of units.

        The text is as SentencePiece sees it: a space in front, spaces as a mark.
        """
        for block in text_blocks(column, 2 << 20):
            rows = column.slice(block.first, block.rows).cast(pa.large_string()).fill_null("")
            marked = pc.binary_join_element_wise(
                pa.scalar(SPACE, pa.large_string()),
                pc.replace_substring(rows, " ", SPACE),
                pa.scalar("", pa.large_string()),
            )
            marked = pc.if_else(pc.equal(pc.binary_length(rows), 0), pa.scalar("", pa.large_string()), marked)
            offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
            data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            kinds = self.kind[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")]
            starts = np.flatnonzero((data & 0xC0) != 0x80)
            cut = np.ones(len(kinds), dtype=bool)
            cut[1:] = ~self.joined[kinds[:-1], kinds[1:]]
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[offsets] = True
            ends = np.append(starts[cut | edge[starts]], len(data))
            units = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data.tobytes()))
            yield units, np.diff(np.searchsorted(ends[:-1], offsets))


def unit_blocks(docs: DataFrame, pieces: Pieces, spread: int = 8, most: int = 1 << 21) -> DataFrame:
    """(unit, blocks, length): every different unit of ``docs`` (block, key, text), the blocks that hold it, its characters.

    A task holds at most about ``most`` units at a time and sends each once a block.  A
    unit's lattice has some forty times its rows, hence ``spread`` times the usual number
    of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pieces)
        seen: dict[int, pa.Array] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for number, units in seen.items():
                for at in range(0, len(units), 50_000):
                    part = units.slice(at, 50_000).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [part, pa.array(np.full(len(part), number))], names=["unit", "block"]
                    )
            seen.clear()

        for batch in batches:
            for number in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), number))
                found = [pc.unique(units) for units, _ in cutter.units(texts)]
                if number in seen:
                    found.append(seen[number])
                seen[number] = pc.unique(pa.concat_arrays(found))
            if sum(map(len, seen.values())) > most:
                yield from flush()
        yield from flush()
        pa.default_memory_pool().release_unused()

    partitions = spread * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # What later joins ask of a unit is asked here, and its length comes out of the aggregation: so no
    # condition of one use goes below the shuffle, and all uses share it.
    pairs = docs.select("block", "text").mapInArrow(run, "unit string, block long").where(F.col("unit").isNotNull())
    return (
        pairs.repartition(partitions, "unit")
        .groupBy("unit")
        .agg(F.collect_set("block").alias("blocks"), F.max(F.char_length("unit")).alias("length"))
    )


def lattice_edges(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, edge): the pieces found in each unit; a character without a piece is an edge with id -1."""
    spark = units.sparkSession
    table = spark.createDataFrame(pieces.pieces, "piece string, id int, score double")
    length = F.char_length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), length - 1)).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), length - F.col("start")))
    spans = starts.select("unit", "start", F.explode(sizes).alias("size"))
    parts = spans.select(
        "unit", "start", "size", F.col("unit").substr(F.col("start") + 1, F.col("size")).alias("piece")
    )
    found = parts.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    edge = F.struct(
        (F.col("start") + F.col("size")).alias("end"),
        (-F.col("start")).alias("back"),
        F.coalesce("id", F.lit(-1)).alias("id"),
        F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
    )
    return found.select("unit", edge.alias("edge"))


def best_paths(edges: DataFrame) -> DataFrame:
    """(unit, path): the (start, end, id) of the best segmentation of each unit.

    Edges come in order of their ends.  The forward fold holds the best score of every
    closed place and that of the place where the current edges end; a place is closed when
    the first edge to a later one comes.  Every place ends an edge, as each single
    character is one.  The backward fold takes, from the end, the longest edge that the
    best score of its end came over.
    """
    no_scores = F.slice(F.array(F.lit(0.0)), 1, 0)
    begin = F.struct(no_scores.alias("closed"), F.lit(0).alias("end"), F.lit(0.0).alias("top"))

    def step(state: Column, edge: Column) -> Column:
        def state_of(closed: Column, top: Column) -> Column:
            return F.struct(closed.alias("closed"), edge.end.alias("end"), top.alias("top"))

        # An edge that starts at the place just closed finds its score in top.
        score = F.coalesce(F.get(state.closed, -edge.back), state.top) + edge.score
        return F.when(
            edge.end > state.end, state_of(F.concat(state.closed, F.array(state.top)), score)
        ).otherwise(state_of(state.closed, F.greatest(state.top, score)))

    grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    folded = grouped.select("unit", "edges", F.aggregate("edges", begin, step).alias("state"))
    scored = folded.select(
        "unit", "edges", F.concat("state.closed", F.array(F.col("state.top"))).alias("best"), "state.end"
    )
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("id"))), 1, 0)

    def back(state: Column, edge: Column) -> Column:
        came = F.get("best", -edge.back) + edge.score == F.get("best", edge.end)
        hop = F.struct((-edge.back).alias("start"), edge.end.alias("end"), edge.id.alias("id"))
        taken = F.struct((-edge.back).alias("at"), F.concat(state.path, F.array(hop)).alias("path"))
        return F.when((edge.end == state["at"]) & came, taken).otherwise(state)

    walk = F.aggregate(F.reverse("edges"), F.struct(F.col("end").alias("at"), none.alias("path")), back)
    return scored.select("unit", F.reverse(walk["path"]).alias("path"))


def long_unit_ids(unit: str, table: dict[str, tuple[int, float]], pieces: Pieces) -> bytes:
    """The ids that the relational lattice gives ``unit``, by a fold over its places.

    Sums are added up in the same order, and ties go to the longest edge, so that both ways agree.
    """
    length, unknown = len(unit), pieces.unknown_score
    best, back = [0.0] * (length + 1), np.zeros(length + 1, np.int32)
    number = np.full(length + 1, -1, np.int32)
    for end in range(1, length + 1):
        top = None
        for start in range(max(0, end - pieces.longest), end):
            found = table.get(unit[start:end])
            if found is None:
                if end - start > 1:
                    continue
                found = -1, unknown
            score = best[start] + found[1]
            if top is None or score > top:
                top, back[end], number[end] = score, start, found[0]
        best[end] = top
    ids: list[int] = []
    at = length
    while at:
        start = int(back[at])
        if number[at] < 0:
            ids += (pieces.bytes[b] for b in reversed(unit[start:at].encode()))
        else:
            ids.append(int(number[at]))
        at = start
    return np.array(ids[::-1], dtype=">u4").tobytes()


def unit_ids(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``units`` with ``ids``, big-endian 32-bit numbers; unknown characters have those of their bytes.

    Units over ``MOST_ROWED`` characters have null, for ``long_unit_ids``.
    """
    # Both uses of the units need their blocks, so they are one and the same shuffle.
    rowed = units.where((F.size("blocks") > 0) & (F.col("length") <= MOST_ROWED)).select("unit")
    paths = best_paths(lattice_edges(rowed, pieces))
    numbers = F.array(*map(F.lit, pieces.bytes))

    def as_bytes(edge: Column) -> Column:
        code = F.hex(F.encode(F.substr(F.col("unit"), edge.start + 1, edge.end - edge.start), "UTF-8"))
        places = F.sequence(F.lit(1), F.length(code), F.lit(2))
        return F.transform(
            places, lambda i: F.element_at(numbers, F.conv(F.substr(code, i, F.lit(2)), 16, 10).cast("int") + 1)
        )

    ids = F.flatten(F.transform("path", lambda e: F.when(e.id < 0, as_bytes(e)).otherwise(F.array(e.id))))
    packed = F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0")), ""))
    return units.join(paths.select("unit", packed.alias("ids")), "unit", "left")


def packed_rows(rows: pa.RecordBatch) -> bytes:
    """Rows as one compressed value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def unpacked_rows(column: pa.ChunkedArray) -> list[pa.Table]:
    return [pa.ipc.open_stream(value.as_buffer()).read_all() for chunk in column.chunks for value in chunk]


def packed_units(units: pa.Array, ids: pa.Array) -> bytes:
    """Units and the bytes of their ids as one compressed value: number and size, lengths, bytes."""

    def parts(column: pa.Array) -> tuple[np.ndarray, bytes]:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.diff(offsets).astype("<u4").tobytes(), (column.buffers()[2] or b"")[offsets[0] : offsets[-1]]

    (long, letters), (wide, numbers) = parts(units), parts(ids)
    body = b"".join((long, wide, letters, numbers))
    return struct.pack("<II", len(units), len(body)) + pa.Codec("zstd", 3).compress(body, asbytes=True)


def unpacked_units(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All units of some packed values, how many ids each has, and those ids."""
    long, wide, letters, numbers = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")], [], []
    codec = pa.Codec("zstd")
    for value in (value for chunk in column.chunks for value in chunk):
        value = value.as_py()
        n, size = struct.unpack_from("<II", value)
        body = codec.decompress(value[8:], size, asbytes=True)
        lengths = np.frombuffer(body, "<u4", 2 * n)
        end = 8 * n + int(lengths[:n].sum())
        long.append(lengths[:n])
        wide.append(lengths[n:])
        letters.append(body[8 * n : end])
        numbers.append(body[end:])
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(long), dtype=np.int64)))
    units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(b"".join(letters)))
    flat = np.frombuffer(b"".join(numbers), ">u4").astype("<u4")
    return units, np.concatenate(wide).astype(np.int64) // 4, flat


def encode(
    docs: DataFrame, pieces: Pieces, block: Column, text: str = "text", key: str = "doc_id", verify: bool = False
) -> DataFrame:
    """(key, ids) of every row of ``docs``; ids are little-endian unsigned 32-bit numbers.

    With ``verify`` there is also ``round_trip``: whether the ids decode to the text.

    ``block`` deals the rows into blocks that one task can hold (some tens of MB of text)
    and must be the same in every run; blocks that lie together in the input let its
    tasks combine their words first.  Null and empty texts have no ids, as have rows
    without text in an empty table; a null key stays null; repeated rows are encoded once
    each; other columns of ``docs`` are ignored; a text of any length is encoded whole.
    """
    rows = docs.select(block.cast("long").alias("block"), F.col(key).alias("key"), F.col(text).alias("text"))
    known = unit_ids(unit_blocks(rows, pieces), pieces)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), number)).select(["key", "text"])
                for at in range(0, own.num_rows, 2000):
                    packed = pa.array([packed_rows(own.slice(at, 2000))], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), packed], names=["block", "rows"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block its units of a batch, packed."""
        table: dict[str, tuple[int, float]] = {}
        for batch in batches:
            if batch.column(2).null_count:
                table = table or {piece: (number, score) for piece, number, score in pieces.pieces}
                ids = [
                    value.as_py() if value.is_valid else long_unit_ids(unit.as_py(), table, pieces)
                    for unit, value in zip(batch.column(1), batch.column(2))
                ]
                batch = batch.set_column(2, "ids", pa.array(ids, pa.binary()))
            lists = batch.column(0)
            size = pc.list_value_length(lists).to_numpy()
            block, unit = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), size)
            order = np.argsort(block, kind="stable")
            block, unit = block[order], unit[order]
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else order
            packed = [
                packed_units(*(batch.column(c).take(pa.array(rows)) for c in (1, 2))) for rows in np.split(unit, first[1:])
            ]
            if len(block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[first]), pa.array(packed, pa.binary())], names=["block", "units"]
                )

    def put_together(packed: pa.Table, words: pa.Table) -> pa.Table:
        texts = unpacked_rows(packed.column("rows"))
        if not texts:
            return pa.Table.from_pylist([], target)
        known, sizes, flat = unpacked_units(words.column("units"))
        starts = np.cumsum(sizes) - sizes
        cutter, decoder, out = Cutter(pieces), Decoder(pieces), []
        for batch in (batch for table in texts for batch in table.to_batches()):
            at = 0
            for units, counts in cutter.units(batch.column(1)):
                found = pc.index_in(units, value_set=known).to_numpy(zero_copy_only=False)
                size = sizes[found]
                ends = np.concatenate(([0], np.cumsum(size)))
                data = flat[np.repeat(starts[found] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
                bounds = (4 * ends[np.concatenate(([0], np.cumsum(counts)))]).astype(np.int32)
                encoded = pa.BinaryArray.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
                )
                columns = [batch.column(0).slice(at, len(counts)), encoded]
                if verify:
                    plain = batch.column(1).slice(at, len(counts)).fill_null("")
                    columns.append(pc.equal(decoder.texts(encoded), plain))
                out.append(pa.RecordBatch.from_arrays(columns, schema=target))
                at += len(counts)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, target)

    schema = docs.select(key).schema.add("ids", BinaryType())
    schema = schema.add("round_trip", "boolean") if verify else schema
    target = to_arrow_schema(schema)
    words = known.select("blocks", "unit", "ids").mapInArrow(dealt, "block long, units binary")
    packed = rows.mapInArrow(squeezed, "block long, rows binary")
    return packed.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(put_together, schema)


class Decoder:
    """Decodes whole Arrow columns: the bytes of all pieces, one after another, are those of the texts."""

    def __init__(self, pieces: Pieces):
        texts = [b""] * (1 + max([number for _, number, _ in pieces.pieces] + pieces.bytes))
        for piece, number, _ in pieces.pieces:
            texts[number] = piece.replace(SPACE, " ").encode()
        for value, number in enumerate(pieces.bytes):
            texts[number] = bytes([value])
        self.table = pa.array(texts, pa.large_binary())

    def texts(self, column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_binary())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        ids = np.frombuffer(column.buffers()[2] or b"", "<u4")[bounds[0] // 4 : bounds[-1] // 4]
        joined = self.table.take(pa.array(ids))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[(bounds - bounds[0]) // 4]
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
        filled = np.diff(ends) > 0
        kept = np.ones(ends[-1], dtype=bool)
        kept[ends[:-1][filled]] = False  # the space in front
        ends = ends - np.concatenate(([0], np.cumsum(filled)))
        data = data[: len(kept)][kept].tobytes()
        rows = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(data)]
        )
        try:
            return rows.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8
            return pa.array([row.decode(errors="replace") for row in rows.to_pylist()], pa.string())


def decode(encoded: DataFrame, pieces: Pieces, decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids``: pieces joined, spaces restored, the one in front taken off.

    No ids, or null, give an empty text.
    """
    keep = [c for c in encoded.columns if c != decoded]
    place = keep.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = decoder.texts(part.column(place).fill_null(b""))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*keep, decoded])

    return encoded.select(keep).mapInArrow(run, encoded.select(keep).schema.add(decoded, "string"))


def file_blocks(docs: DataFrame, key: str = "doc_id", block_bytes: int = 16 << 20) -> Column:
    """Blocks of about ``block_bytes`` for a frame read from files.

    A file split is cut into parts of that size; splits under half of it are put together.
    """
    path, start, length = (F.col(f"_metadata.file_{name}") for name in ("path", "block_start", "block_length"))
    small = length < block_bytes // 2
    splits = docs.select(path.alias("path"), start.alias("start"), length.alias("length")).distinct()
    total = splits.where(F.col("length") < block_bytes // 2).agg(F.sum("length")).first()[0] or 0
    together = F.pmod(F.xxhash64(path, start), F.lit(-(-total // block_bytes) or 1))
    part = F.pmod(F.xxhash64(key), F.ceil(length / block_bytes))
    return F.when(small, together).otherwise(F.xxhash64(path, start, part))
