"""Zstandard WARC archives with a dictionary: writing from a table, reading back, checking.

An archive begins with a skippable frame that holds the dictionary; then each record is a
frame of its own.  Archives lie in a folder that all executors share.  Every attempt of a
task writes under names of its own; a table of the names from the attempts that succeeded,
with their numbers of records, says what is read back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durable import durable

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
TRAINED = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # no capture time is known

RECORD = "record_type string, record_id string, uri string, digest string, refers_to string, payload_bytes long, payload binary, error string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, number: str, uri: str | None, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record: WARC header, HTTP header, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{number}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if uri is None else base64_if_needed(uri),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + len(payload)),
    }
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items() if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def base64_if_needed(uri: str) -> str:
    """A header value stays on one line: other urls go as a data of their own."""
    if uri == uri.strip() and uri.isprintable() and not uri.startswith("base64:"):
        return uri
    return "base64:" + base64.b64encode(uri.encode()).decode()


def plain_uri(value: str) -> str:
    return base64.b64decode(value[7:]).decode() if value.startswith("base64:") else value


def train_dictionary(payloads: list[bytes], size: int = 64 << 10) -> bytes:
    """A trained dictionary, or where the samples are too few or too small their own bytes."""
    samples = [record_bytes("response", str(i), "http://", digest_of(p), len(p), p, None) for i, p in enumerate(payloads)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join([*samples, record_bytes("response", "0", "http://", "", 0, b"", None)])[:size]


def frame_end(data: memoryview, at: int) -> int:
    """End of the frame at ``at``, from the sizes in its block headers."""
    head = bytes(data[at : at + 18])
    if head[:4] != FRAME:
        raise ValueError(f"no frame at byte {at}")
    checksum = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame breaks off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame breaks off")
    return at


def leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    held = bytes(data[8 : 8 + size])
    if len(held) != size:
        raise ValueError("the dictionary's frame breaks off")
    if held[:4] == FRAME:  # the dictionary may itself be compressed
        held = zstandard.ZstdDecompressor().decompress(held)
    kind = zstandard.DICT_TYPE_FULLDICT if held[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(held, dict_type=kind), 8 + size


def parse_record(record: bytes) -> dict:
    """The fields of one decoded record; a fault is named in ``error``."""
    row = dict.fromkeys(("record_type", "record_id", "uri", "digest", "refers_to", "payload_bytes", "payload", "error"))

    def number(value: str | None) -> str | None:
        return value.removeprefix("<urn:page:").removesuffix(">") if value else None

    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        return row | {"error": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode(errors="replace").partition(":")
        if not colon:
            return row | {"error": "malformed header line"}
        fields[name.strip().lower()] = value.strip()
    row |= {
        "record_type": fields.get("warc-type"),
        "record_id": number(fields.get("warc-record-id")),
        "uri": plain_uri(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": number(fields.get("warc-refers-to")),
    }
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        return row | {"error": f"missing {', '.join(sorted(missing))}"}
    length = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if length < 0 or len(rest) != length + 4 or rest[-4:] != b"\r\n\r\n":
        return row | {"error": "the block's length is not that of its header"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    declared = [line.split(b":", 1)[1].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not gap or len(declared) != 1 or not declared[0].isdigit():
        return row | {"error": "no HTTP header with a length"}
    row["payload_bytes"] = int(declared[0])
    if row["record_type"] == "response":
        row["payload"] = payload
        if len(payload) != row["payload_bytes"]:
            row["error"] = "the payload's length is not that of its header"
        elif digest_of(payload) != row["digest"]:
            row["error"] = "the payload's digest is not that of its header"
    elif row["record_type"] == "revisit" and (payload or not row["refers_to"]):
        row["error"] = "a revisit has no payload and names its response"
    return row


def archive_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, one frame decoded at a time; what can't be decoded ends it with an error row."""
    view = memoryview(data)
    try:
        dictionary, at = leading_dictionary(view)
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while at < len(view):
            end = frame_end(view, at)
            frame = bytes(view[at:end])
            size = zstandard.frame_content_size(frame)
            record = decoder.decompress(frame)
            if size >= 0 and len(record) != size:
                raise ValueError("a frame's length is not that of its header")
            yield parse_record(record)
            at = end
    except (ValueError, zstandard.ZstdError) as fault:
        yield dict.fromkeys(("record_type", "record_id", "uri", "digest", "refers_to", "payload_bytes", "payload")) | {"error": str(fault)}


def with_revisits(pages: DataFrame, key: str = "page_id", content: str = "html", uri: str = "url", least: int = 0) -> DataFrame:
    """(number, uri, payload, digest, refers_to): equal payloads of ``least`` bytes or more
    revisit the smallest key that has them."""
    rows = pages.select(
        F.col(key).cast("string").alias("number"),
        F.col(key).cast("long").alias("key"),
        F.col(uri).alias("uri"),
        F.coalesce(F.col(content), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("key").alias("first"))
    again = (F.col("key") != F.col("first")) | (F.col("key").isNull() & F.col("first").isNotNull())
    return rows.join(first, "sha1").select(
        "number",
        "uri",
        "payload",
        F.when(again & (F.octet_length("payload") >= least), F.col("first").cast("string")).alias("refers_to"),
    )


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """Write ``with_revisits`` rows as archives of about ``archive_bytes`` in ``folder``; a row per archive.

    The rows name the archives of the attempts that succeeded: keep them (``durable``), as each
    evaluation writes anew.  Archives of lost attempts stay in the folder, named by no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT
        encoder = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), write_checksum=True
        )
        task, attempt = TaskContext.get(), uuid.uuid4().hex
        leading = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        parts, size, written, count = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal parts, size, written, count
            name = f"part-{task.partitionId():06d}-{attempt}-{written:04d}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(leading)
                for part in parts:
                    out.write(part)
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64())})
            parts, size, count, written = [], 0, 0, written + 1
            return row

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                number, uri, payload, refers_to = row
                kind_of = "response" if refers_to is None else "revisit"
                body = payload if refers_to is None else b""
                record = record_bytes(kind_of, str(number), uri, digest_of(payload), len(payload), body, refers_to)
                parts.append(encoder.compress(record))
                size += len(parts[-1])
                count += 1
                if size >= archive_bytes:
                    yield close()
        if parts:
            yield close()

    return records.select("number", "uri", "payload", "refers_to").mapInArrow(run, "archive string, records long")


def batches_of(data: bytes, records: int | None = None, batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The records of one archive, which holds ``records`` of them where that is known."""
    rows, size, count = [], 0, 0
    for row in archive_records(data):
        rows.append(row)
        size += len(row["payload"] or b"")
        count += 1
        if size > batch_bytes:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
            rows, size = [], 0
    if records is not None and count != records:
        raise ValueError(f"an archive of {records} records gives {count}")
    if rows:
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the ``*.warc.zst`` archives in ``folder``; ``error`` is null for a sound one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from batches_of(data.as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, RECORD)


def read_written(written: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that ``written`` names (rows of ``write_archives``, kept).

    Other archives in the folder, such as those of a lost attempt, are not read.  An archive
    that is missing or gives another number of records fails the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for batch in batches:
            for name, records in zip(*(column.to_pylist() for column in batch.columns)):
                with store.open_input_stream(f"{base}/{name}", compression=None) as archive:
                    data = archive.read()
                yield from batches_of(data, records)

    # An archive a task, as with files that Spark splits.
    archives = max(1, written.count())
    return written.select("archive", "records").repartition(archives, "archive").mapInArrow(run, RECORD)


SCHEMA = pa.schema(
    [
        (name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (column.split() for column in RECORD.split(", "))
    ]
)


def round_trip(
    pages: DataFrame, folder: str, key: str = "page_id", content: str = "html", uri: str = "url", least: int = 0,
    dictionary_pages: int = 500, dictionary_chars: int = 20_000,
) -> DataFrame:
    """Write every row of ``pages`` as a record into ``folder`` and read all records back.

    The dictionary is trained on the first ``dictionary_chars`` characters of about
    ``dictionary_pages`` rows, drawn by a hash; the payloads are whole.  A
    null content is an empty payload.  Of equal payloads the smallest key is the response;
    rows that repeat that key are responses too; null keys revisit, unless all keys of a
    payload are null.  A null url leaves the header out; extra columns are ignored;
    an empty table writes no archive and gives no rows.  Fewer or more records written
    than there are rows, or read than were written, fail.
    """
    # About dictionary_pages rows in all, drawn by a hash, whatever the number of tasks.
    rows = pages.count()
    share = min(1.0, dictionary_pages / max(1, rows))
    drawn = F.pmod(F.xxhash64(key, F.length(content)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = pages.where(drawn & (F.length(content) > 0)).select(F.substring(content, 1, dictionary_chars))
    dictionary = train_dictionary([row[0].encode() for row in sample.limit(2 * dictionary_pages).collect()])
    written = durable(write_archives(with_revisits(pages, key, content, uri, least), folder, dictionary))
    records = written.agg(F.sum("records")).first()[0] or 0
    if records != rows:
        raise ValueError(f"{rows} rows gave {records} records")
    return read_written(written, folder)
