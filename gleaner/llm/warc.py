"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole WARC records,
and a last, skippable frame: the seek table with the sizes and checksum of every frame.
Any Zstandard reader unpacks a bundle; with the table one frame can be read alone. The
index maps each record to its bundle, frame and place inside the frame.

Tasks write bundles into the shared folder under names of their own and report their
records; what Spark commits of these reports is the index. A bundle of a lost or
repeated attempt is in no index and never read. Folders are reached by ``pyarrow.fs``.

A payload of at least ``MIN_REVISIT`` bytes is stored once, in the response of the smallest
page id; all others are revisits that refer to it. Who refers to whom is settled on
narrow rows; pages themselves are dealt by (digest, id), which spreads any number of
copies.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.workers import ready

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
LEVEL = 3
#: Sub-keys of a payload with many copies.
SALTS = 16
#: The tables have no time of crawl; records get this one unless told otherwise.
NO_DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
# Fixed value of the archive format: the profile of a repeated payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_DDL = "record_id string, page_id bigint, bundle string, frame int, offset bigint, length bigint"
RECORD_DDL = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary, "
    "bundle string, frame int, offset bigint, length bigint"
)
_INDEX_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()),
        ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
    ]
)
_RECORD_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()), ("bundle", pa.string()),
        ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
    ]
)


# --- bundles ---


class Frame(NamedTuple):
    start: int
    packed: int
    size: int
    checksum: int


class BundleWriter:
    """Frames and their seek table, written to an open file."""

    def __init__(self, out, level: int = LEVEL) -> None:
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.written = 0

    def add(self, data: bytes) -> int:
        """Write one frame; returns its number."""
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.written += len(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return len(self.table) - 1

    def finish(self) -> None:
        body = b"".join(_ENTRY.pack(*entry) for entry in self.table)
        body += _FOOTER.pack(len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class BundleReader:
    """Frames of a seekable file by number, each read and checked alone."""

    def __init__(self, source) -> None:
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table")
        body = n * _ENTRY.size
        source.seek(size - _FOOTER.size - body - 8)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_MAGIC, body + _FOOTER.size):
            raise ValueError("broken seek table")
        self.frames, start = [], 0
        for packed, raw, checksum in _ENTRY.iter_unpack(source.read(body)):
            self.frames.append(Frame(start, packed, raw, checksum))
            start += packed

    def read(self, number: int) -> bytes:
        frame = self.frames[number]
        self.source.seek(frame.start)
        data = self.unpack.decompress(self.source.read(frame.packed), max_output_size=frame.size)
        if len(data) != frame.size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != frame.checksum:
            raise ValueError(f"frame {number} is damaged")
        return data


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


# --- records ---

_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f  ]")


def _uri(url: str) -> str:
    """White space and control characters cannot stand in a header; they are escaped."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def _id_of(urn: str) -> int | None:
    number = urn.split(":")[2]
    return int(number) if number else None


def make_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One record. A revisit has the header of the answer, with its length, but no payload."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        headers.insert(4, f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        headers.insert(4, f"WARC-Refers-To: <{record_id(refers_to, digest)}>")
        headers.insert(4, f"WARC-Profile: {SAME_PAYLOAD}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")
    pairs = (line.partition(": ") for line in lines[1:])
    return {name.lower(): value for name, _, value in pairs}, end + 4


def parse_record(data: bytes, start: int) -> tuple[tuple, int]:
    """Columns of the record at ``start`` up to its payload, and where it ends."""
    head, body = _headers(data, start)
    end = body + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("broken record")
    http, at = _headers(data, body)
    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
    urn, refers_to, payload = head["warc-record-id"][1:-1], None, None
    if head["warc-type"] == "revisit":
        refers_to = _id_of(head["warc-refers-to"][1:-1])
    else:
        payload = data[at:end]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {urn} is damaged")
    row = (urn, _id_of(urn), head.get("warc-target-uri"), head["warc-type"], refers_to, size, digest, payload)
    return row, end + 4


# --- writing ---


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _write(
    batches: Iterator[pa.RecordBatch], folder: str, date: str, frame_bytes: int, bundle_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Pages to bundles; yields the index rows of a bundle once it is closed."""
    store, base = _open_folder(folder)
    writer, out, name = None, None, ""
    rows: list[tuple] = []
    frame: list[bytes] = []
    in_frame = 0

    def close_frame() -> None:
        nonlocal in_frame
        if frame:
            writer.add(b"".join(frame))
            frame.clear()
            in_frame = 0

    def close_bundle() -> pa.RecordBatch:
        nonlocal writer
        close_frame()
        writer.finish()
        out.close()
        writer = None
        done = _batch(rows, _INDEX_ARROW)
        rows.clear()
        return done

    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(
            *(column.to_pylist() for column in batch.columns), strict=True
        ):
            if writer is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = BundleWriter(out)
            record = make_record(page_id, url, payload, digest, refers_to, date)
            urn = record_id(page_id, digest)
            rows.append((urn, page_id, name, len(writer.table), in_frame, len(record)))
            frame.append(record)
            in_frame += len(record)
            if in_frame >= frame_bytes:
                close_frame()
                if writer.written >= bundle_bytes:
                    yield close_bundle()
    if writer is not None:
        yield close_bundle()


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))


def revisits(pages: DataFrame) -> DataFrame:
    """``digest, page_id, refers_to`` of the pages whose payload a smaller id has as well.

    ``page_id`` may be null: such pages refer to the smallest id, nothing refers to them.
    """
    rows = (
        _keyed(pages)
        .where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest", "page_id")
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )
    first = (
        rows.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("ids"))
        .where("ids > 1 AND refers_to IS NOT NULL")
    )
    # A payload of very many pages: its pages are dealt by a salt as well.
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    found = rows.withColumn("salt", salt).join(
        first.select("digest", "refers_to", every), ["digest", "salt"]
    )
    other = F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))
    return found.where(other).select("digest", "page_id", "refers_to")


def write_archives(
    pages: DataFrame,
    folder: str,
    date: str = NO_DATE,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """One record per row of ``pages`` in bundles under ``folder``, with their index.

    A null payload is empty. Rows without a url have no target header; white space and
    control characters in one are escaped. A null id is written as such. Repeated rows have
    a record each, all under the same record id; those of the smallest id are all
    responses. A record larger than a frame has a frame of its own. An empty table gives
    an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    ready(spark)
    store, base = _open_folder(folder)
    store.create_dir(f"{base}/bundles", recursive=True)
    known = revisits(pages).withColumnRenamed("page_id", "key").withColumnRenamed("digest", "same")
    rows = _keyed(pages)
    told = rows.join(
        known, (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("key")), "left"
    ).select("page_id", "url", "payload", "digest", "refers_to")
    write = partial(
        _write,
        folder=f"{folder}/bundles",
        date=date,
        frame_bytes=frame_bytes,
        bundle_bytes=bundle_bytes,
    )
    told.mapInArrow(write, INDEX_DDL).write.parquet(f"{folder}/index")


# --- reading ---


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_DDL).parquet(f"{folder}/index")


def _read_bundles(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, base = _open_folder(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_file(f"{base}/{name}") as source:
                reader = BundleReader(source)
                for number in range(len(reader.frames)):
                    data, at, rows = reader.read(number), 0, []
                    while at < len(data):
                        row, end = parse_record(data, at)
                        row = row if payloads else (*row[:-1], None)
                        rows.append((*row, name, number, at, end - at))
                        at = end
                    yield _batch(rows, _RECORD_ARROW)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles the index names, every payload and frame checked.

    Revisits have the size and digest of their payload and the page that holds it.
    """
    ready(spark)
    names = read_index(spark, folder).select("bundle").distinct().checkpoint()
    # So many tasks that each reads a few bundles, however small their names are.
    tasks = max(1, min(names.count(), 4 * max(spark.sparkContext.defaultParallelism, 64)))
    read = partial(_read_bundles, folder=f"{folder}/bundles", payloads=payloads)
    return names.repartition(tasks).mapInArrow(read, RECORD_DDL)


def _read_places(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Records by place; rows come sorted, so a file is opened and a frame unpacked once."""
    store, base = _open_folder(folder)
    name, number, source, reader, data = None, None, None, None, b""
    for batch in batches:
        for bundle, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bundle != name:
                if source is not None:
                    source.close()
                source = store.open_input_file(f"{base}/{bundle}")
                reader, name, number = BundleReader(source), bundle, None
            if frame != number:
                data, number = reader.read(frame), frame
            row, end = parse_record(data, offset)
            yield _batch([(*row, bundle, frame, offset, end - offset)], _RECORD_ARROW)
    if source is not None:
        source.close()


def read_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The records of the page ids in ``wanted`` (page_id), reading only their frames."""
    spark = wanted.sparkSession
    ready(spark)
    ids = wanted.select(F.col("page_id").cast("long").alias("page_id")).distinct()
    places = read_index(spark, folder).join(ids, "page_id", "left_semi")
    ordered = places.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    read = partial(_read_places, folder=f"{folder}/bundles")
    return ordered.select("bundle", "frame", "offset").mapInArrow(read, RECORD_DDL)
