"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.sources.shared import shared_folder

# The seekable format of the Zstandard project.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<II")
_HEAD = struct.Struct("<II")

#: Bytes of records put into one frame; a longer record has a frame of its own.
FRAME_BYTES = 256 << 10
#: Bytes of frames in one bundle.
BUNDLE_BYTES = 128 << 20
#: Bytes of payloads, and records, that a reader hands on at once.
READ_BYTES, READ_RECORDS = 16 << 20, 10_000

_INDEX = "page_id long, record_type string, refers_to long, bundle string, frame long, record_start long, record_bytes long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool
) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the record it repeats."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    block = b"" if revisit else payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, in lower case, and block of a record; a damaged one is an error."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(headers.get("content-length", -1))
    if version != "WARC/1.1" or not found or size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"damaged record: {head[:80]!r}")
    return headers, rest[:size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with compressed and plain size of all frames that ends a bundle."""
    body = b"".join(_ENTRY.pack(*f) for f in frames) + _FOOTER.pack(len(frames), 0, _SEEKABLE)
    return _HEAD.pack(_SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int]]:
    """Compressed and plain sizes of a bundle's frames, from its end alone."""
    size = file.size()
    file.seek(size - _FOOTER.size)
    count, flags, magic = _FOOTER.unpack(file.read(_FOOTER.size))
    if magic != _SEEKABLE or flags:
        raise ValueError("no seek table")
    file.seek(size - _FOOTER.size - count * _ENTRY.size)
    return list(_ENTRY.iter_unpack(file.read(count * _ENTRY.size)))


class _Bundle:
    """Frames of one file under a name of its own, seen by others only once it is complete."""

    def __init__(self, folder: str, name: str):
        self._fs, place = pa.fs.FileSystem.from_uri(folder)
        self._fs.create_dir(place, recursive=True)
        self.name, self._path = name, f"{place}/{name}"
        self._file = self._fs.open_output_stream(f"{self._path}.part")
        self._press = zstandard.ZstdCompressor(level=3)
        self._frames: list[tuple[int, int]] = []
        self._waiting: list[tuple[tuple, int]] = []
        self._plain: list[bytes] = []
        self._size = 0
        self.written = 0
        self.index: list[tuple] = []

    def add(self, key: tuple, record: bytes) -> None:
        if self._plain and self._size + len(record) > FRAME_BYTES:
            self.flush()
        self._waiting.append((key, len(record)))
        self._plain.append(record)
        self._size += len(record)

    def flush(self) -> None:
        if not self._plain:
            return
        frame = self._press.compress(b"".join(self._plain))
        at = 0
        for key, size in self._waiting:
            self.index.append((*key, self.name, len(self._frames), at, size))
            at += size
        self._file.write(frame)
        self._frames.append((len(frame), self._size))
        self.written += len(frame)
        self._waiting, self._plain, self._size = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self._file.write(seek_table(self._frames))
        self._file.close()
        self._fs.move(f"{self._path}.part", self._path)
        return self.index


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pd.DataFrame]:
    bundle = None
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def closed() -> pa.RecordBatch:
        columns = list(zip(*bundle.close())) or [()] * len(names)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.slice(first, 200).columns)):
                if bundle is None:
                    part = TaskContext.get().partitionId()
                    bundle = _Bundle(folder, f"{part:06d}-{uuid.uuid4().hex}.warc.zst")
                record = write_record(page_id, url, html or b"", refers_to, revisit)
                kind = "revisit" if revisit else "response"
                bundle.add((page_id, kind, refers_to), record)
                if bundle.written >= BUNDLE_BYTES:
                    yield closed()
                    bundle = None
    if bundle is not None:
        yield closed()


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
) -> DataFrame:
    """Write a record per row into bundles below ``folder``; returns the index, written there too.

    The index maps each record to its bundle, the frame's number there and the record's place in
    the frame; where a frame lies is in the bundle's seek table. The payload is the html in UTF-8; NULL is empty. Of equal payloads of at
    least ``min_revisit_bytes`` the row with the largest id is the response and the others are
    revisits of it; a NULL id is below all others. Rows that repeat id and payload are all
    responses. Digests are pre-aggregated, and only revisits are joined back to the pages.

    A bundle appears under its name once it is complete, and a repeated task writes another one:
    the index names only those of tasks that succeeded. ``folder`` is a URI or path that pyarrow
    can write from every machine. An empty table gives an empty index. Other columns are ignored.
    """
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    own = own.withColumn("sha", F.sha2("payload", 256))
    digests = own.where(F.length("payload") >= min_revisit_bytes).select("page_id", "sha")
    groups = (
        digests.groupBy("sha")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("sha", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    )
    salted = digests.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(32)))
    revisits = (
        salted.join(groups, ["sha", "salt"])
        .where("not page_id <=> refers_to")
        .select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), "refers_to")
        .distinct()
    )
    # Rows that repeat an id may differ in payload: a row meets the revisit of its own id and payload, one at most.
    same = F.col("page_id").eqNullSafe(F.col("again")) & (F.col("sha") == F.col("again_sha"))
    marked = own.join(revisits, same, "left")
    parts = marked.select("page_id", "url", "payload", "refers_to", F.col("again_sha").isNotNull().alias("revisit"))
    index = parts.mapInArrow(partial(_written, folder=f"{folder}/bundles"), _INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return pages.sparkSession.read.parquet(path)


class _Frames:
    """Frames of a bundle by number, found by the seek table at its end; the last one read is kept."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self._file = fs.open_input_file(path)
        self._sizes = read_seek_table(self._file)
        self._starts = [0, *accumulate(packed for packed, _ in self._sizes)]
        self._press = zstandard.ZstdDecompressor()
        self._at, self._plain = -1, b""

    def record(self, frame: int, first: int, length: int) -> bytes:
        if frame != self._at:
            packed, plain = self._sizes[frame]
            self._file.seek(self._starts[frame])
            self._plain = self._press.decompress(self._file.read(packed), max_output_size=plain)
            if len(self._plain) != plain:
                raise ValueError(f"frame {frame} has {len(self._plain)} bytes and not {plain}")
            self._at = frame
        return self._plain[first : first + length]

    def close(self) -> None:
        self._file.close()


def _read(groups: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, place = pa.fs.FileSystem.from_uri(folder)
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: 6 if payloads else 5]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    name, frames = None, None
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in groups:
        for page_id, bundle, frame, first, length in zip(*(c.to_pylist() for c in batch.columns)):
            if bundle != name:
                if frames is not None:
                    frames.close()
                name, frames = bundle, _Frames(fs, f"{place}/{bundle}")
            headers, block = read_record(frames.record(frame, first, length))
            own = headers["warc-record-id"][len("<urn:page:") : -1]
            if own != ("" if page_id is None else str(page_id)):
                raise ValueError(f"record {own} where {page_id} should be")
            kind = headers["warc-type"]
            stored = headers["warc-payload-digest"].removeprefix("sha1:")
            refers_to = headers.get("warc-refers-to", "<urn:page:>")[len("<urn:page:") : -1]
            if kind == "response" and digest_of(block) != stored:
                raise ValueError(f"payload of {own} does not match its digest")
            n = len(block) if kind == "response" else int(headers["x-payload-length"])
            row = (page_id, kind, int(refers_to) if refers_to else None, n, stored)
            rows.append((*row, block) if payloads else row)
            held += len(block) if payloads else 0
            if held >= READ_BYTES or len(rows) >= READ_RECORDS:
                yield out()
                rows, held = [], 0
    if frames is not None:
        frames.close()
    yield out()


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records named in ``index``: ``page_id, record_type, refers_to, payload_bytes, payload_digest`` and, if asked for, ``payload``.

    Any part of an index will do. A task reads the seek tables of the bundles it needs and goes to
    the frames; index rows are dealt out by frame and sorted, so a frame is unpacked once. Each
    response's digest is computed anew and compared; a revisit has an empty ``payload``, and digest
    and length of the one it refers to. A task holds one frame and ``READ_BYTES`` of payloads.
    """
    spark = index.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("page_id", "bundle", "frame", "record_start", "record_bytes")
    dealt = places.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "record_start")
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    schema += ", payload binary" if payloads else ""
    return dealt.mapInArrow(partial(_read, folder=f"{folder}/bundles", payloads=payloads), schema)


def archive_folder(spark) -> str:
    """A new place for archives in the shared folder."""
    place = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return place if "://" in place or place.startswith("/") else place.replace("file:", "file://", 1)
