"""WARC archives with a two-level capture index.

Archives hold one gzip member a record, so that a record can be read by offset and length.  The capture index is sorted by
reversed host and URL (then page id): lines in compressed blocks, one index file a range of keys, each with a sparse directory of
its blocks at its end.  A lookup goes to the file whose range holds the key, finds the block in that file's directory by binary
search, the line in the block by binary search, and then reads the record's bytes from the archive.

Files go to the shared folder through pyarrow.fs.  Every attempt of a task writes files of its own, and only what a finished
attempt returns is looked at, so a task that is run again leaves at worst an unused file.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.lineage import cut_lineage, new_path

MIN_BYTES = 1000  # smaller payloads are never written as revisits
ARCHIVE_BYTES = 256 << 20  # an archive file is closed once it has as many
BLOCK_LINES = 512
_DATE, _EOL = "2000-01-01T00:00:00Z", "\r\n"


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the rest of the URL: 'com,example)/a?b'.  Null and host-less URLs sort by themselves."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)\A.*?://", "")
    host = F.lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    after = F.regexp_replace(rest, r"\A[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), after)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(value: str) -> str:
    """A header's value on one line: control characters and % as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that has the headers only."""
    http = f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: {size}{_EOL}{_EOL}".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}",
             f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _EOL.join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + (_EOL * 2).encode()


def parse(data: bytes) -> dict:
    """A record's headers (lower-case names), the length that its HTTP header states, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split(_EOL)[1:])}
    http, _, payload = rest[:int(headers["content-length"])].partition(b"\r\n\r\n")
    stated = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode().split(_EOL)[1:])}
    return headers | {"payload": payload, "payload-length": int(stated["content-length"])}


class _Appender:
    """Files of one task attempt, written from front to back."""

    def __init__(self, folder: str, suffix: str):
        self.system, self.folder = _open(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.suffix, self.stream = suffix, None

    def append(self, data: bytes) -> tuple[str, int]:
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.stream = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.stream.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class _Reader:
    """Byte ranges of files in one folder; the file read last stays open."""

    def __init__(self, folder: str):
        self.system, self.folder = _open(folder)
        self.name = self.file = None

    def read(self, name: str, at: int, size: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.system.open_input_file(f"{self.folder}/{name}")
        return self.file.read_at(size, at)


_ENTRY = "key string, id string, archive string, at bigint, size bigint"
_SHARD = "first string, last string, shard string, bytes bigint"


def _sort_id(page_id: Column) -> Column:
    """An id as text of fixed length that sorts as the ids do, nulls first."""
    shifted = page_id.cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")
    return F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit(""))


def with_references(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``pages`` with the bytes and SHA-1 of each payload and, for revisits, the id of the response they refer to."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    known = pages.withColumn("__bytes", F.octet_length(payload).cast("bigint")).withColumn("__digest", F.sha1(payload))
    # Of a payload that a third of all pages share one row a task is shuffled, and payloads met once are not joined.
    last = (known.filter(F.col("__bytes") >= min_bytes).groupBy("__digest", "__bytes").agg(F.max(id_col).alias("__last"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").drop("n"))
    found = known.join(last, ["__digest", "__bytes"], "left")
    other = F.col("__last").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__last"))
    return found.withColumn("__refers", F.when(other, F.col("__last"))).drop("__last")


@dataclass(frozen=True)
class Capture:
    """Where an archive set is: its folders, and the index files' key ranges (one row per file)."""

    folder: str
    shards: DataFrame


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_bytes: int = MIN_BYTES,
          archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES, folder: str | None = None) -> Capture:
    """Write a record per row and the index over all of them.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest id is the response and the others revisit it
    (a null id is smaller than any other; rows that repeat the largest id are all responses, as are rows whose ids are all null).  Null html is an
    empty payload, a null URL an empty one.  Other columns are not written.  An empty table gives no files.
    """
    folder = folder or new_path(pages.sparkSession, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Appender(f"{folder}/archives", ".warc.gz")
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                body = packer.compress(record(r["id"], r["url"], (r["html"] or "").encode(), r["digest"], r["bytes"], r["refers"])) + packer.flush()
                name, at = files.append(body)
                rows.append((r["key"], r["sort"], name, at, len(body)))
                if files.at >= archive_bytes:
                    files.close()
            yield _rows(rows, ["key", "id", "archive", "at", "size"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])
        files.close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, directory, lines, last = _Appender(f"{folder}/index", ".idx"), [], [], None

        def block() -> None:
            body = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            directory.append([lines[0][:2], files.append(body)[1], len(body)])
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                lines.append([r["key"], r["id"], r["archive"], r["at"], r["size"]])
                last = [r["key"], r["id"]]
                if len(lines) >= block_lines:
                    block()
        if lines:
            block()
        if directory:
            body = zlib.compress(json.dumps(directory).encode())
            name, _ = files.append(body + struct.pack("<q", len(body)))
            files.close()
            yield _rows([(json.dumps(directory[0][0]), json.dumps(last), name, files.at)], ["first", "last", "shard", "bytes"],
                        [pa.string(), pa.string(), pa.string(), pa.int64()])

    marked = with_references(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "id", "html", min_bytes)
    rows = marked.select("id", url_key(F.col("url")).alias("key"), _sort_id(F.col("id")).alias("sort"), "url", F.when(F.col("__refers").isNull(), F.col("html")).alias("html"),
                         F.col("__digest").alias("digest"), F.col("__bytes").alias("bytes"), F.col("__refers").alias("refers"))
    entries = cut_lineage(rows.mapInArrow(archive, _ENTRY))
    ranges = entries.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return Capture(folder, cut_lineage(ranges.mapInArrow(index, _SHARD)))


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _read_index(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Look each wanted (key, id) of an index file up; wanted rows come sorted, so a block is read once."""
    files, shard, blocks, held, lines, starts = _Reader(f"{folder}/index"), None, [], None, [], []
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            want = [r["key"], r["id"]]
            if r["shard"] != shard:
                shard, held = r["shard"], None
                (size,) = struct.unpack("<q", files.read(shard, r["bytes"] - 8, 8))
                blocks = json.loads(zlib.decompress(files.read(shard, r["bytes"] - 8 - size, size)))
                starts = [b[0] for b in blocks]
            # Equal keys may fill several blocks: start at the block before the first that begins with the key or later.
            k = max(0, bisect.bisect_left(starts, want) - 1)
            while k < len(blocks) and starts[k] <= want:
                if held != k:
                    held, lines = k, [json.loads(x) for x in zlib.decompress(files.read(shard, *blocks[k][1:])).decode().split("\n")]
                at = bisect.bisect_left(lines, want, key=lambda x: x[:2])
                while at < len(lines) and lines[at][:2] == want:
                    found.append((r["key"], r["id"], *lines[at][2:]))
                    at += 1
                k += 1
        yield _rows(found, ["key", "id", "archive", "at", "size"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])


def _read_records(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files = _Reader(f"{folder}/archives")
    number = lambda urn: None if urn is None or urn == "<urn:page:None>" else int(urn[len("<urn:page:"):-1])
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            got = parse(zlib.decompress(files.read(r["archive"], r["at"], r["size"]), 31))
            digest, kind = got["warc-payload-digest"].removeprefix("sha1:"), got["warc-type"]
            if kind == "response" and (hashlib.sha1(got["payload"]).hexdigest() != digest or len(got["payload"]) != got["payload-length"]):
                raise ValueError(f"{r['archive']} at {r['at']}: the payload differs from its digest")
            found.append((number(got["warc-record-id"]), got["warc-target-uri"], kind, digest, got["payload-length"], number(got.get("warc-refers-to")),
                          got["payload"] if kind == "response" else None))
        yield _rows(found, ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"],
                    [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()])


_RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def lookup(capture: Capture, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The records of the (id, url) rows of ``wanted``, repeated rows once: page_id, url, type, digest, length, refers_to, payload.

    The payload of a revisit is null; every response is checked against its digest.  Requests without a record give no row.
    """
    spark: SparkSession = wanted.sparkSession
    # One row an index file, each the work of a whole task: few enough for every task to hold.
    ranges = sorted((json.loads(r["first"]), json.loads(r["last"]), r["shard"], r["bytes"]) for r in capture.shards.collect())
    folder = capture.folder

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = [x[1] for x in ranges]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = bisect.bisect_left(lasts, [r["key"], r["id"]])
                while k < len(ranges) and ranges[k][0] <= [r["key"], r["id"]]:
                    out.append((r["key"], r["id"], *ranges[k][2:]))
                    k += 1
            yield _rows(out, ["key", "id", "shard", "bytes"], [pa.string(), pa.string(), pa.string(), pa.int64()])

    asked = wanted.select(url_key(F.col(url_col)).alias("key"), _sort_id(F.col(id_col)).alias("id")).distinct()
    placed = asked.mapInArrow(place, "key string, id string, shard string, bytes bigint")
    if not ranges:
        return spark.createDataFrame([], _RECORD)
    by_file = placed.repartition("shard").sortWithinPartitions("shard", "key", "id")
    spots = by_file.mapInArrow(lambda it: _read_index(it, folder), _ENTRY)
    # Records are read archive by archive from front to back, in as many tasks as there are ranges of bytes.
    return spots.repartitionByRange("archive", "at").sortWithinPartitions("archive", "at").mapInArrow(lambda it: _read_records(it, folder), _RECORD)
