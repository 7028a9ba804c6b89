"""WARC writing, and a salvage reader that survives damage.

Archives are series of gzip members, one record each (or plain records), with block digests, so each record can be checked alone. The
reader checks gzip CRC, version line, headers, Content-Length and digest. After a failed check it searches for the next offset that
begins a valid member or version line, recovers the records from there on, and logs the bytes between as a quarantined gap.

A task writes archives under names of its own attempt and reports them; only reported archives are read. Writers roll to a new archive
at ROLL_BYTES, so readers hold one archive's record, not its whole.

Defined results: null payload is the empty payload; null url is an empty target; records with equal payloads are one response (largest
page_id; all rows that tie on it) and revisits. A null page_id is never larger than others. Empty tables give no archives. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import open_fs, ready, rows_of, session
from ledgerloom.llm.skew import lookup
from ledgerloom.runtime import scratch_path, written

ROLL_BYTES = 64 << 20
MAX_HEADER = 1 << 16
LEVEL = 4
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: The headers that every record has.
REQUIRED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
VERSION_LINES = (b"WARC/1.0", b"WARC/1.1")
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, compress: bool = True) -> bytes:
    """One record: a response, or where refers_to is given a revisit, which has the HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return data
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def mark_revisits(pages: DataFrame, total: int, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to: null for responses, else the page that holds the equal payload."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    best = rows.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    marked = lookup(rows, best.filter("n > 1"), "digest", "n", total)
    return marked.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("best")), F.col("best")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the written table of archives: file, bytes, records."""
    spark = session(pages)
    ready(spark)
    folder = folder or scratch_path(spark, "warc")
    marked = mark_revisits(pages, pages.select(id_col).count(), id_col, url_col, payload_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        stream = None
        size = records = 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*rows_of(batch, "page_id", "url", "payload", "refers_to"), strict=True):
                if stream is None:
                    name = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                    fs, path = open_fs(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    stream, size, records = fs.open_output_stream(path, compression=None, buffer_size=1 << 20), 0, 0
                data = record_bytes(page_id, url, payload, payload_digest(payload), refers_to)
                stream.write(data)
                size, records = size + len(data), records + 1
                if size >= ROLL_BYTES:
                    stream.close()
                    stream = None
                    yield pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "records": records}], schema)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "records": records}], schema)

    return written(spark, marked.mapInArrow(write, "file string, bytes long, records long"), "warc-files")


@dataclass(frozen=True)
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Damaged(Exception):
    """A record that fails a check."""


class Source:
    """Random access to a file with a sliding window, so that searches and records need no more memory than a record."""

    def __init__(self, f, size: int, step: int = 4 << 20):
        self.f, self.size, self.step, self.at, self.data = f, size, step, 0, b""

    def view(self, at: int, n: int) -> bytes:
        """n bytes from at, or what is left."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.data):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(min(max(n, self.step), self.size - at))
        return self.data[at - self.at : at - self.at + n]

    def find(self, at: int) -> int:
        """The first offset from at on where a gzip member or a version line may begin, else the size."""
        while at < self.size:
            part = self.view(at, self.step)
            hits = [k for k in (part.find(GZIP), part.find(VERSION)) if k >= 0]
            if hits:
                return at + min(hits)
            if at + len(part) >= self.size:
                break
            at += max(1, len(part) - len(VERSION))
        return self.size


def _parse(data: bytes, partial: bool = False) -> tuple[dict[str, str], int, int]:
    """Headers, start of the block and its length."""
    end = data.find(b"\r\n\r\n")
    if data[: data.find(b"\r\n")] not in VERSION_LINES or end < 0:
        raise Damaged("version or headers")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("content length")
    return headers, end + 4, int(length)


def _checked(headers: dict[str, str], block: bytes) -> None:
    if not REQUIRED <= headers.keys():
        raise Damaged("required header")
    said = headers.get("warc-block-digest", "")
    if said and said != f"sha1:{payload_digest(block)}":
        raise Damaged("block digest")


def _head(source: Source, at: int) -> bytes:
    """Bytes from at that reach over the header's end, however far it is, as long as they are header lines."""
    n = MAX_HEADER
    while True:
        data = source.view(at, n)
        lines = data.split(b"\r\n")
        if len(data) < n or b"\r\n\r\n" in data or lines[0] not in VERSION_LINES:
            return data
        if any(b":" not in x for x in lines[1:-1]) or (len(lines[-1]) >= MAX_HEADER and b":" not in lines[-1][:MAX_HEADER]):
            raise Damaged("header line")
        n *= 2


def read_record(source: Source, at: int) -> Record:
    """The record at an offset, all checks passed; else Damaged."""
    magic = source.view(at, 7)
    if magic.startswith(GZIP):
        gz, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not gz.eof:
                part = source.view(pos, 1 << 16)
                if not part:
                    raise Damaged("truncated member")
                parts.append(gz.decompress(part))
                pos += len(part)
                if len(parts) == 1 and not parts[0].startswith(VERSION[: len(parts[0])]):
                    raise Damaged("not a record")
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from e
        data, length = b"".join(parts), pos - len(gz.unused_data) - at
        headers, start, n = _parse(data)
        if len(data) != start + n + 4 or not data.endswith(b"\r\n\r\n"):
            raise Damaged("record length")
        block = data[start : start + n]
    elif magic == VERSION:
        headers, start, n = _parse(_head(source, at))
        if at + start + n + 4 > source.size:
            raise Damaged("truncated record")
        data = source.view(at, start + n + 4)
        if not data.endswith(b"\r\n\r\n"):
            raise Damaged("record end")
        block, length = data[start : start + n], start + n + 4
    else:
        raise Damaged("no member or version line")
    _checked(headers, block)
    return Record(at, length, headers, block)


def salvage(f, size: int) -> Iterator[Record | tuple[int, int, str]]:
    """Records in order, and (start, end, reason) of every gap of bytes that belong to no valid record."""
    source, at = Source(f, size), 0
    while at < size:
        try:
            record = read_record(source, at)
        except Damaged as e:
            start, reason = at, str(e)
            while True:
                at = source.find(at + 1)
                try:
                    record = read_record(source, at) if at < size else None
                    break
                except Damaged:
                    continue
            yield start, at, reason
            if record is None:
                return
        yield record
        at += record.length


RECORD_COLUMNS = "file string, offset long, length long, gap_reason string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _page(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_warc(archives: DataFrame, payloads: bool = False, file_col: str = "file") -> DataFrame:
    """Rows of RECORD_COLUMNS: a row per recovered record, and a row with gap_reason per quarantined gap (offset, length)."""
    spark = session(archives)
    ready(spark)
    names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RECORD_COLUMNS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = open_fs(name)
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for x in salvage(f, f.size()):
                        if isinstance(x, tuple):
                            rows.append(dict.fromkeys(names) | {"file": name, "offset": x[0], "length": x[1] - x[0], "gap_reason": x[2]})
                        else:
                            head, _, payload = x.block.partition(b"\r\n\r\n")
                            kind = x.headers.get("warc-type", "")
                            lengths = [int(v) for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:") and (v := h[15:].strip()).isdigit()]
                            rows.append({"file": name, "offset": x.offset, "length": x.length, "gap_reason": None, "record_type": kind, "page_id": _page(x.headers.get("warc-record-id", "")), "url": x.headers.get("warc-target-uri"), "refers_to": _page(x.headers["warc-refers-to"]) if "warc-refers-to" in x.headers else None, "payload_bytes": len(payload) if kind != "revisit" else next(iter(lengths), None), "payload_digest": payload_digest(payload) if kind != "revisit" else x.headers.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": payload if payloads and kind != "revisit" else None})
                            held += len(payload) * payloads
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, min(archives.count(), spark.sparkContext.defaultParallelism * 4))  # a number, or the few bytes of names would all go to one task
    return archives.select(file_col).repartition(n).mapInArrow(read, RECORD_COLUMNS)


def warc_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The archives (.warc, .warc.gz) of a folder that others wrote, for read_warc: column file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select(F.col("path").alias("file"))
