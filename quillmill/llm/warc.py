"""WARC archives: a writer with revisit records, and a salvage reader.

The writer deals payloads into archive files of gzip members, one member a
record.  Files are written through ``pyarrow.fs`` into a folder that all
executors share; a manifest table, committed by Spark, names the files that
count, so what a lost or repeated task left behind is never read.

The reader checks every record (gzip trailer, version line, header syntax,
lengths, payload digest).  When a check fails it searches on for the next
valid member or version line, carries on from there, and logs the bytes
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
_VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
_MEMBER = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes that are given to the decompressor at a time: what it leaves over is copied.
STEP = 1 << 13

#: Bytes that are searched for the end of headers at a time; headers may be longer.
HEADER_STEP = 1 << 16


def digest(payload: bytes) -> str:
    """Base32 SHA-1 in upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit names the record it refers to, and has the digest and length of the full payload but no block."""
    block = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {uri}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "text/html",
        "Content-Length": str(len(block)),
        "X-Row-Key": key,
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": _PROFILE, "X-Refers-To-Key": refers_to or ""}
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in head.items())]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Record(NamedTuple):
    headers: dict[str, str]  # names in lower case
    payload: bytes
    offset: int  # of the member, or of the record in an archive that isn't compressed


class Gap(NamedTuple):
    offset: int
    length: int
    why: str


def _header_end(data: bytes, at: int) -> int:
    """Where the blank line after the headers at ``at`` is, however long they are; -1 if a version line or the end comes first."""
    for begin in range(at, len(data), HEADER_STEP):
        stop = data.find(b"\r\n\r\n", begin, begin + HEADER_STEP + 3)
        if any(data.find(b"\r\n" + v, begin, stop if stop >= 0 else begin + HEADER_STEP + 11) >= 0 for v in _VERSIONS):
            return -1
        if stop >= 0:
            return stop
    return -1


def _parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, payload and end of the record at ``at``; or what is wrong with it."""
    if not data.startswith(_VERSIONS, at):
        return "no version line"
    stop = _header_end(data, at)
    if stop < 0:
        return "headers don't end"
    headers: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if line[:1] in b" \t" and headers and line:  # folded
            headers[next(reversed(headers))] += " " + line.strip().decode(errors="replace")
            continue
        if not colon or not name.strip():
            return "malformed header line"
        headers[name.strip().lower().decode(errors="replace")] = value.strip().decode(errors="replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers:
        return "no length or type"
    begin, end = stop + 4, stop + 4 + int(length)
    if end + 4 > len(data) or data[end : end + 4] != b"\r\n\r\n":
        return "record is cut or its length is wrong"
    payload = data[begin:end]
    said = headers.get("warc-payload-digest", "")
    if headers["warc-type"] != "revisit" and said.startswith("sha1:") and said[5:] != digest(payload):
        return "payload digest differs"
    return headers, payload, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | str:
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(data))
    except zlib.error as e:
        return f"gzip: {e}"
    return (b"".join(out), at - len(z.unused_data)) if z.eof else "gzip member is cut"


class Next:
    """Where a pattern is met next: each stretch of ``data`` is searched once, as long as what is asked for moves on."""

    def __init__(self, data: bytes, patterns: tuple[bytes, ...]):
        self.data, self.at = data, dict.fromkeys(patterns, -1)

    def after(self, at: int) -> int:
        """The first place beyond ``at``; the end if there is none."""
        for x, known in self.at.items():
            if known <= at:
                found = self.data.find(x, at + 1)
                self.at[x] = found if found >= 0 else len(self.data)
        return min(self.at.values())


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of an archive in order, and the gaps that hold none.

    Members and bare records may alternate. An empty archive gives nothing; one
    without any valid record gives a single gap. Every byte is in a record or a gap.
    """
    at, bad, why = 0, -1, ""
    start = Next(data, (_MEMBER, *_VERSIONS))
    while at < len(data):
        found: list[Record] = []
        wrong, end = "", at
        if data.startswith(_MEMBER, at):
            got = _inflate(data, at)
            if isinstance(got, str):
                wrong = got
            else:
                inner, end = got
                pos, later = 0, Next(inner, _VERSIONS)
                while pos < len(inner):
                    one = _parse(inner, pos)
                    if isinstance(one, str):
                        # what the member still holds may have later records
                        wrong = wrong or one
                        pos = later.after(pos)
                    else:
                        found.append(Record(one[0], one[1], at))
                        pos = one[2]
        else:
            one = _parse(data, at)
            if isinstance(one, str):
                wrong = one
            else:
                found, end = [Record(one[0], one[1], at)], one[2]
        if found or not wrong and end > at:
            if bad >= 0:
                yield Gap(bad, at - bad, why)
                bad = -1
            yield from found
            if wrong:
                yield Gap(at, end - at, f"part of a member: {wrong}")
            at = end
            continue
        if bad < 0:
            bad, why = at, wrong
        at = start.after(at)
    if bad >= 0:
        yield Gap(bad, len(data) - bad, why)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes a record per row (key, uri, html, kind, refers_to) below ``folder``; returns the manifest (path, bytes, records).

    ``folder`` is a URI that ``pyarrow.fs`` and Spark both open. A file is closed
    at ``archive_bytes`` compressed bytes. Null payloads are written as empty ones.
    """
    spark = rows.sparkSession

    def run(batches):
        fs, top = _filesystem(folder)
        fs.create_dir(f"{top}/warc", recursive=True)
        sink = name = None
        size = count = 0

        def closed():
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for x in (dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns), strict=True)) for i in range(batch.num_rows)):
                if sink is None:
                    name = f"warc/{uuid.uuid4().hex}.warc.gz"
                    sink, size, count = fs.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                data = member(record(x["kind"], str(x["key"]), x["uri"] or "", (x["html"] or "").encode(), None if x["refers_to"] is None else str(x["refers_to"])))
                sink.write(data)
                size += len(data)
                count += 1
                if size >= archive_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    rows.select("key", "uri", "html", "kind", "refers_to").mapInArrow(run, "path string, bytes bigint, records bigint").write.parquet(f"{folder}/manifest")
    return spark.read.schema("path string, bytes bigint, records bigint").parquet(f"{folder}/manifest")


RECORD_FIELDS = "path string, offset bigint, kind string, key string, uri string, payload_bytes bigint, payload_digest string, refers_to string, gap_bytes bigint, why string"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives in the manifest, and with ``kind`` = ``gap`` every quarantined stretch of bytes.

    A response's length and digest are computed from the bytes that were read; a revisit has those of its headers.
    """

    def run(batches):
        fs, top = _filesystem(folder)
        names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
        types = [pa.int64() if " bigint" in f else pa.string() for f in RECORD_FIELDS.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{top}/{path}", compression=None) as f:
                    data = f.read()
                out = []
                for x in salvage(data):
                    if isinstance(x, Gap):
                        out.append((path, x.offset, "gap", None, None, None, None, None, x.length, x.why))
                    else:
                        h = x.headers
                        full = h["warc-type"] != "revisit"
                        size = len(x.payload) if full else int(h.get("x-payload-length") or 0)
                        sha = digest(x.payload) if full else h.get("warc-payload-digest", "").removeprefix("sha1:")
                        out.append((path, x.offset, h["warc-type"], h.get("x-row-key"), h.get("warc-target-uri"), size, sha, h.get("x-refers-to-key"), None, None))
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return manifest.select("path").mapInArrow(run, RECORD_FIELDS)


def with_revisits(pages: DataFrame, key_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(key, uri, html, kind, refers_to) of each page: of equal payloads of ``least_bytes`` or more, the one with the largest key is the response.

    Null payloads count as empty. Rows that repeat the largest key are all
    responses, and null keys come before all others. A payload shared by very
    many pages is a hot join key: only the small side (digest, key) is grouped,
    with partial sums, and adaptive execution splits the pages' side.
    """
    p = pages.select(pages[f"`{key_col}`"].alias("key"), pages[f"`{uri_col}`"].alias("uri"), F.coalesce(pages[f"`{html_col}`"], F.lit("")).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1("html")))
    last = p.filter(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("key").alias("last"))
    joined = p.join(last, "sha", "left")
    again = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return joined.select("key", "uri", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("last")).alias("refers_to"))


def archive_round_trip(pages: DataFrame, folder: str, key_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes the pages to archives below ``folder`` and returns what the salvage reader reads back from them."""
    manifest = write_archives(with_revisits(pages, key_col, uri_col, html_col, least_bytes), folder, archive_bytes)
    return read_archives(manifest.repartition(max(1, manifest.count()), "path"), folder)

