"""ARC to WARC: parse legacy archives, write WARC files, read them back.

``pages_to_arc`` packs pages into ARC files (version 1 or 2) held as rows
(path, content), the shape Spark's ``binaryFile`` source gives.  ``parse_arc``
reads the version block, takes each record's header line by the fields that
block names and its content by the declared length.  ``arc_to_warc``
synthesises what WARC needs and ARC lacks: record ids (UUIDs named by the
record's url, date, page id and digest), ISO timestamps, record types and
SHA-1 digests.  ``write_warc`` writes records of one payload as one response
and revisits of it; ``read_warc`` parses the files again, by declared lengths.

Defined cases: null html is an empty payload; a null or blank url becomes
``unknown:`` and spaces in it are percent-encoded; rows repeated with one page
id and one payload are all responses; a record cut short by the end of its
file keeps what is there and is marked truncated; empty tables give an empty
result; other columns are ignored.  A page and its copies in Python must fit a
task's memory, texts of hundreds of MB do; else a task holds one file and a
batch of rows, which ``small_batches`` keeps short.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import cut, join_groups, table
from canopy.session import shared_dir

CAPTURE_DATE = "20000101000000"     # pages carry no capture time
ARC_BYTES = 8 << 20                 # an ARC file is closed once it is this long
WARC_BYTES = 16 << 20               # aim for the length of a WARC file
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed: the URL namespace
BROADCAST_ROWS = 10_000             # about 1 MB of digests and record ids
BATCH_BYTES = 4 << 20               # rows are handed to Python in batches that end once they are this long
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside hand rows to Python in batches of ``BATCH_BYTES`` and one row: files are long rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _each(column: pa.Array) -> Iterator:
    """The values of a column, one Python object at a time."""
    return (x.as_py() for x in column)


# --- ARC -------------------------------------------------------------------------------------------

def arc_head(name: str, version: int = 1, date: str = CAPTURE_DATE) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}"
    else:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def arc_record(url: str | None, content: bytes, name: str, offset: int, version: int = 1, date: str = CAPTURE_DATE,
               mime: str = "text/html") -> bytes:
    u = "%20".join((url or "").split()) or "unknown:"
    if version == 1:
        line = f"{u} 0.0.0.0 {date} {mime} {len(content)}"
    else:
        line = f"{u} 0.0.0.0 {date} {mime} 200 - - {offset} {name} {len(content)}"
    return line.encode() + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes, bool]]:
    """(header fields, content, truncated) of each record after the version block."""
    at, end = data.find(b"\n"), len(data)
    if at < 0:
        return
    length = int(data[:at].rsplit(b" ", 1)[1])
    block = data[at + 1:at + 1 + length].split(b"\n")
    names = block[1].decode().split(" ")  # the fields that this version's header lines have
    at += 1 + length
    while True:
        while at < end and data[at] in b"\r\n":  # separators between records
            at += 1
        if at >= end:
            return
        stop = data.find(b"\n", at)
        if stop < 0:
            return
        fields = dict(zip(names, data[at:stop].decode("utf-8", "replace").rsplit(" ", len(names) - 1)))
        length = int(fields["Archive-length"])
        yield fields, data[stop + 1:stop + 1 + length], stop + 1 + length > end
        at = stop + 1 + length


def pages_to_arc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> DataFrame:
    """Pages as ARC files (path, content), a few MB each; the page id travels in the HTTP header."""

    def pack(batches):
        parts, size, n = [], 0, 0
        for b in batches:
            for pid, url, html in zip(_each(b[0]), _each(b[1]), _each(b[2].cast(pa.binary()))):
                html = html or b""
                name = f"legacy-{n:06d}.arc"
                if not parts:
                    parts, size = [arc_head(name, version)], 0
                http = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if pid is None else pid}\r\n\r\n"
                parts.append(arc_record(url, http.encode() + html, name, size, version))
                size += len(parts[-1])
                if size >= ARC_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": [name], "content": pa.array([b"".join(parts)], pa.binary())})
                    parts, n = [], n + 1
        if parts:
            yield pa.RecordBatch.from_pydict({"path": [f"legacy-{n:06d}.arc"], "content": pa.array([b"".join(parts)], pa.binary())})

    return df.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(pack, "path string, content binary")


def arc_to_warc(arcs: DataFrame, id_header: str = "X-Page-Id") -> DataFrame:
    """ARC files (path, content) -> one row per record, ready to be written as WARC.

    record_id, page_id, target_uri, date, http (HTTP header), payload,
    payload_bytes, payload_digest, truncated.
    """
    key = id_header.lower().encode()

    def convert(batches):
        for b in batches:
            for data in _each(b.column("content")):
                rows, size = [], 0
                for f, content, short in parse_arc(data or b""):
                    http, sep, payload = content.partition(END)
                    if not sep or not http.startswith(b"HTTP/"):
                        http, payload = b"", content
                    pid = next((v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == key), b"")
                    digest = b32_sha1(payload)
                    d = f["Archive-date"].ljust(14, "0")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    name = f"{f['URL']} {d} {pid.decode()} {digest}"
                    rows.append((f"urn:uuid:{uuid.uuid5(NAMESPACE, name)}", int(pid) if pid else None, f["URL"], date, http,
                                 payload, len(payload), digest, short))
                    size += len(content)
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return arcs.select("content").mapInArrow(convert, RECORD)


RECORD = ("record_id string, page_id long, target_uri string, date string, http binary, payload binary, "
          "payload_bytes long, payload_digest string, truncated boolean")
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.bool_())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)


# --- WARC ------------------------------------------------------------------------------------------

def link_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to_id``: of equal payloads, the record id of the one with the largest page id; null for that one."""
    shared = (records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.max(F.struct("page_id", "record_id")).alias("keep"), F.count("*").alias("n")).where("n > 1")
              .select("payload_digest", "keep"))
    # only payloads met more than once take part: where copies are few, their measured table goes to the
    # pages; else both sides are shuffled
    shared = cut(shared)
    if shared.count() <= BROADCAST_ROWS:
        out = records.join(F.broadcast(shared), "payload_digest", "left")
    else:
        out = join_groups(records, shared, "payload_digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep.page_id")) & (F.col("payload_bytes") >= min_bytes)
    return out.withColumn("refers_to_id", F.when(revisit, F.col("keep.record_id"))).drop("keep")


def warc_record(record_id, page_id, uri, date, http, payload, digest, refers_to, truncated) -> bytes:
    """One WARC/1.0 record without the two line ends that close it."""
    block = http + END if http else b""
    if refers_to is None:
        block += payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{b32_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    if truncated:
        head.append("WARC-Truncated: length")
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block


def write_warc(records: DataFrame, path: str, mean_bytes: float | None = None) -> None:
    """Write records as WARC files through Spark's own writer: any file system, task retries commit once.

    Files aim for ``WARC_BYTES``; ``mean_bytes`` is the mean length of a record, computed from the records if not given.
    """
    names = ("record_id", "page_id", "target_uri", "date", "http", "payload", "payload_digest", "refers_to_id", "truncated")

    def lines(batches):
        for b in batches:
            out, size = [], 0
            for r in zip(*(_each(b.column(n)) for n in names)):
                out.append(warc_record(*r))
                size += len(out[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"line": pa.array(out, pa.binary())})
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"line": pa.array(out, pa.binary())})

    mean = mean_bytes or records.agg(F.avg(F.col("payload_bytes") + F.octet_length("http") + 600)).first()[0] or 1
    (records.mapInArrow(lines, "line binary").select(F.col("line").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, math.ceil(WARC_BYTES / mean))).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(named fields, block) of each record, blocks by declared length."""
    at, end = 0, len(data)
    while True:
        while at < end and data[at] in b"\r\n":
            at += 1
        stop = data.find(END, at)
        if at >= end or stop < 0:
            return
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:])
        length = int(fields["Content-Length"])
        yield fields, data[stop + 4:stop + 4 + length]
        at = stop + 4 + length


READ = "record_id string, record_type string, refers_to_id string, page_id long, payload_bytes long, payload_digest string, digest_ok boolean"


def read_warc(spark: SparkSession, path: str, id_header: str = "X-Page-Id") -> DataFrame:
    """One row per record of the WARC files under ``path``; digests are computed again from the blocks."""
    key = id_header.lower().encode()

    def records(batches):
        for b in batches:
            for data in _each(b.column("content")):
                rows = []
                for f, block in parse_warc(data):
                    http, sep, payload = block.partition(END)
                    if not sep:
                        http, payload = b"", block
                    pid = next((v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == key), b"")
                    declared, kind = f["WARC-Payload-Digest"].partition(":")[2], f["WARC-Type"]
                    own = b32_sha1(payload) if kind == "response" else declared
                    rows.append((f["WARC-Record-ID"].strip("<>"), kind, f.get("WARC-Refers-To", "").strip("<>") or None,
                                 int(pid) if pid else None, len(payload) if kind == "response" else None, own,
                                 own == declared and b32_sha1(block) == f["WARC-Block-Digest"].partition(":")[2]))
                if rows:
                    cols = list(zip(*rows))
                    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in READ.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, READ)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Read-back records -> page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok."""
    target = (records.where("record_type = 'response'").groupBy("record_id")
              .agg(F.max(F.struct("page_id", "payload_bytes")).alias("t")).withColumnRenamed("record_id", "refers_to_id"))
    whole = records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "digest_ok")
    seen = join_groups(records.where("record_type <> 'response'").drop("payload_bytes"), target, "refers_to_id", "left").select(
        "page_id", F.col("t.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("t.page_id").alias("refers_to"), "digest_ok")
    return whole.unionByName(seen)


def op9_warc(spark, sf_dir):
    """Pages through ARC files into WARC archives and back."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    # a record is its payload and about 700 bytes of header lines; the pages tell the mean without a pass over the archives
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 700)).first()[0]
    with small_batches(spark):
        write_warc(link_revisits(arc_to_warc(pages_to_arc(pages))), path, mean)
        records = cut(read_warc(spark, path))
    return resolve_revisits(records)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS keep FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS digest_ok
FROM d
"""
