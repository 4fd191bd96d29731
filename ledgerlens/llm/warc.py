"""WARC archives: written with one gzip member for each record, read by byte ranges.

Writing.  Payloads are hashed in Spark.  Of the records with equal payloads of
at least ``min_bytes`` bytes the one with the smallest id is a ``response``, the
others are ``revisit`` records that name it and carry the HTTP head without the
payload.  A record is one gzip member.  Spark's text sink writes the members as
raw bytes, so a file appears only when its task has been committed, and a lost
executor leaves no part of an archive behind.  The sink ends each row with a
separator byte: that is a member's own last byte, which is zero for any record
below 16 MiB (it is the high byte of the length); a longer record is followed by
an empty member, which ends in zero as well.

Reading.  Any archive compressed record by record can be read, however large
its files are.  The files' names and lengths are cut into ranges.  A task scans
its range for the gzip magic and decodes each candidate's first bytes: those
that do not begin with a WARC version and a header are no records but bytes
inside one.  A record belongs to the range in which its member starts; its
member may end in a later range.  After a record the scan goes on behind its
member.  A task holds one range and one record.

Defined cases: a null payload is the empty payload.  Rows without an id are no
group's smallest unless the whole group has none.  Of rows with equal id and
payload each is a response if that id is the smallest: nothing tells them
apart.  A null url gives a record without a target.  A member that breaks off
or fails its checksum gives a row whose ``error`` says so and whose payload is
null.  An empty table gives archives without records; no files give no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take

MAGIC = b"\x1f\x8b\x08"
URN = "urn:ledgerlens:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_BYTES = 1 << 16            # a candidate's bytes that are decoded to tell a record from chance
STEP = 1 << 20                  # read beyond a range in steps of so many bytes
BATCH_BYTES = 8 << 20           # payload bytes of one Arrow batch

RECORDS = ("path string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes long, payload binary, error string")
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    *[(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")],
                    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


# ------------------------------------------------------------------ writing

def record(kind: str, name, url, refers_to, digest: str, payload: bytes, date: str) -> bytes:
    """One WARC record: an HTTP response, or a revisit of one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if name is None else name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose last byte is zero, without that byte."""
    out = gzip.compress(data, level, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", mtime=0)
    return out[:-1]


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, is_first, first_id): whether a row is its
    payload's response, and the id of that response.

    Only digests and ids are grouped, summed up before the shuffle.  The join
    brings each row the one row of its digest, and a digest that very many rows
    share is dealt by Spark's skew join."""
    sized = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("_n", F.octet_length("html"))
    firsts = (sized.where(F.col("_n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_copies"))
              .where("_copies > 1").drop("_copies"))
    return sized.join(firsts, "digest", "left").withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first_id")) | F.col("first_id").isNull()).drop("_n")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100,
                   date: str = "2000-01-01T00:00:00Z", level: int = 6) -> None:
    """Write a record for every row into archives (one for each task) in the folder ``path``."""
    @F.arrow_udf("binary")
    def members(name: pa.Array, url: pa.Array, html: pa.Array, digest: pa.Array, is_first: pa.Array, first: pa.Array) -> pa.Array:
        rows = ([v.as_py() for v in row] for row in zip(name, url, html, digest, is_first, first))
        return pa.array([member(record("response" if own else "revisit", i, u, f, d, h.encode(), date), level) for i, u, h, d, own, f in rows], pa.binary())

    rows = (take(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
            .select(F.col("page_id").cast("string").alias("_name"), "page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")))
    marked = with_first(rows, min_bytes)
    raw = members("_name", "url", "html", "digest", "is_first", F.col("first_id").cast("string")).cast("string")     # the bytes as they are: the sink does not look at them
    marked.select(raw.alias("value")).write.mode("overwrite").option("lineSep", "\0").option("compression", "none").text(path)


# ------------------------------------------------------------------ reading

def opened(path: str):
    """A seekable file of any store that Arrow reads (local, hdfs, s3, gs)."""
    where, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return where.open_input_file(name)


def parsed(raw: bytes) -> dict:
    """Fields of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields.setdefault(key.strip().lower(), value.strip())
    block = rest[:int(fields["content-length"])]
    kind = fields.get("warc-type")
    payload, size = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        size = int(told[1]) if told else None
    name = lambda key: fields[key].strip("<>") if key in fields else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind != "revisit":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    return {"record_type": kind, "record_id": name("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": name("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": size, "payload": None if kind == "revisit" else payload}


class Window:
    """Bytes of a file from ``start`` on, read further when needed."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, bytearray()
        file.seek(start)

    def fill(self, size: int) -> None:
        """Hold at least ``size`` bytes; fewer only at the file's end."""
        while len(self.data) < size:
            more = self.file.read(max(STEP, size - len(self.data)))
            if not more:
                return
            self.data += more

    def at(self, i: int, size: int) -> bytes:
        self.fill(i + size)
        return bytes(self.data[i:i + size])


def is_record(start: bytes) -> bool:
    head, end, _ = start.partition(b"\r\n\r\n")
    return bool(end) and re.match(rb"WARC/\d+\.\d+\r\n", head) is not None and re.search(rb"(?i)\ncontent-length:\s*\d+\s*(\r\n|$)", head) is not None


def undamaged(fed: bytes) -> bytes:
    """What can be decoded of a member before its error."""
    z, out = zlib.decompressobj(31), b""
    try:
        for i in range(0, len(fed), 64):
            out += z.decompress(fed[i:i + 64])
    except zlib.error:
        pass
    return out


def decoded(window: Window, i: int) -> tuple[bytes, int] | None:
    """The record whose member starts at place ``i`` and the member's end; None if
    no record starts there.  A damaged member raises."""
    z, place = zlib.decompressobj(31), i
    fed = window.at(place, HEAD_BYTES)
    place += len(fed)
    try:
        parts = [z.decompress(fed, HEAD_BYTES)]
    except zlib.error:
        if is_record(undamaged(fed)):
            raise
        return None
    if not is_record(parts[0]):
        return None
    while not z.eof:
        fed = z.unconsumed_tail
        if not fed:
            fed = window.at(place, STEP)
            place += len(fed)
        parts.append(z.decompress(fed, 16 * STEP))
        if not fed and not parts[-1] and not z.eof:
            raise zlib.error("the member breaks off")
    return b"".join(parts), place - len(z.unused_data)


def scan(window: Window, size: int):
    """(offset, length, fields) of the records whose members start in the first ``size`` bytes."""
    window.fill(size + len(MAGIC) - 1)
    i = 0
    while (i := window.data.find(MAGIC, i, size + len(MAGIC) - 1)) >= 0:
        try:
            found = decoded(window, i)
        except zlib.error as e:
            yield window.start + i, None, {"error": str(e)}
            found = None
        if found is None:
            i += 1
        else:
            raw, end = found
            yield window.start + i, end - i, parsed(raw)
            i = end


def read_archives(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """All records of the archives in the folder ``path`` (columns: ``RECORDS``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = ranges.count()

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(name) as file:
                    for offset, length, fields in scan(Window(file, start), range_bytes):
                        rows.append({"path": name, "offset": offset, "length": length, **fields})
                        held += len(fields.get("payload") or b"") + 500
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return ranges.repartition(max(n, 1), "path", "start").mapInArrow(run, RECORDS)


def page_of(urn: Column | str) -> Column:
    """The page id of a record's name; null if it has none."""
    return F.regexp_extract(urn, f"^{URN}(-?[0-9]+)$", 1).try_cast("long")
