"""Line deduplication that returns keep bitmaps instead of text.

Line hashes are range-partitioned and sorted by (hash, document, position);
each task streams its range once and sees the first document of every hash
first.  A very common line spans many ranges: only the run at a range's start
is left open, and settled by a table of at most two rows per range.

Defined cases: a null or empty text is one empty line.  Rows with a null id
keep all lines and hold none.  Rows with the same id are one document; each
gets the bitmap of its own text.  Lines repeated inside one document stay
there.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import ASCII_SPACE, take

LOST, OPEN, TAIL = 0, 1, 2
MARKS = "doc_id long, row_key long, pos int, h1 long, h2 long, first_doc long, kind int"


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, pos, h1, h2) of every line whose key is long enough;
    the key is the line stripped of ASCII white space with A-Z lower-cased."""
    @F.arrow_udf("array<struct<pos:int,h1:long,h2:long>>")
    def hashes(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            lines = []
            for i, line in enumerate((t.as_py() or "").split("\n")):
                key = line.strip(ASCII_SPACE)
                if len(key) >= min_chars:
                    d = hashlib.blake2b(key.encode().lower(), digest_size=16).digest()
                    lines.append({"pos": i, "h1": int.from_bytes(d[:8], "big", signed=True),
                                  "h2": int.from_bytes(d[8:], "big", signed=True)})
            out.append(lines)
        return pa.array(out, pa.list_(pa.struct([("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])))

    return (take(docs, id_col, text_col).where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"),
                    F.explode(hashes(F.col(text_col))).alias("x"))
            .select("doc_id", "row_key", "x.pos", "x.h1", "x.h2"))


def _stream(batches):
    """Marks of one sorted range: rows that lose their line, rows of the run
    that may have begun in an earlier range, and the last run's first document."""
    head = last = None          # first hash of the range; (hash, first document) of the current run
    for b in batches:
        if not b.num_rows:
            continue
        doc, h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h1", "h2"))
        if head is None:
            head = last_hash = (h1[0], h2[0])
            last = doc[0]
        new = np.empty(len(doc), bool)
        new[0] = (h1[0], h2[0]) != last_hash
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(new)
        first = np.concatenate(([last], doc[new]))[run]
        is_open = (h1 == head[0]) & (h2 == head[1])
        out = is_open | (doc != first)
        last, last_hash = first[-1], (h1[-1], h2[-1])
        if out.any():
            i = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[i]), b.column("row_key").take(pa.array(i)), b.column("pos").take(pa.array(i)), pa.array(h1[i]),
                 pa.array(h2[i]), pa.array(first[i]), pa.array(np.where(is_open[i], OPEN, LOST).astype(np.int32))],
                names=["doc_id", "row_key", "pos", "h1", "h2", "first_doc", "kind"])
    if head is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((None, pa.int64()), (None, pa.int64()), (None, pa.int32()),
                                           (last_hash[0], pa.int64()), (last_hash[1], pa.int64()),
                                           (last, pa.int64()), (TAIL, pa.int32()))],
            names=["doc_id", "row_key", "pos", "h1", "h2", "first_doc", "kind"])


def lost_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, pos) of every line that another, smaller document holds."""
    order = ["h1", "h2", "doc_id", "pos"]
    marks = cut_lineage(line_hashes(docs, min_chars, id_col, text_col)
                        .repartitionByRange(*order).sortWithinPartitions(*order)
                        .mapInArrow(_stream, MARKS), "line-marks")
    runs = (marks.where(f"kind in ({OPEN}, {TAIL})").groupBy("h1", "h2")
            .agg(F.min("first_doc").alias("holder")))       # at most two rows per range
    late = (marks.where(f"kind = {OPEN}").join(F.broadcast(runs), ["h1", "h2"]).where("doc_id > holder")
            .select("doc_id", "row_key", "pos"))
    return marks.where(f"kind = {LOST}").select("doc_id", "row_key", "pos").unionByName(late)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, keep) of every distinct row:
    ``keep`` is the deflated bitmap of the lines that stay, first line in the
    highest bit; row_key is the xxhash64 of the text."""
    @F.arrow_udf("struct<n_dropped:long,keep:binary>")
    def bitmap(n_lines: pa.Array, lost: pa.Array) -> pa.Array:
        dropped, keeps = [], []
        for n, l in zip(n_lines, lost):
            stay = np.ones(n.as_py(), bool)
            if l.is_valid:
                stay[l.values.to_numpy(zero_copy_only=False)] = False
            dropped.append(int(len(stay) - stay.sum()))
            keeps.append(zlib.compress(np.packbits(stay).tobytes(), 1))
        return pa.StructArray.from_arrays([pa.array(dropped, pa.int64()), pa.array(keeps, pa.binary())], ["n_dropped", "keep"])

    lost = (lost_lines(docs, min_chars, id_col, text_col).groupBy("doc_id", "row_key")
            .agg(F.collect_list("pos").alias("lost")))
    rows = (take(docs, id_col, text_col)
            .select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"),
                    F.size(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
            .where("doc_id is not null").dropDuplicates(["doc_id", "row_key"]))
    return (rows.join(lost, ["doc_id", "row_key"], "left")
            .select("doc_id", "row_key", "n_lines", bitmap("n_lines", "lost").alias("b"))
            .select("doc_id", "row_key", "n_lines", "b.n_dropped", "b.keep"))


@F.arrow_udf(T.StringType())
def kept_text(texts: pa.Array, keep: pa.Array) -> pa.Array:
    """The lines of a text that its bitmap keeps, joined by line feeds; a row
    without a bitmap keeps all."""
    out = []
    for t, k in zip(texts, keep):
        text = t.as_py() or ""
        if k.is_valid:
            lines = text.split("\n")
            stay = np.unpackbits(np.frombuffer(zlib.decompress(k.as_py()), np.uint8), count=len(lines))
            if not stay.all():
                text = "\n".join([lines[i] for i in np.flatnonzero(stay)])
        out.append(text)
    return pa.array(out, pa.string())
