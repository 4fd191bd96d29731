"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit fingerprint of its word shingles.  Fingerprints that
differ in few bits are found by cutting them into segments: by the pigeonhole
principle two fingerprints within ``max_bits`` agree up to a small Hamming
radius on one segment at least, so each fingerprint enumerates the small ball
around each of its segments, fetches the fingerprints filed under those
segment values, and checks the whole distance of each.

Defined cases: null and empty texts and texts without words have fingerprint
zero, linked like any other.  Texts with fewer words than a shingle are one
shingle.  Equal fingerprints are one node, so copies are never paired.  Rows
with the same id are one document.  A row without an id takes the component of
its fingerprint, null if no other row has an id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, take, words

SEED = 42
SLICE = 1 << 16     # shingles expanded into bits at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[:len(w) - k + 1].tolist(), ends[k - 1:].tolist())])
    octets = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(octets), SLICE):
        ones += np.unpackbits(octets[i:i + SLICE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(octets)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return take(docs, id_col, text_col).select(F.col(id_col), fp(F.col(text_col)).alias("fp"))


def balls(max_bits: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks) of each segment: the flips to enumerate there.

    With max_bits = segments * r + rest, the first rest + 1 segments need the
    radius r and the others r - 1: if none had so few differing bits, the
    whole distance would exceed max_bits.
    """
    r, rest = divmod(max_bits, segments)
    out, shift = [], 0
    for i in range(segments):
        width = 64 // segments + (i < 64 % segments)
        radius = r if i <= rest else r - 1
        masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
        out.append((shift, width, masks))
        shift += width
    return out


def close_pairs(fps: DataFrame, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most max_bits bits.

    ``fps``: (fp, node), one row per fingerprint.  Of two fingerprints whose
    segments differ, the one with a 0 at the highest differing bit probes, so
    a pair is met once per segment.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(s).alias("shift"),
                               F.lit((1 << w) - 1 if w < 64 else -1).cast("long").alias("low"))
                      for i, (s, w, _) in enumerate(balls(max_bits, segments))])
    flips = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long").alias("mask"),
                               F.lit(max(m.bit_length() - 1, 0)).alias("top"))
                      for i, (_, _, masks) in enumerate(balls(max_bits, segments)) for m in masks])
    filed = (fps.select("fp", "node", F.explode(cells).alias("c"))
             .select("fp", "node", F.col("c.seg").alias("seg"),
                     F.expr("shiftrightunsigned(fp, c.shift) & c.low").alias("part")))
    probes = (filed.select(F.col("fp").alias("fp_a"), F.col("node").alias("a"), "seg", "part",
                           F.explode(flips).alias("f"))
              .where("f.seg = seg and (f.mask = 0 or (shiftrightunsigned(part, f.top) & 1) = 0)")
              .select("fp_a", "a", "seg", F.expr("part ^ f.mask").alias("part"), F.col("f.mask").alias("mask")))
    table = filed.select(F.col("fp").alias("fp_b"), F.col("node").alias("b"), "seg", "part")
    return (probes.join(table, ["seg", "part"])
            .where(f"bit_count(fp_a ^ fp_b) <= {int(max_bits)} and (mask <> 0 or fp_a < fp_b)")
            .select("a", "b"))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id
    reachable over links of at most ``max_bits`` differing bits."""
    fps = cut_lineage(with_fingerprint(docs, shingle, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("node"))
    links = close_pairs(nodes.where("node is not null"), max_bits, segments)
    labels = components(links)
    root = (nodes.join(labels, "node", "left")
            .select("fp", F.coalesce("component", "node").alias("component_id")))
    return fps.join(root, "fp").select(id_col, "fp", "component_id")
