"""Secret scan with multipart credential linking.

Strong parts are reported wherever they stand: assigned secrets, access
identifiers and long hexadecimal strings.  Weak parts (short identifiers,
named users, mixed-character tokens, endpoints) are candidates only: an
interval join inside each scope of the text finds the parts near each other,
and a weak part is reported if what completes a credential lies near it.

    weak access   a strong secret near, or a weak one and an endpoint
    weak secret   a strong access identifier near, or a weak one and an endpoint
    endpoint      an access identifier and a secret near, weak or strong

Near means in the same scope, a block of text between empty lines, with starts
at most ``radius`` code points apart.  The interval join is a range window over
the parts sorted by start, so no pairs are made.

Defined cases: a null text is the empty text and has no parts.  Rows are told
apart by id and text; repeated rows each get the same result.
"""

from __future__ import annotations

import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import take

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
BASE = KINDS[:3]

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
USER = re.compile(r"(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}", re.I | re.A)
USER_HINTS = ("access", "client", "user", "login")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])")
BREAK = re.compile(r"\n[\x20\t]*\n")


def mixed(token: str) -> bool:
    """Whether a token has lower-case and upper-case letters and digits."""
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token))


def parts_of(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, scope) of all parts, weak ones included.

    Weak secrets and endpoints matter only beside an access identifier, so a
    text without one isn't searched for them.
    """
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    access = [(m.start(), 1 if m.end() - m.start() >= 16 else 3, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in USER_HINTS):
        access += [(m.start(), 3, m.end()) for m in USER.finditer(text)]
    found += access
    if access:
        taken = sorted((s, e) for s, _, e in found)
        starts = [s for s, _ in taken]
        for m in TOKEN.finditer(text):
            i = bisect(starts, m.start())
            free = (not i or taken[i - 1][1] <= m.start()) and (i == len(taken) or taken[i][0] >= m.end())
            if free and mixed(m[0]):
                found.append((m.start(), 4, m.end()))
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    breaks = [m.start() for m in BREAK.finditer(text)] if len(found) > 1 else []
    return sorted((s, k, e, bisect(breaks, s)) for s, k, e in found)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key_a, key_b, parts) of every row; the keys are hashes of id and text."""
    @F.arrow_udf("array<struct<start:int,kind:int,stop:int,scope:int>>")
    def find(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("start", "kind", "stop", "scope"), p)) for p in parts_of(t.as_py() or "")] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "stop", "scope")])))

    return take(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key_a"), F.hash(id_col, text_col).alias("key_b"),
        find(F.col(text_col)).alias("parts"))


def complete(rows: DataFrame, radius: int = 200) -> DataFrame:
    """(key_a, key_b, weak): the weak parts of each row that are near what
    completes them."""
    part = (rows.where("exists(parts, p -> p.kind > 2)").select("key_a", "key_b", F.explode("parts").alias("p")).distinct()
            .select("key_a", "key_b", "p.*"))
    near = Window.partitionBy("key_a", "key_b", "scope").orderBy("start").rangeBetween(-radius, radius)
    seen = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    told = (part.withColumns({"access": seen(1), "secret": seen(0, 2), "weak_access": seen(3), "weak_secret": seen(4), "endpoint": seen(5)})
            .where("""kind = 3 and (secret or weak_secret and endpoint) or kind = 4 and (access or weak_access and endpoint)
                      or kind = 5 and (access or weak_access) and (secret or weak_secret)"""))
    return told.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("weak"))


def scan(docs: DataFrame, radius: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of struct(start, kind, stop)
    sorted by start and kind; ``base`` has the strong parts, ``spans`` all."""
    rows = cut_lineage(find_parts(docs, id_col, text_col), "credential-parts")
    slim = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop")))
    base = F.filter(slim, lambda p: p["kind"] <= 2)
    return (rows.join(complete(rows, radius), ["key_a", "key_b"], "left").select("doc_id", base.alias("base"), "weak")
            .select("doc_id", "base", F.when(F.col("weak").isNull(), F.col("base"))
                    .otherwise(F.array_sort(F.concat("base", "weak"))).alias("spans")))


def as_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
