"""WARC archives: round trips, ranges, foreign and damaged files, edge rows."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc

SCHEMA = "page_id long, url string, html string, URL string, digest string, payload string, path string"


def expected(rows, min_bytes=100):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        own = first.get(html or "")
        revisit = len(raw) >= min_bytes and i != own
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", own if revisit else None))
    return sorted(out, key=repr)


def read_back(spark, path, **kw):
    r = warc.read_archives(spark, path, **kw)
    rows = r.select(warc.page_of("record_id").alias("i"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("f")).collect()
    return sorted((tuple(x) for x in rows), key=repr)


ROWS = [(1, "http://a/x y\r\nz", "x" * 100), (2, None, "x" * 100), (0, "http://b/é", "x" * 99), (3, "u", "x" * 99), (4, "u", None), (5, "u", ""),
        (None, "u", "x" * 100), (7, "u", "ü" * 50), (6, "u", "ü" * 50), (8, "u", "WARC/1.1\r\n\r\nline\x1f\r\n" * 20), (-9, "u", "x" * 100),
        (10, "u", "y" * (17 << 20)), (11, "u", "Lone " * 30000), (11, "u", "Lone " * 30000)]


@pytest.mark.parametrize("range_bytes", [997, 32 << 20])
def test_round_trip(spark, tmp_path, range_bytes):
    pages = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in ROWS], SCHEMA).repartition(3)
    warc.write_archives(pages, f"{tmp_path}/w")
    assert read_back(spark, f"{tmp_path}/w", range_bytes=range_bytes) == expected(ROWS)


def test_archives_are_plain_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in ROWS], SCHEMA).coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    raw = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in sorted(os.listdir(tmp_path / "w")) if f.startswith("part"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    assert b"WARC-Target-URI: http://a/x%20y%0D%0Az\r\n" in raw


def test_all_fields_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in ROWS[:2]], SCHEMA)
    warc.write_archives(pages, f"{tmp_path}/w")
    r = {x["record_id"]: x for x in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    one, two = r["urn:ledgerlens:page:1"], r["urn:ledgerlens:page:2"]
    assert one["payload"] == b"x" * 100 and one["target_uri"] == "http://a/x%20y%0D%0Az" and one["error"] is None
    assert two["payload"] is None and two["refers_to"] == one["record_id"] and two["target_uri"] is None


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert read_back(spark, f"{tmp_path}/w") == []


def foreign(kind, block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}content-length:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_ranges_that_cut_records_anywhere(spark, tmp_path):
    """Stored (incompressible) payloads full of gzip magic, cut at every 61 bytes."""
    rnd = random.Random(3)
    bodies = [warc.MAGIC * rnd.randrange(9) + rnd.randbytes(rnd.randrange(300)) + warc.MAGIC for _ in range(40)]
    os.mkdir(tmp_path / "w")
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(foreign("resource", b, WARC_Record_ID=f"<x:{i}>"), 0 if i % 2 else 9) for i, b in enumerate(bodies)))
    got = {r["record_id"]: r for r in warc.read_archives(spark, f"{tmp_path}/w", range_bytes=61).collect()}
    assert {k: bytes(r["payload"]) for k, r in got.items()} == {f"x:{i}": b for i, b in enumerate(bodies)}
    offsets = sorted((r["offset"], r["length"]) for r in got.values())
    assert all(a + n == b for (a, n), (b, _) in zip(offsets, offsets[1:])) and offsets[0][0] == 0


def test_damaged_members_are_told(spark, tmp_path):
    good, bad = gzip.compress(foreign("resource", b"good" * 50)), bytearray(gzip.compress(foreign("resource", b"bad" * 50)))
    bad[-6] ^= 1                                        # its checksum
    os.mkdir(tmp_path / "w")
    (tmp_path / "w" / "a.warc.gz").write_bytes(good + bytes(bad) + good + good[:-9])
    rows = warc.read_archives(spark, f"{tmp_path}/w").orderBy("offset").collect()
    assert [r["error"] is None for r in rows] == [True, False, True, False]
    assert [r["payload"] for r in rows if r["error"]] == [None, None]
    assert rows[0]["payload"] == rows[2]["payload"] == b"good" * 50


def test_pages_table_matches_brute_force(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 10_000))
    warc.write_archives(more, f"{tmp_path}/w")
    assert read_back(spark, f"{tmp_path}/w", range_bytes=50_000) == expected([tuple(r) for r in more.select("page_id", "url", "html").collect()])
