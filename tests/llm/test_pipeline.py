"""The pipeline, stage by stage, against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ledgerlens.llm import bpe, mixing, toxicity
from ledgerlens.llm.common import take

from .conftest import EDGE, SF
from .test_dedup import slow_groups, slow_lines
from .test_text import tokens

BLANK = " \t\n\x0b\x0c\r"


def slow_kept_text(rows):
    """(doc_id, text) after line deduplication."""
    holder = {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    for i, t in rows:
        for x in t.split("\n"):
            holder[key(x)] = min(holder.get(key(x), i), i)
    return [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or holder[key(x)] == i)) for i, t in rows]


def fill(want, most, total):
    """The factor f for which min(most, f * want) sums to ``total``, by halving."""
    if sum(most) <= total:
        return 1e300
    low, high = 0.0, 1.0
    while sum(min(m, high * w) for w, m in zip(want, most)) < total and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(m, mid * w) for w, m in zip(want, most)) < total else (low, mid)
    return high


def slow_shares(size, targets, budget):
    """Of each dimension, the share that every class gets: its target or, if it has less, all its tokens."""
    total, out = sum(size.values()), []
    for d, t in enumerate(targets):
        tokens_of = Counter()
        for c, n in size.items():
            tokens_of[c[d]] += n
        most = {v: n / total / budget for v, n in tokens_of.items() if n}
        f = fill([t[v] for v in most], most.values(), 1.0)
        out.append({v: min(m, f * t[v]) for v, m in most.items()})
    return out


def slow_mix(rows, alpha=0.7, budget=0.5, sweeps=60):
    """Sampled rows (doc_id, text, lang, source), raked under the bound that a cell gives no more than it has."""
    cell = lambda r: (r[3], r[2], mixing.topic_of(r[1]))
    size = Counter()
    for r in rows:
        size[cell(r)] += len(tokens(r[1])) - 1
    targets = []
    for d in range(3):
        t = Counter()
        for c, n in size.items():
            t[c[d]] += n
        raw = {v: n ** alpha for v, n in t.items() if n}
        targets.append({v: x / sum(raw.values()) for v, x in raw.items()})
    size = {c: n for c, n in size.items() if n}
    total, shares = sum(size.values()), slow_shares(size, targets, budget)
    w, most = {c: float(n) for c, n in size.items()}, {c: n / total / budget for c, n in size.items()}
    for sweep in range(sweeps):
        for d in range(3):
            for v, share in shares[d].items():
                mine = [c for c in size if c[d] == v]
                f = fill([w[c] for c in mine], [most[c] for c in mine], share * (1 - 1e-15))
                for c in mine:
                    w[c] = min(w[c] * f, 1e100)
        off = max(abs(sum(min(w[c], most[c]) for c in size if c[d] == v) - share) for d in range(3) for v, share in shares[d].items())
        if sweep % 2 and off <= 1e-5:
            break
    rate = {c: min(w[c], most[c]) / size[c] * total for c in size}
    spent = lambda s: sum(size[c] * min(1, s * r) for c, r in rate.items())
    low, high = -10.0, 10.0
    for _ in range(3):
        grid = [low + (high - low) * i / 16 for i in range(17)]
        at = max((i for i in range(16) if spent(2 ** grid[i]) <= budget * total), default=0)
        low, high = grid[at], grid[at + 1]
    u = lambda i: int(hashlib.md5(f"8|{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
    p = {c: min(1, 2 ** low * r) for c, r in rate.items()}
    return [r for r in rows if u(r[0]) < p.get(cell(r), 1.0)], {c: (size[c], p[c]) for c in size}, shares


def test_whole_run(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    clean = [r for r in rows if model.at_least(r[1])[0] < 0.5]
    assert 0.8 * len(rows) < len(clean) < len(rows)
    text = dict(slow_kept_text([r[:2] for r in clean]))
    clean = [(r[0], text[r[0]], *r[2:]) for r in clean]
    _, root = slow_groups([r[:2] for r in clean])
    apart = [r for r in clean if root[r[0]] == r[0]]
    mixed, cells, shares = slow_mix(apart)
    assert set(got) == {r[0] for r in mixed} and 0 < len(mixed) < len(apart) < len(clean)
    expected = sum(n * p for n, p in cells.values())
    for d in range(3):                                  # the expected sample has the shares of every dimension
        for v, share in shares[d].items():
            assert sum(n * p for c, (n, p) in cells.items() if c[d] == v) / expected == pytest.approx(share, abs=0.01)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for i, t, *_ in mixed:
        ids = library.encode(t, add_special_tokens=False).ids
        r = got[i]
        assert r.text == t and r.n_tokens == len(ids) and np.frombuffer(r.token_ids, "<u4").tolist() == ids
        assert r.n_chars == len(t)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_edges(spark, documents, edge, name, stage):
    plain = take(edge, *[c for c in edge.columns if c != "TEXT"])
    last = name == corpus_pipeline.STAGES[-1][0]
    for df in (plain, edge, plain.select("doc_id", "text", "lang", "source", "n_chars")):
        out = stage(spark, df, SF)
        rows = out.collect()
        assert out.columns == df.columns + (["token_ids", "n_tokens"] if last else [])
        assert 0 < len(rows) <= len(EDGE)
        if name in ("toxicity", "bpe", "line_dedup"):
            assert len(rows) == len(EDGE)
        if name == "line_dedup":
            texts = {r[0]: r[1] for r in rows}
            want = {r[0]: (r[1], r[2]) for r in slow_lines([(e[0], e[1]) for e in EDGE])}
            assert {i: len((t or "").split("\n")) for i, t in texts.items() if i is not None and want[i][1] == 0 } == {i: n for i, (n, d) in want.items() if i is not None and d == 0}
            assert texts[1] is None and texts[None] == EDGE[11][1]
        if name.startswith("simhash"):
            ids = [r[0] for r in rows]
            assert len(ids) == len(set(ids)) and None in ids
        assert stage(spark, df.limit(0), SF).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(__spark_entry__.LLM_SQL))
def test_matches_duckdb(spark, name):
    import duckdb
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(__spark_entry__.LLM_SQL[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
