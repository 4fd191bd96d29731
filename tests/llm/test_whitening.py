"""Whitening against numpy."""

import numpy as np
import pytest

from ledgerlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, index string, z double, VEC_ID string"


def whitened(spark, rows, **kw):
    return whitening.whiten(spark.createDataFrame([(*r, 0, 1, "i", 0.5, "v") for r in rows], SCHEMA).repartition(3), **kw).toPandas()


def check(got, rows, components=4):
    """Rows of one length, all usable."""
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, x.shape[1])
    assert len(got) == k * len(rows) and set(got["n"]) == {n}
    deviation = {r[0]: int(d) for r, d in zip(rows, ((n * x - s).astype(object) ** 2).sum(1))}
    assert dict(zip(got["vec_id"], got["deviation"])) == deviation
    assert [int(d) for d in got["deviation_exact"]] == list(got["deviation"])
    z = (x - s / n) @ v[:, :k] / np.sqrt(e[:k])
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in rows]].to_numpy()
    for i in range(k):
        assert min(np.abs(table[:, i] - z[:, i]).max(), np.abs(table[:, i] + z[:, i]).max()) < 1e-9
        assert got[got["component"] == i + 1]["explained"].iloc[0] == pytest.approx(e[i] / e.sum(), rel=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_matches_numpy(spark):
    rng = np.random.default_rng(1)
    scale = np.array([9, 7, 5, 3, 2, 1, 0.5])
    rows = [(i, (rng.normal(size=7) * scale + 2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(500)]              # copies weigh as one
    check(whitened(spark, rows), rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "MIDDLE", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for i in range(401)]
    check(whitened(spark, rows), rows)


def test_table(spark):
    got = whitening.whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).toPandas()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(got, rows)


def test_unusable_rows_are_left_out(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=3) * [3, 2, 1]).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1e38, 0.0, 0.0]), (106, [1.0, 2.0])]
    got = whitened(spark, good + bad)
    check(got, good)
    again = whitened(spark, good + bad + [(None, good[0][1]), (7, good[7][1])])
    assert again["vec_id"].isna().sum() == 3 and (again["vec_id"] == 7).sum() == 6


def test_no_spread(spark):
    got = whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(got) == 4 and got["whitened"].isna().all() and got["identity_error"].isna().all() and (got["deviation"] == 0).all()
    line = whitened(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])
    first, rest = line[line["component"] == 1], line[line["component"] > 1]
    assert len(line) == 27 and first["whitened"].notna().all() and rest["whitened"].isna().all() and (rest["explained"] == 0).all()


def test_large_deviation_is_exact(spark):
    rows = [(i, [float(2 ** 40 * (i + 1)), float(i)]) for i in range(3)]
    got = whitened(spark, rows)
    x = [[256 * 2 ** 40 * (i + 1), 256 * i] for i in range(3)]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * v - t) ** 2 for v, t in zip(r, s)) for i, r in enumerate(x)}
    assert {i: int(d) for i, d in zip(got["vec_id"], got["deviation_exact"])} == want
    assert got[got["vec_id"] == 0]["deviation"].isna().all()


def test_empty(spark):
    assert len(whitened(spark, [])) == 0 and len(whitened(spark, [(1, None)])) == 0
