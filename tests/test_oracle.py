"""Every registered query runs, is written as Parquet, and where it has SQL
gives the same rows as DuckDB."""

import math

import pyarrow.parquet as pq
import pytest

from conftest import SMALL
from ledgerlens.plans.entry import registered_queries, registered_sql

SQL = registered_sql()
QUERIES = registered_queries()
#: Twelve fits take minutes; its parts are tested as baseline_job, model_comparison_smote and technique_summary.
SLOW = {"experiment_grid"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        v = v.replace(tzinfo=None) if hasattr(v, "hour") else v
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_is_registered_with_ids():
    from ledgerlens.plans.registry import REGISTRY
    assert len(REGISTRY) >= 80
    assert all(q.survey_ids for q in REGISTRY.values())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_matches_duckdb(spark, duck, name, tmp_path):
    QUERIES[name](spark, SMALL).write.parquet(str(tmp_path / "out"))
    out = pq.read_table(tmp_path / "out")
    if name not in SQL:
        assert out.num_rows > 0
        return
    s_cols, s_rows = _canon(out.column_names, list(zip(*[c.to_pylist() for c in out.columns])) if out.num_columns else [])
    res = duck.execute(SQL[name])
    d_cols, d_rows = _canon([c[0] for c in res.description], res.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows
