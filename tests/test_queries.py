"""Every registered query runs at sf0.001; a sample agrees with DuckDB."""
import duckdb
import pytest

import __spark_entry__ as E
from codedelta.plans import registry
from codedelta.sources.tables import TABLES

FAST = ["kpi_weighted_score", "risk_all_dedup", "line_diff_multiset", "line_diff_aligned", "map_fuzzy",
        "node_added", "node_modified", "merge_types", "next_steps", "full_report", "list_page", "status_rollup", "status_latest", "over_limit", "validate_requests", "upsert_settings"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "overall_score" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = E.queries()[name](spark, sf)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(ocols, res.fetchall())


def test_every_query_has_rows_or_oracle(spark):
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(registry.QUERIES) - len(registry.ORACLE) <= 3
