"""Every query of the engine itself against DuckDB, and the driver's contract."""

import glob
import os

import duckdb
import pytest

from fernspark.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_like_duckdb(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(names).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in cur.fetchall()) and rows


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert {r['count'] for r in e.entry(spark).groupBy("qid").count().collect()} == {10}  # ten for each vector that asks
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = registry.QUERIES["parquet_column_loader"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "IsNotNull(text)" in plan


def test_topk_is_cut_before_the_shuffle(spark, sf):
    from fernspark.plans.q_retrieval import _similar

    plan = _similar(spark, sf, "cosine")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan
