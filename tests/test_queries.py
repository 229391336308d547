"""Every query against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from ravine.plans.registry import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_oracle_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, duck, name):
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda it: sorted(repr(same(tuple(r))) for r in it)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_tables_of_suppliers_are_not_kept_for_each_document(spark):
    """A nation's table is joined by nation: no join by document carries it."""
    plan = QUERIES["tables_kept_whole"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and line.count("document_id") > 1 for line in plan.splitlines())


def test_relevant_pairs_are_not_made(spark):
    """Labels are counted; no join of the vectors with the queries by label alone."""
    plan = QUERIES["ndcg_mrr_recall"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [label") == 1
