"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from shelfspark import plans

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.9g}"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order] and [tuple(plain(r[i]) for i in order) for r in values])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(SF))
    got = rows(df.columns, df.collect())
    if name in plans.SQL:
        cursor = duck.execute(plans.SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(columns, cursor.fetchall())


def test_the_entry(spark):
    assert entry.entry(spark).columns == ["qid", "id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())


STORED = ["backfill_paths", "backfill_state", "delete_by_path", "ids_by_path", "index_plan", "index_plan_rechunk", "maint_multi_id", "maint_orphans", "orphans_manifest", "orphans_store", "plan_stage3", "root_affected"]


@pytest.mark.parametrize("name", STORED)
def test_the_stored_books_are_found_by_keys(spark, name):
    """No row of the derived store is compared with all candidates."""
    plan = plans.QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
