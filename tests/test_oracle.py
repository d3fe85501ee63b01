"""Every query with SQL gives the rows DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

from conftest import SF_DIR

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def _sort_key(row):
    return tuple((v is not None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = [tuple(r[c] for c in columns) for r in found.collect()]
    cursor = duck.execute(ORACLE[name])
    named = [c[0] for c in cursor.description]
    assert sorted(named) == columns
    want = [tuple(r[named.index(c)] for c in columns) for r in cursor.fetchall()]
    assert len(got) == len(want)
    # Text, dates and whole numbers first, so that rounding cannot change the order.
    firm = [i for i in range(len(columns)) if not any(isinstance(r[i], float) for r in want)]
    order = firm + [i for i in range(len(columns)) if i not in firm]
    got = sorted((tuple(r[i] for i in order) for r in got), key=_sort_key)
    want = sorted((tuple(r[i] for i in order) for r in want), key=_sort_key)
    for g, w in zip(got, want):
        assert all(_close(a, b) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    found = entry_point.entry(spark)
    assert {"series_id", "ds", "predicted", "expected"} == set(found.columns)
    assert found.count() > 0
