"""Every registered query against its DuckDB SQL at sf0.001 (row count, columns, values)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF0001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _digest(rs):
    return sorted(hashlib.sha1(repr(r).encode()).hexdigest() for r in rs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF0001)
    scols = sorted(df.columns)
    srows = [tuple(_norm(r[c]) for c in scols) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = [tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()]
    assert scols == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(srows) == _digest(drows)


def test_every_query_has_oracle_or_is_listed():
    from skillsift.plans.queries import QUERIES
    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only == {"similar_titles"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns
