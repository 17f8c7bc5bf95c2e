"""Every registered query against its SQL oracle (DuckDB) on the smallest scale, and the
entry smoke check. The driver runs the same comparison at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from mediashelf.plans.compare import digest, type_diffs
from mediashelf.plans.registry import load_all
from mediashelf.session import TABLES

from .conftest import SF_SMALL

OWN = load_all()
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in OWN}
QUERIES = {name: build for name, build in E.queries().items() if name in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "file_count" in df.columns


def test_every_query_has_oracle_or_is_stream():
    missing = sorted(set(QUERIES) - set(SQL))
    assert missing == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert type_diffs(df.dtypes, rel.columns, rel.types) == {}
    cur = duck.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    hs, ls = digest(df.columns, srows)
    ho, lo = digest(ocols, cur.fetchall())
    assert hs == ho, (sorted(set(ls) - set(lo))[:3], sorted(set(lo) - set(ls))[:3])
