"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from queuelens.registry import ORACLES, QUERIES
from tools.check_oracles import TABLES, TYPES, normal


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    found = db.sql(ORACLES[name])
    order = sorted(found.columns)
    assert sorted(df.columns) == order
    theirs = dict(zip(found.columns, map(str, found.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == theirs
    at = [found.columns.index(c) for c in order]
    left = sorted(tuple(normal(r[c]) for c in order) for r in df.collect())
    right = sorted(tuple(normal(r[i]) for i in at) for r in found.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
