"""Every registered query of the engine with SQL gives DuckDB's rows."""

import datetime
import math

import duckdb
import pytest

from ledgerloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(frame):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 4)
        return v.date() if isinstance(v, datetime.datetime) else v

    return sorted((tuple(plain(v) for v in r) for r in frame), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in queries.ORACLES:
        assert found
        return
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert rows(found) == rows(want)
