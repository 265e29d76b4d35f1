from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("STRATA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strata.runtime import session, ship

    s = session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(x):
    if hasattr(x, "asDict"):
        return tuple((k, _plain(v)) for k, v in sorted(x.asDict().items()))
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a query against its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, DATA)
        got = duck.execute(sql)
        columns = [c[0] for c in got.description]
        assert sorted(df.columns) == sorted(columns)
        assert _rows(df.columns, df.collect()) == _rows(columns, got.fetchall())

    return check
