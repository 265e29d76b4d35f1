from __future__ import annotations

import duckdb
import pytest

from strata.operators import graph
from strata.plans import catalog

SYMBOLS = "id bigint, file string, qname string, line int, span struct<s:int,e:int>, node_count int, is_test boolean, calls array<struct<base:string,module:string>>, merkle_root bigint, scanned_at timestamp, vocab_tf map<string,int>, wl array<struct<label:bigint,w:double>>"


def _pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes a table of symbols (id, file, qname, calls)."""

    def write(rows):
        made = [(i, f, q, 1, (0, 9), 5, False, [{"base": b, "module": m} for b, m in c], i, None, dict.fromkeys(["alpha", "beta", "gamma", "delta", "omega"], 1), [(i, 1.0)]) for i, f, q, c in rows]
        spark.createDataFrame(made, SYMBOLS).write.parquet(f"{tmp_path}/symbols.parquet")
        return str(tmp_path)

    return write


def _sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW symbols AS SELECT * FROM '{folder}/symbols.parquet/*.parquet'")
    return set(con.execute(catalog.SQL[name]).fetchall())


def test_related_by_every_name(spark, folder):
    """A method is called by its base name, a class by its name, and anything by its lower-case first part."""
    d = folder([(1, "a.py", "f", [("run", None), ("Box", None), ("circuit", None)]), (2, "b.py", "A.run", []), (3, "c.py", "Box.__init__", []), (4, "d.py", "Circuit.load", [])])
    got = _pairs(catalog.QUERIES["call_related"](spark, d))
    assert got == {(1, 2), (1, 3), (1, 4)} == _sql(d, "call_related")


CALLED = [
    (1, "x/m.py", "A.one", [("b", None), ("a", None), ("c", "x.m")]), (2, "x/m.py", "B.two", [("a", None)]), (3, "y.py", "b", [("b", None), ("c", "x.m"), ("c", None)]), (4, "x/m.py", "C.__init__", [("none", None), ("d", "y")]),
    (5, "y.py", "C", [("b", "y"), ("e", "z")]), (6, "y.py", "D", [("d", "y"), ("a", None)]), (7, "z.py", "a", []), (8, "z.py", "e", [("c", None)]), (9, "z.py", "b", [("b", None)]),
]


def _spelt_last(df):
    """Nothing is shuffled or grouped after the pairs are spelt out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate ")]
    return "Exchange" not in above and "Aggregate" not in above


def test_related_spells_each_pair_once(spark, folder):
    d = folder(CALLED)
    df = catalog.QUERIES["call_related"](spark, d)
    assert _pairs(df) == _sql(d, "call_related") and _spelt_last(df)


def test_two_hops_spells_each_pair_once(spark, folder):
    d = folder(CALLED)
    df = catalog.QUERIES["call_two_hop"](spark, d)
    got = _pairs(df)
    assert got == _sql(d, "call_two_hop") and _spelt_last(df)
    assert {(1, 6), (4, 6), (5, 3), (8, 3)} <= got
    assert _pairs(graph.two_hops(spark.createDataFrame([], "id bigint, file string, qname string, calls array<struct<base:string,module:string>>"))) == set()


def test_funnel_follows_every_name(spark, folder):
    """A pair that calls each other by a base name is no competitor."""
    d = folder([(1, "a.py", "f", [("run", None)]), (2, "b.py", "A.run", []), (3, "c.py", "g", [])])
    got = {r["stage"]: r["pairs"] for r in catalog.QUERIES["competing_funnel"](spark, d).collect()}
    assert got == {"vocab_pairs": 3, "cross_context": 3, "low_shape": 3, "vocab_quality": 3, "kept": 2} == dict(_sql(d, "competing_funnel"))
