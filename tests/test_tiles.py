from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strata.config import LOW_SIGNAL_TERMS, Config
from strata.operators import tiles
from strata.plans import catalog
from tests.test_graph import SYMBOLS


def _symbols():
    """Symbols of like vocabularies, some of low signal, in tests, without a file or a shape, that call each other by name."""
    r = random.Random(5)
    terms = ["alpha", "beta", "gamma", "delta", "omega", "sigma", *LOW_SIGNAL_TERMS[:6], *(f"t{k}" for k in range(30))]
    for i in range(150):
        name = f"n{r.randrange(40)}"
        calls = [{"base": f"n{r.randrange(60)}", "module": r.choice([None, None, f"f{r.randrange(9)}"])} for _ in range(r.choice([0, 0, 1]))]
        vocab = dict.fromkeys(r.sample(LOW_SIGNAL_TERMS[:6], 6), 1) if i % 25 == 0 else {t: r.randint(1, 3) for t in r.sample(terms[i % 5 * 5 : i % 5 * 5 + 12], r.randint(4, 9))}
        wl = None if i % 17 == 0 else [(r.randrange(40), float(r.randint(1, 3))) for _ in range(r.randint(2, 12))]
        yield (i, None if i % 29 == 0 else f"f{i % 9}.py", f"{name.upper()}.m{i % 7}", 1, (0, 9), 5, {0: True, 1: None}.get(i % 8, False), calls, i, None, vocab, wl)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tiles"))
    spark.createDataFrame(list(_symbols()), SYMBOLS).coalesce(1).write.parquet(f"{d}/symbols.parquet")
    return d


def _same(folder, name, blocks, monkeypatch, spark):
    monkeypatch.setattr(tiles, "LEAST_BLOCKS", blocks)
    df = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW symbols AS SELECT * FROM '{folder}/symbols.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name])
    plain = lambda rows: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in rows)
    assert df.columns == [c[0] for c in want.description]
    got = plain(df.collect())
    assert got == plain(want.fetchall()) and got
    return df


def _above(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("MapInArrow")]


def _found_last(df):
    return not any(x in _above(df) for x in ("Exchange", "Join", "Sort"))


def test_call_related_anti_does_not_shuffle_pairs(spark, folder, monkeypatch):
    assert _found_last(_same(folder, "call_related_anti", 3, monkeypatch, spark))


@pytest.mark.parametrize("known", [True, False])
def test_tile_against_all_pairs(monkeypatch, known):
    """Each step of a tile's work cut as small as it goes, in one block and between two."""
    for name, most in {"LIST_ROWS": 5, "ENTRIES": 20, "PAIRS": 7, "LINES": 2, "TERMS": 9}.items():
        monkeypatch.setattr(tiles, name, most)
    r, cfg = np.random.default_rng(3), Config()
    n = 60
    words = [sorted(r.choice(12, r.integers(3, 9), replace=False)) for _ in range(n)]
    w = [x / np.sqrt((x * x).sum()) for x in (r.uniform(0.2, 1, len(v)) for v in words)]
    df = np.bincount(np.concatenate(words), minlength=12)
    shape = [sorted(r.choice(30, r.integers(1, 6), replace=False)) if k % 9 else None for k in range(n)]
    own = [int(k % 4) if k % 3 else None for k in range(n)]
    out = [sorted(r.choice(4, r.integers(1, 3), replace=False)) if k % 5 == 0 else None for k in range(n)]
    calls = {g: {g} | {own[k] for k in range(n) if own[k] is not None and out[k] and g in out[k]} for g in range(4)}
    file = [None if k % 11 == 0 else f"f{k % 3}" for k in range(n)]
    test, low = [k % 7 == 0 for k in range(n)], r.integers(0, 8, n)
    rank = {t: k for k, t in enumerate(sorted(range(12), key=lambda t: (df[t], t)))}
    toks = [sorted(({"df": int(df[t]), "label": rank[t], "w": float(x)} for t, x in zip(v, y, strict=True)), key=lambda e: e["label"]) for v, y in zip(words, w, strict=True)]
    table = lambda right, same: pa.table({
        "rep": pa.array(range(n)), "right": pa.array(right), "same": pa.array([same] * n), "is_test": pa.array(test), "terms": pa.array([len(v) for v in words]), "mass": pa.array([float(x.sum()) for x in w]), "low": pa.array(low), "file": pa.array(file, pa.string()),
        "toks": pa.array(toks, pa.list_(pa.struct([("df", pa.int32()), ("label", pa.int64()), ("w", pa.float64())]))), "labels": pa.array(shape, pa.list_(pa.int64())), "ws": pa.array([None if s is None else [1.0] * len(s) for s in shape], pa.list_(pa.float64())), "n": pa.array([None if s is None else float(len(s)) for s in shape]),
        "own": pa.array(own, pa.int64()), "out": pa.array(out, pa.list_(pa.int64())), "into": pa.array([sorted(calls[own[k]]) if own[k] is not None else None for k in range(n)], pa.list_(pa.int64())),
    })

    def want(a, b):
        x, y = (dict(zip(words[k], w[k], strict=True)) for k in (a, b))
        both = x.keys() & y.keys()
        cos = sum(x[t] * y[t] for t in both)
        if cos < cfg.theta_b or not any(df[t] <= 30 for t in both):
            return None
        if test[a] or test[b] or file[a] is None or file[b] is None or file[a] == file[b] or min(len(x), len(y)) < 5:
            return 1, None
        a_cos = len(set(shape[a]) & set(shape[b])) / np.sqrt(len(shape[a]) * len(shape[b])) if shape[a] and shape[b] else 0.0
        if a_cos > cfg.theta_a_low:
            return 2, a_cos
        share = sum(min(x[t], y[t]) for t in both) / min(sum(x.values()), sum(y.values()))
        if len(both) < 3 or share < 0.3 or len(both) <= int(low[a] & low[b]).bit_count():
            return 3, a_cos
        reach = lambda p, q: bool(out[p]) and own[q] is not None and bool(set(out[p]) & calls[own[q]])
        return (4 if not known or reach(a, b) or reach(b, a) else 5), a_cos

    for same, right in ((True, [False] * n), (False, [bool(k % 2) for k in range(n)])):
        got = {}
        for batch in tiles.Tile(table(right, same), known, cfg).pairs(30, 1):
            for p in batch.to_pylist():
                assert (p["a"], p["b"]) not in got
                got[p["a"], p["b"]] = (p["passed"], None if p["a_cos"] is None else round(p["a_cos"], 9))
        all_ = {(a, b): want(a, b) for a in range(n) for b in range(a + 1, n) if same or right[a] != right[b]}
        assert got == {k: (v[0], None if v[1] is None else round(float(v[1]), 9)) for k, v in all_.items() if v}
        assert {v[0] for v in got.values()} >= ({1, 2, 3, 4, 5} if known else {1, 2, 3, 4})


def test_vocab_quality_pairs_does_not_shuffle_pairs(spark, folder, monkeypatch):
    assert _found_last(_same(folder, "vocab_quality_pairs", 1, monkeypatch, spark))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vocab_quality_pairs_writes_symbols_once(spark, folder, monkeypatch):
    """However many blocks there are, no copy of a symbol is shuffled for each of them."""
    assert "Exchange" not in _plan(_same(folder, "vocab_quality_pairs", 6, monkeypatch, spark))


def test_competing_funnel_keeps_no_pairs(spark, folder, monkeypatch):
    """Pairs are counted where they are found; only the counts are exchanged."""
    above = _above(_same(folder, "competing_funnel", 2, monkeypatch, spark))
    assert above.count("Exchange") == 1 and "Join" not in above and "Scan" not in above


def test_competing_funnel_writes_symbols_once(spark, folder, monkeypatch):
    """Besides the counts nothing is exchanged: no copy of a symbol for each block."""
    assert _plan(_same(folder, "competing_funnel", 6, monkeypatch, spark)).split("Initial Plan")[0].count("Exchange") == 1


def test_competing_groups_reads_only_kept_pairs(spark, folder, monkeypatch):
    """What the groups are merged from is what is left after all stages, found without a shuffle of pairs."""
    from strata.plans import shape_queries

    monkeypatch.setattr(tiles, "LEAST_BLOCKS", 2)
    stages, _, _ = shape_queries._stages(spark, folder)
    assert _found_last(stages["kept"]) and {r["passed"] for r in stages["kept"].collect()} == {5}
    members = [m for r in catalog.QUERIES["competing_groups"](spark, folder).collect() for m in r["members"]]
    assert members and len(members) == len(set(members))


def test_ranked_merge_holds_no_pairs(monkeypatch):
    """Pairs that come in small batches, those of other components among them, are merged as all of them at once would be."""
    from strata.operators import clustering

    monkeypatch.setattr(clustering, "BATCH", 4)
    r = np.random.default_rng(11)
    n = 60
    vec = {3 * k: dict(zip(("abcdefgh"[t] for t in sorted(r.choice(8, 3, replace=False))), r.uniform(0.2, 1, 3).tolist(), strict=True)) for k in range(n)}
    pairs = sorted(((round(float(r.uniform(0.5, 1)), 1), 3 * int(a), 3 * int(b)) for a in range(n) for b in range(a + 1, n) if a % 2 == b % 2 and r.random() < 0.3), key=lambda p: (-p[0], *p[1:]))
    low, made, refused = clustering.merge_best_first(list(vec), [], pairs, {i: clustering._unit(v.keys(), list(v.values())) for i, v in vec.items()}, 0.6)
    want = {}
    for i, c in low.items():
        want.setdefault(c, []).append(i)
    want = {c: (m, *max(p for p in pairs if {p[1], p[2]} <= set(m))) for c, m in want.items() if len(m) > 1}
    got = {}
    for part in (0, 1):
        ids = [i for i in vec if i // 3 % 2 == part]
        nodes = pa.table({"id": ids, "k": [list(vec[i]) for i in ids], "w": [list(vec[i].values()) for i in ids]})
        batches = lambda: (pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, cos)], names=["a", "b", "cos"]) for k in range(0, len(pairs), 4) for cos, a, b in [zip(*pairs[k : k + 4], strict=True)])
        for batch in clustering.merge_ranked(nodes, batches, 0.6):
            got |= {p["cluster"]: (p["members"], p["b_max"], p["a"], p["b"]) for p in batch.to_pylist()}
    assert got == want and made and refused


def test_competing_groups_joins_no_pairs(spark, folder, monkeypatch):
    """The pairs are written once, in the order of the merge, and merged in more than one task with the same result; only their best are joined."""
    from pyspark.sql.classic.dataframe import DataFrame

    from strata.operators import clustering

    joined = []
    join = DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, *a, **k: joined.append(self.columns + other.columns) or join(self, other, *a, **k))
    plain = sorted(catalog.QUERIES["competing_groups"](spark, folder).collect())
    assert plain and joined and not any({"a", "b", "cos"} <= set(c) and "a_cos" in c for c in joined)
    monkeypatch.setattr(clustering, "NODES", 7)
    assert sorted(catalog.QUERIES["competing_groups"](spark, folder).collect()) == plain


@pytest.mark.parametrize("n", [0, 2])
def test_blocks_without_symbols(spark, tmp_path, n):
    """Fewer symbols than blocks, or none that may pair."""
    spark.createDataFrame([(i, f"f{i}.py", f"N{i}.m", 1, (0, 9), 5, False, [], i, None, dict.fromkeys(("a", "b", "c", "d", f"e{i % 2 * n // 9}"), 1), None) for i in range(n)], SYMBOLS).coalesce(1).write.parquet(f"{tmp_path}/symbols.parquet")
    got = {r["stage"]: r["pairs"] for r in catalog.QUERIES["competing_funnel"](spark, str(tmp_path)).collect()}
    assert set(got.values()) == {n // 2}
    assert len(catalog.QUERIES["competing_groups"](spark, str(tmp_path)).collect()) == n // 2
