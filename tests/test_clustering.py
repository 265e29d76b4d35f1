"""Order-dependent merges against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.config import Config
from strata.operators import clustering
from strata.operators.components import components
from strata.operators.similarity import prefix_join


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    from strata.operators import components as module

    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(1, None), (None, 2), (7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_prefix_join(spark):
    rng = np.random.default_rng(3)
    vec = {}
    for i in range(80):
        keys = rng.choice(40, 6, replace=False)
        w = rng.random(6) + 0.1
        vec[i] = dict(zip(keys.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True))
    rows = [(i, int(k), float(w)) for i, v in vec.items() for k, w in v.items()]
    got = {(r["a"], r["b"]) for r in prefix_join(spark.createDataFrame(rows, "id bigint, key bigint, w double"), 0.5).collect()}
    dot = lambda a, b: sum(w * b.get(k, 0) for k, w in a.items())
    assert got == {(i, j) for i in vec for j in vec if i < j and dot(vec[i], vec[j]) >= 0.5}


def _symbols(spark, rows):
    return spark.createDataFrame(rows, "id bigint, file string, line int, span struct<s:int,e:int>, node_count int, merkle_root bigint, wl array<struct<label:bigint,w:double>>, minhash array<bigint>, is_test boolean, qname string, vocab_tf map<string,int>")


def _made(seed=1, n=60):
    from strata.sources.python_code import minhashes

    rng = random.Random(seed)
    rows = []
    bases = [[rng.getrandbits(40) for _ in range(20)] for _ in range(6)]
    for i in range(n):
        labels = [x if rng.random() > 0.12 else rng.getrandbits(40) for x in rng.choice(bases)]
        wl = [{"label": x, "w": float(1 + x % 3)} for x in sorted(set(labels))]
        rows.append((i, f"d{i % 7}/f{i % 11}.py", i, {"s": i * 10, "e": i * 10 + 9}, 30 + i % 5, labels[0] if rng.random() < 0.3 else i, wl, minhashes([e["label"] for e in wl]), False, f"C.f{i}", {"alpha": 1, f"t{i % 5}": 2}))
    return rows


def test_shape_clusters(spark):
    rows = _made()
    s = _symbols(spark, rows)
    got = {r["id"]: r["cluster"] for r in clustering.shape_clusters(s).collect()}
    vec = {r[0]: clustering._unit([e["label"] for e in r[6]], [e["w"] for e in r[6]]) for r in rows}
    roots = {}
    for r in rows:
        roots.setdefault(r[5], []).append(r[0])
    bands = {r[0]: {(b, r[7][2 * b], r[7][2 * b + 1]) for b in range(32)} for r in rows}
    pairs = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and bands[a[0]] & bands[b[0]] and a[1] != b[1]:
                c = clustering._cos(vec[a[0]], vec[b[0]])
                if c >= 0.6:
                    pairs.append((c, a[0], b[0]))
    low, _, _ = clustering.merge_best_first([r[0] for r in rows], [g for g in roots.values() if len(g) > 1], pairs, vec, 0.48)
    size = {c: list(low.values()).count(c) for c in low.values()}
    assert got == {i: c for i, c in low.items() if size[c] > 1}
    assert len(set(got.values())) > 1


def test_merge_keeps_larger_side():
    v = {i: {i // 10: 1.0} for i in (0, 1, 10)}
    low, made, refused = clustering.merge_best_first([0, 1, 10], [], [(0.9, 0, 1), (0.8, 1, 10)], v, 0.5)
    assert (low, made, refused) == ({0: 0, 1: 0, 10: 10}, 1, 1)


def test_families(spark):
    rows = _made(2, 40)
    s = _symbols(spark, rows)
    from strata.operators.similarity import term_counts, tfidf

    w = tfidf(term_counts(s, "id", "vocab_tf"), 40)
    tight = clustering.shape_clusters(s, Config(theta_clone=0.8))
    f = clustering.families(s, tight, w, Config(theta_family=0.3, theta_b_family=0.1))
    rows = f.collect()
    assert rows and all(-1e-9 <= r["cos_to_core"] <= 1 + 1e-9 for r in rows)
    tight_ids = {r["id"]: r["cluster"] for r in tight.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["family"], []).append(r)
    for members in by.values():
        core = {tight_ids[r["id"]] for r in members if r["is_core"]}
        assert len(core) == 1 and len({tight_ids.get(r["id"], r["id"]) for r in members}) > 1
    assert len({r["id"] for r in rows}) == len(rows)
    assert clustering.family_summary(f, s).where(F.col("members") < 2).count() == 0


def _unit_cos(a, b):
    dot = sum(w * b.get(k, 0.0) for k, w in a.items())
    size = lambda v: sum(w * w for w in v.values()) ** 0.5
    return dot / (size(a) * size(b)) if a and b else 0.0


def test_competing_groups_against_a_plain_merge(spark):
    """All pairs in one list, merged one after the other, without components."""
    from strata.plans import catalog, shape_queries
    from tests.conftest import DATA

    got = {r["cluster"]: r for r in catalog.QUERIES["competing_groups"](spark, DATA).collect()}
    stages, weights, _ = shape_queries._stages(spark, DATA)
    pairs = [(r["cos"], r["a"], r["b"], r["a_cos"]) for r in stages["kept"].collect()]
    vec = {}
    for r in weights.collect():
        vec.setdefault(r["id"], {})[r["term"]] = r["w"]
    groups = {i: {"members": {i}, "rep": i} for p in pairs for i in p[1:3]}
    home = {i: i for i in groups}
    for _, a, b, _ in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        x, y = groups[home[a]], groups[home[b]]
        if x is y or _unit_cos(vec[x["rep"]], vec[y["rep"]]) < 0.8 * 0.55:
            continue
        rep = x["rep"] if len(x["members"]) >= len(y["members"]) else y["rep"]
        x["members"] |= y["members"]
        x["rep"] = rep
        for i in y["members"]:
            home[i] = home[a]
    want = {min(groups[h]["members"]): groups[h]["members"] for h in set(home.values()) if len(groups[h]["members"]) > 1}
    assert {c: set(r["members"]) for c, r in got.items()} == want and want
    for c, r in got.items():
        cos, _, _, a_cos = max(((p[0], p[1], p[2], p[3]) for p in pairs if {p[1], p[2]} <= want[c]), key=lambda p: (p[0], p[1], p[2]))
        assert abs(r["b_max"] - cos) < 1e-8 and abs(r["a_at_best"] - a_cos) < 1e-8 and 0 < len(r["terms"]) <= 8


def test_families_against_a_plain_agglomeration(spark):
    """Average linkage recomputed from all pairs of members after every merge."""
    from strata.operators.similarity import term_counts, tfidf

    made = _made(5, 36)
    s = _symbols(spark, made)
    w = tfidf(term_counts(s, "id", "vocab_tf"), len(made))
    tight = clustering.shape_clusters(s, Config(theta_clone=0.8))
    cfg = Config(theta_family=0.3, theta_b_family=0.1)
    got = clustering.families(s, tight, w, cfg).collect()
    shape = {r[0]: {e["label"]: e["w"] for e in r[6]} for r in made}
    words = {}
    for r in w.collect():
        words.setdefault(r["id"], {})[r["term"]] = r["w"]
    of = {r["id"]: r["cluster"] for r in tight.collect()}
    units = {}
    for i in shape:
        u = units.setdefault(of.get(i, i), {"a": [], "b": [], "core": i in of, "parts": {}})
        u["a"].append(i)
        u["b"].append(i)
        u["parts"].setdefault(of.get(i, i), []).append(i)

    def mean(x, y, vec, side):
        return sum(_unit_cos(vec[i], vec[j]) for i in x[side] for j in y[side]) / (len(x[side]) * len(y[side]))

    while True:
        best = max(((round(m, 12), -i, -j) for i in units for j in units if i < j and (units[i]["core"] or units[j]["core"]) and (m := mean(units[i], units[j], shape, "a")) >= cfg.theta_family and mean(units[i], units[j], words, "b") >= cfg.theta_b_family), default=None)
        if best is None:
            break
        i, j = -best[1], -best[2]
        x, y = units[i], units.pop(j)
        x["a"] += y["a"]
        x["b"] = x["b"] + y["b"] if x["core"] and y["core"] else x["b"] if x["core"] else y["b"]
        x["core"] = True
        x["parts"] |= y["parts"]
    want = {i: u for i, u in units.items() if u["core"] and len(u["parts"]) > 1}
    assert {(r["family"], r["id"]) for r in got} == {(i, k) for i, u in want.items() for k in u["a"]} and want
    for f, u in want.items():
        sizes = sorted((len(p) for k, p in u["parts"].items() if k in of.values()), reverse=True)
        core = {r["id"] for r in got if r["family"] == f and r["is_core"]}
        assert len(core) == sizes[0] and core in [set(p) for p in u["parts"].values()]


def test_dense_ids_of_wide_rows(spark):
    """Rows wide enough that partitions are coalesced differently from those of the order columns alone."""
    from strata.operators.ids import dense_ids, rank_within
    from strata.runtime import Stage

    rows = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), F.array_repeat(F.md5(F.col("id").cast("string")), 40).alias("wide"))
    rows = Stage(spark, "wide").keep(rows.repartition(16), "rows")
    n = dense_ids(rows, "g", "k", name="n")
    got = n.agg(F.count("*").alias("c"), F.count_distinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert tuple(got) == (60_000, 60_000, 0, 59_999)
    first = n.where("n IN (0, 1, 59999)").orderBy("n").select("g", "k").collect()
    assert [tuple(r) for r in first] == [(0, 0), (0, 7), (6, 59_996 - 59_996 % 7 + 6 if 59_996 % 7 >= 6 else 59_996 - 59_996 % 7 - 1)]
    ranks = rank_within(rows, ["g"], "k", name="r").groupBy("g").agg(F.max("r").alias("m"), F.count_distinct("r").alias("d")).collect()
    assert all(r["m"] == r["d"] for r in ranks) and sum(r["m"] for r in ranks) == 60_000
    assert dense_ids(rows.limit(0), "g", "k").collect() == []
