import numpy as np
from pyspark.sql import functions as F

from strata.operators import geometry, graph, vectors


def frame(spark, x):
    return vectors.unit_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>"), "id", "v")


def test_knn_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(1).standard_normal((60, 8))
    got = {}
    for r in vectors.knn(frame(spark, x), 3).collect():
        got.setdefault(r["i"], {})[r["rank"]] = r["j"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    for i in range(60):
        assert [got[i][k] for k in (1, 2, 3)] == sorted(range(60), key=lambda j: (-s[i, j], j))[:3]


def test_ties_go_to_the_smaller_id(spark):
    v = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0, 0.0])], "id bigint, v array<double>")
    assert [r["id"] for r in vectors.top_k(v, [1.0, 0.0], 3).collect()] == [2, 5, 9]


def test_components_of_variance(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, (rng.standard_normal(1) * np.array([3.0, 0, 0, 0])).tolist()) for i in range(50)], "id bigint, v array<double>")
    comps, var, total, mean = vectors.principal_components(v, 4)
    assert np.allclose(comps[0], [1, 0, 0, 0]) and np.allclose(var[1:], 0) and abs(var.sum() - total) < 1e-9
    assert vectors.project(v, comps, mean).count() == 50


def test_layout_is_fixed_and_inside():
    rng = np.random.default_rng(3)
    seeds = rng.standard_normal((20, 2))
    edges = [(i, (i + 1) % 20, 0.5) for i in range(20)]
    a, b = geometry.layout(seeds, edges), geometry.layout(seeds, edges)
    assert (a == b).all() and a.min() >= 0 and a.max() <= 1
    assert geometry.layout(np.zeros((1, 2)), []).tolist() == [[0.5, 0.5]] and len(geometry.layout(np.zeros((0, 2)), [])) == 0
    p = geometry.relax(np.full((3, 2), 0.5), np.full(3, 0.01))
    d = np.linalg.norm(p[:, None] - p[None], axis=2)[np.triu_indices(3, 1)]
    assert d.min() > 0.015


def test_call_graph(spark):
    rows = [
        (1, "a.py", "f", 5, False, [{"base": "g", "module": None}, {"base": "C", "module": None}, {"base": "k", "module": "x.m"}]), (2, "a.py", "g", 5, False, []), (3, "b.py", "g", 5, False, []),
        (4, "b.py", "C.__init__", 5, False, [{"base": "__init__", "module": None}]), (5, "x/m.py", "k", 5, True, [{"base": "get", "module": None}]), (6, "y.py", "get", 5, False, []),
    ]
    s = spark.createDataFrame(rows, "id bigint, file string, qname string, node_count int, is_test boolean, calls array<struct<base:string,module:string>>")
    pairs = lambda df: {(r[0], r[1]) for r in df.collect()}
    assert pairs(graph.call_graph(s)) == {(1, 2), (1, 3), (1, 4), (1, 5), (5, 6)}
    assert pairs(graph.call_edges(s)) == {(1, 2), (1, 4), (1, 5)}
    assert {r["id"]: r["indeg"] for r in graph.in_degree(s, graph.call_edges(s)).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 6: 0}
    assert pairs(graph.related(graph.call_graph(s))) == {(1, 2), (1, 3), (1, 4), (1, 5), (5, 6), (1, 6)}
    links = {(r["src"], r["base"], r["dst"]) for r in graph.unique_links(s, graph.calls(s)).collect()}
    assert links == {(1, "g", 2), (1, "C", 4), (1, "k", 5)}
    assert graph.capped_callees(graph.call_graph(s), 2).where("src = 1").select("callees", "over").first() == ([2, 3], 2)


def test_labels(spark):
    p = spark.createDataFrame([(i, "d", 0.1 * (i % 2), 0.0) for i in range(4)] + [(9, "e", 0.0, 0.0)], "id bigint, g string, x double, y double")
    r = vectors.labels_by_dir(p, "g").collect()
    assert len(r) == 1 and r[0]["count"] == 4 and abs(r[0]["r"] - 0.1) < 1e-9
    assert vectors.labels_by_dir(p.where(F.lit(False)), "g").collect() == []


def test_neighbours_over_lists(spark):
    """Of the true neighbours at least nine in ten are found, and what is found is ranked as over all pairs."""
    from pyspark.sql import functions as F

    from strata.operators import vectors
    from strata.plans import vector_queries

    v = vector_queries.unit(spark, "/root/testdata/sf0.01")
    exact = vectors.knn(v, 8)
    near = vectors.knn_lists(v, 8)
    n = exact.count()
    assert exact.join(near, ["i", "j"]).count() >= 0.9 * n and near.count() <= n
    assert near.join(exact.withColumnRenamed("cos", "c"), ["i", "j"]).where(F.abs(F.col("cos") - F.col("c")) > 1e-8).count() == 0
    assert vectors.knn_lists(v.limit(0), 8).collect() == []
