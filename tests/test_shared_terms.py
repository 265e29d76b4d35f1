from __future__ import annotations

from strata.operators import similarity


def test_top_shared_where_pairs_are_found(spark, monkeypatch):
    """The same rows as a join of pairs and terms gives, ties by term included, and no exchange of pairs."""
    from strata.operators import postings

    monkeypatch.setattr(postings, "LINKS", 7)
    tf = spark.createDataFrame([(i, t, 1 + (i * k) % 3) for i in range(30) for k, t in enumerate(["b", "a", "d", f"c{i % 3}", f"x{i % 4}", f"y{i // 3}", f"z{i // 3}"])], "id bigint, term string, tf bigint")
    w = similarity.tfidf(tf, 30)
    got = similarity.similar_top_shared(w, 30, 0.2, 3)
    want = similarity.top_shared(similarity.shared_terms(similarity.similar_pairs(w, 30, 0.2), w), 3).select("a", "b", "term", "w", "rank")
    rows = lambda df: sorted((r["a"], r["b"], r["rank"], r["term"], round(r["w"], 9)) for r in df.collect())
    assert rows(got) == rows(want) and rows(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Window" not in plan[: plan.index("MapInArrow")]
