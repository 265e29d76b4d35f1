"""The subpackage's queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import cooccurrence, distinctive, frequency, garbled, groups, leaks, shape_clusters, similar_sets, tokens, vectors
from strata.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "uf_parent", "id", "parent"), table(spark, d, "repeated_clusters", "members"))


SQL["p1_found"] = """
WITH RECURSIVE m AS (SELECT list_filter(members, lambda x: x IS NOT NULL) AS m FROM repeated_clusters),
l AS (SELECT id AS a, parent AS b FROM uf_parent
      UNION ALL SELECT list_min(m), unnest(m) FROM m WHERE len(m) > 1),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r(id, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
SELECT id AS sym_id, min(g) AS group_id FROM r GROUP BY id
"""


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.mark_terms(table(spark, d, "symbols", "id", "vocab_tf")).where("mark IS NOT NULL").select("term", "mark")


@query
def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.mark_terms(table(spark, d, "symbols", "id", "vocab_tf"))


@query
def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all n-grams of up to 3 words in the documents that occur at least twice."""
    words = table(spark, d, "documents", "text").select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1).alias("w"))
    return frequency.term_frequencies(words, "w", max_n=3).where("tf > 1")


@query
def p2_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all n-grams of up to 10 words in the commit messages, whether they repeat or not."""
    words = table(spark, d, "commits", "message").select(F.regexp_extract_all(F.lower("message"), F.lit("([a-z0-9]+)"), 1).alias("w"))
    return frequency.term_frequencies(words, "w", max_n=10)


_TERMS = r"""
t AS (SELECT id, lower(regexp_replace(k, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')) AS term, c
      FROM (SELECT DISTINCT ON (id) id, vocab_tf FROM symbols WHERE id IS NOT NULL ORDER BY id, scanned_at) s,
           LATERAL (SELECT unnest(map_keys(vocab_tf)) AS k, unnest(map_values(vocab_tf)) AS c) u WHERE c >= 1),
o AS (SELECT id, term, CAST(sum(c) AS BIGINT) AS tf FROM t GROUP BY id, term),
n AS (SELECT count(DISTINCT id) AS n FROM symbols),
f AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM o GROUP BY term),
m AS (SELECT term, tf, df, CASE WHEN df < 2 THEN 'rare' WHEN df > greatest(ceil(0.10 * n), 4) THEN 'common' END AS mark FROM f, n)
"""
SQL["p2_found"] = f"WITH {_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL"
SQL["p2_terms"] = f"WITH {_TERMS} SELECT term, tf, df, mark FROM m"
SQL["p2_ngrams"] = """
WITH d AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT r, unnest(w) AS term, 1 AS n FROM d
      UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM d WHERE len(w) > 1
      UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM d WHERE len(w) > 2)
SELECT term, CAST(n AS INT) AS n, count(*) AS tf, count(DISTINCT r) AS df FROM g GROUP BY term, n HAVING count(*) > 1
"""


SQL["p2_phrases"] = """
WITH d AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(message), '[a-z0-9]+') AS w FROM commits),
s AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, array_to_string(w[i:i + n - 1], ' ') AS term, n FROM s, range(1, 11) t(n) WHERE i + n - 1 <= len(w))
SELECT term, CAST(n AS INT) AS n, count(*) AS tf, count(DISTINCT r) AS df FROM g GROUP BY term, n
"""


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    w = distinctive.symbol_term_weights(table(spark, d, "symbols", "id", "vocab_tf"))
    return distinctive.top_terms(w, "id").select(F.col("id").alias("sym_id"), "term")


@query
def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    w = distinctive.symbol_term_weights(table(spark, d, "symbols", "id", "vocab_tf"))
    return w.select(F.col("id").alias("sym_id"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


@query
def p4_elite(spark: SparkSession, d: str) -> DataFrame:
    """Posterior probability that a symbol is elite for a term; checked against a plain fit in the tests."""
    w = distinctive.symbol_term_weights(table(spark, d, "symbols", "id", "vocab_tf"), mixture=True)
    return w.select(F.col("id").alias("sym_id"), "term", "tf", F.round("elite", 6).alias("elite"))


SQL["p4_found"] = f"""
WITH {_TERMS}, w AS (SELECT id, o.term, round(o.tf * ln(1 + n / f.df), 9) AS w FROM o JOIN f USING (term), n),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS k FROM w)
SELECT id AS sym_id, term FROM r WHERE k <= 3
"""
SQL["p4_weights"] = f"WITH {_TERMS} SELECT id AS sym_id, o.term, o.tf, f.df, round(round(o.tf * ln(1 + n / f.df), 9), 6) AS weight FROM o JOIN f USING (term), n"


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.cochanged_files(table(spark, d, "edits", "repo", "commit_id", "path"))
    return pairs.where(F.col("shared") * F.col("baskets") >= 3 * F.col("count_a") * F.col("count_b")).select(F.col("grp").alias("repo"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


@query
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.cochanged_files(table(spark, d, "edits", "repo", "commit_id", "path"))
    return pairs.select(
        F.col("grp").alias("repo"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "shared", "count_a", "count_b", "baskets",
        *(F.round(c, 9).alias(c) for c in ("confidence_ab", "confidence_ba", "lift", "conviction")),
    )


_PAIRS = r"""
e AS (SELECT DISTINCT repo, commit_id, regexp_replace(regexp_replace(regexp_replace(path, '\s+$', ''), '[\\/]+', '/', 'g'), '^(\./)+', '') AS path
      FROM edits WHERE repo IS NOT NULL AND commit_id IS NOT NULL),
b AS (SELECT repo, commit_id FROM e WHERE path <> '' GROUP BY repo, commit_id HAVING count(*) <= 30),
k AS (SELECT e.* FROM e JOIN b USING (repo, commit_id) WHERE path <> ''),
r AS (SELECT repo, path, count(*) AS r FROM k GROUP BY repo, path),
n AS (SELECT repo, count(*) AS n FROM b GROUP BY repo),
s AS (SELECT x.repo, x.path AS path_a, y.path AS path_b, count(*) AS shared FROM k x JOIN k y
      ON x.repo = y.repo AND x.commit_id = y.commit_id AND x.path < y.path GROUP BY ALL HAVING count(*) >= 5),
p AS (SELECT s.*, a.r AS count_a, c.r AS count_b, n AS baskets FROM s JOIN r a ON s.repo = a.repo AND path_a = a.path
      JOIN r c ON s.repo = c.repo AND path_b = c.path JOIN n ON s.repo = n.repo)
"""
SQL["p5_found"] = f"WITH {_PAIRS} SELECT repo, path_a, path_b FROM p WHERE shared * baskets >= 3 * count_a * count_b"
SQL["p5_pairs"] = f"""
WITH {_PAIRS} SELECT repo, path_a, path_b, shared, count_a, count_b, baskets, round(shared / count_a, 9) AS confidence_ab, round(shared / count_b, 9) AS confidence_ba,
round(shared * baskets / (CAST(count_a AS DOUBLE) * count_b), 9) AS lift,
CASE WHEN shared < count_a THEN round((1 - count_b / baskets) / (1 - shared / count_a), 9) END AS conviction FROM p
"""


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest_vectors(table(spark, d, "emb_cache", "vec_id", "v"))
    return near.select(F.least("q", "p").alias("a_id"), F.greatest("q", "p").alias("b_id")).distinct()


SQL["p6_found"] = """
WITH u AS (SELECT DISTINCT ON (vec_id) vec_id AS id, CAST(v AS DOUBLE[]) AS v FROM emb_cache
           WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS q, b.id AS p, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) AS c FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, p) AS k FROM s WHERE c >= 0.85)
SELECT DISTINCT least(q, p) AS a_id, greatest(q, p) AS b_id FROM r WHERE k <= 5
"""


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents", "doc_id", "text"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")).select("doc_id", "item_id")


@query
def p9_contained(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an item's passages: here a document is given up on a size class of which it holds too few."""
    found = leaks.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"), share=0.5)
    return found.select("doc_id", "item_id", "shared", F.round("share", 9).alias("share"))


@query
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    found = leaks.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("shared").alias("most_shared"))


_LEAKS = """
w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g')), '[a-z0-9]+') AS w FROM documents
      UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g')), '[a-z0-9]+') FROM eval_items),
g AS (SELECT DISTINCT k, id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM w WHERE len(w) >= 10),
l AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM g a JOIN g b USING (g) WHERE a.k = 'd' AND b.k = 'i' GROUP BY ALL)
"""
SQL["p9_found"] = f"WITH {_LEAKS} SELECT doc_id, item_id FROM l"
SQL["p9_contained"] = f"""
WITH {_LEAKS}, z AS (SELECT id AS item_id, count(*) AS size FROM g WHERE k = 'i' GROUP BY id)
SELECT doc_id, item_id, shared, round(shared / size, 9) AS share FROM l JOIN z USING (item_id) WHERE 2 * shared >= size
"""
SQL["p9_items"] = f"WITH {_LEAKS} SELECT item_id, count(*) AS docs, max(shared) AS most_shared FROM l GROUP BY item_id"


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_sets.similar_symbols(table(spark, d, "symbols", "id", "wl")).pairs()


@query
def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with its group of near-duplicates and its number of links."""
    return similar_sets.similar_symbols(table(spark, d, "symbols", "id", "wl")).groups()


_SETS = """
s AS (SELECT DISTINCT id, list_sort(list_distinct(list_filter(list_transform(wl, lambda e: e.label), lambda x: x IS NOT NULL))) AS s FROM symbols WHERE id IS NOT NULL AND wl IS NOT NULL),
l AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS na, b.n AS nb, count(*) AS o FROM l a JOIN l b ON a.t = b.t AND a.id < b.id GROUP BY ALL),
p AS (SELECT a_id, b_id FROM o WHERE 4 * o >= 3 * (na + nb - o))
"""
SQL["p7_found"] = f"WITH {_SETS} SELECT a_id, b_id FROM p"
SQL["p7_groups"] = f"""
WITH RECURSIVE {_SETS}, e AS (SELECT a_id AS a, b_id AS b FROM p UNION ALL SELECT b_id, a_id FROM p),
r(id, g) AS (SELECT id, id FROM s WHERE len(s) > 0 UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
SELECT r.id, min(g) AS group_id, any_value(coalesce(c, 0)) AS links FROM r LEFT JOIN (SELECT a, count(*) AS c FROM e GROUP BY a) k ON k.a = r.id GROUP BY r.id
"""


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = shape_clusters.ShapeClusters(table(spark, d, "symbols", "id", "wl")).clusters()
    return found.select(F.col("id").alias("sym_id"), "cluster_id")


@query
def p3_typical(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's size and its three most typical members, as a list of ids."""
    return shape_clusters.ShapeClusters(table(spark, d, "symbols", "id", "wl")).typical()


_SHAPES = """
v AS (SELECT id, e.label AS t, sum(coalesce(e.w, 0)) AS w FROM (SELECT id, unnest(wl) AS e FROM
      (SELECT DISTINCT ON (id) id, wl FROM symbols WHERE id IS NOT NULL AND wl IS NOT NULL ORDER BY id, scanned_at)) WHERE e.label IS NOT NULL GROUP BY id, e.label),
n AS (SELECT id, sum(w * w) AS n FROM v GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) / sqrt(any_value(x.n) * any_value(y.n)) AS c
      FROM v a JOIN v b ON a.t = b.t AND a.id < b.id JOIN n x ON a.id = x.id JOIN n y ON b.id = y.id WHERE x.n > 0 AND y.n > 0 GROUP BY ALL),
e AS (SELECT a, b, c FROM c WHERE c >= 0.60 - 1e-12 UNION ALL SELECT b, a, c FROM c WHERE c >= 0.60 - 1e-12),
r(id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id),
k AS (SELECT id AS sym_id, min(g) AS cluster_id FROM r GROUP BY id)
"""
SQL["p3_found"] = f"WITH RECURSIVE {_SHAPES} SELECT sym_id, cluster_id FROM k"
SQL["p3_typical"] = f"""
WITH RECURSIVE {_SHAPES}, s AS (SELECT a AS sym_id, round(sum(c), 9) AS s FROM e GROUP BY a),
o AS (SELECT k.*, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, sym_id) AS r FROM k JOIN s USING (sym_id))
SELECT cluster_id, count(*) AS size, list(sym_id ORDER BY r) FILTER (WHERE r <= 3) AS typical FROM o GROUP BY cluster_id
"""


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_texts(table(spark, d, "documents", "doc_id", "source", "text")).select("doc_id").distinct()


@query
def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with the cipher found and the text read back; checked by garbling texts in the tests."""
    return garbled.garbled_texts(table(spark, d, "documents", "doc_id", "source", "text")).select("doc_id", "cipher", "restored")
