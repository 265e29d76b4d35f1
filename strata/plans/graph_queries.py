"""Calls between symbols, names, spans and branch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import AMBIENT_NAMES, Config
from strata.functions.paths import dir_of
from strata.functions.text import base_name
from strata.operators import align, graph
from strata.operators.ids import dense_ids
from strata.operators.postings import label_vectors
from strata.operators.similarity import pair_cosines
from strata.plans.inputs import SYM, symbols
from strata.plans.registry import query
from strata.plans.shape_queries import _ALL_CALLS, _CALLS
from strata.runtime import Stage
from strata.sources import python_code
from strata.sources.tables import table

# The tables' calls name things by the lower-case first part of a qualified name; this binding gives the symbols such names.
_CSYM = """sym AS (SELECT * EXCLUDE (qname), lower(string_split(qname, '.')[1]) AS qname FROM symbols WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at) = 1)"""


def callable_symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d, *_COLS).withColumn("qname", F.lower(F.substring_index("qname", ".", 1)))


_COLS = ("file", "qname", "line", "span", "node_count", "is_test", "calls", "merkle_root")
_AMB = ", ".join(f"'{n}'" for n in AMBIENT_NAMES)
_DIR = "CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END"
_EDGES = f"""{_CSYM}, {_CALLS},
nc AS (SELECT name, count(*) AS n FROM nm GROUP BY name),
cq AS (SELECT * FROM cl WHERE NOT (starts_with(base, '__') AND ends_with(base, '__'))),
ce AS (SELECT DISTINCT src, dst FROM (
  SELECT src, nm.id AS dst FROM cq JOIN nm ON nm.name = cq.base JOIN nc ON nc.name = cq.base WHERE module IS NULL AND (cq.file = nm.file OR (n < 2 AND cq.base NOT IN ({_AMB})))
  UNION ALL SELECT src, nm.id FROM cq JOIN md USING (module) JOIN nm ON nm.name = cq.base AND nm.file = md.file) WHERE src <> dst),
rs AS (SELECT id FROM sym WHERE NOT coalesce(is_test, false)),
ig AS (SELECT rs.id, count(DISTINCT src) AS indeg FROM rs LEFT JOIN (SELECT src, dst FROM ce JOIN rs ON rs.id = src) e ON e.dst = rs.id GROUP BY rs.id)"""


@query(f"WITH {_CSYM}, {_CALLS} SELECT src, dst FROM cg")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_graph(callable_symbols(spark, d))


@query(f"WITH {_CSYM}, {_CALLS} SELECT src, dst FROM th")
def call_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hops(callable_symbols(spark, d))


@query(f"WITH {SYM}, {_ALL_CALLS} SELECT a, b FROM rl")
def call_related(spark: SparkSession, d: str) -> DataFrame:
    """A call names a symbol by its base name, its class or the lower-case first part of its qualified name."""
    return graph.related_calls(symbols(spark, d, *_COLS), first_part=True)


@query(f"WITH {_EDGES} SELECT src, dst FROM ce")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_edges(callable_symbols(spark, d))


@query(f"WITH {_EDGES} SELECT name, n FROM nc")
def name_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.names(callable_symbols(spark, d)).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES} SELECT id, indeg FROM ig")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    s = callable_symbols(spark, d)
    return graph.in_degree(s, graph.call_edges(s))


@query(f"""
WITH {_EDGES}, r AS (SELECT {_DIR} AS dir, id, indeg, row_number() OVER (PARTITION BY {_DIR} ORDER BY indeg DESC, node_count DESC, id) AS r FROM ig JOIN sym USING (id) WHERE indeg > 0)
SELECT dir, id, indeg FROM r WHERE r = 1
""")
def entry_per_dir(spark: SparkSession, d: str) -> DataFrame:
    s = callable_symbols(spark, d)
    return graph.entry_points(s, graph.in_degree(s, graph.call_edges(s)))


@query(f"WITH {_CSYM}, {_CALLS} SELECT src, (list(dst ORDER BY dst))[1:8] AS callees, CAST(greatest(count(*) - 8, 0) AS BIGINT) AS over FROM cg GROUP BY src")
def capped_lists(spark: SparkSession, d: str) -> DataFrame:
    return graph.capped_callees(graph.call_graph(callable_symbols(spark, d)), 8).withColumn("over", F.col("over").cast("bigint"))


@query(f"""
WITH {_CSYM}, {_CALLS},
ev AS (SELECT DISTINCT cl.src, cl.base, nm.id AS dst, 1 AS tier FROM cl JOIN md USING (module) JOIN nm ON nm.name = cl.base AND nm.file = md.file
  UNION SELECT src, base, nm.id, CASE WHEN cl.file = nm.file THEN 2 ELSE 3 END FROM cl JOIN nm ON nm.name = cl.base WHERE module IS NULL AND (cl.file = nm.file OR cl.base NOT IN ({_AMB}))),
g AS (SELECT src, base, tier, count(*) AS n, min(dst) AS dst FROM ev GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY src, base ORDER BY tier) AS r FROM g)
SELECT src, base, dst FROM b WHERE r = 1 AND n = 1 AND src <> dst
""")
def unique_link(spark: SparkSession, d: str) -> DataFrame:
    s = callable_symbols(spark, d)
    return graph.unique_links(s, graph.calls(s))


@query(f"""
WITH {SYM}, p AS (SELECT id AS probe, file, line + 3 AS l FROM sym WHERE file IS NOT NULL),
w AS (SELECT id, file, line, line + CAST(floor((span.e - span.s) / 40) AS INT) AS last FROM sym),
c AS (SELECT probe, id, row_number() OVER (PARTITION BY probe ORDER BY last - line, id) AS r FROM p JOIN w ON w.file = p.file AND w.line <= l AND l <= last)
SELECT probe, id FROM c WHERE r = 1
""")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    """The innermost symbol around a line of its file: an interval join on the file, the shortest interval wins."""
    s = symbols(spark, d, *_COLS).where("file IS NOT NULL")
    p = s.select(F.col("id").alias("probe"), "file", (F.col("line") + 3).alias("l"))
    w = s.select("id", "file", "line", (F.col("line") + F.floor((F.col("span.e") - F.col("span.s")) / 40).cast("int")).alias("last"))
    return graph.innermost(p, w)


@query(f"WITH {SYM} SELECT x.id AS a, y.id AS b FROM sym x JOIN sym y ON x.file = y.file AND x.span.s = y.span.s AND x.span.e = y.span.e AND x.id < y.id")
def span_equi_join(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d, "file", "span").select("id", "file", F.col("span.s").alias("s"), F.col("span.e").alias("e"))
    return s.withColumnRenamed("id", "a").join(s.withColumnRenamed("id", "b"), ["file", "s", "e"]).where("a < b").select("a", "b")


@query(f"""
WITH {SYM}, t AS (SELECT id, file, line, node_count, coalesce(is_test, false) AS tst,
  CASE WHEN qname = 'self_data' THEN 1 WHEN ends_with(qname, '.self_data') THEN 2 WHEN contains(lower(qname), 'self_data') THEN 3 END AS tier FROM sym),
m AS (SELECT *, min(tier) OVER () AS best, count(*) FILTER (WHERE tier IS NOT NULL) OVER (PARTITION BY tier) AS n FROM t WHERE tier IS NOT NULL)
SELECT id, CAST(tier AS INT) AS tier, n > 1 AS ambiguous, n FROM m WHERE tier = best ORDER BY tst, node_count DESC, file, line, id LIMIT 12
""")
def resolve_symbol(spark: SparkSession, d: str) -> DataFrame:
    """A name resolved by tiers (exact, dotted suffix, substring); the first that matches decides; the first 12 candidates."""
    from strata.plans.explain import resolve_name

    return resolve_name(symbols(spark, d, *_COLS), "self_data")


@query(f"""
WITH {SYM}, a AS (SELECT max(dating.last_touched) AS anchor FROM sym),
ch AS (SELECT DISTINCT file FROM sym, a WHERE dating.last_touched >= anchor - 365 * 86400), base AS (SELECT DISTINCT merkle_root FROM sym, a WHERE dating.first_seen < anchor - 365 * 86400)
SELECT s.id FROM sym s SEMI JOIN ch ON ch.file = s.file ANTI JOIN base ON base.merkle_root = s.merkle_root
""")
def branch_new(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of files touched in the last 365 days whose structural hash no symbol had before: the base of a branch that began then."""
    s = symbols(spark, d, "file", "merkle_root", "dating")
    start = s.agg(F.max("dating.last_touched")).first()[0]
    start = F.lit(None if start is None else start - 365 * 86400)
    changed = s.where(F.col("dating.last_touched") >= start).select("file").distinct()
    base = s.where(F.col("dating.first_seen") < start).select("merkle_root").distinct()
    return s.join(changed, "file", "left_semi").join(base, "merkle_root", "left_anti").select("id")


@query(f"""
WITH {SYM}, f AS (SELECT {_DIR} AS dir, file, id, qname FROM sym WHERE file IS NOT NULL)
SELECT dir, count(DISTINCT file) AS files, count(DISTINCT file) FILTER (WHERE string_split(qname, '.')[-1] = '__init__') AS init_files, count(*) AS symbols FROM f GROUP BY dir
""")
def prevalence(spark: SparkSession, d: str) -> DataFrame:
    """By folder: files, files that hold an ``__init__``, and symbols."""
    f = symbols(spark, d, "file", "qname").where("file IS NOT NULL").withColumn("dir", dir_of(F.col("file")))
    init = F.when(base_name(F.col("qname")) == "__init__", F.col("file"))
    return f.groupBy("dir").agg(F.count_distinct("file").alias("files"), F.count_distinct(init).alias("init_files"), F.count("*").alias("symbols"))


@query(f"""
WITH {_EDGES}, k AS (SELECT id, count(*) OVER (PARTITION BY merkle_root) - 1 AS copies FROM sym)
SELECT s.id, copies, coalesce(indeg, 0) AS callers, (SELECT count(*) FROM ce WHERE ce.src = s.id) AS callees,
  CAST(coalesce(n, 0) AS BIGINT) AS same_name FROM sym s JOIN k USING (id) LEFT JOIN ig USING (id) LEFT JOIN nc ON nc.name = string_split(s.qname, '.')[-1]
""")
def symbol_card(spark: SparkSession, d: str) -> DataFrame:
    """For each symbol the figures of its card: exact copies, callers, callees, symbols of its name."""
    s = callable_symbols(spark, d)
    e = graph.call_edges(s)
    copies = s.groupBy("merkle_root").agg((F.count("*") - 1).alias("copies"))
    c = s.select("id", "merkle_root").join(copies, "merkle_root").select("id", "copies")
    callees = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    names = graph.names(s).groupBy("name").agg(F.count("*").alias("same_name"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    rows = s.select("id", base_name(F.col("qname")).alias("name")).join(c, "id", "left").join(graph.in_degree(s, e).withColumnRenamed("indeg", "callers"), "id", "left").join(callees, "id", "left").join(names, "name", "left")
    return rows.select("id", zero("copies"), zero("callers"), zero("callees"), zero("same_name"))


@query("""
SELECT id, who FROM (SELECT sym_id AS id, 'cached' AS who FROM emb_cache WHERE sym_id IS NOT NULL UNION SELECT id, 'missing' FROM (SELECT DISTINCT id FROM symbols WHERE id IS NOT NULL) s WHERE id NOT IN (SELECT sym_id FROM emb_cache WHERE sym_id IS NOT NULL AND v IS NOT NULL AND len(v) = 64))
""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with a cached vector, and those without one of the right width."""
    c = table(spark, d, "emb_cache", "sym_id", "v").where("sym_id IS NOT NULL")
    good = c.where(F.size("v") == 64).select(F.col("sym_id").alias("id")).distinct()
    missing = symbols(spark, d).select("id").join(good, "id", "left_anti").select("id", F.lit("missing").alias("who"))
    return c.select(F.col("sym_id").alias("id"), F.lit("cached").alias("who")).distinct().unionByName(missing)


def _source_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The functions in the documents that are source files, with their trees; (id, doc_id, at) numbers them by document and place."""
    docs = table(spark, d, "documents", "doc_id", "text", "kind").where("kind = 'source' AND text IS NOT NULL")
    files = docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.encode("text", "UTF-8").alias("content"))
    found = python_code.scan_symbols(files, Config(min_nodes=1)).withColumn("doc_id", F.regexp_extract("file", r"(\d+)\.py$", 1).cast("bigint")).withColumn("at", F.col("span.s"))
    return dense_ids(found, "doc_id", "at")


@query()
def source_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Functions of source documents with their sizes, calls and vocabulary; made trees are checked in the tests."""
    s = _source_symbols(spark, d)
    return s.select("id", "doc_id", "qname", "line", "last_line", "node_count", F.size("calls").alias("calls"), F.size("vocab_tf").alias("terms"), F.size("wl").alias("labels"))


@query()
def stmt_align(spark: SparkSession, d: str) -> DataFrame:
    """Which parts of neighbouring functions of a source document correspond; known cases are checked in the tests."""
    s = Stage(spark, "align").keep(_source_symbols(spark, d), "symbols")
    pairs = s.select(F.col("id").alias("a"), "doc_id", (F.col("id") + 1).alias("b")).join(s.select(F.col("id").alias("b"), F.col("doc_id").alias("same")), "b").where("doc_id = same").select("a", "b")
    scored = pair_cosines(pairs, label_vectors(s))
    return align.align_pairs(align.sides(scored, s))
