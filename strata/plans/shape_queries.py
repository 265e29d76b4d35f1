"""Repeated shapes, similar vocabularies, clusters and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.config import LOW_SIGNAL_TERMS, Config
from strata.functions.dates import classify, fmt_date
from strata.operators import clustering, graph
from strata.operators import similarity as sim
from strata.operators.components import components
from strata.operators.ids import dense_ids
from strata.plans.inputs import HIST, PAIRS, SYM, TF, TFIDF, symbol_count, symbol_tf, symbol_weights, symbols
from strata.plans.registry import query
from strata.runtime import Stage
from strata.sources.tables import table

CFG = Config()
_SHAPE = ("file", "line", "span", "node_count", "merkle_root", "wl", "minhash", "is_test", "dating")

_CLONES = f"""{SYM},
g AS (SELECT *, min(id) OVER (PARTITION BY merkle_root) AS cluster, count(*) OVER (PARTITION BY merkle_root) AS k FROM sym WHERE merkle_root IS NOT NULL),
m AS (SELECT * FROM g WHERE k > 1),
rep AS (SELECT cluster, (list(id ORDER BY file, line, id))[1] AS first, count(*) AS size, count(DISTINCT file) AS n_files, CAST(sum(node_count) AS BIGINT) AS total_nodes, bool_and(coalesce(is_test, false)) AS all_test,
        min(dating.first_seen) AS first_seen, max(dating.last_touched) AS last_touched, max(dating.first_seen) AS newest_birth FROM m GROUP BY cluster)"""


@query(f"WITH {_CLONES} SELECT cluster, first, size, n_files, total_nodes, all_test FROM rep")
def exact_clones(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d, *_SHAPE)
    return clustering.repeated(s, clustering.clone_clusters(s)).select("cluster", "first", "size", "n_files", "total_nodes", "all_test")


@query(f"WITH {_CLONES} SELECT id, cluster FROM m")
def clone_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of ``exact_clones``, a row each."""
    return clustering.clone_clusters(symbols(spark, d, "merkle_root"))


@query(f"""
WITH {_CLONES}, a AS (SELECT max(dating.last_touched) AS anchor FROM sym)
SELECT 'R' || row_number() OVER (ORDER BY n_files > 1 DESC, NOT all_test DESC, total_nodes DESC, first) AS ref, cluster, strftime(make_timestamp(first_seen * 1000000), '%Y-%m-%d') AS first_day,
  strftime(make_timestamp(last_touched * 1000000), '%Y-%m-%d') AS last_day,
  CASE WHEN last_touched IS NULL OR newest_birth IS NULL THEN NULL WHEN anchor - last_touched > 180 * 86400 THEN 'dead' WHEN anchor - newest_birth <= 90 * 86400 THEN 'growing' ELSE 'flat' END AS activity FROM rep, a
""")
def repeated_dated(spark: SparkSession, d: str) -> DataFrame:
    """Clusters in report order with a positional ref, their dates and their activity. The order is over clusters, not symbols."""
    s = symbols(spark, d, *_SHAPE)
    r = clustering.repeated(s, clustering.clone_clusters(s))
    anchor = F.lit(s.agg(F.max("dating.last_touched")).first()[0])
    keyed = r.withColumns({"k1": F.col("n_files") <= 1, "k2": F.col("all_test"), "k3": -F.col("total_nodes"), "k4": F.col("first")})
    return dense_ids(keyed, "k1", "k2", "k3", "k4", name="n").select(F.concat(F.lit("R"), F.col("n") + 1).alias("ref"), "cluster", fmt_date(F.col("first_seen")).alias("first_day"), fmt_date(F.col("last_touched")).alias("last_day"), classify(anchor, F.col("newest_birth"), F.col("last_touched")).alias("activity"))


@query(f"WITH {TF} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return sim.document_frequency(symbol_tf(spark, d))


@query(f"WITH {TFIDF} SELECT id, term, tf, df, round(w, 9) AS w FROM w")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return symbol_weights(spark, d).withColumn("w", F.round("w", 9))


@query(f"WITH {PAIRS} SELECT a, b, round(cos, 9) AS cos FROM pair")
def vocab_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sim.similar_pairs(symbol_weights(spark, d), symbol_count(spark, d), CFG.theta_b).select("a", "b", F.round("cos", 9).alias("cos"))


@query(f"""
WITH {PAIRS}, s AS (SELECT a, b, x.term, least(x.w, y.w) AS w FROM pair JOIN w x ON x.id = a JOIN w y ON y.id = b AND y.term = x.term)
SELECT a, b, term, round(w, 9) AS w, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(w, 9) DESC, term) AS r FROM s) WHERE r <= 3
""")
def shared_terms_topk(spark: SparkSession, d: str) -> DataFrame:
    w = symbol_weights(spark, d)
    return sim.similar_top_shared(w, symbol_count(spark, d), CFG.theta_b, 3).select("a", "b", "term", F.round("w", 9).alias("w"), "rank")


_LOW = ", ".join(f"'{t}'" for t in LOW_SIGNAL_TERMS)
_CALLS = r"""
nm AS (SELECT string_split(qname, '.')[-1] AS name, id, file FROM sym UNION ALL SELECT regexp_replace(qname, '\.__init__$', ''), id, file FROM sym WHERE ends_with(qname, '.__init__')),
cl AS (SELECT DISTINCT id AS src, file, c.base AS base, c.module AS module FROM (SELECT id, file, unnest(calls) AS c FROM sym) WHERE c.base IS NOT NULL),
fp AS (SELECT DISTINCT file, string_split(regexp_replace(file, '\.py$', ''), '/') AS m FROM sym WHERE file IS NOT NULL),
fq AS (SELECT file, CASE WHEN m[-1] = '__init__' THEN m[:-2] ELSE m END AS m FROM fp),
md AS (SELECT file, unnest(list_transform(range(1, len(m) + 1), lambda i: array_to_string(m[i:], '.'))) AS module FROM fq),
cg AS (SELECT DISTINCT src, dst FROM (SELECT src, nm.id AS dst FROM cl JOIN nm ON nm.name = cl.base WHERE module IS NULL
       UNION ALL SELECT src, nm.id FROM cl JOIN md USING (module) JOIN nm ON nm.name = cl.base AND nm.file = md.file) WHERE src <> dst),
th AS (SELECT src, dst FROM cg UNION SELECT x.src, y.dst FROM cg x JOIN cg y ON x.dst = y.src WHERE x.src <> y.dst),
rl AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM th)"""
# Every name that a call may use: those of ``nm``, and the lower-case first part by which the tables' calls name things.
_ALL_CALLS = _CALLS.replace("ends_with(qname, '.__init__')),", "ends_with(qname, '.__init__') UNION ALL SELECT lower(string_split(qname, '.')[1]), id, file FROM sym),", 1)
_FIRST_CALLS = _CALLS.replace("qname", "lower(string_split(qname, '.')[1])")
_STAGES = f"""{PAIRS}, {HIST}, {_FIRST_CALLS},
tc AS (SELECT id, count(*) AS terms, sum(w) AS mass FROM w GROUP BY id),
i AS (SELECT sym.id, file, coalesce(is_test, false) AS is_test, terms, mass FROM sym LEFT JOIN tc ON tc.id = sym.id),
cx AS (SELECT pair.* FROM pair JOIN i x ON x.id = a JOIN i y ON y.id = b WHERE NOT x.is_test AND NOT y.is_test AND x.file <> y.file AND x.terms >= 5 AND y.terms >= 5),
ac AS (SELECT a, b, sum(x.w * y.w) / sqrt(any_value(p.n) * any_value(q.n)) AS c FROM cx JOIN lw x ON x.id = a JOIN lw y ON y.id = b AND y.label = x.label JOIN ln2 p ON p.id = a JOIN ln2 q ON q.id = b GROUP BY a, b),
lo AS (SELECT cx.a, cx.b, cos, coalesce(c, 0) AS a_cos FROM cx LEFT JOIN ac ON ac.a = cx.a AND ac.b = cx.b WHERE coalesce(c, 0) <= 0.30),
sh AS (SELECT lo.a, lo.b, count(*) AS n_shared, sum(least(x.w, y.w)) AS s, bool_or(x.term NOT IN ({_LOW})) AS signal FROM lo JOIN w x ON x.id = lo.a JOIN w y ON y.id = lo.b AND y.term = x.term GROUP BY lo.a, lo.b),
vq AS (SELECT lo.*, n_shared, s / least(x.mass, y.mass) AS share FROM lo JOIN sh USING (a, b) JOIN tc x ON x.id = a JOIN tc y ON y.id = b WHERE n_shared >= 3 AND signal AND s / least(x.mass, y.mass) >= 0.30),
kp AS (SELECT vq.* FROM vq ANTI JOIN rl ON rl.a = vq.a AND rl.b = vq.b)"""
_FUNNEL = _STAGES.replace(_FIRST_CALLS, _ALL_CALLS)


def _stages(spark: SparkSession, d: str, least: int = 5) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    s = symbols(spark, d, "file", "qname", "is_test", "wl", "calls")
    w = Stage(spark, "competing").keep(symbol_weights(spark, d), "weights")
    named = s.withColumn("qname", F.lower(F.substring_index("qname", ".", 1)))
    return clustering.competing_stages(s, w, symbol_count(spark, d), graph.call_groups(named) if least > 4 else None, CFG, least), w, s


@query(f"WITH {_STAGES} SELECT a, b, round(cos, 9) AS cos, round(a_cos, 9) AS a_cos, n_shared, round(share, 9) AS share FROM vq")
def vocab_quality_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _stages(spark, d, 4)[0]["vocab_quality"]
    return v.select("a", "b", F.round("cos", 9).alias("cos"), F.round("a_cos", 9).alias("a_cos"), "n_shared", F.round("share", 9).alias("share"))


@query(f"WITH {_STAGES} SELECT a, b, round(cos, 9) AS cos FROM kp")
def call_related_anti(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d)[0]["kept"].select("a", "b", F.round("cos", 9).alias("cos"))


@query(f"""
WITH {_FUNNEL} SELECT 'vocab_pairs' AS stage, count(*) AS pairs FROM pair UNION ALL SELECT 'cross_context', count(*) FROM cx UNION ALL SELECT 'low_shape', count(*) FROM lo
UNION ALL SELECT 'vocab_quality', count(*) FROM vq UNION ALL SELECT 'kept', count(*) FROM kp
""")
def competing_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs pass each stage; a call names a symbol as in ``call_related``."""
    s = symbols(spark, d, "file", "qname", "is_test", "wl", "calls")
    stage = Stage(spark, "competing")
    return clustering.funnel(clustering.competing_pairs(s, stage.keep(symbol_weights(spark, d), "weights"), symbol_count(spark, d), graph.call_groups(s, first_part=True), CFG))


@query()
def competing_groups(spark: SparkSession, d: str) -> DataFrame:
    """Best-first groups of competing symbols; SQL cannot state the merge, a plain merge in the tests does."""
    stages, w, s = _stages(spark, d)
    return clustering.competing_groups(stages["kept"], s, w, CFG).select("cluster", "members", F.round("b_max", 9).alias("b_max"), F.round("a_at_best", 9).alias("a_at_best"), "terms")


_CENTROID = f"""{TFIDF},
cl AS (SELECT id, min(id) OVER (PARTITION BY merkle_root) AS cluster, count(*) OVER (PARTITION BY merkle_root) AS k FROM sym WHERE merkle_root IS NOT NULL),
cm AS (SELECT id, cluster, k FROM cl WHERE k > 1),
cr AS (SELECT cluster, term, sum(w) / any_value(k) AS m FROM cm JOIN w USING (id) GROUP BY cluster, term),
ce AS (SELECT cluster, term, m / sqrt(sum(m * m) OVER (PARTITION BY cluster)) AS w FROM cr)"""


@query(f"WITH {_CENTROID} SELECT cluster, term, round(w, 9) AS w FROM ce")
def cluster_centroid_terms(spark: SparkSession, d: str) -> DataFrame:
    c = clustering.clone_clusters(symbols(spark, d, "merkle_root"))
    return clustering.cluster_centroids(c, symbol_weights(spark, d)).withColumn("w", F.round("w", 9))


@query(f"""
WITH {_CENTROID}, a AS (SELECT max(dating.last_touched) AS anchor FROM sym),
ds AS (SELECT cluster, bool_and(coalesce(is_test, false)) AS all_test, max(dating.last_touched) AS lt, max(dating.first_seen) AS nb FROM cm JOIN sym USING (id) GROUP BY cluster),
ck AS (SELECT cluster, CASE WHEN anchor - lt > 180 * 86400 THEN 'dead' WHEN anchor - nb <= 400 * 86400 THEN 'growing' END AS act FROM ds, a WHERE NOT all_test AND lt IS NOT NULL)
SELECT x.cluster AS dead, y.cluster AS growing, round(sum(x.w * y.w), 9) AS cos, (list(x.term ORDER BY round(least(x.w, y.w), 9) DESC, x.term))[1:8] AS terms FROM ce x JOIN ck p ON p.cluster = x.cluster AND p.act = 'dead'
JOIN ce y ON y.term = x.term JOIN ck q ON q.cluster = y.cluster AND q.act = 'growing' GROUP BY ALL HAVING sum(x.w * y.w) >= 0.10
""")
def deprecated_twins(spark: SparkSession, d: str) -> DataFrame:
    """Dead clusters and younger ones of like vocabulary; the bounds are widened to 400 days and 0.10, as these tables hold no closer twins."""
    s = symbols(spark, d, *_SHAPE)
    c = clustering.clone_clusters(s)
    summary = clustering.repeated(s, c)
    anchor = s.agg(F.max("dating.last_touched")).first()[0]
    shifted = summary.withColumn("newest_birth", F.when(F.lit(anchor) - F.col("newest_birth") <= 400 * 86400, F.lit(anchor)).otherwise(F.col("newest_birth")))
    return clustering.deprecated(shifted, clustering.cluster_centroids(c, symbol_weights(spark, d)), anchor, 0.10).withColumn("cos", F.round("cos", 9))


_BANDS = f"""{SYM},
bd AS (SELECT id, r.b AS band, minhash[2 * r.b + 1] || '|' || minhash[2 * r.b + 2] AS key FROM sym, range(32) r(b) WHERE minhash IS NOT NULL AND len(minhash) >= 2 * r.b + 2),
bk AS (SELECT band, key, count(*) AS size FROM bd GROUP BY band, key),
cd AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key AND x.id < y.id JOIN bk ON bk.band = x.band AND bk.key = x.key WHERE size BETWEEN 2 AND 200)"""
_NEAR = f"""{_BANDS}, {HIST},
ok AS (SELECT a, b FROM cd JOIN sym x ON x.id = a JOIN sym y ON y.id = b WHERE least(x.node_count, y.node_count) / greatest(x.node_count, y.node_count) >= 0.5
       AND NOT (x.file = y.file AND ((x.span.s <= y.span.s AND y.span.e <= x.span.e) OR (y.span.s <= x.span.s AND x.span.e <= y.span.e)))),
nr AS (SELECT a, b, sum(x.w * y.w) / sqrt(any_value(p.n) * any_value(q.n)) AS cos FROM ok JOIN lw x ON x.id = a JOIN lw y ON y.id = b AND y.label = x.label JOIN ln2 p ON p.id = a JOIN ln2 q ON q.id = b GROUP BY a, b),
np AS (SELECT * FROM nr WHERE cos >= 0.60 - 1e-12)"""


@query(f"WITH {_BANDS} SELECT a, b FROM cd")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return sim.lsh_candidates(sim.lsh_bands(symbols(spark, d, "minhash").where("minhash IS NOT NULL"), "id", "minhash"))


@query(f"WITH {_BANDS} SELECT CAST(band AS INT) AS band, count(*) AS buckets, count(*) FILTER (WHERE size BETWEEN 2 AND 200) AS used, count(*) FILTER (WHERE size > 200) AS oversized FROM bk GROUP BY band")
def lsh_bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    b = sim.lsh_buckets(sim.lsh_bands(symbols(spark, d, "minhash").where("minhash IS NOT NULL"), "id", "minhash"))
    return b.groupBy("band").agg(F.count("*").alias("buckets"), F.count_if(F.col("size").between(2, 200)).alias("used"), F.count_if(F.col("size") > 200).alias("oversized"))


_ALL_NEAR = f"""{SYM}, {HIST},
pc AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) / sqrt(any_value(p.n) * any_value(q.n)) AS cos FROM lw x JOIN lw y ON x.label = y.label AND x.id < y.id JOIN ln2 p ON p.id = x.id JOIN ln2 q ON q.id = y.id GROUP BY x.id, y.id),
ea AS (SELECT a, b, cos FROM pc JOIN sym x ON x.id = a JOIN sym y ON y.id = b WHERE cos >= 0.60 - 1e-12 AND least(x.node_count, y.node_count) / greatest(x.node_count, y.node_count) >= 0.5
       AND NOT (x.file = y.file AND ((x.span.s <= y.span.s AND y.span.e <= x.span.e) OR (y.span.s <= x.span.s AND x.span.e <= y.span.e))))"""


@query(f"WITH {_ALL_NEAR} SELECT a, b, round(cos, 9) AS cos FROM ea")
def near_pairs_exact(spark: SparkSession, d: str) -> DataFrame:
    """The near pairs without signatures or buckets: every pair of like size, not nested, with a cosine of 0.60 or more."""
    return sim.near_pairs_exact(symbols(spark, d, *_SHAPE), CFG.theta_clone).withColumn("cos", F.round("cos", 9))


@query(f"""
WITH {_NEAR.replace("WITH ", "")}, {_ALL_NEAR.split("pc AS", 1)[1].join(["pc AS", ""])}
SELECT count(*) AS pairs, count(np.a) AS by_buckets FROM ea LEFT JOIN np ON np.a = ea.a AND np.b = ea.b
""")
def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the exact near pairs the buckets, cut at 200 members, also give."""
    s = Stage(spark, "recall").keep(symbols(spark, d, *_SHAPE), "symbols")
    found = sim.near_pairs(s, CFG.theta_clone).select("a", "b", F.lit(1).alias("hit"))
    return sim.near_pairs_exact(s, CFG.theta_clone).join(found, ["a", "b"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("by_buckets"))


@query(f"WITH {_NEAR} SELECT a, b, round(cos, 9) AS cos FROM np")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sim.near_pairs(symbols(spark, d, *_SHAPE), CFG.theta_clone).withColumn("cos", F.round("cos", 9))


@query(f"""
WITH RECURSIVE {_NEAR}, ex AS (SELECT id, min(id) OVER (PARTITION BY merkle_root) AS f FROM sym WHERE merkle_root IS NOT NULL),
e AS (SELECT a, b FROM np UNION ALL SELECT b, a FROM np UNION ALL SELECT id, f FROM ex WHERE id <> f UNION ALL SELECT f, id FROM ex WHERE id <> f),
r(id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
SELECT id, min(g) AS root FROM r GROUP BY id
""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d, *_SHAPE)
    exact = clustering.clone_clusters(s).where("id <> cluster").select(F.col("cluster").alias("a"), F.col("id").alias("b"))
    return components(sim.near_pairs(s, CFG.theta_clone).select("a", "b").unionByName(exact))


@query()
def shape_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Tight clusters; the order of merges decides, so a plain merge in the tests stands for SQL."""
    return clustering.shape_clusters(symbols(spark, d, *_SHAPE), CFG)


@query()
def families(spark: SparkSession, d: str) -> DataFrame:
    """Families grown around tight clusters, with a vocabulary bound that these tables' random terms reach; a plain agglomeration in the tests stands for SQL."""
    s = symbols(spark, d, *_SHAPE, "qname")
    stage = Stage(spark, "families")
    s, w = stage.keep(s, "symbols"), stage.keep(symbol_weights(spark, d), "weights")
    f = clustering.families(s, stage.keep(clustering.shape_clusters(s, CFG), "tight"), w, Config(theta_b_family=0.005))
    return f.select("family", "id", "is_core", F.round("cos_to_core", 6).alias("cos_to_core"), F.round("b_cos_to_core", 6).alias("b_cos_to_core"))


@query(f"""
WITH {TFIDF}, s AS (SELECT id FROM w GROUP BY id), q AS (SELECT min(id) AS q FROM s),
c AS (SELECT y.id, sum(x.w * y.w) AS c FROM w x JOIN q ON x.id = q JOIN w y ON y.term = x.term GROUP BY y.id)
SELECT s.id, round(coalesce(c, 0), 9) AS b_cos FROM s LEFT JOIN c ON c.id = s.id
""")
def anchor_cosines(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary cosine of one symbol to every symbol, 0 where no term is shared."""
    w = symbol_weights(spark, d)
    q = w.agg(F.min("id")).first()[0]
    one = w.where(F.col("id") == F.lit(q)).select("term", F.col("w").alias("q"))
    c = w.join(one, "term").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("c"))
    return w.select("id").distinct().join(c, "id", "left").select("id", F.round(F.coalesce("c", F.lit(0.0)), 9).alias("b_cos"))


@query(f"""
WITH {TFIDF}, u AS (SELECT file, id, term, w FROM w JOIN sym USING (id) WHERE file IS NOT NULL), k AS (SELECT file, count(DISTINCT id) AS n FROM u GROUP BY file),
t AS (SELECT file, term, sum(w) / any_value(n) AS m FROM u JOIN k USING (file) GROUP BY file, term)
SELECT x.file AS a, y.file AS b, round(sum(x.m * y.m), 9) AS coherence FROM t x JOIN t y ON x.term = y.term AND x.file < y.file GROUP BY ALL HAVING sum(x.m * y.m) >= 0.15
""")
def coherence_edges(spark: SparkSession, d: str) -> DataFrame:
    """Files whose symbols' vocabularies have a mean pairwise cosine of 0.15 or more, as one dot product of mean vectors."""
    u = symbol_weights(spark, d).join(symbols(spark, d, "file").where("file IS NOT NULL"), "id")
    n = u.groupBy("file").agg(F.count_distinct("id").alias("n"))
    mean = u.groupBy("file", F.col("term").alias("key")).agg(F.sum("w").alias("s")).join(n, "file").select(F.col("file").alias("id"), "key", (F.col("s") / F.col("n")).alias("w"))
    return sim.prefix_join(mean, 0.15).select("a", "b", F.round("dot", 9).alias("coherence"))


@query(f"""
WITH {_CLONES}, nb AS (SELECT id, string_split(qname, '.')[-1] AS base FROM sym),
r AS (SELECT id, cluster, CASE WHEN regexp_full_match(base, '__.*__') AND length(base) > 4 THEN base ELSE '' END AS role FROM m JOIN nb USING (id))
SELECT cluster, role, min(id) AS first, count(*) AS members FROM r GROUP BY cluster, role
""")
def role_classes(spark: SparkSession, d: str) -> DataFrame:
    """The clones of a cluster by role: two of one class may merge, two of different classes may not, so no pair is listed."""
    return clustering.role_classes(symbols(spark, d, "merkle_root", "qname"))


@query("""
WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL),
g AS (SELECT md5(text) AS root, min(doc_id) AS first_id, count(*) AS copies, count(DISTINCT source) AS sources FROM d GROUP BY md5(text) HAVING count(*) > 1)
SELECT root, first_id, copies, sources FROM g
""")
def document_clones(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "source", "text").where("text IS NOT NULL")
    return t.groupBy(F.md5("text").alias("root")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.count_distinct("source").alias("sources")).where("copies > 1")
