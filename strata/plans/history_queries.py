"""Dates, activity and change coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import history
from strata.operators.ids import rank_within
from strata.plans.inputs import GIT, TXN, anchors, commits, edits, tree, txns
from strata.plans.registry import query
from strata.sources.tables import table


@query(f"""
WITH {GIT}, fd AS (SELECT e.repo, e.path, min(secs) AS first_seen, max(secs) AS last_touched FROM ed e JOIN co c ON c.repo = e.repo AND c.commit_id = e.commit_id GROUP BY e.repo, e.path)
SELECT repo, path, strftime(make_timestamp(first_seen * 1000000), '%Y-%m-%d') AS first_day, strftime(make_timestamp(last_touched * 1000000), '%Y-%m-%d') AS last_day,
  CASE WHEN anchor - last_touched > 180 * 86400 THEN 'dead' WHEN anchor - first_seen <= 90 * 86400 THEN 'growing' ELSE 'flat' END AS activity FROM fd JOIN anchor USING (repo)
""")
def first_last_activity(spark: SparkSession, d: str) -> DataFrame:
    return history.activity(history.file_dates(commits(spark, d), edits(spark, d)), anchors(spark, d))


@query(f"WITH {GIT} SELECT t.repo, t.path, t.n_lines, min(secs) AS first_seen, max(secs) AS last_touched FROM tree t LEFT JOIN (SELECT e.repo, e.path, secs FROM ed e JOIN co c ON c.repo = e.repo AND c.commit_id = e.commit_id) x ON x.repo = t.repo AND x.path = t.path GROUP BY ALL")
def dated_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Every file at head with its dates, null where it was never touched."""
    return tree(spark, d).join(history.file_dates(commits(spark, d), edits(spark, d)), ["repo", "path"], "left")


@query(f"WITH {TXN} SELECT repo, txn, count(*) AS paths, max(secs) AS secs, max(ticket) AS ticket FROM tx GROUP BY repo, txn")
def raw_transactions(spark: SparkSession, d: str) -> DataFrame:
    t = history.transactions(commits(spark, d), edits(spark, d), tree(spark, d))
    return t.groupBy("repo", "txn").agg(F.count("*").alias("paths"), F.max("secs").alias("secs"), F.max("ticket").alias("ticket"))


_FILES = f"""{TXN},
pf AS (SELECT t.repo, path, count(*) AS revs, max(secs) AS last_touched, sum(pow(0.5, (anchor - secs) / (182.5 * 86400))) AS weighted_revs, CAST(sum(churn) AS BIGINT) AS churn FROM t JOIN anchor USING (repo) GROUP BY t.repo, path)"""


@query(f"""
WITH {_FILES} SELECT repo, path, coalesce(revs, 0) AS revs, last_touched, round(coalesce(weighted_revs, 0), 9) AS weighted_revs, coalesce(churn, 0) AS churn,
  CASE WHEN coalesce(revs, 0) >= 10 THEN 'RelativeChurn' ELSE 'InsufficientHistory' END AS kind, CASE WHEN coalesce(revs, 0) >= 10 THEN round(CASE WHEN n_lines > 0 THEN churn / n_lines ELSE 0 END, 9) END AS relative_churn
FROM tree LEFT JOIN pf USING (repo, path)
""")
def coupling_files(spark: SparkSession, d: str) -> DataFrame:
    f = history.coupling_files(txns(spark, d), tree(spark, d), anchors(spark, d))
    return f.withColumn("weighted_revs", F.round("weighted_revs", 9)).withColumn("relative_churn", F.round("relative_churn", 9))


def _coupled(t: str) -> str:
    return f"""
tw AS (SELECT {t}.repo, txn, path, pow(0.5, (anchor - secs) / (182.5 * 86400)) AS w FROM {t} JOIN anchor USING (repo)),
on1 AS (SELECT repo, path, count(*) AS revs, sum(w) AS wrevs FROM tw GROUP BY repo, path),
sh AS (SELECT x.repo, x.path AS a, y.path AS b, count(*) AS shared, sum(x.w) AS ws FROM tw x JOIN tw y ON x.repo = y.repo AND x.txn = y.txn AND x.path < y.path GROUP BY ALL HAVING count(*) >= 5),
cp AS (SELECT sh.repo, a, b, shared, shared / p.revs AS confidence_ab, shared / q.revs AS confidence_ba, 200.0 * shared / (p.revs + q.revs) AS degree, 200.0 * ws / (p.wrevs + q.wrevs) AS recent_degree
       FROM sh JOIN on1 p ON p.repo = sh.repo AND p.path = a JOIN on1 q ON q.repo = sh.repo AND q.path = b WHERE 200.0 * shared / (p.revs + q.revs) >= 30)"""


_ROUND = "round(confidence_ab, 9) AS confidence_ab, round(confidence_ba, 9) AS confidence_ba, round(degree, 9) AS degree"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {TXN}, {_coupled('t')} SELECT repo, a, b, shared, {_ROUND}, CAST(row_number() OVER (PARTITION BY repo ORDER BY greatest(round(confidence_ab, 9), round(confidence_ba, 9)) DESC, a, b) AS INT) AS place FROM cp")
def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Coupled pairs with their place in the repo's report: the larger confidence first, then by name."""
    p = _rounded(history.coupled_pairs(txns(spark, d), anchors(spark, d)), "confidence_ab", "confidence_ba", "degree").drop("recent_degree")
    return rank_within(p.withColumn("k", -F.greatest("confidence_ab", "confidence_ba")), ["repo"], "k", "a", "b", name="place").drop("k")


@query(f"WITH {TXN}, {_coupled('t')} SELECT repo, a, b, round(recent_degree, 9) AS recent_degree FROM cp")
def recency_weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(history.coupled_pairs(txns(spark, d), anchors(spark, d)).select("repo", "a", "b", "recent_degree"), "recent_degree")


@query(f"""
WITH {TXN}, gk AS (SELECT *, CASE WHEN ticket IS NOT NULL THEN 't' || chr(1) || concat_ws(chr(1), author, ticket) ELSE 'c' || chr(1) || txn END AS k FROM tx),
gt AS (SELECT repo, k AS txn, path, max(secs) AS secs FROM gk GROUP BY repo, k, path), gn AS (SELECT repo, txn, path, max(secs) OVER (PARTITION BY repo, txn) AS secs FROM gt),
gc AS (SELECT repo, txn FROM gn GROUP BY repo, txn HAVING count(*) <= 30), g AS (SELECT gn.* FROM gn JOIN gc USING (repo, txn)), {_coupled('g')}
SELECT repo, a, b, shared, {_ROUND} FROM cp
""")
def cochange_ticket_grouped(spark: SparkSession, d: str) -> DataFrame:
    p = history.coupled_pairs(txns(spark, d, True), anchors(spark, d)).drop("recent_degree")
    return _rounded(p, "confidence_ab", "confidence_ba", "degree")


_PARTNERS = f"""{TXN}, {_coupled('t')},
df0 AS (SELECT repo, path FROM tree WHERE path LIKE 'core/%' OR path = 'CHANGELOG.md'),
bo AS (SELECT repo, a AS file, b AS partner, shared, confidence_ab AS c FROM cp UNION ALL SELECT repo, b, a, shared, confidence_ba FROM cp),
pr AS (SELECT bo.*, row_number() OVER (PARTITION BY repo, file ORDER BY round(c, 9) DESC, shared DESC, partner) AS r FROM bo SEMI JOIN df0 ON df0.repo = bo.repo AND df0.path = bo.file ANTI JOIN df0 x ON x.repo = bo.repo AND x.path = bo.partner)"""


def _partners(spark: SparkSession, d: str) -> DataFrame:
    diff = tree(spark, d).where("path LIKE 'core/%' OR path = 'CHANGELOG.md'")
    return history.partners(history.coupled_pairs(txns(spark, d), anchors(spark, d)), diff)


@query(f"WITH {_PARTNERS} SELECT repo, file, partner, shared, round(c, 9) AS confidence, CAST(r AS INT) AS rank FROM pr WHERE r <= 3")
def cochange_partners_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_partners(spark, d), "confidence")


@query(f"WITH {_PARTNERS} SELECT DISTINCT repo, partner FROM pr WHERE r <= 3")
def also_review_union(spark: SparkSession, d: str) -> DataFrame:
    return _partners(spark, d).select("repo", "partner").distinct()


@query(f"""
WITH {TXN}, {_coupled('t')}, o AS (SELECT repo, file, partner, max(shared_revs) AS old FROM cochange_partners GROUP BY ALL),
n AS (SELECT repo, a AS file, b AS partner, shared FROM cp UNION ALL SELECT repo, b, a, shared FROM cp)
SELECT repo, file, partner, CAST(old AS BIGINT) AS old, shared FROM o FULL JOIN n USING (repo, file, partner)
""")
def stale_partners(spark: SparkSession, d: str) -> DataFrame:
    """The old report beside what the history says now: either side may lack a pair."""
    p = history.coupled_pairs(txns(spark, d), anchors(spark, d))
    now = p.select("repo", F.col("a").alias("file"), F.col("b").alias("partner"), "shared").unionByName(p.select("repo", F.col("b").alias("file"), F.col("a").alias("partner"), "shared"))
    old = table(spark, d, "cochange_partners", "repo", "file", "partner", "shared_revs").groupBy("repo", "file", "partner").agg(F.max("shared_revs").cast("bigint").alias("old"))
    return old.join(now, ["repo", "file", "partner"], "full")


@query(f"""
WITH {GIT}, y AS (SELECT e.repo, e.path, year(make_timestamp(secs * 1000000)) AS y FROM ed e JOIN co c ON c.repo = e.repo AND c.commit_id = e.commit_id),
l AS (SELECT repo, max(y) AS last FROM y GROUP BY repo), s AS (SELECT DISTINCT repo, path, y = last AS recent FROM y JOIN l USING (repo)),
g AS (SELECT repo, path, bool_or(recent) AS now, bool_or(NOT recent) AS before FROM s GROUP BY repo, path)
SELECT repo, count(*) AS either, count(*) FILTER (WHERE now AND before) AS both, count(*) FILTER (WHERE now AND NOT before) AS only_now, count(*) FILTER (WHERE before AND NOT now) AS only_before FROM g GROUP BY repo
""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Paths touched in a repo's last year and before: union, intersection and both differences."""
    y = edits(spark, d).select("repo", "commit_id", "path").join(commits(spark, d).select("repo", "commit_id", "secs"), ["repo", "commit_id"]).select("repo", "path", F.year(F.timestamp_seconds("secs")).alias("y"))
    last = y.groupBy("repo").agg(F.max("y").alias("last"))
    g = y.join(last, "repo").groupBy("repo", "path").agg(F.max((F.col("y") == F.col("last")).cast("int")).alias("now"), F.max((F.col("y") != F.col("last")).cast("int")).alias("before"))
    return g.groupBy("repo").agg(F.count("*").alias("either"), F.count_if(F.expr("now = 1 AND before = 1")).alias("both"), F.count_if(F.expr("now = 1 AND before = 0")).alias("only_now"), F.count_if(F.expr("now = 0 AND before = 1")).alias("only_before"))
