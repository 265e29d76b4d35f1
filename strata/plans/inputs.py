"""The tables in the form the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import history
from strata.operators.similarity import term_counts, tfidf
from strata.sources.tables import table


def symbols(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each symbol id once."""
    return table(spark, d, "symbols", "id", *columns).where("id IS NOT NULL").dropDuplicates(["id"])


def symbol_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "symbols", "id").where("id IS NOT NULL").distinct().count()


def symbol_tf(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(symbols(spark, d, "vocab_tf"), "id", "vocab_tf")


def symbol_weights(spark: SparkSession, d: str) -> DataFrame:
    return tfidf(symbol_tf(spark, d), symbol_count(spark, d))


def commits(spark: SparkSession, d: str) -> DataFrame:
    return history.plain_commits(table(spark, d, "commits"))


def edits(spark: SparkSession, d: str) -> DataFrame:
    return history.plain_edits(table(spark, d, "edits"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return history.anchors(commits(spark, d))


def tree(spark: SparkSession, d: str) -> DataFrame:
    return history.current_tree(table(spark, d, "head_files"))


def txns(spark: SparkSession, d: str, ticket: bool = False) -> DataFrame:
    t = history.transactions(commits(spark, d), edits(spark, d), tree(spark, d))
    return history.within_cap(history.by_ticket(t) if ticket else t)


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", *columns)


SYM = "sym AS (SELECT * FROM symbols WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at) = 1)"
TF = rf"""{SYM},
tf AS (SELECT id, lower(regexp_replace(k, '^[\s\x{{00a0}}\x{{3000}}]+|[\s\x{{00a0}}\x{{3000}}]+$', '', 'g')) AS term, CAST(sum(c) AS BIGINT) AS tf
       FROM (SELECT id, unnest(map_keys(vocab_tf)) AS k, unnest(map_values(vocab_tf)) AS c FROM sym) WHERE c >= 1 GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM sym),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
TFIDF = f"""{TF},
raw AS (SELECT id, term, tf, df, tf * ln(1 + n / df) AS r FROM tf JOIN df USING (term), nn),
w AS (SELECT id, term, tf, df, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM raw)"""
PAIRS = f"""{TFIDF},
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM w x JOIN w y ON x.term = y.term AND x.id < y.id, nn WHERE x.df >= 2 AND x.df <= greatest(ceil(0.10 * n), 4)),
pair AS (SELECT a, b, sum(x.w * y.w) AS cos FROM cand JOIN w x ON x.id = a JOIN w y ON y.id = b AND y.term = x.term GROUP BY a, b HAVING sum(x.w * y.w) >= 0.55)"""
HIST = """lw AS (SELECT id, e.label AS label, sum(coalesce(e.w, 0)) AS w FROM (SELECT id, unnest(wl) AS e FROM sym) WHERE e.label IS NOT NULL GROUP BY id, e.label),
ln2 AS (SELECT id, sum(w * w) AS n FROM lw GROUP BY id)"""
PLAIN = r"regexp_replace(regexp_replace(regexp_replace(path, '\s+$', ''), '[\\/]+', '/', 'g'), '^(\./)+', '')"
NOISE = r"regexp_matches(path, '\.lock$|(^|/)package-lock\.json$|_pb2\.py$|\.min\.[^/]*$|(^|/)(vendor|node_modules|dist|target)(/|$)')"
GIT = rf"""co AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo, commit_id ORDER BY loaded_at) = 1),
ed AS (SELECT DISTINCT commit_id, repo, {PLAIN} AS path, prev_blob, blob, added, removed FROM edits WHERE repo IS NOT NULL AND commit_id IS NOT NULL AND {PLAIN} <> ''),
anchor AS (SELECT repo, max(secs) AS anchor FROM co GROUP BY repo),
tree AS (SELECT repo, path, CASE WHEN is_binary THEN 0 ELSE n_lines END AS n_lines FROM head_files WHERE NOT {NOISE})"""
_TICKET = r"CASE WHEN regexp_extract(message, '(#[0-9]+|(?:^|[^A-Za-z0-9])([A-Z]+-[0-9]+)(?:[^A-Za-z0-9]|$))', 1) <> '' THEN regexp_extract(regexp_extract(message, '(#[0-9]+|(?:^|[^A-Za-z0-9])[A-Z]+-[0-9]+(?:[^A-Za-z0-9]|$))', 1), '#[0-9]+|[A-Z]+-[0-9]+') END"
TICKET = _TICKET
TXN = f"""{GIT},
tx0 AS (SELECT e.repo, e.commit_id AS txn, e.path, CAST(sum(coalesce(added, 0) + coalesce(removed, 0)) AS BIGINT) AS churn FROM ed e JOIN tree t ON e.repo = t.repo AND e.path = t.path GROUP BY ALL),
tx AS (SELECT x.*, c.secs, c.author, {_TICKET} AS ticket FROM tx0 x JOIN co c ON c.repo = x.repo AND c.commit_id = x.txn WHERE c.n_parents < 2),
cap AS (SELECT repo, txn FROM tx GROUP BY repo, txn HAVING count(*) <= 30),
t AS (SELECT tx.* FROM tx JOIN cap USING (repo, txn))"""
UNIT = "vec AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"
