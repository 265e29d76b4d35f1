"""Dates, activity and change coupling from commits (repo, commit_id, secs, author, message, n_parents) and edits (repo, commit_id, path, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.config import HALF_LIFE_DAYS, MAX_CHANGESET, MIN_DEGREE, MIN_REVS, MIN_SHARED_REVS
from strata.functions.dates import classify, fmt_date, recency
from strata.functions.paths import is_noise_path, plain_path
from strata.functions.text import first_ticket


def plain_edits(edits: DataFrame) -> DataFrame:
    """Edits with paths in their plain spelling; repeated rows once. Null repos, commits and paths are left out."""
    columns = [c for c in edits.columns if c != "loaded_at"]
    return edits.select(*columns).withColumn("path", plain_path(F.col("path"))).where("repo IS NOT NULL AND commit_id IS NOT NULL AND path IS NOT NULL").distinct()


def plain_commits(commits: DataFrame) -> DataFrame:
    """Each commit once."""
    return commits.drop("loaded_at").dropDuplicates(["repo", "commit_id"])


def file_dates(commits: DataFrame, edits: DataFrame) -> DataFrame:
    """(repo, path, first_seen, last_touched): the oldest and newest commit of every path."""
    return edits.select("repo", "commit_id", "path").join(commits.select("repo", "commit_id", "secs"), ["repo", "commit_id"]).groupBy("repo", "path").agg(F.min("secs").alias("first_seen"), F.max("secs").alias("last_touched"))


def activity(dates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Dates with both days written out and the class of activity at the repo's newest commit."""
    return dates.join(anchors, "repo").select("repo", "path", fmt_date(F.col("first_seen")).alias("first_day"), fmt_date(F.col("last_touched")).alias("last_day"), classify(F.col("anchor"), F.col("first_seen"), F.col("last_touched")).alias("activity"))


def anchors(commits: DataFrame) -> DataFrame:
    """(repo, anchor): the newest commit's seconds stand for now."""
    return commits.groupBy("repo").agg(F.max("secs").alias("anchor"))


def current_tree(head: DataFrame) -> DataFrame:
    """(repo, path, n_lines) at head without noise; a binary file has 0 lines."""
    return head.where(~is_noise_path(F.col("path"))).select("repo", "path", F.when(F.col("is_binary"), 0).otherwise(F.col("n_lines")).alias("n_lines"))


def transactions(commits: DataFrame, edits: DataFrame, tree: DataFrame) -> DataFrame:
    """(repo, txn, secs, author, ticket, path, churn): edits of non-merge commits to paths at head, one row per commit and path."""
    real = commits.where("n_parents < 2").select("repo", F.col("commit_id").alias("txn"), "secs", "author", first_ticket(F.col("message")).alias("ticket"))
    kept = edits.join(tree.select("repo", "path"), ["repo", "path"], "left_semi")
    per = kept.groupBy("repo", F.col("commit_id").alias("txn"), "path").agg(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))).cast("bigint").alias("churn"))
    return per.join(real, ["repo", "txn"])


def by_ticket(txns: DataFrame) -> DataFrame:
    """Transactions of one author and ticket merged, at their newest time; those without a ticket stay as they are."""
    key = F.when(F.col("ticket").isNotNull(), F.concat_ws("\u0001", F.lit("t"), "author", "ticket")).otherwise(F.concat_ws("\u0001", F.lit("c"), "txn"))
    newest = F.max("secs").over(Window.partitionBy("repo", "txn"))
    merged = txns.withColumn("txn", key).groupBy("repo", "txn", "path").agg(F.sum("churn").alias("churn"), F.max("secs").alias("secs"), F.max("author").alias("author"), F.max("ticket").alias("ticket"))
    return merged.withColumn("secs", newest)


def within_cap(txns: DataFrame, cap: int = MAX_CHANGESET) -> DataFrame:
    """Transactions of at most ``cap`` paths; larger ones are left out whole."""
    small = txns.groupBy("repo", "txn").agg(F.count("*").alias("n")).where(F.col("n") <= cap)
    return txns.join(small.select("repo", "txn"), ["repo", "txn"], "left_semi")


def coupling_files(txns: DataFrame, tree: DataFrame, anchor: DataFrame, min_revs: int = MIN_REVS, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Every path at head with its revisions, newest touch, recency-weighted revisions and churn.

    ``kind`` is ``RelativeChurn`` with churn over lines (0 without lines) from ``min_revs``
    revisions on, else ``InsufficientHistory`` with a null ratio.
    """
    per = txns.join(anchor, "repo").groupBy("repo", "path").agg(F.count("*").alias("revs"), F.max("secs").alias("last_touched"), F.sum(recency(F.col("anchor"), F.col("secs"), half_life)).alias("weighted_revs"), F.sum("churn").alias("churn"))
    ratio = F.when(F.col("n_lines") > 0, F.col("churn") / F.col("n_lines")).otherwise(0.0)
    enough = F.coalesce("revs", F.lit(0)) >= min_revs
    return tree.join(per, ["repo", "path"], "left").select(
        "repo", "path", F.coalesce("revs", F.lit(0)).alias("revs"), "last_touched", F.coalesce("weighted_revs", F.lit(0.0)).alias("weighted_revs"), F.coalesce("churn", F.lit(0)).alias("churn"),
        F.when(enough, "RelativeChurn").otherwise("InsufficientHistory").alias("kind"), F.when(enough, ratio).alias("relative_churn"),
    )


def coupled_pairs(txns: DataFrame, anchor: DataFrame, min_shared: int = MIN_SHARED_REVS, min_degree: float = MIN_DEGREE, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Pairs of paths changed together: shared revisions, both confidences, the degree, and the same weighted by recency.

    The self-join runs within a transaction, whose size ``within_cap`` bounds.
    """
    t = txns.join(anchor, "repo").select("repo", "txn", "path", recency(F.col("anchor"), F.col("secs"), half_life).alias("w"))
    pair = t.select("repo", "txn", F.col("path").alias("a"), "w").join(t.select("repo", "txn", F.col("path").alias("b")), ["repo", "txn"]).where("a < b")
    shared = pair.groupBy("repo", "a", "b").agg(F.count("*").alias("shared"), F.sum("w").alias("weighted_shared")).where(F.col("shared") >= min_shared)
    one = t.groupBy("repo", "path").agg(F.count("*").alias("revs"), F.sum("w").alias("wrevs"))
    out = shared.join(one.select("repo", F.col("path").alias("a"), F.col("revs").alias("ra"), F.col("wrevs").alias("wa")), ["repo", "a"]).join(one.select("repo", F.col("path").alias("b"), F.col("revs").alias("rb"), F.col("wrevs").alias("wb")), ["repo", "b"])
    return out.select(
        "repo", "a", "b", "shared", (F.col("shared") / F.col("ra")).alias("confidence_ab"), (F.col("shared") / F.col("rb")).alias("confidence_ba"),
        (200.0 * F.col("shared") / (F.col("ra") + F.col("rb"))).alias("degree"), (200.0 * F.col("weighted_shared") / (F.col("wa") + F.col("wb"))).alias("recent_degree"),
    ).where(F.col("degree") >= min_degree)


def partners(pairs: DataFrame, diff: DataFrame, k: int = 3) -> DataFrame:
    """(repo, file, partner, shared, confidence, rank): for each file of ``diff`` (repo, path) its strongest partners outside it.

    Order: confidence, shared revisions, then the smaller name.
    """
    both = pairs.select("repo", F.col("a").alias("file"), F.col("b").alias("partner"), "shared", F.col("confidence_ab").alias("confidence")).unionByName(
        pairs.select("repo", F.col("b").alias("file"), F.col("a").alias("partner"), "shared", F.col("confidence_ba").alias("confidence"))
    )
    seen = both.join(diff.select("repo", F.col("path").alias("file")), ["repo", "file"], "left_semi").join(diff.select("repo", F.col("path").alias("partner")), ["repo", "partner"], "left_anti")
    w = Window.partitionBy("repo", "file").orderBy(F.round("confidence", 9).desc(), F.desc("shared"), "partner")
    return seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("repo", "file", "partner", "shared", "confidence", "rank")
