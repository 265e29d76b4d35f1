"""The shared engine behind scan, explain, explore and review: one analysis of a source tree."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import Config
from strata.operators import clustering, graph, history
from strata.operators.ids import dense_ids
from strata.operators.similarity import document_frequency, term_counts, tfidf
from strata.runtime import Stage, ship
from strata.sources import git_log, python_code


@dataclass
class Analysis:
    root: str
    cfg: Config
    symbols: DataFrame
    weights: DataFrame
    edges: DataFrame
    tight: DataFrame
    repeated: DataFrame
    families: DataFrame
    competing: DataFrame
    competing_pairs: DataFrame
    deprecated: DataFrame | None
    stats: dict[str, int]
    anchor: int | None
    n: int
    history: tuple[DataFrame, DataFrame, DataFrame] | None = None
    seconds: dict[str, float] = field(default_factory=dict)


def analyze(spark: SparkSession, root: str, cfg: Config = Config()) -> Analysis:
    """Reads a source tree and its history, and runs every search over it. Tables used more than once are written to the shared folder."""
    ship(spark)
    stage, seconds, began = Stage(spark, "scan"), {}, time.perf_counter()

    def phase(name: str) -> None:
        nonlocal began
        now = time.perf_counter()
        seconds[name], began = now - began, now

    files = python_code.python_files(spark, root)
    every = stage.keep(python_code.scan_symbols(files, cfg), "scanned")
    n_files, n_all = files.select("file").count(), every.count()
    symbols = dense_ids(every.where(F.col("node_count") >= cfg.min_nodes).withColumn("start", F.col("span.s")), "file", "start").drop("start")
    phase("scan")
    past = git_log.history(spark, root)
    anchor = None
    dating = F.lit(None).cast("struct<first_seen:bigint,last_touched:bigint>")
    if past:
        commits, edits, _ = past
        anchor = commits.agg(F.max("secs")).first()[0]
        dates = history.file_dates(commits, edits).select(F.col("path").alias("file"), "first_seen", "last_touched")
        symbols = symbols.join(dates, "file", "left").withColumn("dating", F.when(F.col("first_seen").isNotNull(), F.struct("first_seen", "last_touched"))).drop("first_seen", "last_touched")
    else:
        symbols = symbols.withColumn("dating", dating)
    symbols = stage.keep(symbols, "symbols")
    n = symbols.count()
    phase("history")
    weights = stage.keep(tfidf(term_counts(symbols, "id", "vocab_tf"), n), "weights")
    phase("vocabulary")
    tight = stage.keep(clustering.shape_clusters(symbols, cfg), "tight")
    phase("shapes")
    repeated = stage.keep(clustering.repeated(symbols, tight), "repeated")
    phase("repeated")
    families = stage.keep(clustering.families(symbols, tight, weights, cfg), "families")
    phase("families")
    edges = stage.keep(graph.call_edges(symbols), "edges")
    calls = graph.call_groups(symbols)
    phase("calls")
    stages = stage.keep(clustering.competing_pairs(symbols, weights, n, calls, cfg), "staged")
    kept = stages.where("passed = 5")
    competing = stage.keep(clustering.competing_groups(kept, symbols, weights, cfg), "competing")
    phase("competing")
    old = None
    if anchor is not None:
        old = stage.keep(clustering.deprecated(repeated, clustering.cluster_centroids(tight, weights), anchor, cfg.theta_b), "deprecated")
    phase("deprecated")
    return Analysis(root, cfg, symbols, weights, edges, tight, repeated, families, competing, stages, old, {"files": n_files, "symbols": n, "skipped_small": n_all - n}, anchor, n, past, seconds)


__all__ = ["Analysis", "analyze", "dense_ids", "document_frequency"]
