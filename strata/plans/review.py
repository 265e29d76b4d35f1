"""Review of a branch: its new symbols, what exists already that is like them, and files that usually change along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import Config
from strata.functions.paths import dir_of
from strata.operators import history, vectors
from strata.operators.postings import label_vectors
from strata.operators.similarity import pair_cosines
from strata.plans.analysis import Analysis, analyze
from strata.plans.find import SCHEMA, embed, hashed_vector
from strata.runtime import Stage
from strata.sources import git_log, python_code


def new_symbols(symbols: DataFrame, changed: DataFrame, base_roots: DataFrame) -> DataFrame:
    """Symbols of changed files whose structural hash the base does not have."""
    return symbols.join(changed, "file", "left_semi").join(base_roots, "merkle_root", "left_anti")


def nearest_existing(a: Analysis, new: DataFrame, embedding: DataFrame, k: int = 3) -> DataFrame:
    """(id, near, a_cos, b_cos, rank): for each new symbol the existing ones, no tests, of nearest embedding (id, v), with the cosines of their shapes and vocabularies.

    The embedding only ranks. Each new symbol is a query against all existing ones, in blocks.
    """
    mine = new.select("id")
    old = a.symbols.where(~F.col("is_test")).select("id").join(mine, "id", "left_anti")
    found = vectors.knn(embedding.join(old, "id"), k, embedding.join(mine, "id")).select(F.col("i").alias("a"), F.col("j").alias("b"), "rank")
    shaped = pair_cosines(found, label_vectors(a.symbols), "rank").withColumnRenamed("cos", "a_cos")
    wa, wb = (a.weights.select(F.col("id").alias(end), "term", F.col("w").alias(f"w{end}")) for end in ("a", "b"))
    words = found.select("a", "b").join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("b_cos"))
    return shaped.join(words, ["a", "b"], "left").select(F.col("a").alias("id"), F.col("b").alias("near"), "a_cos", F.coalesce("b_cos", F.lit(0.0)).alias("b_cos"), "rank")


def prevalence(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """(dir, files, documented, symbols) by folder."""
    f = docs.withColumn("dir", dir_of(F.col("file"))).groupBy("dir").agg(F.count("*").alias("files"), F.count_if("has_docstring").alias("documented"))
    s = symbols.withColumn("dir", dir_of(F.col("file"))).groupBy("dir").agg(F.count("*").alias("symbols"))
    return f.join(s, "dir", "left").select("dir", "files", "documented", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def coupling(a: Analysis) -> tuple[DataFrame, DataFrame] | None:
    """(files, pairs) of change coupling at head; null without history."""
    if a.history is None:
        return None
    commits, edits, head = a.history
    tree = history.current_tree(head)
    txns = history.within_cap(history.transactions(commits, edits, tree))
    anchors = history.anchors(commits)
    return history.coupling_files(txns, tree, anchors), history.coupled_pairs(txns, anchors)


def review(spark: SparkSession, root: str, base: str | None = None, embedder: Callable[[str], list[float]] | None = hashed_vector) -> dict | None:
    """The report on the checked-out branch; null if there is no branch to review. Without an embedder nothing is named as nearest."""
    b = git_log.detect_branch(root, base)
    if b is None:
        return None
    a = analyze(spark, root, Config(min_nodes=8))
    changed = spark.createDataFrame([(f,) for f in sorted(b.changed_files)], "file string")
    roots = spark.createDataFrame([(r,) for r in sorted(b.base_roots)], "merkle_root bigint")
    new = new_symbols(a.symbols, changed, roots)
    near = []
    if embedder is not None:
        text = F.concat("qname", F.lit("  ("), "file", F.lit(")\n"), "source")
        v = embed(a.symbols.select("id", text.alias("text"), F.md5(text).alias("doc_key")), spark.createDataFrame([], SCHEMA), embedder).select("id", "v")
        v = Stage(spark, "review").keep(v, "vectors")
        near = nearest_existing(a, new, v).join(a.symbols.select(F.col("id").alias("near"), "qname", "file", "line"), "near").orderBy("id", "rank").collect()
    along: dict[str, list] = {}
    pairs = coupling(a)
    if pairs is not None:
        diff = changed.select(F.lit(".").alias("repo"), F.col("file").alias("path"))
        known = pairs[0].where("kind = 'RelativeChurn'").select("repo", F.col("path").alias("file"), "revs")  # files with too little history name no partners
        for r in history.partners(pairs[1], diff).join(known, ["repo", "file"]).orderBy("file", "rank").collect():
            along.setdefault(r["file"], []).append({"file": r["partner"], "shared_revs": r["shared"], "file_revs": r["revs"], "confidence": round(r["confidence"], 6)})
    file_docs = Stage(spark, "review").keep(python_code.file_docs(python_code.python_files(spark, root)), "docs")
    docs = {r["dir"]: r for r in prevalence(a.symbols, file_docs).collect()}
    documented = {r["file"] for r in file_docs.join(changed, "file", "left_semi").where("has_docstring").select("file").collect()}
    rows = new.select("id", "qname", "file", "line", "is_test", dir_of(F.col("file")).alias("dir")).orderBy("file", "line").collect()
    return {
        "schema": "review/1", "branch": b.branch, "base": b.base, "changed_files": sorted(b.changed_files), "changed_symbols": len(rows), "semantic_available": embedder is not None,
        "also_review": sorted({p["file"] for ps in along.values() for p in ps}),
        "symbols": [
            {
                "qname": r["qname"], "file": r["file"], "line": r["line"], "dir": r["dir"], "is_test": r["is_test"], "also_review": along.get(r["file"], []),
                "nearest_existing": [{"qname": x["qname"], "file": x["file"], "line": x["line"], "a_cos": round(x["a_cos"], 6), "b_cos": round(x["b_cos"], 6)} for x in near if x["id"] == r["id"]],
                "prevalence": {"dir": r["dir"], "file_has_docstring": r["file"] in documented, **{k: docs[r["dir"]][k] for k in ("files", "documented", "symbols")}},
            }
            for r in rows
        ],
    }


def render(report: dict | None) -> str:
    if report is None:
        return "nothing to review"
    lines = [f"{report['branch']} against {report['base']}: {len(report['changed_files'])} changed files, {report['changed_symbols']} new symbols"]
    for s in report["symbols"]:
        lines.append(f"{s['qname']}  {s['file']}:{s['line']}")
        lines += [f"  like {n['qname']}  {n['file']}:{n['line']}  shape {n['a_cos']:.2f}, words {n['b_cos']:.2f}" for n in s["nearest_existing"]]
        lines += [f"  changes with {p['file']} ({p['shared_revs']} times, {p['confidence']:.0%})" for p in s["also_review"]]
    return "\n".join(lines)
