"""Ranking symbols against a query text through vectors that a cache keeps by content."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import Config
from strata.operators.ids import dense_ids
from strata.operators.vectors import top_k
from strata.runtime import ship
from strata.sources import python_code

WIDTH = 256
SCHEMA = "doc_key string, v array<double>"


def hashed_vector(text: str, width: int = WIDTH) -> list[float]:
    """A deterministic stand-in for a model: signed hashed subwords with damped counts, of length 1."""
    v = np.zeros(width)
    count: dict[str, int] = {}
    for w in python_code.subwords(text):
        count[w] = count.get(w, 0) + 1
    for w, c in count.items():
        h = xxhash.xxh3_64_intdigest(w)
        v[h % width] += (1 if h >> 63 else -1) * (1 + math.log(c))
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def doc_text(qname: str, file: str, source: str) -> str:
    return f"{qname}  ({file})\n{source}"


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached vectors of the right width; none if the cache is missing or unreadable."""
    try:
        cached = spark.read.parquet(path).select("doc_key", F.col("v").cast("array<double>").alias("v"))
        cached.schema  # noqa: B018
        return cached.where(F.size("v") == WIDTH)
    except Exception:  # noqa: BLE001 - whatever is wrong with a cache, it can be made again
        return spark.createDataFrame([], SCHEMA)


def save_cache(cache: DataFrame, path: str) -> None:
    """Written aside and then moved into place, by the file system that holds it."""
    jvm = cache.sparkSession.sparkContext._jvm
    at, aside, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}", f"{path}.old"))
    cache.write.parquet(aside.toString())
    fs = at.getFileSystem(cache.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(aside, at)
    fs.delete(old, True)


def embed(docs: DataFrame, cache: DataFrame, embedder: Callable[[str], list[float]]) -> DataFrame:
    """(id, doc_key, v): cached vectors where there are some, new ones for the keys the cache lacks, each text once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_key": f["doc_key"], "v": [embedder(t) for t in f["text"]]})

    missing = docs.select("doc_key", "text").dropDuplicates(["doc_key"]).join(cache.select("doc_key"), "doc_key", "left_anti")
    return docs.select("id", "doc_key").join(cache.unionByName(missing.mapInPandas(run, SCHEMA)).dropDuplicates(["doc_key"]), "doc_key")


def search(spark: SparkSession, root: str, query: str, top: int = 10, tests: bool = False, cache_path: str | None = None, embedder: Callable[[str], list[float]] = hashed_vector) -> list[dict]:
    """The symbols nearest to a query, numbered from 1; tests only if asked for."""
    ship(spark)
    cfg = Config(min_nodes=8, wl_iters=1)
    every = python_code.scan_symbols(python_code.python_files(spark, root), cfg).where(F.col("node_count") >= cfg.min_nodes)
    s = dense_ids(every.withColumn("start", F.col("span.s")), "file", "start")
    if not tests:
        s = s.where(~F.col("is_test"))
    text = F.concat("qname", F.lit("  ("), "file", F.lit(")\n"), "source")
    docs = s.select("id", text.alias("text"), F.md5(text).alias("doc_key"))
    cache = load_cache(spark, cache_path) if cache_path else spark.createDataFrame([], SCHEMA)
    v = embed(docs, cache, embedder).persist()
    if cache_path:
        save_cache(v.select("doc_key", "v").dropDuplicates(["doc_key"]), cache_path)
    hits = top_k(v.select("id", "v"), embedder(query), top).join(s.select("id", "qname", "file", "line"), "id").orderBy(F.desc("score"), "id").collect()
    v.unpersist()
    return [{"rank": n, "score": r["score"], "qname": r["qname"], "file": r["file"], "line": r["line"]} for n, r in enumerate(hits, 1)]


def render(query: str, hits: list[dict]) -> str:
    return "\n".join(f"{h['rank']:>3}  {h['score']:.3f}  {h['qname']}  {h['file']}:{h['line']}" for h in hits) or f"no hits for {query!r}"
