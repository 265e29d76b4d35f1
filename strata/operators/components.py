"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.runtime import Stage

FEW = 1 << 20
"""Links that one task finishes, whatever their shape."""


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every linked id with the smallest id it is linked to, directly or through others.

    Large stars connect a node's larger neighbours to the smallest id around it, small
    stars its smaller ones; both keep components as they are, and a number of rounds that
    grows with the logarithm of the ids leaves one star around each smallest id. Rounds
    end when the edges no longer change, or when ``FEW`` or fewer are left, which one task
    finishes. Nulls and self-links are ignored.
    """
    stage = Stage(links.sparkSession, "components")
    start = links.select(F.col(a).cast("bigint").alias("p"), F.col(b).cast("bigint").alias("q")).where("p IS NOT NULL AND q IS NOT NULL AND p <> q")
    (edges, now), last = _kept(start.select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y")).distinct(), stage), None
    while now != last:
        if now[0] <= FEW:
            return edges.coalesce(1).mapInArrow(_finish, "id bigint, root bigint")
        before, last = edges, now
        edges, now = _kept(_small(_large(before)), stage)
        stage.drop(before)
    return edges.select(F.col("x").alias("id"), F.col("y").alias("root")).unionByName(edges.select(F.col("y").alias("id"), F.col("y").alias("root")).distinct())


def _kept(edges: DataFrame, stage: Stage) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and what tells two sets of them apart."""
    seen = Observation()
    out = stage.keep(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")), "stars")
    return out, (seen.get["n"], seen.get["h"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        x, y = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in local_stars(x, y)], names=["id", "root"])


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the links and the smallest id it is linked to by these links: roots hook to smaller roots, paths are halved, until none is left."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        up = np.arange(len(ids))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]
        root = up[root]
    return ids, ids[root]


def _large(edges: DataFrame) -> DataFrame:
    """Edges (x, y), x > y: each node's larger neighbours joined to the smallest of it and its neighbours."""
    ends = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")
    both = edges.select(ends).select("e.x", "e.y")
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges (x, y), x > y: each node and its smaller neighbours joined to the smallest of these."""
    least = edges.groupBy("x").agg(F.min("y").alias("m"))
    down = edges.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return down.unionByName(least.select("x", F.col("m").alias("y"))).distinct()
