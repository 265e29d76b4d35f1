"""Inverted lists of dense vectors: what lies near each other meets in lists, whose number grows with the root of the vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 65536
"""Vectors, the first by hash of their id, on which the list centres are fitted, or four for each list if that is more; all vectors are indexed."""
LISTS = 8
"""Lists for each root of the number of vectors."""
TOPS = 8
"""Upper centres under which a vector's lists are looked for."""
STORED, PROBED = 2, 8
"""Lists a vector stands in, and lists it is compared with."""
BLOCK_ROWS = 4096


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors, started from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        ids, at = np.unique(near[order], return_index=True)
        c[ids] = np.add.reduceat(x[order], at, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def best(q: np.ndarray, p: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((p, -cos, q))
    q, p, cos = q[order], p[order], cos[order]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else q
    keep = rank < k
    return q[keep], p[keep], cos[keep]


def matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Unit vectors, the first by hash of their id, and the number of lists."""
    n = vectors.count()
    lists = max(1, min(n // 24, round(LISTS * n**0.5)))
    got = vectors.select("v", F.xxhash64("id").alias("o"), "id").orderBy("o", "id").limit(max(FIT_ROWS, 4 * lists)).select("v").toArrow().column(0).combine_chunks()
    return unit(matrix(got)).astype(np.float32) if len(got) else np.ones((1, 1), np.float32), lists


class Centres:
    """Two levels of list centres: about the square root of their number, and under each its share of all."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.top = fit_centres(sample, max(1, round(lists**0.5)))
        near = np.concatenate([(sample[i : i + 4096] @ self.top.T).argmax(1) for i in range(0, len(sample), 4096)])
        self.below = [fit_centres(part, max(1, round(lists * len(part) / len(sample)))) if len(part := sample[near == t]) else self.top[t : t + 1] for t in range(len(self.top))]
        self.first = np.cumsum([0, *map(len, self.below)])

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The ``m`` nearest lists of each unit vector, nearest first, among those under its ``TOPS`` nearest upper centres; -1 where there are fewer."""
        tops = min(TOPS, len(self.top))
        s = x @ self.top.T
        at = np.argpartition(-s, tops - 1, axis=1)[:, :tops]
        width = max(map(len, self.below))
        score, number = np.full((len(x), tops, width), -2, np.float32), np.full((len(x), tops, width), -1, np.int32)
        row, place = np.repeat(np.arange(len(x)), tops), np.tile(np.arange(tops), len(x))
        order = np.argsort(at.ravel(), kind="stable")
        cuts = np.searchsorted(at.ravel()[order], np.arange(len(self.top) + 1))
        for t, c in enumerate(self.below):
            w = order[cuts[t] : cuts[t + 1]]
            if len(w):
                score[row[w], place[w], : len(c)] = x[row[w]] @ c.T
                number[row[w], place[w], : len(c)] = np.arange(self.first[t], self.first[t + 1])
        score, number = score.reshape(len(x), -1), number.reshape(len(x), -1)
        m = min(m, score.shape[1])
        best = np.argpartition(-score, m - 1, axis=1)[:, :m]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(number, best, 1)


def listed(vectors: DataFrame, centres: Centres, m: int) -> DataFrame:
    """(id, v, lists): each vector with its ``m`` nearest lists, nearest first."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = centres.nearest(unit(matrix(part.column("v"))).astype(np.float32), m)
                size = np.r_[0, np.cumsum((near >= 0).sum(1))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(pa.array(size), pa.array(near[near >= 0]))], names=["id", "v", "lists"])

    return vectors.select("id", "v").mapInArrow(assign, f"id bigint, v {dict(vectors.dtypes)['v']}, lists array<int>")


def meet_lists(listed: DataFrame, kernel: Callable, stored: int, k: int) -> DataFrame:
    """(q, p, cos): what meets in the lists, the ``k`` best of each vector in each pair of blocks.

    Every vector is compared with those that stand in a list it probes; a pair met counts
    for both. The kernel gets the vectors of two blocks and gives pairs (i, j, cos) of their rows.
    """
    at = listed.select("id", "v", F.posexplode("lists").alias("rank", "list"))
    sizes = listed.select(F.posexplode("lists").alias("rank", "list")).groupBy("list").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("probing"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("rank") < stored) / BLOCK_ROWS)).cast("int").alias("standing")
    )
    h, ends = F.xxhash64("id"), F.col("rank") < stored
    # In each list blocks of what probes (x) meet blocks of what stands there (y).
    placed = at.join(F.broadcast(sizes), "list").withColumns({"own_x": F.pmod(h, "probing").cast("int"), "own_y": F.pmod(h, "standing").cast("int")})  # a row per list
    as_probe = F.transform(F.sequence(F.lit(0), F.col("standing") - 1), lambda y: F.struct(F.col("own_x").alias("x"), y.alias("y")))
    as_standing = F.transform(F.sequence(F.lit(0), F.col("probing") - 1), lambda x: F.struct(x.alias("x"), F.col("own_y").alias("y")))
    cell = F.explode(F.when(ends, F.array_union(as_probe, as_standing)).otherwise(as_probe)).alias("c")
    met = placed.select("list", cell, "id", "v", "own_x", "own_y", ends.alias("ends")).select(
        "list", "c.x", "c.y", (F.col("c.x") == F.col("own_x")).alias("probes"), (F.col("ends") & (F.col("c.y") == F.col("own_y"))).alias("stands"), "id", "v"
    )
    met = met.repartition("list", "x", "y").sortWithinPartitions("list", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "x", "y")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, s])
                if held and key != last:
                    yield from one(held)
                    held = []
                last = key
                held.append(batch.slice(s, e - s))
        if held:
            yield from one(held)

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        probes, stands, ids = (t.column(c).to_numpy() for c in ("probes", "stands", "id"))
        a, b = np.flatnonzero(probes), np.flatnonzero(stands)
        if not len(a) or not len(b):
            return
        v = unit(matrix(t.column("v").combine_chunks() if t.column("v").num_chunks != 1 else t.column("v").chunk(0)))
        i, j, cos = kernel(v, a, b)
        q, p = ids[i], ids[j]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(best(q, p, cos, k), best(p, q, cos, k), strict=True)], names=["q", "p", "cos"])

    return met.mapInArrow(run, "q bigint, p bigint, cos double")
