"""Grouping records into similarity clusters: power-iteration spectral clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strata.llm.groups import group_links
from strata.operators.components import local_stars
from strata.operators.postings import SHORT, cosine_kernel, label_vectors, meet, rare_first
from strata.runtime import Stage

VECTORS = 3
"""Vectors that are iterated together."""
ROUNDS, TURNS = 3, 2
"""Rounds of power iteration between two orthogonalisations, and how often both are done."""
FIT_ROWS = 65536
"""Rows of the embedding, the first by hash of their id, on which k-means is fitted; every row is assigned."""
CELL_ROWS = 512
"""Shapes of a cell on average, as far as the sample can tell so many cells apart (one in four of its rows)."""
SPLIT_ROWS = 1 << 16
"""Shapes of a cell that are looked at together; a larger cell is split by hash."""
KEEP = 16
"""Strongest links of a shape within one posting list, besides a spanning forest; the rest of its links add up to one weight."""
BLOCK_LINKS = 1 << 20
"""Links held in memory to find what they connect; only speed depends on it."""


def sparse_affinities(least: float):
    """The kernel of one posting list: links that keep what is connected connected, and sums over those left out.

    A link of a list is given if it is among the ``KEEP`` strongest of one of its ends or
    in a spanning forest, so that a hot list of like shapes gives rows in proportion to
    its entries, not to its pairs; a list in which no entry has more links gives all. A
    row (a, a, x) holds what a's links left out add up to, each times the copies it leads to.
    """
    every = cosine_kernel(least)

    def kernel(e: dict, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, right: np.ndarray | None):
        got = every(e, sizes, labels, weights, right)
        m = len(sizes)
        if got is None or len(got[0]) <= KEEP:
            return got
        i, j, x = got
        if np.bincount(np.r_[i, j]).max() <= KEEP:
            return got
        keep = _strongest(i, j, x, m) | _forest(i, j, m)
        p, q, y = i[~keep], j[~keep], x[~keep]
        rest = np.bincount(p, y * e["copies"][q], m) + np.bincount(q, y * e["copies"][p], m)
        own = np.flatnonzero(rest)
        return np.r_[i[keep], own], np.r_[j[keep], own], np.r_[x[keep], rest[own]]

    if KEEP >= SHORT:  # in a short list no entry has more links
        kernel.pairs = every.pairs
    return kernel


def _strongest(i: np.ndarray, j: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Marks the links that are among the ``KEEP`` strongest of one of their ends."""
    end, link = np.r_[i, j], np.r_[np.arange(len(i)), np.arange(len(j))]
    order = np.lexsort((link, -x[link], end))
    first = np.searchsorted(end[order], np.arange(m))
    rank = np.arange(len(order)) - first[end[order]]
    out = np.zeros(len(i), bool)
    out[link[order[rank < KEEP]]] = True
    return out


def _forest(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Marks the links of a spanning forest, found breadth first."""
    at = np.full((m, m), -1, np.int64)
    at[i, j] = at[j, i] = np.arange(len(i))
    seen, out = np.zeros(m, bool), np.zeros(len(i), bool)
    for root in np.unique(i):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            new = np.flatnonzero((at[front] >= 0).any(0) & ~seen)
            out[at[front[(at[np.ix_(front, new)] >= 0).argmax(0)], new]] = True
            seen[new] = True
            front = new
    return out


class ShapeClusters:
    """Clusters of records by the cosine of their label weights.

    ``rows`` has an id and ``wl``, an array of (label, w). The weights of a label that
    stands twice add up, null labels are left out, a null weight is 0. Null ids, null
    arrays and vectors without any weight are left out; an id that comes again must come
    with the same vector. Equal vectors are one shape, named by its smallest id. An
    empty input gives no rows.

    1. Affinities: pairs of shapes with a cosine of at least ``least``, by posting lists
       of the rarest labels. A shape's labels are indexed, rarest first, until those left
       cannot reach the bound together. All pairs are scored and summed; a crowded list
       gives the strongest and a spanning forest (``sparse_affinities``), and what it
       leaves out stays with the shape as a weight of its own.
    2. Power iteration: affinities with copies as weights are normalised by their row
       sums, and ``VECTORS`` vectors of hashed start values are iterated, all as columns
       of one table; after ``ROUNDS`` rounds they are made orthogonal again, by the
       Cholesky factor of their weighted moments, which come with the table.
    3. Two-level k-means of the iterated vectors gives every shape a cell; the number of
       cells grows with that of the shapes. Within what is linked the vectors converge to
       one point, so a cluster lies in one cell, or in few.
    4. Clusters come out of the cells: each cell's links are merged to stars in one task,
       a crowded cell's in several. The check that makes the result exact joins stars
       that share a shape, with the p1 operator; where the vectors have converged there
       are none. What comes out are the records that are linked, directly or through others.

    ``members`` is (id, rep), ``links`` (a, b, x) with the cosine x, ``rest`` (rep, w)
    the affinity of links left out; ``clusters()`` gives all records of clusters of two or more.
    """

    def __init__(self, rows: DataFrame, id_col: str = "id", wl: str = "wl", least: float = 0.60):
        stage = self.stage = Stage(rows.sparkSession, "shapes")
        every = stage.keep(label_vectors(rows, id_col, wl), "vectors")
        shapes = stage.keep(every.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.max("n").alias("n"), F.any_value("labels").alias("labels"), F.any_value("ws").alias("ws")), "shapes")
        self.shapes = shapes.select("rep", "copies")
        self.members = stage.keep(every.select("id", "f1", "f2").distinct().join(shapes.select("f1", "f2", "rep", "copies"), ["f1", "f2"]).select("id", "rep", "copies"), "members")
        stage.drop(every)
        flat = shapes.select("rep", "n", "copies", F.explode(F.arrays_zip("labels", "ws")).alias("e")).select("rep", "n", "copies", F.col("e.labels").alias("label"), F.col("e.ws").alias("w"))
        tokens = rare_first(flat, stage, "copies").withColumn("ratio", F.lit(least * least * (1 - 1e-9)))
        found = stage.keep(meet(tokens, sparse_affinities(least), carry=("copies",)), "links")
        self.links = found.where("a <> b")
        self.rest = found.where("a = b").select(F.col("a").alias("rep"), F.col("x").alias("w"))

    def affinities(self) -> DataFrame:
        """(src, dst, w, own): links in both directions, weighted by the copies at ``dst``, with the copies at ``src``."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("copies_b").alias("k"), F.col("copies_a").alias("own")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("copies_a").alias("k"), F.col("copies_b").alias("own"))))
        return self.links.select(ends.alias("e"), "x").select("e.src", "e.dst", (F.col("x") * F.col("e.k")).alias("w"), "e.own")

    def embedding(self) -> DataFrame:
        """(rep, x0, x1, ...): the iterated vectors of every shape that has a link."""
        linked = self.affinities()
        own = linked.groupBy("src").agg(F.max("own").cast("double").alias("w")).unionByName(self.rest.withColumnRenamed("rep", "src")).select("src", F.col("src").alias("dst"), "w")
        edges = self.stage.keep(linked.select("src", "dst", "w").unionByName(own), "affinities")
        xs = [f"x{k}" for k in range(VECTORS)]
        x = edges.where("src = dst").select(F.col("src").alias("rep")).distinct().select("rep", *((F.pmod(F.xxhash64("rep", F.lit(k)), F.lit(1 << 20)) / (1 << 20)).alias(c) for k, c in enumerate(xs)))
        for _ in range(TURNS):
            for _ in range(ROUNDS):
                # A partition of the vectors is far smaller than one of the affinities: it fits in memory, and no affinity has to be sorted.
                met = edges.join(x.select(F.col("rep").alias("dst"), *xs).hint("shuffle_hash"), "dst")
                x = met.groupBy(F.col("src").alias("rep")).agg(F.sum("w").alias("degree"), *((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in xs))
            seen = Observation()
            moments = [F.count("*").alias("n"), F.sum("degree").alias("d"), *(F.sum(F.col("degree") * F.col(c)).alias(c) for c in xs), *(F.sum(F.col("degree") * F.col(c) * F.col(e)).alias(c + e) for c in xs for e in xs)]
            x = self.stage.keep(x.observe(seen, *moments), "x")
            self.linked = seen.get["n"]
            mean, turn = _orthogonal(seen.get, xs)
            x = x.select("rep", *(sum(((F.col(e) - mean[j]) * turn[i, j] for j, e in enumerate(xs)), F.lit(0.0)).alias(c) for i, c in enumerate(xs)))
        return x.select("rep", *xs)

    def cells(self) -> DataFrame:
        """(rep, cell): k-means of the embedding."""
        x = self.embedding()
        xs = x.columns[1:]
        got = x.select(*xs, F.xxhash64("rep").alias("o"), "rep").orderBy("o", "rep").limit(FIT_ROWS).select(*xs).toArrow()
        sample = np.stack([got.column(c).to_numpy() for c in xs], 1)
        tree = _Cells(sample, max(1, min(self.linked // CELL_ROWS, len(sample) // 4)))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in batches:
                cell = tree(np.stack([f.column(c).to_numpy(zero_copy_only=False) for c in xs], 1))
                yield pa.RecordBatch.from_arrays([f.column("rep"), pa.array(cell.astype(np.int32))], names=["rep", "cell"])

        return x.mapInArrow(assign, "rep bigint, cell int")

    def solve(self) -> DataFrame:
        """(rep, cluster_id) of the shapes that have a link."""
        cells = self.stage.keep(self.cells(), "cells")
        splits = cells.groupBy("cell").agg(F.ceil(F.count("*") / SPLIT_ROWS).alias("splits"))  # a row per cell, at most FIT_ROWS / 4
        placed = cells.join(F.broadcast(splits), "cell").select(F.col("rep").alias("a"), "cell", F.pmod(F.xxhash64("rep"), "splits").alias("split"))
        inside = self.links.select("a", "b").join(placed, "a").repartition("cell", "split").select("a", "b")

        def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= BLOCK_LINKS:
                    yield star(held)
                    held, n = [], 0
            if n:
                yield star(held)

        def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in local_stars(t.column("a").to_numpy(), t.column("b").to_numpy())], names=["rep", "root"])

        of = self.stage.keep(inside.mapInArrow(stars, "rep bigint, root bigint").groupBy("rep").agg(F.min("root").alias("root"), F.max("root").alias("other"), F.collect_set("root").alias("roots")), "stars")
        several = of.where("root <> other").select("root", F.explode("roots").alias("other"))
        joined = group_links(several, "root", "other", self.stage)
        return of.select("rep", "root").join(joined.withColumnRenamed("id", "root"), "root", "left").select("rep", F.coalesce("group_id", "root").alias("cluster_id"))

    def clusters(self) -> DataFrame:
        """(id, rep, cluster_id) of the records of clusters of two or more; ``cluster_id`` is the smallest id."""
        return self.members.join(self.solve(), "rep", "left").where("cluster_id IS NOT NULL OR copies > 1").select("id", "rep", F.coalesce("cluster_id", "rep").alias("cluster_id"))

    def typical(self, k: int = 3) -> DataFrame:
        """(cluster_id, size, typical): each cluster's size and its ``k`` members of highest internal affinity, ties to the smaller id.

        A member's internal affinity is the sum of its cosines with the members it is linked to.
        """
        sums = self.affinities().select(F.col("src").alias("rep"), "w").unionByName(self.rest).groupBy("rep").agg(F.sum("w").alias("affinity"))
        member = self.clusters().join(self.shapes, "rep").join(sums, "rep", "left").select("id", "cluster_id", F.round(F.coalesce("affinity", F.lit(0.0)) + F.col("copies") - 1, 9).alias("affinity"))
        ranked = member.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("affinity"), "id")))
        top = ranked.where(F.col("r") <= k).groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
        return member.groupBy("cluster_id").agg(F.count("*").alias("size")).join(top, "cluster_id")


def _orthogonal(moments: dict, xs: list[str]) -> tuple[list[float], np.ndarray]:
    """Means, and the inverse of the Cholesky factor of the covariance; a vector that depends on those before it becomes 0."""
    k = len(xs)
    total = moments["d"]
    if not total:
        return [0.0] * k, np.eye(k)
    mean = [moments[c] / total for c in xs]
    cov = np.array([[moments[c + e] / total - mean[i] * mean[j] for j, e in enumerate(xs)] for i, c in enumerate(xs)])
    out, least = np.zeros((k, k)), 1e-14 * max(np.trace(cov), 1e-300)
    for i in range(k):
        row = np.eye(k)[i]
        for r in out[:i]:
            row = row - (row @ cov @ r) * r
        size = row @ cov @ row
        if size > least:
            out[i] = row / np.sqrt(size)
    return mean, out


class _Cells:
    """Two levels of k-means: about the square root of ``k`` centres, and under each its share of ``k``."""

    def __init__(self, sample: np.ndarray, k: int):
        self.top = _kmeans(sample, max(1, round(k**0.5))) if len(sample) else np.zeros((1, VECTORS))
        near = _nearest(sample, self.top)
        self.below = [_kmeans(part, max(1, round(k * len(part) / len(sample)))) if len(part := sample[near == t]) else self.top[t : t + 1] for t in range(len(self.top))]
        self.first = np.cumsum([0, *map(len, self.below)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        near = _nearest(x, self.top)
        out = np.empty(len(x), np.int64)
        for t in np.unique(near):
            at = np.flatnonzero(near == t)
            out[at] = self.first[t] + _nearest(x[at], self.below[t])
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((x[i : i + 1024, None, :] - c[None]) ** 2).sum(2).argmin(1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means, started from rows spread evenly along the first coordinate."""
    c = x[np.argsort(x[:, 0], kind="stable")][np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        ids, at, size = np.unique(near[order], return_index=True, return_counts=True)
        c[ids] = np.add.reduceat(x[order], at, axis=0) / size[:, None]
    return c
