"""Dense vectors: top-k, k nearest neighbours, medoids, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.vectors import dot, l2_normalize
from strata.operators import lists
from strata.runtime import Stage

BLOCK = 2048


def unit_vectors(rows: DataFrame, id_col: str, vector: str, *others: str) -> DataFrame:
    """(id, others..., v): vectors of length 1 in doubles; null vectors are left out."""
    return rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), *others, l2_normalize(F.col(vector)).alias("v"))


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): the k vectors of largest dot product with a query, ties to the smaller id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("id", F.round(dot(F.col("v"), q), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn(vectors: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(i, j, rank, cos): for every query vector its k largest dot products with the others, ties to the smaller id.

    The vectors are cut into blocks by hash; every block of queries meets every block of
    vectors in a task of its own and keeps k rows per query, so a task holds two blocks
    and the shuffle k rows per query and block.
    """
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    q = (vectors if queries is None else queries).select("id", "v", own.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("y"), F.lit(True).alias("is_query"))
    c = vectors.select("id", "v", own.alias("y"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x"), F.lit(False).alias("is_query")).select(*q.columns)

    def best(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["is_query"]], f[~f["is_query"]]
        if a.empty or b.empty:
            return pd.DataFrame({"i": [], "j": [], "cos": []})
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        order = np.argsort(ib)
        ib = ib[order]
        s = np.round(np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy())[order].T, 9)
        s[ia[:, None] == ib[None]] = -np.inf
        m = min(k, len(ib))
        top = np.argsort(-s, axis=1, kind="stable")[:, :m]
        out = pd.DataFrame({"i": np.repeat(ia, m), "j": ib[top].ravel(), "cos": np.take_along_axis(s, top, 1).ravel()})
        return out[np.isfinite(out["cos"])]

    found = q.unionByName(c).groupBy("x", "y").applyInPandas(best, "i bigint, j bigint, cos double")
    w = Window.partitionBy("i").orderBy(F.desc("cos"), "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "j", "rank", "cos")


def knn_lists(vectors: DataFrame, k: int, stored: int = lists.STORED, probed: int = 2 * lists.PROBED) -> DataFrame:
    """(i, j, rank, cos): ``knn`` of unit vectors over inverted lists, for collections whose blocks cannot all meet.

    What is compared grows with n^1.5 and each vector is sent to a fixed number of lists;
    neighbours that meet in none of them are missed. Cosines are rounded to 9 decimals, ties go to the smaller id.
    """
    stage = Stage(vectors.sparkSession, "knn")
    some = stage.keep(vectors.select("id", "v"), "vectors")

    def kernel(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.round(v[a] @ v[b].T, 9)
        s[a[:, None] == b[None]] = -np.inf
        # Each row and each column keeps its best, with their ties.
        m, w = min(k, len(b)), min(k, len(a))
        row = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
        column = -np.partition(-s, w - 1, axis=0)[w - 1 : w]
        keep = ((s >= row) | (s >= column)) & np.isfinite(s)
        i, j = np.nonzero(keep)
        return a[i], b[j], s[i, j]

    met = lists.meet_lists(stage.keep(lists.listed(some, lists.Centres(*lists.sample(some)), probed), "listed"), kernel, stored, k)
    found = met.groupBy(F.col("q").alias("i"), F.col("p").alias("j")).agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("i").orderBy(F.desc("cos"), "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "j", "rank", "cos")


def mutual_adjacency(neighbours: DataFrame) -> DataFrame:
    """(i, j, w): mutual neighbours with weight max(cos, 0)^2; a node without any keeps its nearest, in both directions."""
    w = F.pow(F.greatest("cos", F.lit(0.0)), F.lit(2.0)).alias("w")
    back = neighbours.select(F.col("j").alias("i"), F.col("i").alias("j"))
    mutual = neighbours.join(back, ["i", "j"]).select("i", "j", w)
    lonely = neighbours.where("rank = 1").join(mutual.select("i").distinct(), "i", "left_anti").select("i", "j", w)
    return mutual.unionByName(lonely).unionByName(lonely.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))


def group_sums(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, s): each group's size and the sum of its vectors; a batch of rows sends one sum for each of its groups."""
    kind = dict(vectors.dtypes)[group]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                coded = b.column(0).dictionary_encode("encode")
                code = coded.indices.to_numpy()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                total = np.add.reduceat(x[order], starts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * x.shape[1]), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(code)), lists], names=[group, "n", "s"])

    parts = vectors.select(group, "v").mapInArrow(part, f"{group} {kind}, n bigint, s array<double>")
    flat = parts.select(group, "n", F.posexplode("s").alias("d", "x")).groupBy(group, "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return flat.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("s"))


def group_cohesion(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, tightness, medoid): mean pairwise cosine (1 for one member) and the member of largest cosine to all others, ties to the smaller id.

    The sum of a unit vector's cosines to its group is its dot product with the group's
    sum, so no pair is enumerated.
    """
    types = dict(vectors.dtypes)
    joined = vectors.join(group_sums(vectors, group), group).select(group, "id", "n", "v", "s")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, s = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1)) for c in ("v", "s"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (group, "id", "n")), pa.array((v * (s - v)).sum(1))], names=[group, "id", "n", "c"])

    member = joined.mapInArrow(dots, f"{group} {types[group]}, id {types['id']}, n bigint, c double")
    best = F.max_by("id", F.struct(F.round("c", 9), -F.col("id")))
    return member.groupBy(group).agg(F.max("n").alias("n"), F.sum("c").alias("t"), best.alias("medoid")).select(group, "n", F.when(F.col("n") > 1, F.col("t") / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("tightness"), "medoid")


def moments(vectors: DataFrame) -> DataFrame:
    """(d, n, mean, variance): each dimension's moments, the variance over n."""
    return vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def covariance(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance over n). Each task sends one d x d sum, whatever its rows."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, None, None
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                n, s, c = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if c is None else c)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "c": [c.ravel()]})

    got = vectors.select("v").mapInPandas(part, "n bigint, s array<double>, c array<double>").toPandas()
    if got.empty:
        return 0, np.zeros(0), np.zeros((0, 0))
    n = int(got["n"].sum())
    mean = np.sum([np.asarray(x) for x in got["s"]], axis=0) / n
    c = np.sum([np.asarray(x) for x in got["c"]], axis=0).reshape(len(mean), -1) / n
    return n, mean, c - np.outer(mean, mean)


def principal_components(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(components k x d, variances, total variance, mean). The largest loading of each is positive; beyond the rank all is zero."""
    n, mean, cov = covariance(vectors)
    d = len(mean)
    comps, var = np.zeros((k, d)), np.zeros(k)
    if n:
        value, vector = np.linalg.eigh(cov)
        order = np.argsort(-value, kind="stable")[: min(k, d)]
        for row, i in enumerate(order):
            if value[i] > 1e-12 * max(float(np.trace(cov)), 1e-300):
                v = vector[:, i]
                comps[row] = v * (1 if v[np.argmax(np.abs(np.round(v, 12)))] > 0 else -1)
                var[row] = value[i]
    return comps, var, float(np.trace(cov)) if n else 0.0, mean


def project(vectors: DataFrame, comps: np.ndarray, mean: np.ndarray) -> DataFrame:
    """(id, pca): scores on the components; k numbers per row."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "pca": list((np.stack(f["v"].to_numpy()) - mean) @ comps.T)})

    return vectors.select("id", "v").mapInPandas(score, "id bigint, pca array<double>")


def labels_by_dir(points: DataFrame, group: str, least: int = 4, most: float = 0.12) -> DataFrame:
    """(group, x, y, count, r): centroids of groups of points (id, x, y) that have a tight middle.

    The medoid has the least sum of distances, ties to the smaller id; r is the upper
    median distance to it. Groups of fewer than ``least`` points or a larger r than
    ``most`` give no label. Distances run within one group of plotted points.
    """
    p = points.select(group, "id", "x", "y")
    q = p.select(group, F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dist = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    sums = p.join(q, group).groupBy(group, "id").agg(F.sum(dist).alias("s"))
    medoid = sums.groupBy(group).agg(F.min(F.struct(F.round("s", 9).alias("s"), F.col("id"))).alias("m")).select(group, F.col("m.id").alias("id")).join(p.withColumnsRenamed({"x": "ox", "y": "oy"}), [group, "id"]).drop("id")
    d = p.join(medoid, group).groupBy(group).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("count"), F.array_sort(F.collect_list(dist)).alias("ds"))
    r = F.element_at("ds", (F.floor(F.col("count") / 2) + 1).cast("int"))
    return d.select(group, "x", "y", "count", r.alias("r")).where((F.col("count") >= least) & (F.col("r") <= most))


def truncated(v: Column, d: int) -> Column:
    """The first d components, normalised again."""
    return l2_normalize(F.slice(v, 1, d))
