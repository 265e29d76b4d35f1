"""Dense vectors: ranking, neighbours, groups, components and layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import KNN
from strata.functions.vectors import dot, norm
from strata.operators import geometry, vectors
from strata.plans.inputs import UNIT
from strata.plans.registry import query
from strata.sources.tables import table

_SIM = f"{UNIT}, sm AS (SELECT x.id AS i, y.id AS j, round(list_dot_product(x.v, y.v), 9) AS s FROM vec x JOIN vec y ON x.id <> y.id), kn AS (SELECT i, j, s AS cos, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM sm QUALIFY rank <= 8)"


def unit(spark: SparkSession, d: str) -> DataFrame:
    return vectors.unit_vectors(table(spark, d, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding", "label")


def _query_vector(v: DataFrame) -> list[float]:
    return v.where("id = 0").select("v").first()[0]


@query(f"WITH {UNIT} SELECT x.id, round(list_dot_product(x.v, q.v), 9) AS score FROM vec x, (SELECT v FROM vec WHERE id = 0) q WHERE label <> 9 ORDER BY score DESC, x.id LIMIT 10")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to a query; label 9 stands for tests and is left out before ranking."""
    v = unit(spark, d)
    return vectors.top_k(v.where("label <> 9"), _query_vector(v), 10)


@query(f"WITH {_SIM} SELECT i, j, CAST(rank AS INT) AS rank, round(cos, 6) AS cos FROM kn")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(unit(spark, d), KNN).withColumn("cos", F.round("cos", 6))


@query()
def knn_lists(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of ``knn_graph`` over inverted lists; the tests measure the recall against all pairs."""
    return vectors.knn_lists(unit(spark, d), KNN).withColumn("cos", F.round("cos", 6))


@query(f"""
WITH {_SIM}, mu AS (SELECT x.i, x.j, pow(greatest(x.cos, 0), 2) AS w FROM kn x JOIN kn y ON y.i = x.j AND y.j = x.i),
lo AS (SELECT i, j, pow(greatest(cos, 0), 2) AS w FROM kn WHERE rank = 1 AND i NOT IN (SELECT i FROM mu))
SELECT i, j, round(max(w), 6) AS w FROM (SELECT * FROM mu UNION ALL SELECT * FROM lo UNION ALL SELECT j, i, w FROM lo) GROUP BY i, j
""")
def mutual_knn_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mutual_adjacency(vectors.knn(unit(spark, d), KNN)).withColumn("w", F.round("w", 6))


_GROUP = f"""{UNIT}, fl AS (SELECT label, id, unnest(v) AS x, unnest(range(64)) AS d FROM vec), su AS (SELECT label, d, sum(x) AS s, count(*) AS n FROM fl GROUP BY label, d),
co AS (SELECT fl.label, id, any_value(n) AS n, sum(x * s) - sum(x * x) AS c FROM fl JOIN su ON su.label = fl.label AND su.d = fl.d GROUP BY fl.label, id)"""


@query(f"WITH {_GROUP} SELECT label, any_value(n) AS n, round(CASE WHEN any_value(n) > 1 THEN sum(c) / (any_value(n) * (any_value(n) - 1)) ELSE 1 END, 6) AS tightness, arg_max(id, (round(c, 9), -id)) AS medoid FROM co GROUP BY label")
def group_medoid(spark: SparkSession, d: str) -> DataFrame:
    return vectors.group_cohesion(unit(spark, d), "label").withColumn("tightness", F.round("tightness", 6))


@query(f"WITH {UNIT}, sm AS (SELECT x.id AS i, y.id AS j, round(list_dot_product(x.v, y.v), 9) AS s FROM vec x JOIN vec y ON x.id <> y.id WHERE x.id % 100 = 0) SELECT i, j, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM sm) WHERE r <= 3")
def nearest_existing(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of each changed one; the queries are the ids divisible by 100, against all."""
    v = unit(spark, d)
    return vectors.knn(v, 3, v.where("id % 100 = 0")).select("i", "j", "rank")


@query(f"WITH {UNIT}, fl AS (SELECT unnest(v) AS x, unnest(range(64)) AS d FROM vec) SELECT CAST(d AS INT) AS d, count(*) AS n, round(avg(x), 9) AS mean, round(var_pop(x), 9) AS variance FROM fl GROUP BY d")
def dimension_moments(spark: SparkSession, d: str) -> DataFrame:
    return vectors.moments(unit(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean", "variance")})


@query(f"WITH {UNIT}, fl AS (SELECT unnest(v) AS x, unnest(range(64)) AS d FROM vec), va AS (SELECT d, var_pop(x) AS v FROM fl GROUP BY d) SELECT CAST(d AS INT) AS d, round(v / sum(v) OVER (), 9) AS share FROM va")
def variance_shares(spark: SparkSession, d: str) -> DataFrame:
    m = vectors.moments(unit(spark, d))
    total = m.agg(F.sum("variance")).first()[0]
    return m.select("d", F.round(F.col("variance") / F.lit(total), 9).alias("share"))


@query(f"WITH {UNIT}, f AS (SELECT id, unnest(v[1:4]) AS x, unnest(range(4)) AS d FROM vec) SELECT CAST(a.d AS INT) AS i, CAST(b.d AS INT) AS j, round(covar_pop(a.x, b.x), 9) AS cov FROM f a JOIN f b USING (id) GROUP BY a.d, b.d")
def covariance_corner(spark: SparkSession, d: str) -> DataFrame:
    """The first 4 x 4 of the covariance, which is computed whole."""
    _, _, c = vectors.covariance(unit(spark, d))
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 9)) for i in range(4) for j in range(4)], "i int, j int, cov double")


@query()
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores on eight principal components; signs and variances are checked in the tests."""
    v = unit(spark, d)
    comps, _, _, mean = vectors.principal_components(v, 8)
    return vectors.project(v, comps, mean).select("id", F.transform("pca", lambda x: F.round(x, 6)).alias("pca"))


@query("""
WITH p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
s AS (SELECT p.label, p.id, sum(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS s FROM p JOIN p q ON q.label = p.label GROUP BY p.label, p.id),
m AS (SELECT label, arg_min(id, (round(s, 9), id)) AS id FROM s GROUP BY label),
d AS (SELECT p.label, p.x, p.y, sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)) AS d FROM p JOIN m ON m.label = p.label JOIN p c ON c.id = m.id),
g AS (SELECT label, avg(x) AS x, avg(y) AS y, count(*) AS count, list_sort(list(d))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS r FROM d GROUP BY label)
SELECT label, round(x, 9) AS x, round(y, 9) AS y, count, round(r, 9) AS r FROM g WHERE count >= 4 AND r <= 0.2
""")
def label_dispersion(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return vectors.labels_by_dir(p, "label", 4, 0.2).withColumns({c: F.round(c, 9) for c in ("x", "y", "r")})


@query(f"""
WITH {UNIT}, tr AS (SELECT id, label, v[1:16] AS t FROM vec), nr AS (SELECT id, label, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS t FROM tr),
a AS (SELECT x.id AS i, y.id AS j, round(list_dot_product(x.v, y.v), 9) AS s FROM vec x JOIN vec y ON x.id <> y.id QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 5),
b AS (SELECT x.id AS i, y.id AS j, round(list_dot_product(x.t, y.t), 9) AS s, x.label = y.label AS hit FROM nr x JOIN nr y ON x.id <> y.id QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 5)
SELECT b.i, count(a.j) / 5.0 AS overlap, sum(hit::INT) / 5.0 AS precision FROM b LEFT JOIN a ON a.i = b.i AND a.j = b.j GROUP BY b.i
""")
def truncated_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Vectors cut to 16 components: how many of the five nearest stay, and how many of them share the label."""
    v = unit(spark, d)
    short = v.select("id", "label", vectors.truncated(F.col("v"), 16).alias("v"))
    whole = vectors.knn(v, 5).select("i", "j", F.lit(1).alias("kept"))
    lab = v.select("id", "label")
    near = vectors.knn(short, 5).join(lab.select(F.col("id").alias("i"), F.col("label").alias("li")), "i").join(lab.select(F.col("id").alias("j"), F.col("label").alias("lj")), "j").join(whole, ["i", "j"], "left")
    return near.groupBy("i").agg((F.sum(F.coalesce("kept", F.lit(0))) / 5.0).alias("overlap"), (F.sum((F.col("li") == F.col("lj")).cast("int")) / 5.0).alias("precision"))


@query(f"WITH {UNIT} SELECT x.label AS a, y.label AS b, round(avg(list_dot_product(x.v, y.v)), 9) AS cos FROM vec x JOIN vec y ON x.label < y.label GROUP BY ALL")
def unit_edges(spark: SparkSession, d: str) -> DataFrame:
    """Average linkage of every two labels as one dot product of their sums."""
    s = vectors.group_sums(unit(spark, d), "label")
    a, b = s.select(F.col("label").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), s.select(F.col("label").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("sa"), F.col("sb")) / (F.col("na") * F.col("nb")), 9).alias("cos"))


@query(f"WITH {UNIT} SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(v, v))), 6) AS norm FROM vec WHERE label <> 9 GROUP BY label")
def non_test_ranked(spark: SparkSession, d: str) -> DataFrame:
    return unit(spark, d).where("label <> 9").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm(F.col("v"))), 6).alias("norm"))


def _xy(spark: SparkSession, d: str, relax: bool) -> DataFrame:
    v = unit(spark, d)
    comps, _, _, mean = vectors.principal_components(v, 2)
    seeds = vectors.project(v, comps, mean)
    adj = vectors.mutual_adjacency(vectors.knn(v, KNN))
    rows, edges = geometry.one_picture(seeds), adj.toPandas()  # a point has at most KNN edges
    xy = geometry.layout_frame(rows, edges)
    if relax:
        xy[["x", "y"]] = geometry.relax(xy[["x", "y"]].to_numpy(), pd.Series(3.5 / 832, index=xy.index).to_numpy())
    return spark.createDataFrame(xy.round(6), "id bigint, x double, y double")


@query()
def layout_xy(spark: SparkSession, d: str) -> DataFrame:
    """A force-directed picture of all vectors: one sequential computation over the points of one picture."""
    return _xy(spark, d, False)


@query()
def relaxed_xy(spark: SparkSession, d: str) -> DataFrame:
    return _xy(spark, d, True)
