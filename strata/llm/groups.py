"""Consolidating pairwise matches into groups: deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.runtime import Stage

HOT, SALTS = 1_000_000, 64
"""Links from which an id is a hub, and how many tasks its links are spread over. Of n links, at most 2 n / HOT ids are hubs."""


def list_links(lists: DataFrame, column: str) -> DataFrame:
    """Links (a, b) that connect all non-null elements of each list: from its smallest element to every other one."""
    members = F.array_distinct(F.filter(F.col(column), lambda x: x.isNotNull()))
    return (
        lists.select(members.alias("m"))
        .where(F.size("m") > 1)
        .select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
        .where("a <> b")
    )


def group_links(links: DataFrame, a: str = "a", b: str = "b", stage: Stage | None = None) -> DataFrame:
    """Gives every id linked to another one, directly or through others, the smallest id of its group.

    Each round every component takes its smallest outgoing edge. Edges are ordered by
    (smaller end, larger end), so that edge leads to the smallest neighbour, the only
    cycles are two components that chose each other, and of these the smaller becomes
    the root. Trees collapse by pointer doubling; edges are relabelled and deduplicated;
    rounds end when no edge is left. A round at least halves the components that have
    edges, and every tree's root is its smallest id.

    Nulls in either end, links of an id to itself and repeated or reversed links are
    ignored. An empty input gives no rows. Other columns of ``links`` are not read.

    Returns (id, group_id).
    """
    stage = stage or Stage(links.sparkSession, "groups")
    edges, left = _edges(
        links.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a IS NOT NULL AND _b IS NOT NULL AND _a <> _b")
        .select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))
        .distinct(),
        stage,
    )
    maps: list[DataFrame] = []
    while left:
        parent, hubs = _collapse(edges, stage)
        maps.append(parent)
        to = _follow(_follow(edges, "u", parent, hubs).withColumnRenamed("_next", "pu"), "v", parent, hubs).withColumnRenamed("_next", "pv")
        relabelled, left = _edges(to.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), stage)
        stage.drop(edges)
        edges = relabelled
    if not maps:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    # The last round's map is the smallest; carried back, each round's map is read once.
    final = maps.pop()
    while maps:
        earlier = maps.pop()
        later = final.select(F.col("id").alias("p"), F.col("p").alias("root"))
        final = earlier.join(later, "p", "left").select("id", F.coalesce("root", "p").alias("p"))
    return final.select("id", F.col("p").alias("group_id"))


def _edges(edges: DataFrame, stage: Stage) -> tuple[DataFrame, int]:
    """The edges, written, and how many there are."""
    seen = Observation()
    kept = stage.keep(edges.observe(seen, F.count("*").alias("n")), "edges")
    return kept, seen.get["n"]


def _follow(rows: DataFrame, key: str, parent: DataFrame, hubs: int) -> DataFrame:
    """The rows with ``_next``, the parent of what ``key`` names. Rows of a hub are spread over ``SALTS`` tasks, each with a copy of its parent."""
    up = parent.select(F.col("id").alias(key), F.col("p").alias("_next"), (F.col("links") >= HOT).alias("_hub"))
    if not hubs:
        return rows.join(up.drop("_hub"), key)
    known = F.broadcast(up.where("_hub").select(key, "_hub"))  # as few as HOT allows
    salt = F.when(F.col("_hub"), F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(SALTS))).otherwise(0)
    spread = up.select(key, "_next", F.explode(F.when(F.col("_hub"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))).alias("_salt"))
    return rows.join(known, key, "left").withColumn("_salt", salt.cast("bigint")).join(spread, [key, "_salt"]).drop("_salt", "_hub")


def _hook(edges: DataFrame) -> DataFrame:
    """(id, p, links): the smallest neighbour of every component; of two that chose each other the smaller is its own, a root."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("n")), F.struct(F.col("v").alias("id"), F.col("u").alias("n")))).alias("e")).select("e.id", "e.n")
    chosen = both.groupBy("id").agg(F.min("n").alias("p"), F.count("*").alias("links"))
    # In a mutual choice the smaller end chose a larger id, and is the smallest of those that chose it.
    up = chosen.where("p > id").groupBy(F.col("p").alias("id")).agg(F.min("id").alias("by"))
    back = chosen.join(up, "id").where("p = by").select(F.col("by").alias("id"), F.lit(True).alias("root"))
    return chosen.join(back, "id", "left").select("id", F.when(F.col("root"), F.col("id")).otherwise(F.col("p")).alias("p"), "links")


def _collapse(edges: DataFrame, stage: Stage) -> tuple[DataFrame, int]:
    """(id, p, links) with parents pointing at roots, and the number of hubs. Each pass goes up four steps, two doublings, and ends where the last of them led nowhere."""
    seen = Observation()
    parent = stage.keep(_hook(edges).observe(seen, F.count_if(F.col("links") >= HOT).alias("hubs")), "hook")
    hubs = seen.get["hubs"]
    while True:
        seen, step = Observation(), parent
        for k in range(3):
            step = _follow(step.withColumnRenamed("p", f"p{k}"), f"p{k}", parent, hubs).withColumnRenamed("_next", "p")
        moved = F.max(F.col("p") != F.col("p2")).alias("moved")
        out = stage.keep(step.observe(seen, moved).select("id", "p", "links"), "parent")
        stage.drop(parent)
        parent = out
        if not seen.get["moved"]:
            return parent, hubs


def match_groups(uf_parent: DataFrame, repeated_clusters: DataFrame) -> DataFrame:
    """Groups over parent entries (id, parent) and member lists (members), as (sym_id, group_id)."""
    links = uf_parent.select(F.col("id").alias("a"), F.col("parent").alias("b")).unionByName(list_links(repeated_clusters, "members"))
    return group_links(links).select(F.col("id").alias("sym_id"), "group_id")
