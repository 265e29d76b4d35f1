"""Items that appear together: basket collapsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import Stage


def plain_path(c: F.Column) -> F.Column:
    """A path in its plain spelling: forward slashes, none doubled, no leading ``./``, no blanks at the end; null if nothing is left."""
    p = F.regexp_replace(F.regexp_replace(c, r"\s+$", ""), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when(p != "", p)


def baskets(rows: DataFrame, group: str, basket: str, item: str, max_items: int) -> DataFrame:
    """Distinct item sets with the number of baskets that hold exactly them: (grp, items, w).

    An item counts once per basket; null groups, baskets and items are ignored; baskets
    of more than ``max_items`` items are left out whole. Ranks are cut at ``max_items + 1``
    while sorting, so that a huge basket is never gathered into one array.
    """
    w = Window.partitionBy("grp", "basket").orderBy("item")
    return (
        rows.select(F.col(group).alias("grp"), F.col(basket).alias("basket"), F.col(item).alias("item"))
        .where("grp IS NOT NULL AND basket IS NOT NULL AND item IS NOT NULL")
        .withColumn("r", F.dense_rank().over(w))
        .where(F.col("r") <= max_items + 1)
        .groupBy("grp", "basket")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .where(F.size("items") <= max_items)
        .groupBy("grp", "items")
        .agg(F.count("*").alias("w"))
    )


def pair_counts(collapsed: DataFrame, min_shared: int = 1) -> DataFrame:
    """Pairs of items with their joint count and measures against chance.

    Pairs are enumerated once per distinct basket and weighted; partial sums run before
    the shuffle, so a hot item costs one row per task and pair. item_a < item_b in
    code-point order.

    Returns (grp, item_a, item_b, shared, count_a, count_b, baskets, confidence_ab,
    confidence_ba, lift, conviction); conviction is null where b always follows a.
    An empty input gives no rows.
    """
    pairs = F.expr(
        "explode(flatten(transform(sequence(1, size(items) - 1),"
        " i -> transform(slice(items, i + 1, size(items)), y -> struct(items[i - 1] AS a, y AS b)))))"
    )
    shared = (
        collapsed.where(F.size("items") > 1)
        .select("grp", "w", pairs.alias("p"))
        .groupBy("grp", F.col("p.a").alias("item_a"), F.col("p.b").alias("item_b"))
        .agg(F.sum("w").alias("shared"))
        .where(F.col("shared") >= min_shared)
    )
    single = collapsed.select("grp", "w", F.explode("items").alias("item")).groupBy("grp", "item").agg(F.sum("w").alias("n"))
    total = collapsed.groupBy("grp").agg(F.sum("w").alias("baskets"))
    a = single.withColumnsRenamed({"item": "item_a", "n": "count_a"})
    b = single.withColumnsRenamed({"item": "item_b", "n": "count_b"})
    s, ra, rb, n = (F.col(x).cast("double") for x in ("shared", "count_a", "count_b", "baskets"))
    return (
        shared.join(a, ["grp", "item_a"])
        .join(b, ["grp", "item_b"])
        .join(total, "grp")
        .select(
            "grp", "item_a", "item_b", "shared", "count_a", "count_b", "baskets",
            (s / ra).alias("confidence_ab"),
            (s / rb).alias("confidence_ba"),
            (s * n / (ra * rb)).alias("lift"),
            F.when(s < ra, (1 - rb / n) / (1 - s / ra)).alias("conviction"),
        )
    )


def cochanged_files(edits: DataFrame, max_paths: int = 30, min_shared: int = 5) -> DataFrame:
    """``pair_counts`` of the paths changed by the same commit of a repo, at least ``min_shared`` times."""
    rows = edits.select("repo", "commit_id", plain_path(F.col("path")).alias("path"))
    collapsed = Stage(edits.sparkSession, "baskets").keep(baskets(rows, "repo", "commit_id", "path", max_paths), "baskets")
    return pair_counts(collapsed, min_shared)
