"""Dense numbering of ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import Stage


def dense_ids(rows: DataFrame, *order: str, name: str = "id", stage: Stage | None = None) -> DataFrame:
    """Adds ``name``, 0, 1, 2, ... in the given order, without gathering the rows in one task.

    Rows are sorted by range and written once together with their place, a partition and
    a row of it; the sizes of the partitions are read from what was written, so both
    always speak of the same partitions. Ties in ``order`` are numbered in any order, nulls come first.
    An empty input gives no rows.
    """
    stage = stage or Stage(rows.sparkSession, "ids")
    placed = stage.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "placed")
    # monotonically_increasing_id() has the partition above bit 33 and the row within it below.
    sizes = placed.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # one row per partition
    number = (F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return placed.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(before), "_p").select(*rows.columns, number)


def rank_within(rows: DataFrame, keys: list[str], *order: str, name: str = "rank") -> DataFrame:
    """Adds ``name``, 1, 2, 3, ... in the given order within equal ``keys``, however many rows a key has: all rows are numbered by range, and each key's first number is taken off."""
    numbered = dense_ids(rows, *keys, *order, name="_n")
    first = numbered.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min("_n").alias("_f"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return numbered.join(first, same).select(*rows.columns, (F.col("_n") - F.col("_f") + 1).cast("int").alias(name))
