"""Resolving a name to a symbol, and the card of one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_name(symbols: DataFrame, name: str, top: int = 12) -> DataFrame:
    """(id, tier, ambiguous, n): candidates of the first tier that matches.

    Tier 1 is the qualified name, tier 2 a dotted suffix, tier 3 a substring without
    case. More than one candidate is ambiguous; of these the first ``top``, non-test
    first, then by more nodes, file, line and id. No match, no rows.
    """
    q = F.col("qname")
    tier = F.when(q == name, 1).when(q.endswith("." + name), 2).when(F.instr(F.lower(q), name.lower()) > 0, 3)
    hit = symbols.withColumn("tier", tier).where("tier IS NOT NULL")
    count = hit.groupBy("tier").agg(F.count("*").alias("n"))
    best = count.agg(F.min("tier").alias("tier"))
    found = hit.join(count.join(best, "tier"), "tier")
    order = [F.coalesce("is_test", F.lit(False)), F.desc("node_count"), "file", "line", "id"]
    return found.orderBy(*order).limit(top).select("id", "tier", (F.col("n") > 1).alias("ambiguous"), "n")


def innermost(symbols: DataFrame, file: str, line: int) -> DataFrame:
    """Symbols around ``file:line``, the innermost of each matching file; several files are ambiguous."""
    f = F.col("file")
    at = symbols.where((f == file) | f.endswith("/" + file)).where((F.col("line") <= line) & (F.col("last_line") >= line))
    w = Window.partitionBy("file").orderBy(F.col("last_line") - F.col("line"), "id")
    return at.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def ambiguous(symbols: DataFrame, ids: list[int], n: int) -> str:
    """The candidates of a target that means more than one symbol, in their order, and how many more there are."""
    rows = {r["id"]: r for r in symbols.where(F.col("id").isin(ids)).select("id", "file", "line", "qname", "node_count").collect()}
    lines = [f"  {r['file']}:{r['line']}  {r['qname']}  ({r['node_count']} nodes)" for r in (rows[i] for i in ids)]
    return "\n".join([f"{n} symbols match; name one by FILE:LINE", *lines, *([f"  +{n - len(ids)} more"] if n > len(ids) else [])])
