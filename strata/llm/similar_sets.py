"""Near-duplicate records with small edits: an exact set join by set-relation skipping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.groups import group_links
from strata.operators.postings import ListMatrix, fingerprint, meet, rare_first
from strata.runtime import Stage

SKIP_BLOCK = 64
"""Entries of a list that are skipped together."""


def _similar(num: int, den: int):
    """The kernel of one list: pairs whose intersection is at least num / den of their union.

    Entries stand in the order of their element's position. They fall into blocks; a
    block whose entries have too few elements left behind that position for any overlap
    that would do is skipped whole. Sets are taken in the order of their elements, rarest
    first, so that similar ones follow each other. Each block keeps the overlaps that were
    last computed for it; for the next set they are derived from these by the elements in
    which the two sets differ, or, where these are too many, computed anew.
    """

    def kernel(e: dict, sizes: np.ndarray, labels: np.ndarray, _w, right: np.ndarray | None):
        n, pos = e["n"].astype(np.int64), e["pos"]
        m = len(pos)
        mat = ListMatrix(sizes, labels, pos)
        has = mat.has
        left_over = sizes - pos  # of the elements that can be shared, from the list's element on
        columns = np.asfortranarray(has, dtype=np.int16)
        order = np.lexsort(has.T[::-1])  # sets that begin alike follow each other, so little has to be derived anew
        if right is not None:
            order = order[~right[order]]
        other = np.arange(m) if right is None else np.flatnonzero(right)
        cuts = list(range(0, len(other), SKIP_BLOCK)) + [len(other)]
        blocks = [other[s:t] for s, t in zip(cuts[:-1], cuts[1:], strict=True)]
        most = [left_over[b].max() for b in blocks]
        least = [n[b].min() for b in blocks]
        parts = [columns[b] for b in blocks]
        known: list[tuple[int, np.ndarray] | None] = [None] * len(blocks)
        out_i, out_j, out_o = [], [], []
        for i in order:
            for k, b in enumerate(blocks):
                if right is None and b[0] > i:
                    break  # each pair once, from its later entry
                if min(left_over[i], most[k]) * (num + den) < num * (n[i] + least[k]):
                    continue
                was = known[k]
                if was is not None:
                    more, less = np.flatnonzero(has[i] & ~has[was[0]]), np.flatnonzero(has[was[0]] & ~has[i])
                if was is None or 2 * (len(more) + len(less)) > sizes[i]:
                    overlap = parts[k][:, has[i]].sum(1)
                elif len(more) + len(less) == 0:
                    overlap = was[1]
                else:
                    overlap = was[1] + parts[k][:, more].sum(1) - parts[k][:, less].sum(1)
                known[k] = (i, overlap)
                hit = overlap * (num + den) >= num * (n[i] + n[b])
                if right is None:
                    hit &= b < i
                j = b[hit]
                if len(j):
                    out_i.append(np.full(len(j), i))
                    out_j.append(j)
                    out_o.append(overlap[hit])
        if not out_i:
            return None
        i, j, o = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_o)
        keep = mat.first(i, j)
        return i[keep], j[keep], o[keep].astype(np.int64)

    return kernel


class SimilarSets:
    """Records whose sets share at least ``num / den`` of their union.

    ``rows`` has an id and an array of elements. Null ids and null arrays are left out, as
    are null elements and repeated ones; an empty set is similar to nothing, not even to
    another empty set. An id that comes again must come with the same set. Equal sets are
    joined once, by their smallest id. An empty input gives no rows.

    ``members`` is (id, rep, copies): each record, the smallest id that has its set, and
    how many ids have it. ``links`` is (a, b, x): pairs of different sets, by those ids,
    and the number of elements they share.
    """

    def __init__(self, rows: DataFrame, id_col: str, elements: str, num: int = 3, den: int = 4):
        stage = Stage(rows.sparkSession, "sets")
        every = (
            rows.where(F.col(id_col).isNotNull() & F.col(elements).isNotNull())
            .select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.filter(F.col(elements), lambda x: x.isNotNull()))).alias("s"))
            .where(F.size("s") > 0)
            .select("id", "s", *fingerprint("s"))
        )
        sets = stage.keep(every.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.any_value("s").alias("s")), "reps")
        self.members = stage.keep(every.select("id", "f1", "f2").distinct().join(sets.select("f1", "f2", "rep", "copies"), ["f1", "f2"]).select("id", "rep", "copies"), "members")
        flat = sets.select("rep", F.size("s").alias("n"), F.explode("s").alias("label"), F.lit(None).cast("double").alias("w"))
        tokens = rare_first(flat, stage)
        need = F.ceil(F.col("n") * num / den - 1e-9)
        p = F.col("n") - need + 1 - (F.col("n") - F.size("toks"))
        pairs = meet(tokens.withColumn("p", F.least(F.greatest(p, F.lit(0)), F.size("toks")).cast("int")), _similar(num, den), "bigint", weighted=False)
        self.links = stage.keep(pairs, "links")
        self.stage = stage

    def pairs(self) -> DataFrame:
        """All pairs of records (a_id, b_id), a_id < b_id, copies expanded."""
        m = self.members
        a, b = m.select(F.col("rep").alias("a"), F.col("id").alias("i")), m.select(F.col("rep").alias("b"), F.col("id").alias("j"))
        apart = self.links.select("a", "b").join(a, "a").join(b, "b").select("i", "j")
        many = m.where("copies > 1")
        equal = many.select("rep", F.col("id").alias("i")).join(many.select("rep", F.col("id").alias("j")), "rep").where("i < j").select("i", "j")
        return apart.unionByName(equal).select(F.least("i", "j").alias("a_id"), F.greatest("i", "j").alias("b_id"))

    def groups(self) -> DataFrame:
        """One row per record: (id, group_id, links). Records without a similar one are their own group, with 0 links."""
        copies = self.members.select("rep", "copies").distinct()
        both = self.links.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(self.links.select(F.col("b").alias("rep"), F.col("a").alias("o")))
        linked = both.join(copies.withColumnRenamed("rep", "o"), "o").groupBy("rep").agg(F.sum("copies").alias("others"))
        group = group_links(self.links, "a", "b", self.stage).withColumnRenamed("id", "rep")
        return (
            self.members.join(linked, "rep", "left")
            .join(group, "rep", "left")
            .select("id", F.coalesce("group_id", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("links"))
        )


def similar_symbols(symbols: DataFrame, num: int = 3, den: int = 4) -> SimilarSets:
    """``SimilarSets`` of the labels of ``wl``; weights do not matter."""
    return SimilarSets(symbols.select("id", F.transform("wl", lambda e: e["label"]).alias("labels")), "id", "labels", num, den)
