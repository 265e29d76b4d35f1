"""Posting lists, rarest elements first: what joins on sets and on sparse vectors have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.ids import dense_ids
from strata.runtime import Stage

LIST_BLOCK = 512
"""Entries of a block of a long posting list; blocks meet pairwise, in tasks of their own."""


def fingerprint(*cols: str) -> list[Column]:
    """128 bits that stand for the values of the columns."""
    return [F.xxhash64(F.lit("a"), *cols).alias("f1"), F.xxhash64(F.lit("b"), *cols).alias("f2")]


def label_vectors(rows: DataFrame, id_col: str = "id", wl: str = "wl") -> DataFrame:
    """(id, labels, ws, n, f1, f2) of rows with an array of (label, w): sparse vectors by ascending label, their squared length and 128 bits that stand for them.

    Weights of a label that stands twice add up, null labels are left out, as are labels
    whose weight is null or comes to 0. Rows with a null id or array, without any weight
    or with one that is not finite are left out.
    """
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wl")
            entries = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ok = entries.is_valid().to_numpy(zero_copy_only=False) & entries.field("label").is_valid().to_numpy(zero_copy_only=False)
            row, label = row[ok], entries.field("label").to_numpy(zero_copy_only=False)[ok].astype(np.int64)
            w = entries.field("w").to_numpy(zero_copy_only=False)[ok]
            w = np.where(entries.field("w").is_null().to_numpy(zero_copy_only=False)[ok], 0.0, w)
            order = np.lexsort((w, label, row))
            row, label, w = row[order], label[order], w[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])]) if len(row) else np.zeros(0, np.int64)
            row, label, w = row[first], label[first], np.add.reduceat(w, first) if len(first) else w
            row, label, w = row[w != 0], label[w != 0], w[w != 0]
            n = np.bincount(row, w * w, len(lists))
            bits = [np.zeros(len(lists), np.uint64) for _ in range(2)]
            for k, out in enumerate(bits):
                np.add.at(out, row, _mix(_mix(label.view(np.uint64) + np.uint64(k)) ^ w.view(np.uint64)))
            good = np.flatnonzero((n > 0) & np.isfinite(n))
            size = np.bincount(row, minlength=len(lists))
            at = np.r_[0, np.cumsum(size)].astype(np.int32)
            whole = [pa.ListArray.from_arrays(pa.array(at), pa.array(c)) for c in (label, w)]
            every = pa.RecordBatch.from_arrays([batch.column("id"), *whole, pa.array(n), *(pa.array(x.view(np.int64)) for x in bits)], names=["id", "labels", "ws", "n", "f1", "f2"])
            yield every.take(pa.array(good))

    pick = rows.where(F.col(id_col).isNotNull() & F.col(wl).isNotNull()).select(F.col(id_col).alias("id"), F.col(wl).cast("array<struct<label:bigint,w:double>>").alias("wl"))
    return pick.mapInArrow(run, f"id {kind}, labels array<bigint>, ws array<double>, n double, f1 bigint, f2 bigint")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    for k, r in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(r))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def rare_first(flat: DataFrame, stage: Stage, *carry: str) -> DataFrame:
    """(rep, n, toks, carried columns): each row's elements that also occur in another row, rarest first.

    ``flat`` has a row (rep, n, label, w) for each element of each row. Elements are
    numbered from the rarest on, so that lists hold small numbers whatever the labels
    are. Elements of one row only can link nothing; they count in n alone. Rows left
    without elements are left out.
    """
    df = stage.keep(flat.groupBy("label").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "df")
    named = dense_ids(df, "df", "label", name="no", stage=stage)
    return flat.join(named, "label").groupBy("rep").agg(*(F.max(c).alias(c) for c in ("n", *carry)), F.sort_array(F.collect_list(F.struct("df", F.col("no").alias("label"), "w"))).alias("toks"))


def meet(rows: DataFrame, kernel: Callable, value: str = "double", weighted: bool = True, carry: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Runs ``kernel`` over every posting list, or pair of blocks of a long list.

    ``rows`` has rep, n, toks (rarest first), the columns to ``carry`` and either p, how many of toks are
    indexed, or ``ratio``: then all are indexed until the squared weights left are a
    smaller part of n. With ``most``, only elements of at most so many rows are. Weights
    travel along only if ``weighted``. A list is cut by the number of rows its element
    occurs in. The kernel gets the columns of one list's entries as numpy arrays and
    gives linked entries (i, j) with a value; a list's entries are contiguous in a sorted
    partition, so no list is ever gathered beyond two blocks. A kernel with ``pairs`` gets
    the pairs of all short lists of a batch at once.

    Returns (a, b, x) with a <= b, and the carried columns of both as ``name_a`` and ``name_b``.
    """
    kept = ["n", *carry]
    types = dict(rows.dtypes)
    given = "p" if "p" in rows.columns else "ratio"
    posted = rows.select("rep", F.xxhash64("rep").alias("h"), F.col(given).alias("upto"), *kept, "toks").mapInArrow(
        lambda batches: _post(batches, given == "p", weighted, kept, most),
        f"tok {types['toks'].split('label:')[1].split(',')[0]}, x int, y int, right boolean, rep {types['rep']}, pos int, {', '.join(f'{c} {types[c]}' for c in kept)}, labels array<{types['toks'].split('label:')[1].split(',')[0]}>, ws array<double>",
    )
    met = posted.repartition("tok", "x", "y").sortWithinPartitions("tok", "x", "y", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            t = t.combine_chunks()
            starts = _starts(t)
            yield from _lists(t, starts[:-1], starts[1:], kept, carry, kernel)
            rest = t.slice(int(starts[-1])) if t.num_rows else None
        if rest is not None:
            rest = rest.combine_chunks()
            starts = _starts(rest)
            yield from _lists(rest, starts, np.r_[starts[1:], rest.num_rows].astype(int), kept, carry, kernel)

    return met.mapInArrow(run, f"a {types['rep']}, b {types['rep']}, x {value}" + "".join(f", {c}_a {types[c]}, {c}_b {types[c]}" for c in carry))


def _post(batches: Iterator[pa.RecordBatch], counted: bool, weighted: bool, kept: list[str], most: int | None) -> Iterator[pa.RecordBatch]:
    """The entries of rows in the lists, and blocks of lists, of their first elements."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            b = batch.slice(at, 1024)
            toks = b.column("toks")
            flat = toks.flatten()
            sizes = np.diff(toks.offsets.to_numpy())
            start = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            df, label = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("df", "label"))
            pos = np.arange(len(row)) - start[row]
            upto = b.column("upto").to_numpy(zero_copy_only=False)
            if counted:
                index = pos < upto[row]
            else:
                part = flat.field("w").to_numpy(zero_copy_only=False) ** 2 / b.column("n").to_numpy(zero_copy_only=False)[row]
                done = np.cumsum(part)
                total = np.bincount(row, part, len(sizes))
                index = total[row] - (done - part - (done[start] - part[start])[row]) >= upto[row] if len(row) else np.zeros(0, bool)
            if most is not None:
                index &= df <= most
            row, label, pos, blocks = row[index], label[index], pos[index], -(-df[index] // LIST_BLOCK)
            own = b.column("h").to_numpy()[row] % blocks
            other = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            row, label, pos, own = (np.repeat(c, blocks) for c in (row, label, pos, own))
            take = pa.array(row)
            labels = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat.field("label"))
            ws = pa.ListArray.from_arrays(labels.offsets, flat.field("w")).take(take) if weighted else pa.ListArray.from_arrays(pa.array(np.zeros(len(row) + 1, np.int32)), pa.array(np.zeros(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(label), pa.array(np.minimum(own, other).astype(np.int32)), pa.array(np.maximum(own, other).astype(np.int32)), pa.array(own > other), b.column("rep").take(take), pa.array(pos.astype(np.int32)), *(b.column(c).take(take) for c in kept), labels.take(take), ws],
                names=["tok", "x", "y", "right", "rep", "pos", *kept, "labels", "ws"],
            )


LINKS = 1 << 14
"""Links handed on at once where lists are carried along."""

SHORT = 16
"""Entries of a list up to which its pairs are looked at together with those of other lists."""


def _short_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of entries of the lists of up to ``SHORT`` entries."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, SHORT + 1):
        s = starts[sizes == m]
        i, j = np.triu_indices(m, 1)
        left.append((s[:, None] + i).ravel())
        right.append((s[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _starts(t: pa.Table) -> np.ndarray:
    keys = [t.column(k).to_numpy() for k in ("tok", "x", "y")]
    change = np.zeros(t.num_rows, bool)
    if t.num_rows:
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _lists(t: pa.Table, starts: np.ndarray, ends: np.ndarray, kept: list[str], carry: tuple[str, ...], kernel: Callable) -> Iterator[pa.RecordBatch]:
    if not len(starts):
        return
    column = {k: t.column(k).combine_chunks() for k in ("rep", "pos", "right", "x", "y", *kept)}
    value = {k: v.to_numpy(zero_copy_only=False) for k, v in column.items() if not pa.types.is_nested(v.type)}
    lists = t.column("labels").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    at = lists.offsets.to_numpy()
    labels = lists.values.to_numpy(zero_copy_only=False)
    ws = t.column("ws").combine_chunks()
    if isinstance(ws, pa.ChunkedArray):
        ws = ws.chunk(0)
    w_at, weights = ws.offsets.to_numpy(), ws.values.to_numpy(zero_copy_only=False)
    found = []
    if pairs := getattr(kernel, "pairs", None):
        short = (ends - starts <= SHORT) & (value["x"][starts] == value["y"][starts])
        i, j = _short_pairs(starts[short], (ends - starts)[short])
        if len(i):
            found.append(pairs(value, i, j, at, labels, weights, w_at))
        starts, ends = starts[~short], ends[~short]
    for s, e in zip(starts, ends, strict=True):
        if e - s < 2:
            continue
        same = value["x"][s] == value["y"][s]
        right = value["right"][s:e]
        if not same and (right.all() or not right.any()):
            continue
        sizes = np.diff(at[s : e + 1])
        part = {k: value[k][s:e] for k in ("rep", "pos", *kept) if k in value}
        got = kernel(part, sizes, labels[at[s] : at[e]], weights[w_at[s] : w_at[e]], None if same else right)
        if got is not None:
            found.append((got[0] + s, got[1] + s, got[2]))
    if found:
        i, j, x = (np.concatenate(c) for c in zip(*found, strict=True))
        rep = value["rep"]
        swap = rep[i] > rep[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        step = LINKS if len(value) < len(column) else max(len(i), 1)
        for at in range(0, len(i), step):
            sides = [("a", i[at : at + step]), ("b", j[at : at + step])]
            yield pa.RecordBatch.from_arrays(
                [*(column["rep"].take(pa.array(k)) for _, k in sides), pa.array(x[at : at + step]), *(column[c].take(pa.array(k)) for c in carry for _, k in sides)],
                names=["a", "b", "x", *(f"{c}_{name}" for c in carry for name, _ in sides)],
            )


class ListMatrix:
    """The elements that at least two entries of a list have, as columns; and which of them stand before the list's own element."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, pos: np.ndarray, weights: np.ndarray | None = None):
        m = len(sizes)
        row = np.repeat(np.arange(m), sizes)
        _, col, count = np.unique(labels, return_inverse=True, return_counts=True)
        keep = count[col] > 1
        number = np.cumsum(count > 1) - 1
        row, col = row[keep], number[col[keep]]
        width = int(number[-1]) + 1
        self.has = np.zeros((m, width), bool)
        self.has[row, col] = True
        place = (np.arange(len(labels)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[keep]
        self.before = np.zeros((m, width), bool)
        early = place < pos[row]
        self.before[row[early], col[early]] = True
        if weights is not None:
            self.w = np.zeros((m, width))
            self.w[row, col] = weights[keep]

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the list's element is the first one that the entries have in common; a pair counts in that list only."""
        return ~(self.before[i] & self.before[j]).any(1)


SLACK = 1e-12
"""A cosine this much below the bound is rounding."""


def cosine_kernel(least: float):
    """The kernel of one posting list of sparse vectors: pairs whose cosine is at least ``least``; n is a vector's squared length."""

    def kernel(e: dict, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, right: np.ndarray | None):
        mat = ListMatrix(sizes, labels, e["pos"], weights)
        unit = mat.w / np.sqrt(e["n"])[:, None]
        if right is None:
            i, j = np.nonzero(np.tril(unit @ unit.T, -1) >= least - 1e-9)
        else:
            left, other = np.flatnonzero(~right), np.flatnonzero(right)
            i, j = np.nonzero(unit[left] @ unit[other].T >= least - 1e-9)
            i, j = left[i], other[j]
        if not len(i):
            return None
        cos = np.einsum("ij,ij->i", mat.w[i], mat.w[j]) / np.sqrt(e["n"][i] * e["n"][j])
        keep = (cos >= least - SLACK) & mat.first(i, j)
        return i[keep], j[keep], cos[keep]

    def pairs(e: dict, i: np.ndarray, j: np.ndarray, at: np.ndarray, labels: np.ndarray, weights: np.ndarray, w_at: np.ndarray):
        n, pos, sizes = e["n"], e["pos"].astype(np.int64), np.diff(at)
        first, weights = at[:-1] - at[0], weights[w_at[0] :]
        # What two entries can share from the list's element on is no more than what each has left there.
        part = weights[: sizes.sum()] ** 2 / np.repeat(n, sizes)
        done = np.r_[0.0, np.cumsum(part)]
        left = done[first + sizes] - done[first + pos]
        close = left[i] * left[j] >= least * least * (1 - 1e-6) - 1e-9
        i, j = i[close], j[close]
        swap = sizes[i] - pos[i] > sizes[j] - pos[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        # The elements of each entry ascend, so those of all entries, numbered by entry, do as well.
        entry = np.repeat(np.arange(len(sizes)), sizes)
        base = int(labels.max()) + 1
        keys = entry * base + labels[at[0] : at[-1]]
        pair = np.repeat(np.arange(len(i)), sizes[i])
        which = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[i]) - sizes[i], sizes[i]) + first[i][pair]
        want = j[pair] * base + labels[at[0] + which]
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[place] == want
        pair, which, place = pair[hit], which[hit], place[hit]
        lead = np.full(len(i), -1)
        lead[pair[::-1]] = which[::-1]
        cos = np.bincount(pair, weights[which] * weights[place], len(i)) / np.sqrt(n[i] * n[j])
        keep = (cos >= least - SLACK) & (lead == first[i] + pos[i])  # the list's element is the first they share
        return i[keep], j[keep], cos[keep]

    kernel.pairs = pairs
    return kernel
