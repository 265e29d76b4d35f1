"""Similar vocabularies, judged where they are found: blocks of symbols, each written once, meet two by two in tiles, and no pair is shuffled or kept."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import LOW_SIGNAL_TERMS, MIN_SHARED_MASS, MIN_SHARED_TERMS, MIN_TERMS, Config
from strata.operators.ids import dense_ids
from strata.operators.postings import SHORT, _short_pairs, cosine_kernel, label_vectors, rare_first
from strata.operators.similarity import df_most
from strata.runtime import Stage

BLOCK_ROWS, LEAST_BLOCKS = 1 << 14, 5
"""Symbols of a block, and the fewest blocks; a symbol is written once and read once for each block."""

LIST_ROWS, ENTRIES, PAIRS, LINES, TERMS = 256, 1 << 14, 1 << 18, 256, 1 << 18
"""What a tile looks at together: entries of a long list, entries of short lists, pairs, their first ends, and elements of their second ends."""

STAGED = "a bigint, b bigint, cos double, a_cos double, n_shared bigint, share double, passed int"


def shape_labels(symbols: DataFrame, stage: Stage) -> DataFrame:
    """(rep, labels, ws, n): the vectors of ``label_vectors``; labels are numbered, and those of one symbol only, which no two share, count in n alone."""
    vectors = label_vectors(symbols).select(F.col("id").alias("rep"), "n", "labels", "ws")
    flat = vectors.select("rep", F.explode(F.arrays_zip("labels", "ws")).alias("e")).select("rep", "e.labels", "e.ws")
    shared = flat.groupBy("labels").agg(F.count("*").alias("df")).where("df > 1").select("labels")
    named = dense_ids(shared, "labels", name="no", stage=stage)
    lists = flat.join(named, "labels").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("no", "ws"))).alias("e"))
    return vectors.select("rep", "n").join(lists, "rep", "left").select("rep", "n", F.col("e.no").alias("labels"), F.col("e.ws").alias("ws"))


def staged_pairs(symbols: DataFrame, weights: DataFrame, n: int, calls: tuple[DataFrame, DataFrame] | None, cfg: Config = Config(), least: int = 1) -> DataFrame:
    """(a, b, cos, a_cos, n_shared, share, passed): see ``clustering.competing_pairs``. Everything that decides on a pair is written with its symbols. ``weights`` are read more than once and not kept here."""
    stage = Stage(symbols.sparkSession, "pairs")
    if least > 1:
        symbols = symbols.where("file IS NOT NULL AND NOT coalesce(is_test, false)")
    flat = weights.select(F.col("id").alias("rep"), F.lit(1.0).alias("n"), F.col("term").alias("label"), "w")
    place = F.array_position(F.array(*map(F.lit, LOW_SIGNAL_TERMS)), F.col("label"))
    own = flat.groupBy("rep").agg(F.count("*").alias("terms"), F.sum("w").alias("mass"), F.sum(F.when(place > 0, F.pow(F.lit(2.0), place - 1)).otherwise(0.0)).cast("bigint").alias("low"))
    if least > 1:
        own = own.where(F.col("terms") >= MIN_TERMS)
    info = symbols.select(F.col("id").alias("rep"), "file", F.coalesce("is_test", F.lit(False)).alias("is_test"))
    rows = rare_first(flat, stage).select("rep", "toks").join(own, "rep").join(info, "rep").join(shape_labels(symbols, stage), "rep", "left")
    if calls:
        out, members = calls
        rows = rows.join(members.select(F.col("id").alias("rep"), F.col("grp").alias("own")), "rep", "left").join(out.groupBy(F.col("src").alias("rep")).agg(F.collect_list("grp").alias("out")), "rep", "left")
    whole = stage.keep(rows, "rows")
    blocks = max(LEAST_BLOCKS, -(-whole.count() // BLOCK_ROWS))
    rows = whole.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    if calls:
        # Who calls a group is written with the first symbol of the group in each block.
        step = members.join(out.select(F.col("src").alias("id"), F.col("grp").alias("own")), "id").select("own", "grp").distinct()
        into = step.groupBy("own").agg(F.collect_list("grp").alias("into"))
        heads = rows.where("own IS NOT NULL").groupBy("block", "own").agg(F.min("rep").alias("rep")).join(into, "own", "left")
        none = F.array().cast("array<bigint>")
        rows = rows.join(heads.select("rep", F.concat(F.array("own"), F.coalesce("into", none)).alias("into")), "rep", "left")
    files = by_number(stage.keep(rows.repartitionById(blocks, F.col("block")).drop("block"), "blocks"))
    stage.drop(whole)
    of = [(x, y) for x in sorted(files) for y in sorted(files) if x <= y]
    most, known = df_most(n), calls is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                x, y = of[k]
                sides = [_side(files[x], False, x == y)] + ([_side(files[y], True, False)] if x != y else [])
                if all(side is not None for side in sides):
                    yield from Tile(pa.concat_tables(sides), known, cfg).pairs(most, least)

    return symbols.sparkSession.range(0, len(of), 1, max(len(of), 1)).mapInArrow(run, STAGED)


def by_number(kept: DataFrame) -> dict[int, list[str]]:
    """The files of a kept table by the partition they were written from."""
    files: dict[int, list[str]] = {}
    for uri in sorted(kept.inputFiles()):
        files.setdefault(int(re.search(r"part-(\d+)-[^/]*$", uri)[1]), []).append(uri)
    return files


def batches_of(uris: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of files, in their order, read from the shared folder by whatever file system holds it."""
    for system, path in map(fs.FileSystem.from_uri, uris):
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, use_threads=False)


def _side(uris: list[str], right: bool, same: bool) -> pa.Table | None:
    """The rows of a block, if it has any."""
    held = list(batches_of(uris, 1 << 16))
    if not held:
        return None
    t = pa.Table.from_batches(held)
    return t.append_column("right", pa.array(np.full(t.num_rows, right))).append_column("same", pa.array(np.full(t.num_rows, same)))


class Lists:
    """Lists of elements by row: labels and weights, cut at ``at``."""

    def __init__(self, at: np.ndarray, label: np.ndarray, w: np.ndarray):
        _, code = np.unique(label, return_inverse=True)
        self.at, self.label, self.w = at, code, w
        self.place = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int64)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of rows and where their elements are."""
        sizes = self.at[rows + 1] - self.at[rows]
        return sizes, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.at[rows], sizes)

    def common(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of the pairs, by ascending i: (slice, pair of the slice, weights at i and j) of each element both ends have. Weights are not 0."""
        if not len(i):
            return
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        ends = np.cumsum(self.at[j + 1] - self.at[j])
        for f in range(0, len(first), LINES):
            lines = i[first[f : f + LINES]]
            sizes, at = self.of(lines)
            labels, code = np.unique(self.label[at], return_inverse=True)
            self.place[labels] = np.arange(1, len(labels) + 1)
            dense = np.zeros((len(lines), len(labels) + 1))
            dense[np.repeat(np.arange(len(lines)), sizes), code + 1] = self.w[at]
            start, end = int(first[f]), int(first[f + LINES]) if f + LINES < len(first) else len(i)
            while start < end:
                done = ends[start - 1] if start else 0
                stop = min(end, max(start + 1, int(np.searchsorted(ends, done + TERMS, "right"))))
                line = np.searchsorted(lines, i[start:stop])
                sizes, at = self.of(j[start:stop])
                pair = np.repeat(np.arange(stop - start), sizes)
                w = dense[line[pair], self.place[self.label[at]]]
                hit = np.flatnonzero(w)
                yield slice(start, stop), pair[hit], w[hit], self.w[at[hit]]
                start = stop
            self.place[labels] = 0


def _lists(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """Where the lists of a column begin, and their elements; null lists are empty."""
    column = t.column(name)
    flat = pc.list_flatten(column).combine_chunks()
    return np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())].astype(np.int64), flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat


class Tile:
    """Two blocks of symbols, or one that meets itself."""

    def __init__(self, t: pa.Table, known: bool, cfg: Config):
        self.known, self.cfg = known, cfg
        t = t.sort_by("rep")
        self.id, self.right, self.test, self.terms, self.mass, self.low = (t.column(c).to_numpy() for c in ("rep", "right", "is_test", "terms", "mass", "low"))
        self.same = bool(t.column("same")[0].as_py())
        self.file = pc.fill_null(pc.rank(t.column("file"), tiebreaker="dense"), 0).to_numpy().astype(np.int64)
        self.no_file = t.column("file").is_null().to_numpy()
        at, toks = _lists(t, "toks")
        self.df, w = (toks.field(c).to_numpy(zero_copy_only=False) for c in ("df", "w"))
        self.words = Lists(at, toks.field("label").to_numpy(zero_copy_only=False), w)
        at, labels = _lists(t, "labels")
        self.shape = Lists(at, labels.to_numpy(zero_copy_only=False), _lists(t, "ws")[1].to_numpy(zero_copy_only=False))
        self.n = pc.fill_null(t.column("n"), 1.0).to_numpy()
        if known:
            self.own = pc.fill_null(t.column("own"), 0).to_numpy()
            self.called = t.column("own").is_valid().to_numpy()
            self.out_at, out = _lists(t, "out")
            self.out = out.to_numpy(zero_copy_only=False)
            at, into = _lists(t, "into")
            into = into.to_numpy(zero_copy_only=False)
            self.groups = np.unique(np.r_[self.own, self.out, into])
            self.own, self.out, into = (np.searchsorted(self.groups, c) for c in (self.own, self.out, into))
            self.into = np.unique(np.repeat(self.own, np.diff(at)) * len(self.groups) + into)

    def pairs(self, most: int, least: int) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in self.found(self.cfg.theta_b, most):
            held.append(found)
            n += len(found[0])
            if n >= PAIRS:
                yield from self.judged(held, least)
                held, n = [], 0
        if n:
            yield from self.judged(held, least)

    def found(self, theta: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows i, j and their cosine, for each similar pair once: in the list of the first element both have."""
        kernel, at = cosine_kernel(theta), self.words.at
        row = np.repeat(np.arange(len(self.id)), np.diff(at))
        part = self.words.w**2
        done = np.r_[0.0, np.cumsum(part)]
        left = done[at[row + 1]] - done[:-1]
        e = np.flatnonzero((left >= theta * theta * (1 - 1e-6)) & (self.df <= most))
        e = e[np.argsort(self.words.label[e], kind="stable")]
        if not len(e):
            return
        label, row, pos = self.words.label[e], row[e], (e - at[row[e]])
        right = self.right[row]
        starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        sizes = np.diff(np.r_[starts, len(e)])
        others = np.add.reduceat(right.astype(np.int64), starts)
        meet = sizes > 1 if self.same else (others > 0) & (others < sizes)
        starts, sizes = starts[meet], sizes[meet]
        yield from self._short(kernel, starts[sizes <= SHORT], sizes[sizes <= SHORT], row, pos, right)
        for s, m in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            whole = np.arange(s, s + m)
            cut = lambda c: [c[k : k + LIST_ROWS] for k in range(0, len(c), LIST_ROWS)]
            if self.same:
                blocks = cut(whole)
                tasks = [(x, blocks[k] if k > h else None) for h, x in enumerate(blocks) for k in range(h, len(blocks))]
            else:
                tasks = [(x, y) for x in cut(whole[~right[whole]]) for y in cut(whole[right[whole]])]
            for x, y in tasks:
                both = x if y is None else np.r_[x, y]
                size, where = self.words.of(row[both])
                got = kernel({"n": np.ones(len(both)), "pos": pos[both]}, size, self.words.label[where], self.words.w[where], None if y is None else np.arange(len(both)) >= len(x)) if len(both) > 1 else None
                if got is not None and len(got[0]):
                    yield row[both[got[0]]], row[both[got[1]]], got[2]

    def _short(self, kernel: Callable, starts: np.ndarray, sizes: np.ndarray, row: np.ndarray, pos: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ends = np.cumsum(sizes)
        for of in np.split(np.arange(len(sizes)), np.searchsorted(ends, np.arange(ENTRIES, ends[-1], ENTRIES))) if len(sizes) else []:
            size = sizes[of]
            first = np.cumsum(size) - size
            e = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(starts[of], size)
            i, j = _short_pairs(first, size)
            if not self.same:
                i, j = (c[right[e[i]] != right[e[j]]] for c in (i, j))
            if not len(i):
                continue
            length, where = self.words.of(row[e])
            at = np.r_[0, np.cumsum(length)]
            i, j, cos = kernel.pairs({"n": np.ones(len(e)), "pos": pos[e]}, i, j, at, self.words.label[where], self.words.w[where], at)
            if len(i):
                yield row[e[i]], row[e[j]], cos

    def judged(self, held: list, least: int) -> Iterator[pa.RecordBatch]:
        """The pairs that pass ``least`` stages."""
        i, j, cos = (np.concatenate(c) for c in zip(*held, strict=True))
        i, j = np.minimum(i, j), np.maximum(i, j)  # rows ascend by id
        order = np.argsort(i, kind="stable")
        i, j, cos = i[order], j[order], cos[order]
        passed = np.ones(len(i), np.int32)
        a_cos, share, shared = np.full(len(i), np.nan), np.full(len(i), np.nan), np.full(len(i), -1)
        ok = ~self.test & ~self.no_file & (self.terms >= MIN_TERMS)
        k = np.flatnonzero(ok[i] & ok[j] & (self.file[i] != self.file[j]))
        passed[k] = 2
        dot = np.zeros(len(k))
        for at, pair, x, y in self.shape.common(i[k], j[k]):
            dot[at] = np.bincount(pair, x * y, at.stop - at.start)
        a_cos[k] = dot / np.sqrt(self.n[i[k]] * self.n[j[k]])
        k = k[a_cos[k] <= self.cfg.theta_a_low]
        passed[k] = 3
        count, mass = np.zeros(len(k), np.int64), np.zeros(len(k))
        for at, pair, x, y in self.words.common(i[k], j[k]):
            count[at] = np.bincount(pair, minlength=at.stop - at.start)
            mass[at] = np.bincount(pair, np.minimum(x, y), at.stop - at.start)
        part = mass / np.minimum(self.mass[i[k]], self.mass[j[k]])
        good = (count >= MIN_SHARED_TERMS) & (part >= MIN_SHARED_MASS) & (count > np.bitwise_count(self.low[i[k]] & self.low[j[k]]))
        k = k[good]
        shared[k], share[k] = count[good], part[good]
        passed[k] = 4
        if self.known and len(k):
            passed[k[~(self.reaches(i[k], j[k]) | self.reaches(j[k], i[k]))]] = 5
        for at in range(0, len(i), 1 << 16):
            k = np.flatnonzero(passed[at : at + (1 << 16)] >= least) + at
            if len(k):
                columns = [pa.array(self.id[i[k]]), pa.array(self.id[j[k]]), pa.array(cos[k]), pa.array(a_cos[k], mask=passed[k] < 2), pa.array(shared[k], mask=passed[k] < 4), pa.array(share[k], mask=passed[k] < 4), pa.array(passed[k])]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "cos", "a_cos", "n_shared", "share", "passed"])

    def reaches(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether i calls j or a symbol that calls j: a group that i calls is j's own or calls it."""
        got = np.zeros(len(i), bool)
        for at in range(0, len(i) if len(self.into) else 0, 1 << 18):
            x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            sizes = np.where(self.called[y], self.out_at[x + 1] - self.out_at[x], 0)
            pair = np.repeat(np.arange(len(x)), sizes)
            where = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.out_at[x], sizes)
            want = self.own[y][pair] * len(self.groups) + self.out[where]
            place = np.minimum(np.searchsorted(self.into, want), len(self.into) - 1)
            got[at + pair[self.into[place] == want]] = True
        return got
