"""Encoding a corpus with a public byte-level BPE: length-bucketed padded matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int32(2**31 - 1)
LONG = 512
"""Pieces of more bytes than this are merged one by one, all places of a pair at once."""
CACHE = 1 << 18
"""Pieces a task remembers between batches; only speed depends on it."""
_BITS = 20


class PairTable:
    """Ranks of adjacent token pairs in an open-addressing hash table of numpy arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = 1 << (int(len(a) * 2).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.ranks = np.full(self.size, NONE, np.int32)
        key, rank = a << _BITS | b, r.astype(np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.ranks[at[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, at = key[rest], rank[rest], (at[rest] + 1) % self.size

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self.size.bit_length())).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair does not merge; negative ids are padding."""
        key = (left.astype(np.int64) << _BITS | right.astype(np.int64)).ravel()
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._slot(key[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == key[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], (at[on] + 1) % self.size
        return out.reshape(left.shape)


def merge_matrix(m: np.ndarray, table: PairTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merges the rows of a padded matrix (padding -1); gives (row numbers, their ids still padded) as rows end.

    Each round every row merges its leftmost pair of least rank. Each merging row loses
    one column, so the matrix stays rectangular; rows without a pair are taken out.
    """
    rows, done = np.arange(len(m)), []
    ranks = table(m[:, :-1], m[:, 1:])
    while len(rows):
        if m.shape[1] < 2:
            done.append((rows, m))
            break
        at = ranks.argmin(1)
        line = np.arange(len(rows))
        best = ranks[line, at]
        on = best != NONE
        if not on.all():
            done.append((rows[~on], m[~on]))
            rows, m, ranks, at, best = rows[on], m[on], ranks[on], at[on], best[on]
            line = np.arange(len(rows))
            if not len(rows):
                break
        m[line, at] = best
        keep = np.ones(m.shape, bool)
        keep[line, at + 1] = False
        m = m[keep].reshape(len(rows), -1)
        keep = np.ones(ranks.shape, bool)
        keep[line, at] = False
        ranks = ranks[keep].reshape(len(rows), -1)
        if m.shape[1] > 1:
            for side in (at - 1, at):
                ok = (side >= 0) & (side < m.shape[1] - 1)
                ranks[line[ok], side[ok]] = table(m[line[ok], side[ok]], m[line[ok], side[ok] + 1])
    return done


def merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """The same merges for one long piece: all places of the least pair at once, where that changes nothing.

    If a merge would make a pair of a still smaller rank, only the leftmost place is merged.
    """
    while len(ids) > 1:
        ranks = table(ids[:-1], ids[1:])
        best = ranks.min()
        if best == NONE:
            break
        at = np.flatnonzero(ranks == best)
        run = np.r_[0, np.cumsum(np.diff(at) > 1)]
        place = np.arange(len(at)) - np.searchsorted(run, run)
        at = at[place % 2 == 0]
        new = ids.copy()
        new[at] = best
        new = np.delete(new, at + 1)
        if len(at) > 1 and table(new[:-1], new[1:]).min() < best:
            new = np.delete(ids, at[0] + 1)
            new[at[0]] = best
        ids = new
    return ids


class Encoder:
    """Encodes texts; remembers the pieces it has merged."""

    def __init__(self, table: PairTable, pattern: str = PATTERN):
        self.table, self.split, self.known = table, regex.compile(pattern), {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, length of each)."""
        pieces = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = list({p for ps in pieces for p in ps if p not in known})
        for p, ids in zip(new, self.merge([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
            known[p] = ids
        parts = [known[p] for ps in pieces for p in ps]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
        last = np.cumsum([len(ps) for ps in pieces], dtype=np.int64)
        return flat, np.diff(np.r_[0, ends[last]])

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for n in np.flatnonzero(lengths > LONG):
            out[n] = merge_long(self.table.byte[np.frombuffer(pieces[n], np.uint8)], self.table)
        bucket = np.ceil(np.log2(np.maximum(lengths, 1)) * 2).astype(int)  # widths grow by the square root of 2
        bucket[lengths > LONG] = -1
        for b in np.unique(bucket[bucket >= 0]):
            of = np.flatnonzero(bucket == b)
            width = int(lengths[of].max())
            step = max(1, (1 << 22) // width)
            for at in range(0, len(of), step):
                part = of[at : at + step]
                m = np.full((len(part), width), -1, np.int32)
                inside = np.arange(width) < lengths[part][:, None]
                m[inside] = self.table.byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for rows, ids in merge_matrix(m, self.table):
                    real = (ids >= 0).sum(1)
                    for r, line, w in zip(part[rows], ids, real, strict=True):
                        out[r] = line[:w].copy()
        return out


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The token ids of every text, special tokens' names read as ordinary text.

    Every row gives a row, also with a null id or repeated; an empty list stands for an
    empty or null text. Whole texts are encoded, however long. The pair table, whose size
    the vocabulary fixes, is read on the driver and broadcast.

    Returns (id_col, ids).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(PairTable(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, sizes = encoder(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    pick = docs.select(F.col(id_col), F.col(text).alias("_text"))
    return pick.mapInArrow(run, f"`{id_col}` {pick.schema[0].dataType.simpleString()}, ids array<int>")
