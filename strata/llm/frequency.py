"""Frequency of every distinct value, term or n-gram: suffix arrays with common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TOKENS = 1 << 20
"""Tokens gathered for one suffix array; only memory depends on it, never a count. A longer record makes a longer block."""


def suffix_array(codes: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Where the suffixes begin, in order of their first ``depth`` tokens, by prefix doubling. ``left`` tokens of its record follow from each place on; a suffix that ends comes first."""
    rank, known = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while known < depth:
        step = np.zeros(len(codes), np.int64)
        step[: max(0, len(codes) - known)] = rank[known:] + 1
        step[left <= known] = 0
        key = rank * (int(rank.max()) + 2) + step
        rank, known = np.unique(key, return_inverse=True)[1].astype(np.int64), 2 * known
        if rank.max() == len(codes) - 1:
            break
    return np.argsort(rank, kind="stable")


def common_prefixes(codes: np.ndarray, left: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Tokens that each suffix has in common with the one before it in the array, counted up to ``depth``; 0 for the first."""
    out = np.zeros(len(suffixes), np.int64)
    at = np.arange(1, len(suffixes))
    for k in range(depth):
        x, y = suffixes[at], suffixes[at - 1]
        on = (left[x] > k) & (left[y] > k)
        at = at[on]
        at = at[codes[x[on] + k] == codes[y[on] + k]]
        out[at] = k + 1
    return out


def prefix_intervals(codes: np.ndarray, record: np.ndarray, weight: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n: n, where each n-gram starts, its occurrences and its records.

    ``codes`` are the tokens of whole records one after the other and ``record`` numbers
    the records. Neighbours in the suffix array with n tokens or more in common lie in one
    interval; its (weighted) size is the n-gram's count. A suffix whose predecessor of the
    same record lies in the same interval is a duplicate within that record; the size less
    those duplicates is the number of records. Rounds end with the longest record.
    """
    m = len(codes)
    if m == 0:
        return
    ends = np.r_[np.flatnonzero(record[1:] != record[:-1]) + 1, m]
    left = ends[np.searchsorted(ends, np.arange(m), "right")] - np.arange(m)
    max_n = min(max_n, int(left.max()))
    suffixes = suffix_array(codes, left, max_n)
    common = common_prefixes(codes, left, suffixes, max_n)
    by_record = np.argsort(record[suffixes], kind="stable")
    same = record[suffixes[by_record[1:]]] == record[suffixes[by_record[:-1]]]
    before, after = by_record[:-1][same], by_record[1:][same]
    for n in range(1, max_n + 1):
        long = left[suffixes] >= n
        interval = np.cumsum(common < n) - 1
        starts = np.flatnonzero(common < n)
        count = np.add.reduceat(np.where(long, weight[suffixes], 0), starts)
        size = np.add.reduceat(long.astype(np.int64), starts)
        repeated = (interval[before] == interval[after]) & long[after]
        records = size - np.bincount(interval[after[repeated]], minlength=len(starts))
        keep = size > 0
        yield n, suffixes[starts[keep]], count[keep], records[keep]


def _count_block(terms: pa.Array, lengths: np.ndarray, weight: np.ndarray, max_n: int, sep: str) -> pa.Table:
    coded = terms.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(names)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[coded.indices.to_numpy()]
    names = names[order]
    record = np.repeat(np.arange(len(lengths)), lengths)
    out = []
    for n, at, count, records in prefix_intervals(codes, record, weight, max_n):
        gram = names[codes[at]]
        for k in range(1, n):
            gram = gram + sep + names[codes[at + k]]
        out.append(pa.table({"term": pa.array(gram, pa.string()), "n": pa.array(np.full(len(at), n, np.int32)), "tf": count, "df": records}))
    return pa.concat_tables(out)


def term_frequencies(records: DataFrame, terms: str, counts: str | None = None, max_n: int = 1, sep: str = " ") -> DataFrame:
    """Occurrences (tf) and records (df) of every n-gram of up to ``max_n`` terms.

    ``records`` has one row per record; ``terms`` is its array of terms in order.
    ``counts``, only with ``max_n=1``, holds how often each entry occurs; a count that is
    null or below 1 means the entry does not occur. Null arrays, empty arrays and null
    terms add nothing; a term listed twice in a record counts its occurrences together
    and the record once. An empty input gives no rows.

    Each task builds suffix arrays over blocks of whole records, so records of a block
    are complete and the blocks' counts add up; only one row per block and distinct
    n-gram is shuffled, however hot the n-gram is.

    Returns (term, n, tf, df).
    """
    if counts and max_n > 1:
        raise ValueError("counts belong to bags of terms; n-grams need the terms in order")
    pick = records.select(F.col(terms).alias("t"), (F.col(counts) if counts else F.lit(None)).cast("array<bigint>").alias("c"))
    if counts:
        pick = pick.select(F.filter(F.arrays_zip("t", "c"), lambda e: e["t"].isNotNull() & (e["c"] >= 1)).alias("e")).select(F.col("e.t").alias("t"), F.col("e.c").alias("c"))
    else:
        pick = pick.select(F.filter("t", lambda x: x.isNotNull()).alias("t"))
    pick = pick.where(F.size("t") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            held.append(batch)
            tokens += len(pc.list_flatten(batch.column(0)))
            if tokens >= BLOCK_TOKENS:
                yield from flush(held)
                held, tokens = [], 0
        if held:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column("t").combine_chunks()
        flat = pc.list_flatten(lists)
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        if len(flat) == 0:
            return
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        weight = pc.list_flatten(t.column("c").combine_chunks()).to_numpy(zero_copy_only=False) if counts else np.ones(len(flat), np.int64)
        yield from _count_block(flat, lengths, weight, max_n, sep).to_batches()

    return (
        pick.mapInArrow(count, "term string, n int, tf bigint, df bigint")
        .groupBy("term", "n")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )


def symbol_terms(symbols: DataFrame) -> DataFrame:
    """One row per symbol id with its identifier terms: (id, terms, counts).

    A term is a map key without white space around it, in lower case. A symbol scanned
    again counts once. Rows with a null id are left out; a null or empty map gives a
    null or empty array.
    """
    entries = F.map_entries("vocab_tf")
    return (
        symbols.where("id IS NOT NULL")
        .select("id", entries.alias("e"))
        .dropDuplicates(["id"])
        .select(
            "id",
            F.transform("e", lambda x: F.lower(F.regexp_replace(x["key"], r"^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$", ""))).alias("terms"),
            F.transform("e", lambda x: x["value"].cast("bigint")).alias("counts"),
        )
    )


def mark_terms(symbols: DataFrame, rare_below: int = 2, common_share: tuple[int, int] = (1, 10), common_least: int = 4) -> DataFrame:
    """Every term with its counts and a mark: rare if df < ``rare_below``, common if df > max(ceil(share * n), least), else null.

    Returns (term, tf, df, mark).
    """
    n = symbols.where("id IS NOT NULL").select("id").distinct().count()
    most = max(-(-n * common_share[0] // common_share[1]), common_least)
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > most, "common")
    return term_frequencies(symbol_terms(symbols), "terms", "counts").select("term", "tf", "df", mark.alias("mark"))
