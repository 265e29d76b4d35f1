"""Evaluation texts leaking into training text: MinHash containment of passages, verified by exact shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.runtime import Stage

RUN = 10
"""Consecutive words that make a leak."""
SHINGLE = 5
"""Words of a shingle under the MinHash."""
SLOTS = 32
"""Slots of the filter for each passage of the items at least, so that few passages of documents are found by chance."""
MOST_BITS = 31
"""The largest filter has 2^31 slots, 256 MB as bits: enough for 64 million item passages at full width; beyond it more passages of documents are found by chance, and none is lost."""
CLASSES = 16
"""Size classes; the last one holds all larger items."""
WORD = re.compile("[A-Za-z0-9]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else "".join(c if c < "\x80" else " " for c in text).lower()) if text else []


def passage_minhashes(hashes: np.ndarray, run: int = RUN, shingle: int = SHINGLE) -> np.ndarray:
    """For each ``run`` consecutive words the MinHash of their shingles.

    Equal runs have equal shingle sets, hence equal MinHashes: a shared run is never missed.
    """
    if len(hashes) < run:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(len(hashes) - shingle + 1, np.uint64)
    for k in range(shingle):
        mixed = (mixed ^ hashes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.lib.stride_tricks.sliding_window_view(mixed, run - shingle + 1).min(1)


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 1 << 18:
        known.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def needed(share: float) -> np.ndarray:
    """Passages that a document must hold of an item of each size class (of 2^(c-1) passages at least), never less than one."""
    return np.maximum(1, np.ceil(share * np.r_[0, 2.0 ** np.arange(CLASSES - 1)] - 1e-9)).astype(int)


class Filter:
    """The slots that the items' MinHashes fall into; with classes, which size classes they belong to."""

    def __init__(self, bits: int, need: np.ndarray):
        self.bits, self.need = bits, need
        self.known = np.zeros(1 << bits - 3, np.uint8)
        self.classes = np.zeros(1 << bits, np.uint16) if need.max() > 1 else None

    def folded(self, of_items: DataFrame) -> DataFrame:
        """(part, slots, classes): the slots taken, and the size classes as bits, in parts of 2^16 slots."""
        slot = F.shiftrightunsigned("h", 64 - self.bits)
        taken = of_items.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1, size_class)")).alias("c"))
        return taken.groupBy(F.shiftright("slot", 16).alias("part")).agg(F.collect_list("slot").alias("slots"), F.collect_list("c").alias("classes"))

    def put(self, _part: int, slots: list[int], classes: list[int]) -> None:
        at = np.array(slots, np.int64)
        np.bitwise_or.at(self.known, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if self.classes is not None:
            self.classes[at] = np.array(classes, np.uint16)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Which passages of a document, by MinHash, belong to an item, and to a size class of which the document holds enough."""
        slots = self._slots(hashes)
        at = np.flatnonzero(self.known[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
        if self.classes is None or not len(at):
            return at
        mask = self.classes[slots[at]]
        for c in np.flatnonzero(self.need > 1):
            if np.count_nonzero(mask & (1 << c)) < self.need[c]:
                mask = mask & ~np.uint16(1 << c)
        return at[mask > 0]


def passages(rows: DataFrame, id_col: str, text: str, run: int, filters=None) -> DataFrame:
    """Distinct passages of ``run`` words, (id, size_class, h, passage), or, with ``filters``, only those that it holds.

    h is a passage's MinHash; size classes are the powers of two of the number of passages of a text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        look = filters.value if filters is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, keys, sizes, hashes = [], [], [], []
                for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    w = words_of(t)
                    m = passage_minhashes(_hashes(w, known), run)
                    if not len(m):
                        continue
                    seen = {" ".join(w[i : i + run]): m[i] for i in (range(len(m)) if look is None else look.held(m))}
                    ids += [n] * len(seen)
                    keys += seen
                    hashes += seen.values()
                    sizes += [min(len(m).bit_length(), CLASSES - 1)] * len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema[0].type), pa.array(sizes, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(keys, pa.string())], names=["id", "size_class", "h", "passage"])

    pick = rows.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    return pick.mapInArrow(cut, f"id {pick.schema[0].dataType.simpleString()}, size_class int, h bigint, passage string")


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN, share: float = 0.0) -> DataFrame:
    """Documents that hold ``run`` consecutive words of an item, and the items found in each.

    A word is a longest run of ASCII letters and digits, compared without case. Items are
    partitioned by size; the MinHashes of their passages set the bits of a filter whose
    size follows from the number of these passages. A document's passages are looked up by
    MinHash; a class of which it holds fewer passages than a share of ``share`` takes is
    dropped. Only passages found are shuffled, and what joins has the very same words.

    Null ids and texts, and texts of fewer than ``run`` words, give no rows; repeated
    rows change nothing; no items or no documents, no rows.

    Returns (doc_id, item_id, shared, share): distinct passages in common, and their share
    of the item's distinct passages.
    """
    spark = docs.sparkSession
    of_items = Stage(spark, "leaks").keep(passages(items, "item_id", "text", run).distinct(), "items")
    look = Filter(max(16, min(MOST_BITS, (SLOTS * of_items.count()).bit_length())), needed(share))
    for row in look.folded(of_items).toLocalIterator():  # a row per part of the filter, whatever the items
        look.put(row["part"], row["slots"], row["classes"])
    of_docs = passages(docs, "doc_id", "text", run, spark.sparkContext.broadcast(look))
    size = of_items.groupBy("id").agg(F.count("*").alias("size"))
    pairs = (
        of_docs.select(F.col("id").alias("doc_id"), "passage").distinct()
        .join(of_items.select(F.col("id").alias("item_id"), "passage"), "passage")
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("shared"))
    )
    out = pairs.join(size.withColumnRenamed("id", "item_id"), "item_id").withColumn("share", F.col("shared") / F.col("size"))
    return out.where(F.col("share") >= share).select("doc_id", "item_id", "shared", "share")
