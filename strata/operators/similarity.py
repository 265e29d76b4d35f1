"""Similarity joins on vocabularies, label histograms and signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.config import BUCKET_CAP, LSH_ROWS, SIZE_RATIO
from strata.operators.postings import cosine_kernel, label_vectors, meet, rare_first
from strata.runtime import Stage


def term_counts(rows: DataFrame, id_col: str, tf_map: str) -> DataFrame:
    """(id, term, tf) of a map of counts: keys trimmed and in lower case, counts below 1 or null left out."""
    e = F.explode(F.map_entries(tf_map)).alias("e")
    return (
        rows.select(F.col(id_col).alias("id"), e)
        .where("e.value >= 1")
        .groupBy("id", F.lower(F.regexp_replace("e.key", r"^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$", "")).alias("term"))
        .agg(F.sum("e.value").alias("tf"))
    )


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(tf: DataFrame, n: int) -> DataFrame:
    """(id, term, tf, df, w): tf * ln(1 + n / df), divided by the length of each id's vector."""
    raw = tf.join(document_frequency(tf), "term").withColumn("r", F.col("tf") * F.log(1 + F.lit(n) / F.col("df")))
    length = F.sqrt(F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "tf", "df", (F.col("r") / length).alias("w"))


def df_most(n: int) -> int:
    """Terms that may pair records are in two records or more, and in a tenth of them (4 at least) or fewer."""
    return max(-(-n // 10), 4)


def prefix_join(vectors: DataFrame, theta: float, most: int | None = None) -> DataFrame:
    """(a, b, dot): pairs a < b of sparse vectors (id, key, w) no longer than 1 whose dot product is at least theta.

    With keys ordered rarest first, such a pair shares a key of both prefixes, a prefix
    being all keys until those left are shorter than theta together. Candidates come from
    prefixes only, each pair from its first common key, so none is scored twice. With
    ``most``, a pair must also share a key of at most so many vectors; its first common
    key, the rarest, decides that.
    """
    stage = Stage(vectors.sparkSession, "prefix")
    flat = stage.keep(vectors.select(F.col("id").alias("rep"), F.lit(1.0).alias("n"), F.col("key").alias("label"), "w"), "vectors")
    toks = rare_first(flat, stage)
    got = meet(toks.withColumn("ratio", F.lit(theta * theta * (1 - 1e-9))), cosine_kernel(theta), most=most)
    return got.select("a", "b", F.col("x").alias("dot"))


def similar_pairs(weights: DataFrame, n: int, theta: float) -> DataFrame:
    """(a, b, cos): pairs a < b that share a term of the df window and whose whole vectors have a cosine of at least theta."""
    return prefix_join(weights.select("id", F.col("term").alias("key"), "w"), theta, df_most(n)).withColumnRenamed("dot", "cos")


def similar_top_shared(weights: DataFrame, n: int, theta: float, k: int) -> DataFrame:
    """``top_shared`` over all of ``similar_pairs``: (a, b, term, w, rank). The terms of both ends travel with the posting lists, so a pair is spelt out where it is found and pairs are never shuffled."""
    stage = Stage(weights.sparkSession, "prefix")
    flat = stage.keep(weights.select(F.col("id").alias("rep"), F.lit(1.0).alias("n"), F.col("term").alias("label"), "w"), "vectors")
    own = flat.groupBy("rep").agg(F.collect_list(F.struct("label", "w")).alias("own"))
    toks = rare_first(flat, stage).join(own, "rep")
    got = meet(toks.withColumn("ratio", F.lit(theta * theta * (1 - 1e-9))), cosine_kernel(theta), carry=("own",), most=df_most(n))
    both = F.filter("own_a", lambda e: F.exists("own_b", lambda f: f["label"] == e["label"]))
    other = lambda e: F.filter("own_b", lambda f: f["label"] == e["label"])[0]["w"]
    least = F.transform(both, lambda e: F.struct(F.least(e["w"], other(e)).alias("w"), e["label"].alias("term")))
    top = F.slice(F.array_sort(F.transform(least, lambda e: F.struct((-F.round(e["w"], 9)).alias("first"), e["term"].alias("term"), e["w"].alias("w")))), 1, k)
    return got.select("a", "b", F.posexplode(top).alias("at", "e")).select("a", "b", "e.term", "e.w", (F.col("at") + 1).alias("rank"))


def shared_terms(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, term, w): terms both ends of a pair have, with the smaller weight."""
    wa = weights.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"))
    wb = weights.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    return pairs.select("a", "b").join(wa, "a").join(wb, ["b", "term"]).select("a", "b", "term", F.least("wa", "wb").alias("w"))


def top_shared(shared: DataFrame, k: int) -> DataFrame:
    """The k heaviest shared terms of each pair, ties to the smaller term, with their rank."""
    w = Window.partitionBy("a", "b").orderBy(F.round("w", 9).desc(), "term")
    return shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_weights(rows: DataFrame, id_col: str = "id", wl: str = "wl") -> DataFrame:
    """(id, label, w) of weighted label arrays; a label that stands twice adds up."""
    return rows.select(F.col(id_col).alias("id"), F.explode(wl).alias("e")).where("e.label IS NOT NULL").groupBy("id", F.col("e.label").alias("label")).agg(F.sum(F.coalesce("e.w", F.lit(0.0))).alias("w"))


def histogram_map(rows: DataFrame, id_col: str = "id", wl: str = "wl") -> DataFrame:
    """(id, m, n): label weights as a map, with the squared length."""
    return label_weights(rows, id_col, wl).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("m"), F.sum(F.col("w") * F.col("w")).alias("n"))


def map_cosine(ma: Column, mb: Column, na: Column, nb: Column) -> Column:
    """Cosine of two maps with squared lengths; 0 if a length is 0."""
    d = F.aggregate(F.map_keys(ma), F.lit(0.0), lambda s, k: s + F.element_at(ma, k) * F.coalesce(F.try_element_at(mb, k), F.lit(0.0)))
    return F.when((na > 0) & (nb > 0), d / F.sqrt(na * nb)).otherwise(0.0)


def pair_cosines(pairs: DataFrame, vectors: DataFrame, *kept: str) -> DataFrame:
    """(a, b, kept columns, cos) of pairs (a, b, ...) and the sparse vectors (id, labels, ws, n) of ``label_vectors``; 0 where an end has none. Whole batches of pairs are looked up at once."""
    types = dict(pairs.dtypes)
    for end in ("a", "b"):
        pairs = pairs.join(vectors.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("labels", "ws", "n"))), end, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                label, w, row = {}, {}, {}
                for end in ("a", "b"):
                    lists, weights = b.column(f"labels_{end}"), b.column(f"ws_{end}")
                    row[end] = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                    label[end], w[end] = lists.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
                every, code = np.unique(np.r_[label["a"], label["b"]], return_inverse=True)
                keys = {end: row[end] * (len(every) + 1) + c for end, c in zip("ab", np.split(code, [len(label["a"])]), strict=True)}
                place = np.minimum(np.searchsorted(keys["b"], keys["a"]), max(len(keys["b"]) - 1, 0))
                hit = keys["b"][place] == keys["a"] if len(keys["b"]) else np.zeros(len(keys["a"]), bool)
                dot = np.bincount(row["a"][hit], w["a"][hit] * w["b"][place[hit]], b.num_rows)
                n = [pc.fill_null(b.column(f"n_{end}"), 1.0).to_numpy(zero_copy_only=False) for end in ("a", "b")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", *kept)), pa.array(dot / np.sqrt(n[0] * n[1]))], names=["a", "b", *kept, "cos"])

    return pairs.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("a", "b", *kept)) + ", cos double")


def minhash(rows: DataFrame, id_col: str, tokens: str, functions: int) -> DataFrame:
    """(id, seed, h): for each seed the least of the 60-bit md5 hashes of ``seed|token``, found within the row; each distinct token of a batch is hashed once. Null and empty token arrays give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            names = [t.encode() for t in coded.dictionary.to_pylist()]
            h = np.array([[int(hashlib.md5(b"%d|%s" % (k, t)).hexdigest()[:15], 16) for k in range(functions)] for t in names], np.int64)
            least = np.minimum.reduceat(h[coded.indices.to_numpy()], (lists.offsets.to_numpy() - lists.offsets[0].as_py())[:-1], axis=0)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(lists)), functions)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(functions, dtype=np.int32), len(lists))), pa.array(least.ravel())], names=["id", "seed", "h"])

    flat = rows.select(F.col(id_col).alias("id"), F.filter(tokens, lambda t: t.isNotNull()).alias("t")).where(F.size("t") > 0)
    return flat.mapInArrow(run, f"id {dict(rows.dtypes)[id_col]}, seed int, h bigint")


def lsh_bands(rows: DataFrame, id_col: str, signature: str, rows_per_band: int = LSH_ROWS) -> DataFrame:
    """(id, band, key): the whole bands of a signature, the key being the band's values."""
    bands = F.floor(F.size(signature) / rows_per_band).cast("int")
    at = F.explode(F.sequence(F.lit(0), bands - 1)).alias("band")
    return rows.where(F.size(signature) >= rows_per_band).select(F.col(id_col).alias("id"), F.col(signature).alias("s"), at).select("id", "band", F.array_join(F.slice("s", F.col("band") * rows_per_band + 1, rows_per_band), "|").alias("key"))


def lsh_buckets(bands: DataFrame) -> DataFrame:
    return bands.groupBy("band", "key").agg(F.count("*").alias("size"))


def lsh_candidates(bands: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b): distinct pairs a < b that share a bucket of 2 to ``cap`` members."""
    ok = bands.join(lsh_buckets(bands).where((F.col("size") >= 2) & (F.col("size") <= cap)).select("band", "key"), ["band", "key"])
    return ok.select(F.col("id").alias("a"), "band", "key").join(ok.select(F.col("id").alias("b"), "band", "key"), ["band", "key"]).where("a < b").select("a", "b").distinct()


def attach(pairs: DataFrame, rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """Columns of both ends of pairs, as ``name_a`` and ``name_b``."""
    for end in ("a", "b"):
        pairs = pairs.join(rows.select(F.col(id_col).alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def comparable(size_a: Column, size_b: Column) -> Column:
    """Sizes within a factor of two."""
    return F.least(size_a, size_b) / F.greatest(size_a, size_b) >= SIZE_RATIO


def nested(file_a: Column, file_b: Column, span_a: Column, span_b: Column) -> Column:
    """In the same file, one span inside the other."""
    return (file_a == file_b) & (((span_a["s"] <= span_b["s"]) & (span_b["e"] <= span_a["e"])) | ((span_b["s"] <= span_a["s"]) & (span_a["e"] <= span_b["e"])))


def near_pairs(symbols: DataFrame, theta: float, cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b, cos) of symbols: LSH candidates of like size, not nested, with a cosine of at least theta."""
    cand = lsh_candidates(lsh_bands(symbols.where("minhash IS NOT NULL"), "id", "minhash"), cap)
    cand = attach(cand, symbols, "id", "node_count", "file", "span").where(comparable(F.col("node_count_a"), F.col("node_count_b")) & ~nested(F.col("file_a"), F.col("file_b"), F.col("span_a"), F.col("span_b")))
    return pair_cosines(cand.select("a", "b"), label_vectors(symbols)).where(F.col("cos") >= theta - 1e-12)


def near_pairs_exact(symbols: DataFrame, theta: float) -> DataFrame:
    """(a, b, cos) of symbols: all pairs of like size, not nested, with a cosine of at least theta, whatever their signatures and however large their buckets are."""
    lw = label_weights(symbols)
    length = lw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len")).where("len > 0")
    found = prefix_join(lw.join(length, "id").select("id", F.col("label").alias("key"), (F.col("w") / F.col("len")).alias("w")), theta)
    apart = comparable(F.col("node_count_a"), F.col("node_count_b")) & ~nested(F.col("file_a"), F.col("file_b"), F.col("span_a"), F.col("span_b"))
    return attach(found, symbols, "id", "node_count", "file", "span").where(apart).select("a", "b", F.col("dot").alias("cos"))
