"""How distinctive a term is per record: two-Poisson mixtures fitted on each term's frequency histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.frequency import symbol_terms

EM_ROUNDS = 40


def two_poisson(term: np.ndarray, tf: np.ndarray, records: np.ndarray, n: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fits P(k) = share * Poisson(k; elite) + (1 - share) * Poisson(k; plain) for each term by expectation-maximisation.

    The histograms of all terms stand one below the other: ``records`` records hold the
    term numbered ``term`` exactly ``tf`` times; the rest of the ``n`` records hold it
    zero times.
    """
    df = np.bincount(term, records, n_terms)
    total = np.bincount(term, records * tf, n_terms)
    zero = np.maximum(n - df, 0)
    mean = total / max(n, 1)
    share = np.clip(df / max(n, 1) / 2, 1e-9, 0.5)
    plain, elite = np.maximum(mean / 2, 1e-9), np.maximum(1.5 * total / np.maximum(df, 1), 1e-6)
    for _ in range(EM_ROUNDS):
        odds = np.log(share) - np.log1p(-share) - elite + plain
        slope = np.log(elite) - np.log(plain)
        g = 1 / (1 + np.exp(-np.clip(odds[term] + tf * slope[term], -500, 500)))
        g0 = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        w = records * g
        mass = np.bincount(term, w, n_terms) + zero * g0
        hits = np.bincount(term, w * tf, n_terms)
        share = np.clip(mass / max(n, 1), 1e-9, 1 - 1e-9)
        elite = np.maximum(hits / np.maximum(mass, 1e-12), 1e-9)
        plain = np.maximum((total - hits) / np.maximum(n - mass, 1e-12), 1e-9)
        swap = elite < plain
        share = np.where(swap, 1 - share, share)
        elite, plain = np.where(swap, plain, elite), np.where(swap, elite, plain)
    return share, elite, plain


def term_weights(records: DataFrame, id_col: str, terms: str, counts: str, n: int, mixture: bool = False) -> DataFrame:
    """Scores each term of each record by how characteristic it is there.

    ``records`` has one row per record with parallel arrays of terms and counts; entries
    with a null term or a count that is null or below 1 do not occur, and equal terms of
    a record add up. ``n`` is the number of all records, also those without terms.
    Nothing is returned for records without terms; an empty input gives no rows.

    ``weight`` is tf * ln(1 + n / df) to 9 decimals. With ``mixture``, ``elite`` is the
    posterior probability that the occurrence count comes from the elite component of the
    term's mixture. Both come from a table with a row per term, built from the histogram
    of counts, so a hot term is one small row before anything is joined.

    Returns (id_col, term, tf, df, weight), with ``mixture`` also elite.
    """
    occ = (
        records.select(id_col, F.explode(F.filter(F.arrays_zip(F.col(terms).alias("t"), F.col(counts).alias("c")), lambda e: e["t"].isNotNull() & (e["c"] >= 1))).alias("e"))
        .groupBy(id_col, F.col("e.t").alias("term"))
        .agg(F.sum("e.c").alias("tf"))
    )
    weight = F.round(F.col("tf") * F.log(1 + F.lit(n) / F.col("df")), 9).alias("weight")
    if not mixture:
        return occ.join(occ.groupBy("term").agg(F.count("*").alias("df")), "term").select(id_col, "term", "tf", "df", weight)
    hist = occ.groupBy("term", "tf").agg(F.count("*").alias("records")).groupBy("term").agg(F.collect_list(F.struct("tf", "records")).alias("h"))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = np.fromiter((len(h) for h in f["h"]), np.int64, len(f))
            term = np.repeat(np.arange(len(f)), sizes)
            flat = [x for h in f["h"] for x in h]
            tf = np.fromiter((x["tf"] for x in flat), float, len(flat))
            rec = np.fromiter((x["records"] for x in flat), float, len(flat))
            share, elite, plain = two_poisson(term, tf, rec, n, len(f))
            yield pd.DataFrame({"term": f["term"], "df": np.bincount(term, rec, len(f)).astype("int64"), "share": share, "elite_rate": elite, "plain_rate": plain})

    model = hist.mapInPandas(fit, "term string, df bigint, share double, elite_rate double, plain_rate double")
    odds = F.log("share") - F.log1p(-F.col("share")) - F.col("elite_rate") + F.col("plain_rate") + F.col("tf") * (F.log("elite_rate") - F.log("plain_rate"))
    elite = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))
    return occ.join(model, "term").select(id_col, "term", "tf", "df", weight, elite.alias("elite"))


def top_terms(weights: DataFrame, id_col: str, k: int = 3, by: str = "weight") -> DataFrame:
    """The ``k`` heaviest terms of each record, ties to the smaller term in code-point order."""
    w = Window.partitionBy(id_col).orderBy(F.col(by).desc(), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def symbol_term_weights(symbols: DataFrame, mixture: bool = False) -> DataFrame:
    """``term_weights`` of the identifier terms of symbols, over all distinct ids."""
    n = symbols.where("id IS NOT NULL").select("id").distinct().count()
    return term_weights(symbol_terms(symbols), "id", "terms", "counts", n, mixture)
