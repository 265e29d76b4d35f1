"""Clusters of symbols: exact and near shapes, competing vocabularies, deprecated twins and families.

The best-first merges depend on the order of their pairs. A merge never crosses a
connected component of the pairs, so each component is merged in one task; only
a component has to fit in a task, not the pairs. Of competing symbols just the symbols
of a component have to fit: their pairs are written once, best first, and read in that order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.config import REP_RELAX, Config
from strata.functions.dates import classify
from strata.functions.text import base_name, is_dunder
from strata.operators.components import components, local_stars
from strata.runtime import Stage
from strata.operators.postings import label_vectors
from strata.operators.similarity import label_weights, near_pairs, pair_cosines, prefix_join, top_shared, shared_terms
from strata.operators.tiles import batches_of, by_number, staged_pairs


def _cos(a: dict, b: dict) -> float:
    if len(a) > len(b):
        a, b = b, a
    return sum(w * b[k] for k, w in a.items() if k in b)


def _unit(keys, ws) -> dict:
    n = float(np.sqrt(np.dot(ws, ws))) or 1.0
    return {k: w / n for k, w in zip(keys, ws, strict=True)}


def merge_best_first(ids: list[int], groups: list[list[int]], pairs: list[tuple[float, int, int]], vectors: dict[int, dict], least: float) -> tuple[dict[int, int], int, int]:
    """Merges along pairs, best first, where the two sides' representatives are alike.

    Each of ``groups`` is one set from the start, represented by its last member. A pair
    within one set changes nothing; a pair whose representatives have a cosine below
    ``least`` is refused. The representative of the larger side stays, of the first side
    on ties. Returns the smallest id of each id's set, the merges made and those refused.
    """
    root, rep, size = {i: i for i in ids}, {i: i for i in ids}, dict.fromkeys(ids, 1)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for g in groups:
        last = max(g)
        for i in g:
            root[i] = last
        size[last] = len(g)
    made = refused = 0
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        x, y = find(a), find(b)
        if x == y:
            continue
        if _cos(vectors.get(rep[x], {}), vectors.get(rep[y], {})) < least:
            refused += 1
            continue
        keep = rep[x] if size[x] >= size[y] else rep[y]
        root[x] = y
        rep[y], size[y] = keep, size[x] + size[y]
        made += 1
    low: dict[int, int] = {}
    for i in sorted(ids):
        low.setdefault(find(i), i)
    return {i: low[find(i)] for i in ids}, made, refused


def _merged(pairs: DataFrame, exact: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(id, cluster, made, refused) over pairs (a, b, score), groups (id, grp) and vectors (id, k, w): the merges of each component."""
    star = exact.join(exact.groupBy("grp").agg(F.min("id").alias("first")), "grp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    comp = components(pairs.select("a", "b").unionByName(star.where("a <> b")))
    nodes = comp.join(vectors, "id", "left").join(exact, "id", "left").select("root", "id", "k", "w", "grp")
    edges = pairs.join(comp.select(F.col("id").alias("a"), F.col("root").alias("of")), "a").select("of", "a", "b", "score")

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        vec = {i: _unit(k, w) for i, k, w in zip(n["id"], n["k"], n["w"], strict=True) if k is not None}
        groups = [list(g) for _, g in n.dropna(subset=["grp"]).groupby("grp")["id"]]
        low, made, refused = merge_best_first(list(n["id"]), groups, list(zip(e["score"], e["a"], e["b"], strict=True)), vec, least)
        out = pd.DataFrame({"id": list(low), "cluster": list(low.values()), "made": 0, "refused": 0})
        if len(out):
            out.loc[0, ["made", "refused"]] = [made, refused]
        return out

    return nodes.groupBy("root").cogroup(edges.groupBy("of")).applyInPandas(run, "id bigint, cluster bigint, made int, refused int")


def exact_groups(symbols: DataFrame) -> DataFrame:
    """(id, grp): symbols that share their structural hash with another one."""
    own = symbols.select("id", F.col("merkle_root").alias("grp")).where("grp IS NOT NULL")
    return own.join(own.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "grp").select("id", "grp")


def shape_clusters(symbols: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(id, cluster): tight clusters of two or more symbols; ``cluster`` is the smallest id.

    Equal structural hashes join at once; near pairs are merged best first where the
    representatives' cosine reaches four fifths of the bound.
    """
    pairs = Stage(symbols.sparkSession, "shapes").keep(near_pairs(symbols, cfg.theta_clone).withColumnRenamed("cos", "score"), "pairs")
    vec = label_vectors(symbols).select("id", F.col("labels").alias("k"), F.col("ws").alias("w"))
    merged = Stage(symbols.sparkSession, "shapes").keep(_merged(pairs, exact_groups(symbols), vec, REP_RELAX * cfg.theta_clone).select("id", "cluster"), "merged")
    return merged.join(merged.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster"), "cluster").select("id", "cluster")


def repeated(symbols: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, first, size, n_files, total_nodes, all_test, first_seen, last_touched, newest_birth): summary of each cluster of two or more.

    ``first`` is the first member by file, line and id; the members themselves stay rows of ``clusters``. Dates are null if no member is dated.
    """
    m = clusters.join(symbols, "id")
    return m.groupBy("cluster").agg(
        F.min(F.struct("file", "line", "id"))["id"].alias("first"),
        F.count("*").alias("size"),
        F.count_distinct("file").alias("n_files"),
        F.sum("node_count").alias("total_nodes"),
        F.bool_and(F.coalesce("is_test", F.lit(False))).alias("all_test"),
        F.min("dating.first_seen").alias("first_seen"),
        F.max("dating.last_touched").alias("last_touched"),
        F.max("dating.first_seen").alias("newest_birth"),
    ).where("size > 1")


def clone_clusters(symbols: DataFrame) -> DataFrame:
    """(id, cluster) by equal structural hash; ``cluster`` is the smallest id."""
    own = symbols.select("id", F.col("merkle_root").alias("grp")).where("grp IS NOT NULL")
    first = own.groupBy("grp").agg(F.min("id").alias("cluster"), F.count("*").alias("n")).where("n > 1")
    return own.join(first.select("grp", "cluster"), "grp").select("id", "cluster")


def role_classes(symbols: DataFrame) -> DataFrame:
    """(cluster, role, first, members): the clones of a cluster that may merge with each other: of the same dunder name, or of none (role '')."""
    name = base_name(F.col("qname"))
    role = symbols.select("id", F.when(is_dunder(name), name).otherwise("").alias("role"))
    return clone_clusters(symbols).join(role, "id").groupBy("cluster", "role").agg(F.min("id").alias("first"), F.count("*").alias("members"))


def cluster_centroids(clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """(cluster, term, w): mean of the members' weights, divided by its length."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    mean = clusters.join(weights, "id").groupBy("cluster", "term").agg(F.sum("w").alias("s")).join(size, "cluster").select("cluster", "term", (F.col("s") / F.col("n")).alias("m"))
    return mean.select("cluster", "term", (F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("cluster")))).alias("w"))


def deprecated(summary: DataFrame, centroids: DataFrame, anchor: int, theta_b: float) -> DataFrame:
    """(dead, growing, cos, terms): dead clusters and growing ones of like vocabulary, with the eight terms that weigh most in both; all-test and undated clusters are left out."""
    classed = summary.where("NOT all_test AND last_touched IS NOT NULL").select("cluster", classify(F.lit(anchor), F.col("newest_birth"), F.col("last_touched")).alias("activity"))
    c = centroids.join(classed, "cluster")
    dead = c.where("activity = 'dead'").select(F.col("cluster").alias("dead"), "term", F.col("w").alias("wd"))
    growing = c.where("activity = 'growing'").select(F.col("cluster").alias("growing"), "term", F.col("w").alias("wg"))
    pairs = dead.join(growing, "term").groupBy("dead", "growing").agg(F.sum(F.col("wd") * F.col("wg")).alias("cos")).where(F.col("cos") >= theta_b)
    weights = centroids.withColumnRenamed("cluster", "id")
    top = top_shared(shared_terms(pairs.select(F.col("dead").alias("a"), F.col("growing").alias("b")), weights), 8)
    terms = top.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return pairs.join(terms, (F.col("dead") == F.col("a")) & (F.col("growing") == F.col("b"))).select("dead", "growing", "cos", "terms")


STAGES = ("vocab_pairs", "cross_context", "low_shape", "vocab_quality", "kept")


def competing_pairs(symbols: DataFrame, weights: DataFrame, n: int, calls: tuple[DataFrame, DataFrame] | None, cfg: Config = Config(), least: int = 1) -> DataFrame:
    """The similar vocabularies (a, b, cos), with a_cos, n_shared and share, and how many of the stages of the search for the same job in another shape each passes: 1 to 5, those that pass ``least``. The last stage drops pairs that call each other, over ``calls``, the groups of ``graph.call_groups``; without them no pair passes it. The pairs are not kept: each reading finds them anew."""
    return staged_pairs(symbols, weights, n, calls, cfg, least)


def funnel(pairs: DataFrame) -> DataFrame:
    """(stage, pairs): how many pairs pass each stage, in one pass over ``competing_pairs``."""
    counts = pairs.agg(*(F.count_if(F.col("passed") > k).alias(name) for k, name in enumerate(STAGES)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("stage"), F.col(name).alias("pairs")) for name in STAGES))).alias("e")).select("e.*")


def competing_stages(symbols: DataFrame, weights: DataFrame, n: int, calls: tuple[DataFrame, DataFrame] | None, cfg: Config = Config(), least: int = 1) -> dict[str, DataFrame]:
    """The pairs after each stage of ``competing_pairs``, from the stage ``least`` on."""
    staged = competing_pairs(symbols, weights, n, calls, cfg, least)
    return {name: staged.where(F.col("passed") > k) for k, name in enumerate(STAGES) if k + 1 >= least}


BANDS, BATCH, LINKS, NODES = 64, 1 << 13, 1 << 20, 1 << 18
"""Files of the pairs by falling cosine, pairs looked at together, links held before they are reduced to stars, and symbols from which a further task merges."""


def competing_groups(kept: DataFrame, symbols: DataFrame, weights: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(cluster, members, b_max, a_at_best, terms): groups of competing symbols, merged best first on their vocabularies.

    The pairs (a, b, cos) are found once, written by falling cosine and read by the merges in that order; no join reads them.
    """
    spark, stage = kept.sparkSession, Stage(kept.sparkSession, "competing")
    band = F.floor((1 - F.col("cos")) / F.lit(1 - cfg.theta_b) * BANDS).cast("int")
    ranked = kept.select("a", "b", "cos").repartitionById(BANDS, F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), band))).sortWithinPartitions(F.desc("cos"), "a", "b")
    ranked = stage.keep(ranked, "ranked")
    comp = stage.keep(components(ranked.select("a", "b").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(_stars, "a bigint, b bigint")), "components")
    vec = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("e"))
    nodes = comp.join(vec, "id", "left").select("root", "id", F.col("e.term").alias("k"), F.col("e.w").alias("w"))
    files = by_number(ranked)
    uris, least = [u for k in sorted(files) for u in files[k]], REP_RELAX * cfg.theta_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from merge_ranked(pa.Table.from_batches(held).sort_by("id"), lambda: batches_of(uris, BATCH), least)

    tasks = max(1, -(-comp.count() // NODES))
    best = stage.keep(nodes.repartition(tasks, "root").mapInArrow(run, "cluster bigint, members array<bigint>, a bigint, b bigint, b_max double"), "merged")
    stage.drop(ranked)
    ends = best.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    shape = pair_cosines(best.select("a", "b", "cluster"), label_vectors(symbols.join(ends, "id", "left_semi")), "cluster").select("cluster", F.col("cos").alias("a_at_best"))
    terms = top_shared(shared_terms(best, weights), 8).groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return best.join(shape, "cluster").join(terms, ["a", "b"]).select("cluster", "members", "b_max", "a_at_best", "terms")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the same ids as those given: one for each id at most."""
    held, n = [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        ids, root = local_stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return ids[ids != root], root[ids != root]

    for b in batches:
        held.append((b.column("a").to_numpy(), b.column("b").to_numpy()))
        n += b.num_rows
        if n >= LINKS:
            held, n = [reduced()], 0
    if held:
        yield from pa.table(dict(zip("ab", map(pa.array, reduced()), strict=True))).to_batches()


def merge_ranked(nodes: pa.Table, pairs: Callable[[], Iterator[pa.RecordBatch]], least: float) -> Iterator[pa.RecordBatch]:
    """The sets of two or more of ``merge_best_first``, of single symbols to start with, and the pair of each with the greatest (cos, a, b).

    ``nodes`` (id, k, w) ascend by id and hold all of some components; ``pairs`` gives (a, b, cos)
    of these and other components in the order of the merge, as often as it is called. Pairs are never held beyond a batch.
    """
    ids = nodes.column("id").to_numpy()
    sizes = pc.fill_null(pc.list_value_length(nodes.column("k")), 0).to_numpy()
    at = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    terms = pc.list_flatten(nodes.column("k"))
    term = pc.index_in(terms, pc.unique(terms)).to_numpy().astype(np.int64)
    w = pc.list_flatten(nodes.column("w")).to_numpy()
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(ids)), sizes), w * w, len(ids)))
    w = w / np.repeat(np.where(length > 0, length, 1.0), sizes)
    width = int(term.max()) + 1 if len(term) else 1
    order = np.argsort(np.repeat(np.arange(len(ids)), sizes) * width + term)
    term, w = term[order], w[order]
    home, rep, members = np.arange(len(ids)), np.arange(len(ids)), [[k] for k in range(len(ids))]

    def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the elements of each row, ascending, and their weights."""
        of = np.repeat(np.arange(len(rows)), sizes[rows])
        where = np.arange(len(of)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows]) + np.repeat(at[rows], sizes[rows])
        return of * width + term[where], w[where]

    def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (p, u), (q, v) = flat(x), flat(y)
        if not len(q):
            return np.zeros(len(x))
        place = np.minimum(np.searchsorted(q, p), len(q) - 1)
        hit = q[place] == p
        return np.bincount(p[hit] // width, u[hit] * v[place[hit]], len(x))

    def known() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        last = np.inf
        for b in pairs():
            a, b, cos = (b.column(c).to_numpy() for c in ("a", "b", "cos"))
            if len(cos) and (cos[0] > last or (np.diff(cos) > 0).any()):
                raise ValueError("pairs do not come by falling cosine")
            last = cos[-1] if len(cos) else last
            i, j = (np.minimum(np.searchsorted(ids, c), len(ids) - 1) for c in (a, b))
            own = (ids[i] == a) & (ids[j] == b)
            yield i[own], j[own], cos[own]

    vectors: dict[int, dict] = {}

    def vector(k: int) -> dict:
        if k not in vectors:
            vectors[k] = dict(zip(term[at[k] : at[k + 1]].tolist(), w[at[k] : at[k + 1]].tolist(), strict=True))
        return vectors[k]

    for i, j, _ in known():
        apart = home[i] != home[j]
        i, j = i[apart], j[apart]
        x, y = home[i], home[j]
        good = cosines(rep[x], rep[y]) >= least
        changed: set[int] = set()
        for p, q, r, s, ok in zip(i.tolist(), j.tolist(), x.tolist(), y.tolist(), good.tolist(), strict=True):
            if r in changed or s in changed:  # as the batch began, it was otherwise
                r, s = int(home[p]), int(home[q])
                ok = r != s and _cos(vector(int(rep[r])), vector(int(rep[s]))) >= least
            if ok:
                stays = rep[r] if len(members[r]) >= len(members[s]) else rep[s]
                changed |= {r, s}
                if len(members[r]) < len(members[s]):
                    r, s = s, r
                home[members[s]] = r
                members[r] += members[s]
                members[s] = []
                rep[r] = stays
    best: dict[int, tuple[float, int, int]] = {}
    top = np.full(len(ids), -np.inf)
    for i, j, cos in known():
        x = home[i]
        for k in np.flatnonzero((x == home[j]) & (cos >= top[x])).tolist():
            h, pair = int(x[k]), (float(cos[k]), int(i[k]), int(j[k]))
            if h not in best or pair > best[h]:
                best[h], top[h] = pair, pair[0]
    for found in (list(best.items())[k : k + BATCH] for k in range(0, len(best), BATCH)):
        sets = [ids[sorted(members[h])] for h, _ in found]
        columns = [[int(m[0]) for m in sets], [m.tolist() for m in sets], [int(ids[p[1]]) for _, p in found], [int(ids[p[2]]) for _, p in found], [p[0] for _, p in found]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "members", "a", "b", "b_max"])


def grow_families(units: pd.DataFrame, links: list[tuple[int, int]], cfg: Config) -> list[dict]:
    """Average linkage around tight cores, over one component of units.

    ``units`` has unit, core (a tight cluster), role, members, and their label and term
    vectors (la, lw, ta, tw: lists by member); ``links`` are the pairs of units whose
    similarity reaches the family bound. The most similar pair with a core is merged while
    its similarity, role and vocabulary allow. A pair of sets can only be as similar as
    some pair of their units, so links are all that has to be looked at.
    """
    state = {}
    for u in units.sort_values("unit").itertuples():
        a = [_unit(k, w) for k, w in zip(u.la, u.lw, strict=True)]
        b = [_unit(k, w) for k, w in zip(u.ta, u.tw, strict=True)]
        state[u.unit] = {"a": _total(a), "n": len(a), "b": _total(b), "m": len(b), "core": bool(u.core), "role": u.role, "units": [u.unit]}
    like: dict[int, set[int]] = {i: set() for i in state}
    now: dict[tuple[int, int], float] = {}
    heap: list[tuple[float, int, int]] = []

    def look(i: int, j: int) -> None:
        """Notes how similar two sets are now, and offers them for a merge."""
        i, j = min(i, j), max(i, j)
        x, y = state[i], state[j]
        now.pop((i, j), None)
        s = _cos(x["a"], y["a"]) / (x["n"] * y["n"])
        if s < cfg.theta_family:
            return
        like[i].add(j)
        like[j].add(i)
        if (x["core"] or y["core"]) and _cos(x["b"], y["b"]) / max(x["m"] * y["m"], 1) >= cfg.theta_b_family:
            now[i, j] = s
            heapq.heappush(heap, (-s, i, j))

    for i, j in links:
        if state[i]["role"] == state[j]["role"]:
            look(i, j)
    while heap:
        s, i, j = heapq.heappop(heap)
        if now.get((i, j)) != -s:
            continue
        del now[i, j]
        x, y = state[i], state.pop(j)
        x["a"], x["n"] = _total([x["a"], y["a"]]), x["n"] + y["n"]
        if x["core"] and y["core"]:
            x["b"], x["m"] = _total([x["b"], y["b"]]), x["m"] + y["m"]
        elif y["core"]:
            x["b"], x["m"] = y["b"], y["m"]
        x["core"] = True
        x["units"] += y["units"]
        around = (like.pop(j) | like[i]) - {i, j}
        like[i] = set()
        for k in around:
            like[k] -= {i, j}
            now.pop((min(j, k), max(j, k)), None)
            look(i, k)
    return [{"family": i, "units": s["units"]} for i, s in state.items() if s["core"] and len(s["units"]) > 1]


def _total(vectors: list[dict]) -> dict:
    out: dict = {}
    for v in vectors:
        for k, w in v.items():
            out[k] = out.get(k, 0.0) + w
    return out


def families(symbols: DataFrame, tight: DataFrame, weights: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(family, id, is_core, cos_to_core, b_cos_to_core): looser families grown around tight clusters.

    Units are tight clusters and single symbols with a shape. Their mean vectors are
    joined at the family bound; each component of these edges is grown in its own task.
    ``family`` is its smallest unit; the core is the largest tight cluster in it (ties:
    tighter, then the lowest medoid), and cosines are to that cluster's medoid.
    """
    lw = label_weights(symbols)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    unit_l = lw.select("id", F.col("label").alias("key"), (F.col("w") / norm).alias("w")).where("w > 0")
    ids = unit_l.select("id").distinct()
    name = base_name(F.col("qname"))
    role = F.when(is_dunder(name), name).otherwise("")
    unit = ids.join(tight, "id", "left").join(symbols.select("id", role.alias("role")), "id").select("id", F.coalesce("cluster", "id").alias("unit"), F.col("cluster").isNotNull().alias("core"), "role")
    # A cluster whose members' roles differ has the role of none.
    size = unit.groupBy("unit").agg(F.count("*").alias("n"), F.when(F.min("role") == F.max("role"), F.min("role")).otherwise(F.lit("")).alias("role"), F.bool_or("core").alias("core"))
    mean = unit_l.join(unit.select("id", "unit"), "id").groupBy("unit", "key").agg(F.sum("w").alias("s")).join(size, "unit").select(F.col("unit").alias("id"), "key", (F.col("s") / F.col("n")).alias("w"))
    stage = Stage(symbols.sparkSession, "families")
    joined = stage.keep(prefix_join(stage.keep(mean, "units"), cfg.theta_family), "edges")
    comp = stage.keep(components(joined), "components")
    links = joined.select("a", "b").join(comp.select(F.col("id").alias("a"), F.col("root").alias("of")), "a").select("of", "a", "b")
    lists_l = unit_l.groupBy("id").agg(F.collect_list("key").alias("la"), F.collect_list("w").alias("lw"))
    lists_t = weights.groupBy("id").agg(F.collect_list("term").alias("ta"), F.collect_list("w").alias("tw"))
    empty_t, empty_w = F.array().cast("array<string>"), F.array().cast("array<double>")
    nodes = unit.select("id", "unit").join(size.select("unit", "core", "role"), "unit").join(comp.withColumnsRenamed({"id": "unit"}), "unit").join(lists_l, "id").join(lists_t, "id", "left").select("root", "unit", "core", "role", "id", "la", "lw", F.coalesce("ta", empty_t).alias("ta"), F.coalesce("tw", empty_w).alias("tw"))

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not n["core"].any():
            return pd.DataFrame(rows, columns=["family", "id", "is_core", "cos_to_core", "b_cos_to_core"])
        n = n.sort_values(["unit", "id"])
        g = n.groupby("unit", sort=True)
        units = g.agg(core=("core", "first"), role=("role", "first"), la=("la", list), lw=("lw", list), ta=("ta", list), tw=("tw", list)).reset_index()
        a = {i: _unit(k, w) for i, k, w in zip(n["id"], n["la"], n["lw"], strict=True)}
        b = {i: _unit(k, w) for i, k, w in zip(n["id"], n["ta"], n["tw"], strict=True)}
        ids = {u: list(x) for u, x in g["id"]}
        core = dict(zip(units["unit"], units["core"], strict=True))
        for f in grow_families(units, list(zip(e["a"], e["b"], strict=True)), cfg):
            best = None
            for u in (u for u in f["units"] if core[u]):
                total = _total([a[i] for i in ids[u]])
                m = len(ids[u])
                sums = {i: _cos(a[i], total) for i in ids[u]}
                medoid = min(ids[u], key=lambda i: (-round(sums[i] - _cos(a[i], a[i]), 9), i))
                tightness = (sum(sums.values()) - m) / (m * (m - 1)) if m > 1 else 1.0
                key = (-m, -round(tightness, 9), medoid)
                if best is None or key < best[0]:
                    best = (key, u, medoid)
            _, u0, medoid = best
            for u in f["units"]:
                for i in ids[u]:
                    rows.append((f["family"], i, u == u0, _cos(a[i], a[medoid]), _cos(b[i], b[medoid])))
        return pd.DataFrame(rows, columns=["family", "id", "is_core", "cos_to_core", "b_cos_to_core"])

    return nodes.groupBy("root").cogroup(links.groupBy("of")).applyInPandas(run, "family bigint, id bigint, is_core boolean, cos_to_core double, b_cos_to_core double")


def family_summary(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """(family, members, core, sub_units, n_files, min_cos, max_cos, all_test): one row per family; the gradient leaves the medoid out."""
    m = members.join(symbols.select("id", "file", F.coalesce("is_test", F.lit(False)).alias("is_test")), "id")
    off = F.when(F.round("cos_to_core", 9) < 1, F.col("cos_to_core"))
    return m.groupBy("family").agg(
        F.count("*").alias("members"), F.sum(F.col("is_core").cast("int")).alias("core"), F.count_distinct("file").alias("n_files"),
        F.round(F.min(off), 6).alias("min_cos"), F.round(F.max(off), 6).alias("max_cos"), F.bool_and("is_test").alias("all_test"),
    )
