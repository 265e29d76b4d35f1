"""JSON and text for what an analysis found. Findings are few next to the symbols; they are gathered on the driver to be printed."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import Row
from pyspark.sql import functions as F

from strata.config import DEAD_AFTER, GROWING_WITHIN
from strata.operators.clustering import family_summary, funnel
from strata.operators.graph import entry_points, in_degree, names
from strata.operators.similarity import histogram_map, map_cosine
from strata.plans.analysis import Analysis

SECTIONS = ("families", "competing")


def day(secs: int | None) -> str | None:
    return None if secs is None else (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=secs)).strftime("%Y-%m-%d")


def member(r: Row, **more: Any) -> dict:
    d = r["dating"]
    return {"file": r["file"], "line": r["line"], "qname": r["qname"], "nodes": r["node_count"], "is_test": bool(r["is_test"]), "first_seen": day(d and d["first_seen"]), "last_touched": day(d and d["last_touched"]), **more}


def _members(a: Analysis, ids: set[int]) -> dict[int, Row]:
    if not ids:
        return {}
    wanted = a.symbols.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "id bigint")
    return {r["id"]: r for r in a.symbols.join(wanted, "id").select("id", "file", "line", "qname", "node_count", "is_test", "dating").collect()}


def report(a: Analysis, only: set[str] | None = None) -> dict:
    """The scan's contract: repeated and deprecated always, families and competing if selected, counts of every stage always."""
    pick = set(SECTIONS) if only is None else only
    repeated = a.repeated.collect()
    inside: dict[int, list[int]] = {r["cluster"]: [] for r in repeated}
    for r in a.tight.join(a.symbols.select("id", "file", "line"), "id").orderBy("file", "line", "id").select("id", "cluster").collect():
        inside[r["cluster"]].append(r["id"])
    fam = a.families.collect()
    summary = {r["family"]: r for r in family_summary(a.families, a.symbols).collect()}
    comp = a.competing.collect()
    old = a.deprecated.collect() if a.deprecated is not None else []
    rows = _members(a, {i for ids in inside.values() for i in ids} | {r["id"] for r in fam} | {i for r in comp for i in r["members"]})
    repeated.sort(key=lambda r: (r["n_files"] <= 1, r["all_test"], -r["total_nodes"], rows[r["first"]]["file"], rows[r["first"]]["line"]))
    place = {r["cluster"]: f"R{n}" for n, r in enumerate(repeated, 1)}
    out: dict[str, Any] = {
        "schema": "scan/1", "repo": a.root, "config": asdict(a.cfg), "stats": a.stats, "history": None if a.anchor is None else {"anchor": day(a.anchor)},
        "repeated": [{"ref": place[r["cluster"]], "members": [member(rows[i]) for i in inside[r["cluster"]]], "n_files": r["n_files"], "total_nodes": r["total_nodes"], "all_test": r["all_test"], "first_seen": day(r["first_seen"]), "last_touched": day(r["last_touched"])} for r in repeated],
        "repeated_funnel": {"clusters_formed": len(repeated), "clustered_symbols": sum(r["size"] for r in repeated)},
        "deprecated": [{"dead": place.get(r["dead"]), "growing": place.get(r["growing"]), "cosine": round(r["cos"], 6), "terms": r["terms"]} for r in sorted(old, key=lambda r: (-r["cos"], r["dead"], r["growing"]))],
        "deprecated_funnel": {"pairs": len(old)}, "family_funnel": {"families": len(summary)},
        "competing_funnel": {r["stage"]: r["pairs"] for r in funnel(a.competing_pairs).collect()}, "families": [], "competing": [],
    }
    if "families" in pick:
        order = sorted(summary.values(), key=lambda r: (-r["members"], -r["n_files"], r["family"]))
        for n, s in enumerate(order, 1):
            own = sorted((r for r in fam if r["family"] == s["family"]), key=lambda r: (not r["is_core"], -r["cos_to_core"], r["id"]))
            out["families"].append({"ref": f"F{n}", "n_files": s["n_files"], "core_size": s["core"], "min_cos": s["min_cos"], "max_cos": s["max_cos"], "all_test": s["all_test"], "members": [member(rows[r["id"]], is_core=r["is_core"], cos_to_core=round(r["cos_to_core"], 6)) for r in own]})
    if "competing" in pick:
        for n, r in enumerate(sorted(comp, key=lambda r: (-r["b_max"], r["members"])), 1):
            ms = sorted(r["members"], key=lambda i: (rows[i]["file"], rows[i]["line"]))
            out["competing"].append({"ref": f"C{n}", "members": [member(rows[i]) for i in ms], "b_max": round(r["b_max"], 6), "a_at_best": round(r["a_at_best"], 6), "terms": r["terms"]})
    return out


def to_json(x: Any) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False, indent=2)


def largest_targets(a: Analysis, k: int = 3) -> list[str]:
    """Example targets: the largest symbols that are no tests."""
    rows = a.symbols.where(~F.col("is_test")).orderBy(F.desc("node_count"), "file", "line").limit(k).select("qname").collect()
    return [r["qname"] for r in rows]


SHOWN, CAP = 2, 32
"""Names a line of the card shows, and names a list of the card holds."""


def card(a: Analysis, target: Row) -> dict:
    """One symbol's dossier: dates and activity, whether it is its folder's entry point, exact and near clones, role twins, callers and callees (the first 32 and how many more), family, and how common its shape and name are.

    Near clones come by falling cosine, all other lists by file and line.
    """
    i, s, d = target["id"], a.symbols, target["dating"]
    place = ["file", "line", "id"]
    shown = ["id", "file", "line", "qname", "node_count", "is_test", "dating"]
    own = a.tight.join(a.tight.where(F.col("id") == i).select("cluster"), "cluster").join(s, "id")
    shape = own.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).first()
    others = own.where(F.col("id") != i)
    exact = others.where(F.col("merkle_root") == target["merkle_root"]).orderBy(*place).select(*shown).collect()
    hist = histogram_map(s)
    mine = hist.where(F.col("id") == i).select(F.col("m").alias("m0"), F.col("n").alias("n0"))
    near_ids = others.where(F.col("merkle_root") != target["merkle_root"])
    cos = map_cosine(F.col("m0"), F.col("m"), F.col("n0"), F.col("n")).alias("cos")
    near = near_ids.join(hist, "id").join(F.broadcast(mine)).select(*shown, cos).orderBy(F.round("cos", 9).desc(), *place).collect()  # the target's row
    twins = a.competing.where(F.array_contains("members", i)).first()
    twin_rows = sorted(_members(a, set(twins["members"]) - {i}).values(), key=lambda r: (r["file"], r["line"])) if twins else []
    fam = a.families.where(F.col("id") == i).first()
    family = None
    if fam is not None:
        order = family_summary(a.families, s).orderBy(F.desc("members"), F.desc("n_files"), "family").collect()
        n, row = next((n, r) for n, r in enumerate(order, 1) if r["family"] == fam["family"])
        family = {"family": f"F{n}", "is_core": fam["is_core"], "cos_to_core": round(fam["cos_to_core"], 6), "members": row["members"], "n_files": row["n_files"]}
    base = target["qname"].rsplit(".", 1)[-1]
    key = target["qname"].rsplit(".", 2)[-2] if base == "__init__" and "." in target["qname"] else base
    return {
        "symbol": member(target), "activity": _activity(a, d), "entry": _entry(a, i),
        "exact": [member(r) for r in exact], "near": [member(r, cosine=round(r["cos"], 6)) for r in near],
        "twins": None if twins is None else {"members": [member(r) for r in twin_rows], "b_max": round(twins["b_max"], 6), "terms": twins["terms"]},
        "theta_b": a.cfg.theta_b, **_ends(a, i), "family": family,
        "facts": {"same_shape": max(shape["n"], 1), "same_shape_files": max(shape["files"], 1), "name": key, "same_name": max(names(s).where(F.col("name") == key).count(), 1)},
    }


def _activity(a: Analysis, dating: Row | None) -> str | None:
    if dating is None or a.anchor is None:
        return None
    if a.anchor - dating["last_touched"] > DEAD_AFTER:
        return "dead"
    return "growing" if a.anchor - dating["first_seen"] <= GROWING_WITHIN else "flat"


def _entry(a: Analysis, i: int) -> int | None:
    """Callers of the symbol if it is the most called of its folder."""
    top = entry_points(a.symbols, in_degree(a.symbols, a.edges)).where(F.col("id") == i).first()
    return top and top["indeg"]


def _ends(a: Analysis, i: int) -> dict:
    out = {}
    for name, own, other in (("callers", "dst", "src"), ("callees", "src", "dst")):
        linked = a.edges.where(F.col(own) == i).select(F.col(other).alias("id")).join(a.symbols.select("id", "file", "line", "qname"), "id")
        rows = linked.orderBy("file", "line", "id").limit(CAP).collect()
        out[name] = [f"{r['file']}:{r['line']} {r['qname']}" for r in rows]
        out[f"{name}_over"] = max(linked.count() - CAP, 0) if len(rows) == CAP else 0
    return out


def fact_lines(facts: dict, family: dict | None) -> list[str]:
    """How common a symbol's shape and name are, in words, and its family."""
    where = lambda n: "in the same file" if n == 1 else f"across {n} files"
    same_shape, same_name = facts["same_shape"] > 1, facts["same_name"] > 1
    shape = f"one of {facts['same_shape']} symbols with this shape, {where(facts['same_shape_files'])}" if same_shape else "the only symbol with this shape"
    name = f"one of {facts['same_name']} named {json.dumps(facts['name'])}" if same_name else f"the only symbol named {json.dumps(facts['name'])}"
    if not same_shape and not same_name:
        out = ["nothing else in the corpus shares this shape or name"]
    else:
        out = [shape, name] if same_shape else [name, shape]
    return [*out, f"one of {family['members']} members in family {family['family']}, {where(family['n_files'])}"] if family else out


def _named(rows: list[dict], cosine: bool = False) -> str:
    """The first names of a list with their places, and how many more there are."""
    each = [f"{r['qname'].rsplit('.', 1)[-1]} {r['file']}:{r['line']}" + (f" ({r['cosine']:.2f})" if cosine else "") for r in rows[:SHOWN]]
    return ", ".join(each) + (f", +{len(rows) - SHOWN} more" if len(rows) > SHOWN else "")


def card_text(c: dict) -> str:
    m = c["symbol"]
    tags = [f"{m['nodes']} nodes", *([f"entry {c['entry']}×"] if c["entry"] else []), *([f"{m['first_seen']} → {m['last_touched']}", c["activity"]] if c["activity"] else [])]
    lines = [f"{m['file']}:{m['line']}  {m['qname']}  ({' · '.join(tags)})", "facts       " + "; ".join(fact_lines(c["facts"], c["family"]))]
    clones = [f"{title}: {_named(c[title], title == 'near')}" for title in ("exact", "near") if c[title]]
    if clones:
        lines.append("clones      " + " · ".join(clones))
    t = c["twins"]
    lines.append(f"role twins  (vocab ≥{c['theta_b']:.2f}, different shape): " + (f"{_named(t['members'])} · B={t['b_max']:.2f} shared: {','.join(t['terms'])}" if t else "none"))

    def count(name: str) -> str:
        n = len(c[name]) + c[f"{name}_over"]
        return f"{n} — " + ", ".join(x.rsplit(".", 1)[-1].rsplit(" ", 1)[-1] for x in c[name][:SHOWN]) + (" …" if n > SHOWN else "") if n else "0"

    lines.append(f"callers     {count('callers')}; callees {count('callees')}  [import-aware]")
    if c["family"]:
        f = c["family"]
        lines.append(f"family      {f['family']} member ({'core' if f['is_core'] else 'drift'}, cos {f['cos_to_core']:.2f})")
    return "\n".join(lines)
