"""The map of an analysis and its read-only endpoints, as plain functions over state gathered once for display."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import KNN
from strata.operators import align, geometry, graph, vectors
from strata.operators.similarity import histogram_map, map_cosine, shared_terms, top_shared
from strata.plans.analysis import Analysis
from strata.plans.report import card, day, fact_lines
from strata.runtime import Stage
from strata.sources import python_code
from strata.sources.git_log import Branch


PAGE = """<!doctype html><meta charset="utf-8"><title>strata</title><h1>{repo}</h1>
<p>{count} symbols. Endpoints: /api/symbols, /api/meta, /api/find?q=, /api/explain?id=, /api/source?id=, /api/compare?id=&amp;b=, /api/anchor?id=, /api/edge?a=&amp;b=, /api/sublayout?path=</p>
<script>const boot = {boot}</script>"""
EXTENT = 832
"""Width of a picture in points of the screen, in which radii are given."""


@dataclass
class Plane:
    """One picture: positions, neighbours and labels."""

    xy: dict[int, tuple[float, float]]
    near: dict[int, list[int]]
    labels: list[dict]


def color_depth(files: list[str]) -> int:
    """The least number of folders, up to 4, by which files fall into three keys or more."""
    return next((d for d in range(1, 5) if len({folder_key(f, d) for f in files}) >= 3), 4)


def folder_key(file: str, depth: int) -> str:
    return "/".join(file.split("/")[:-1][:depth]) or "."


class Explorer:
    """Answers GET requests about one analysis; wrong methods give 405, bad parameters 400, unknown ids or paths 404.

    Two planes are drawn: one of all symbols and one of those that are no tests. A picture
    is drawn on the driver and has a bounded number of points.
    """

    def __init__(self, a: Analysis, embedding: DataFrame, find: Callable[[str], list[dict]] | None = None, files: DataFrame | None = None, branch: Branch | None = None, tests: bool = False):
        self.a, self.find, self.tests = a, find, tests
        self.spark = a.symbols.sparkSession
        stage = Stage(self.spark, "explore")
        self.v = v = stage.keep(embedding.select("id", "v"), "vectors")
        comps, var, total, mean = vectors.principal_components(v, 8)
        seeds = geometry.one_picture(vectors.project(v, comps, mean))
        self.pca = {int(r.id): [round(float(x), 6) for x in r.pca] for r in seeds.itertuples()}
        found = a.symbols.select("id", "qname", "file", "line", "node_count", "is_test", "dating", "merkle_root").orderBy("id").collect()
        root = np.sqrt([r["node_count"] for r in found])
        span = root.max() - root.min() if len(root) else 0
        self.radius = dict(zip((r["id"] for r in found), (2 + 5 * (root - root.min()) / span if span else np.full(len(root), 3.5)) / EXTENT, strict=True))
        self.is_test = {r["id"]: bool(r["is_test"]) for r in found}
        self.file, self.qname = {r["id"]: r["file"] for r in found}, {r["id"]: r["qname"] for r in found}
        product = [i for i in self.file if not self.is_test[i]]
        depth = color_depth([self.file[i] for i in product])
        keys = {i: folder_key(f, depth) for i, f in self.file.items()}
        start = {i: tuple(p[:2]) if len(p) > 1 else (0.0, 0.0) for i, p in self.pca.items()}
        self.full = self._plane(list(self.file), start, keys)
        self.prod = self._plane(product, start, keys)
        self.new = {r["id"] for r in found if branch and r["file"] in branch.changed_files and r["merkle_root"] not in branch.base_roots}
        self.tokens = self.links = None
        if files is not None:
            at = a.symbols.select(F.col("id").alias("src"), "file", F.col("span.s").alias("s"))
            self.tokens = stage.keep(python_code.scan_sources(files).join(at, ["file", "s"]), "tokens")
            sites = self.tokens.select("src", "file", F.explode("toks").alias("t")).where("t.base IS NOT NULL").select("src", "file", "t.base", "t.module").distinct()
            self.links = stage.keep(graph.unique_links(a.symbols, sites), "links")
        indeg = {r["id"]: r["indeg"] for r in graph.in_degree(a.symbols, a.edges).collect()}
        calls = {r["src"]: r for r in graph.capped_callees(a.edges).collect()}
        self.rows = []
        for r in found:
            i, d = r["id"], r["dating"]
            x, y = self.prod.xy.get(i, (None, None))
            row = {
                "id": i, "qname": r["qname"], "file": r["file"], "line": r["line"], "nodes": r["node_count"], "indeg": indeg.get(i, 0), "is_test": r["is_test"], "branch_new": i in self.new, "dir": keys[i],
                "first_seen": day(d and d["first_seen"]), "last_touched": day(d and d["last_touched"]), "x": x, "y": y, "xt": self.full.xy[i][0], "yt": self.full.xy[i][1], "pca": self.pca[i],
                "nn": self.full.near[i], "nnp": self.prod.near.get(i), "calls": calls[i]["callees"] if i in calls else [],
            }
            if i in calls and calls[i]["over"]:
                row["calls_over"] = calls[i]["over"]
            self.rows.append(row)
        docs = [] if files is None else [{"file": r["file"], "is_test": r["is_test"], "doc": r["has_docstring"]} for r in python_code.file_docs(files).orderBy("file").collect()]
        self.meta = {
            "pca_var": [round(float(x / total), 6) if total else 0.0 for x in var], "symbols": len(self.rows), "labels": {"prod": self.prod.labels, "full": self.full.labels},
            "branch": None if branch is None else {"name": branch.branch, "base": branch.base, "changed": len(self.new)}, "file_docs": docs,
        }

    def _plane(self, ids: list[int], start: dict[int, tuple[float, float]], keys: dict[int, str]) -> Plane:
        """The picture of some symbols, unfolded from where they stood before."""
        if not ids:
            return Plane({}, {}, [])
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        adj = vectors.mutual_adjacency(vectors.knn(self.v.join(wanted, "id"), KNN)).toPandas()  # a point has a few neighbours
        seeds = pd.DataFrame({"id": ids, "pca": [start[i] for i in ids]})
        xy = geometry.layout_frame(seeds, adj)
        xy[["x", "y"]] = geometry.relax(xy[["x", "y"]].to_numpy(), np.array([self.radius[i] for i in xy["id"]]))
        place = {int(r.id): (round(float(r.x), 6), round(float(r.y), 6)) for r in xy.itertuples()}
        near: dict[int, list[int]] = {i: [] for i in ids}
        for i, j in sorted(zip(adj["i"], adj["j"], strict=True)):
            near[int(i)].append(int(j))
        points = self.spark.createDataFrame([(i, keys[i], *place[i]) for i in ids], "id bigint, dir string, x double, y double")
        labels = [{"dir": r["dir"], "x": round(r["x"], 6), "y": round(r["y"], 6), "count": r["count"], "r": round(r["r"], 6)} for r in vectors.labels_by_dir(points, "dir").orderBy("dir").collect()]
        return Plane(place, near, labels)

    def respond(self, method: str, url: str) -> tuple[int, object]:
        if method != "GET":
            return 405, {"error": "method"}
        parts = urlsplit(url)
        q: dict[str, str] = {}
        for k, v in parse_qsl(parts.query, keep_blank_values=True):
            q.setdefault(k, v)
        path = parts.path
        if path == "/":
            return 200, PAGE.format(repo=html.escape(self.a.root), count=len(self.rows), boot=json.dumps({"count": len(self.rows), "tests": self.tests, "k": KNN}))
        if path == "/favicon.ico":
            return 204, ""
        if path == "/api/sublayout":
            got = self._sublayout(q["path"].strip("/")) if q.get("path", "").strip("/") else None
            return (200, got) if got else (404, {"error": "path"}) if q.get("path") else (400, {"error": "path"})
        if path == "/api/compare":
            return self._compare(self._id(q.get("id")), self._id(q["b"]) if "b" in q else -1)
        if path == "/api/symbols":
            return 200, self.rows
        if path == "/api/meta":
            return 200, self.meta
        if path == "/api/find":
            return (200, self.find(q["q"])) if self.find and q.get("q") else (400, {"error": "q"})
        if path == "/api/edge":
            a, b = self._id(q.get("a")), self._id(q.get("b"))
            return self._two(a, b, lambda: {"a": a, "b": b, "terms": self._terms(a, b)})
        if path in ("/api/anchor", "/api/explain", "/api/source"):
            i = self._id(q.get("id"))
            if i is None:
                return 400, {"error": "id"}
            if not 0 <= i < len(self.rows):
                return 404, {"error": "id"}
            return 200, {"/api/anchor": self._anchor, "/api/explain": self._explain, "/api/source": self._source}[path](i)
        return 404, {"error": "path"}

    @staticmethod
    def _id(s: str | None) -> int | None:
        return int(s) if s is not None and s.isascii() and s.isdigit() else None

    def _two(self, a: int | None, b: int | None, make: Callable[[], object]) -> tuple[int, object]:
        if a is None or b is None:
            return 400, {"error": "a, b"}
        return (200, make()) if max(a, b) < len(self.rows) else (404, {"error": "id"})

    def _terms(self, a: int, b: int) -> list[str]:
        pair = self.a.symbols.sparkSession.createDataFrame([(a, b)], "a bigint, b bigint")
        return [r["term"] for r in top_shared(shared_terms(pair, self.a.weights), 3).orderBy("rank").collect()]

    def _explain(self, i: int) -> dict:
        got = card(self.a, self.a.symbols.where(F.col("id") == i).first())
        return got | {"facts_text": fact_lines(got["facts"], got["family"]), "nearest_existing": self._existing(i)}

    def _existing(self, i: int, k: int = 8) -> list[dict] | None:
        """For a symbol new on the branch the existing ones nearest to it by embedding, with their cosines of shape and vocabulary; for others null."""
        if i not in self.new:
            return None
        old = [j for j in self.file if j not in self.new and not self.is_test[j]]
        near = self._nearest(i, old, k)
        a, b = (self._anchor(i)[c] for c in ("a_cos", "b_cos"))
        return [{"id": j, "qname": self.qname[j], "file": self.file[j], "line": self.rows[j]["line"], "a_cos": a[j], "b_cos": b[j]} for j in near]

    def _nearest(self, i: int, among: list[int], k: int) -> list[int]:
        own = self.v.where(F.col("id") == i).first()
        if own is None or not among:
            return []
        some = self.v.join(self.spark.createDataFrame([(j,) for j in among], "id bigint"), "id")
        return [r["id"] for r in vectors.top_k(some, own["v"], k).collect()]

    def _source(self, i: int) -> dict:
        r = self.a.symbols.where(F.col("id") == i).select("qname", "file", "line", "is_test", "source").first()
        toks: list[list] = []
        if self.tokens is not None:
            link = {x["base"]: x["dst"] for x in self.links.where(F.col("src") == i).collect()}
            row = self.tokens.where(F.col("src") == i).first()
            toks = sorted([t["s"], t["e"], t["kind"] or "", link.get(t["base"])] for t in (row["toks"] if row else []) if t["kind"] or t["base"] in link)
        return {"id": i, **{k: r[k] for k in ("qname", "file", "line", "is_test")}, "text": r["source"], "toks": toks}

    def _compare(self, i: int | None, other: int | None) -> tuple[int, object]:
        """Two symbols' texts and what corresponds in them; without ``b`` the nearest one by embedding, which is a test only for a test."""
        if i is None or other is None:
            return 400, {"error": "id, b"}
        if max(i, other) >= len(self.rows):
            return 404, {"error": "id"}
        if other < 0:
            best = self._nearest(i, [j for j in self.file if j != i and (self.is_test[i] or not self.is_test[j])], 1)
            if not best:
                return 404, {"error": "nothing to compare with"}
            other = best[0]
        pair = self.spark.createDataFrame([(i, other, self._anchor(i)["a_cos"][other])], "a bigint, b bigint, cos double")
        regions = align.align_pairs(align.sides(pair, self.a.symbols)).orderBy("a_s", "b_s").collect()
        starts = {r["id"]: r["s"] for r in self.a.symbols.where(F.col("id").isin(i, other)).select("id", F.col("span.s").alias("s")).collect()}
        a, b = self._source(i), self._source(other)

        def units(text: str, at: int) -> int:
            return len(text.encode()[:at].decode("utf-8", "ignore").encode("utf-16-le")) // 2

        return 200, {"a": a, "b": b, "regions": [{"a": [units(a["text"], r[c] - starts[i]) for c in ("a_s", "a_e")], "b": [units(b["text"], r[c] - starts[other]) for c in ("b_s", "b_e")], "tier": r["tier"]} for r in regions]}

    def _sublayout(self, path: str) -> dict | None:
        """The picture of what lies in one file or below one folder, unfolded from the whole map; keys are classes in a file, else folders below the path, else files."""
        ids = [i for i, f in self.file.items() if f == path or f.startswith(path + "/")]
        if not ids:
            return None
        is_file = all(self.file[i] == path for i in ids)
        if is_file:
            keys = {i: self.qname[i].rpartition(".")[0] or "." for i in ids}
        else:
            rel = {i: self.file[i].removeprefix(path + "/") for i in ids}
            depth = color_depth([rel[i] for i in ids if not self.is_test[i]])
            keys = {i: folder_key(rel[i], depth) for i in ids}
            if len(set(keys.values())) < 2:
                keys = {i: rel[i].split("/")[0] for i in ids}
        full = self._plane(ids, self.full.xy, keys)
        prod = self._plane([i for i in ids if not self.is_test[i]], self.prod.xy, keys)
        at = lambda plane, k: [plane.xy[i][k] if i in plane.xy else None for i in ids]
        return {
            "path": path, "kind": "file" if is_file else "dir", "ids": ids, "dir": [keys[i] for i in ids], "x": at(prod, 0), "y": at(prod, 1), "xt": at(full, 0), "yt": at(full, 1),
            "nn": [full.near[i] for i in ids], "nnp": [prod.near.get(i) for i in ids], "labels": {"prod": prod.labels, "full": full.labels},
        }

    def _anchor(self, i: int) -> dict:
        """Shape and vocabulary cosines of one symbol to all, 0 where nothing is shared."""
        h = histogram_map(self.a.symbols)
        one = h.where(F.col("id") == i).select(F.col("m").alias("m1"), F.col("n").alias("n1"))
        a = {r["id"]: r["c"] for r in h.join(F.broadcast(one)).select("id", map_cosine(F.col("m1"), F.col("m"), F.col("n1"), F.col("n")).alias("c")).collect()}
        w = self.a.weights
        b = {r["id"]: r["c"] for r in w.join(w.where(F.col("id") == i).select("term", F.col("w").alias("q")), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("c")).collect()}
        return {"id": i, "a_cos": [round(a.get(r["id"], 0.0), 6) for r in self.rows], "b_cos": [round(b.get(r["id"], 0.0), 6) for r in self.rows]}

    def serve(self, port: int = 4816) -> None:
        explorer = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self) -> None:
                status, body = explorer.respond(self.command, self.path)
                data = (body if isinstance(body, str) else json.dumps(body, sort_keys=True)).encode()
                self.send_response(status)
                self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(body, str) else "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = do_DELETE = _answer  # noqa: N815

        HTTPServer(("127.0.0.1", port), Handler).serve_forever()
