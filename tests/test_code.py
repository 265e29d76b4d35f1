"""Source trees, git history and the verbs, on a tree and a repository made here."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from strata.config import Config
from strata.operators.align import STATEMENTS, Side, align
from strata.sources import git_log, python_code
from strata.sources.python_code import Tree, signed, symbols_of

CLONE = '''
def load_rows(path, limit=10):
    """Reads."""
    rows = []
    with open(path) as handle:
        for line in handle:
            parts = line.strip().split(",")
            if len(parts) < limit:
                continue
            rows.append({"key": parts[0], "value": int(parts[1]) + 1})
    return rows
'''
RENAMED = CLONE.replace("load_rows", "read_items").replace("rows", "items").replace("path", "where").replace("parts", "bits").replace("line", "raw").replace('"key"', '"k"').replace("+ 1", "+ 2")
CALLER = '''
import json as j
from pkg.util import helper as h
from . import sib

class Box:
    def __init__(self, a):
        self.a = a

    def run(self):
        h(self.a)
        j.dumps(self.a)
        sib.go()
        return Box(1)
'''
OVERLOADED = '''
from typing import overload
import typing

@overload
def f(a: int) -> int: ...
@typing.overload
def f(a: str) -> str: ...
def f(a):
    return a

@overload_not
def g(a):
    return a
'''


def names(src, **cfg):
    return {s["qname"]: s for s in symbols_of("pkg/a.py", src.encode(), Config(min_nodes=1, **cfg))}


def test_renamed_clone_has_the_same_root():
    a, b = names(CLONE)["load_rows"], names(RENAMED)["read_items"]
    assert a["merkle_root"] == b["merkle_root"] and a["wl"] == b["wl"]
    assert a["merkle_root"] != names(CLONE.replace("continue", "break"))["load_rows"]["merkle_root"]


def test_overloads_are_dropped():
    got = symbols_of("a.py", OVERLOADED.encode(), Config(min_nodes=1))
    assert [s["qname"] for s in got] == ["f", "g"]
    assert symbols_of("a.py", b"def f(:", Config()) == []


BROKEN = b'''import os

def good(a):
    return os.path.join(a, "x")

def bad(a):
    return (a +

class C:
    def one(self):
        return self.x

    def two(self
        return 2

    def three(self):
        return "\xc3\xa9"

print "old"

def last(q):
    return q
'''


def test_a_broken_function_does_not_take_its_file_along():
    got = {s["qname"]: s for s in symbols_of("a.py", BROKEN, Config(min_nodes=1))}
    assert set(got) == {"good", "C.one", "C.three", "last"}
    assert got["last"]["line"] == 21 and got["C.three"]["source"].startswith("def three") and got["good"]["calls"]
    assert symbols_of("a.py", b"\x00", Config()) == [] and symbols_of("a.py", b"", Config()) == []


VIEWED = '''from pkg.core import load_rows
import json as j

def run_all(paths, parse_row):
    """Doc."""
    data = []  # héllo
    for p in paths:
        data.append(load_rows(p, limit=3))
    return j.dumps(parse_row(data)), transform(f"é {data} ünï"), None
'''


def test_view():
    ((s, toks),) = python_code._viewed("pkg/use.py", VIEWED.encode())
    text = VIEWED[s:].rstrip("\n")
    units = text.encode("utf-16-le")
    seen = [(units[2 * t["s"] : 2 * t["e"]].decode("utf-16-le"), t["kind"], t["base"], t["module"]) for t in toks]
    assert ("run_all", "def", None, None) in seen and ("for", "kw", None, None) in seen and ("None", "kw", None, None) in seen and ("3", "num", None, None) in seen
    assert ("load_rows", "call", "load_rows", "pkg.core") in seen and ("dumps", "call", "dumps", "json") in seen and ("transform", "call", "transform", None) in seen
    assert ("# héllo", "com", None, None) in seen and any(k == "str" and "ünï" in x for x, k, _, _ in seen)
    assert not any(b in ("p", "data", "limit", "parse_row", "j") for _, _, b, _ in seen)


def test_calls_and_vocabulary():
    run = names(CALLER)["Box.run"]
    assert run["calls"] == [{"base": "Box", "module": None}, {"base": "dumps", "module": "json"}, {"base": "go", "module": "pkg.sib"}, {"base": "helper", "module": "pkg.util"}]
    assert run["vocab_tf"]["dumps"] == 1 and "self" not in run["vocab_tf"]
    assert python_code.relative_module("a/b/c.py", 3, "x") == "x" and python_code.relative_module("a/b/c.py", 4, "x") is None


def test_span_covers_decorators():
    s = names("@deco\ndef f(a):\n    return 'é'\n")["f"]
    assert s["source"].startswith("@deco") and s["line"] == 2


def side(src, name):
    s = names(src)[name]
    t = Tree([x & (2**64 - 1) for x in s["labels"]], s["children"], [(x["s"], x["e"]) for x in s["spans"]])
    return Side(t, s["source"], s["span"]["s"], STATEMENTS)


ONE = '''
def f(alpha, beta):
    first_total = compute_sum(alpha, beta, alpha)
    log_value("other words here", first_total)
    return publish(first_total)
'''


def test_alignment_of_statements():
    """Pairs are chosen by similarity first; what is no evidence is dropped after that, and equal statements of 8 nodes are an anchor."""
    other = ONE.replace("publish(first_total)", "render(first_total, alpha)").replace("def f(", "def g(")
    a, b = side(ONE, "f"), side(other, "g")
    texts = [(x, ONE.encode()[x[0] : x[1]].decode(), tier) for x, _, tier in align(a, b, 0.1)]
    assert any("compute_sum" in t and tier == 1 for _, t, tier in texts)  # kept although the shapes are unlike, as it anchors
    assert a.distinctive(len(a.t.labels) - 1) == {"alpha", "beta", "first_total", "compute_sum", "log_value", "publish"}
    spans = sorted(x for x, _, _ in texts)
    assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))


def test_alignment():
    same = align(side(CLONE, "load_rows"), side(CLONE, "load_rows"), 1.0)
    assert len(same) == 1 and same[0][2] == 1
    changed = align(side(CLONE, "load_rows"), side(CLONE.replace("continue", "break"), "load_rows"), 0.9)
    assert changed
    assert align(side(CLONE, "load_rows"), side("def g(q):\n    return q * 2\n", "g"), 0.1) == []


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def run(*args, at=0):
        env = os.environ | {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "a"), ("EMAIL", "a@x"), ("DATE", f"{1700000000 + at * 86400} +0000"))}
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)

    run("init", "-q", "-b", "main")
    (root / "pkg").mkdir()
    (root / "pkg" / "a.py").write_text(CLONE)
    (root / "pkg" / "b.py").write_text('"""Doc."""\n' + CALLER)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.py").write_text(CLONE)
    run("add", "-A")
    run("commit", "-qm", "one #1", at=0)
    for k in range(11):
        (root / "pkg" / "a.py").write_text(CLONE + f"\nX = {k}\n")
        (root / "pkg" / "b.py").write_text('"""Doc."""\n' + CALLER + f"\nY = {k}\n")
        run("commit", "-qam", f"step {k}", at=k + 1)
    run("checkout", "-qb", "feature")
    (root / "pkg" / "c.py").write_text(RENAMED)
    run("add", "-A")
    run("commit", "-qm", "new", at=20)
    (root / "pkg" / "d.py").write_text("def untracked(q):\n    return [x * 2 for x in q if x > 1]\n")
    return str(root)


def test_walk_skips_hidden(spark, repo):
    assert sorted(r["file"] for r in python_code.python_files(spark, repo).select("file").collect()) == ["pkg/a.py", "pkg/b.py", "pkg/c.py", "pkg/d.py"]
    docs = {r["file"]: r["has_docstring"] for r in python_code.file_docs(python_code.python_files(spark, repo)).collect()}
    assert docs["pkg/b.py"] and not docs["pkg/a.py"]


def test_history(spark, repo):
    commits, edits, head = git_log.history(spark, repo)
    assert commits.count() == 13 and head.where("path = 'pkg/a.py' AND NOT is_binary").count() == 1
    assert edits.where("path = 'pkg/a.py'").count() == 12
    assert git_log.history(spark, repo + "/pkg") is None


def test_scan_find_review(spark, repo, tmp_path):
    from strata.plans import find, report, review
    from strata.plans.analysis import analyze
    from strata.plans.explain import ambiguous, resolve_name
    from strata.plans.explore import Explorer

    a = analyze(spark, repo, Config(min_nodes=8))
    r = report.report(a)
    assert r["schema"] == "scan/1" and r["stats"]["files"] == 4
    clones = [{m["qname"] for m in x["members"]} for x in r["repeated"]]
    assert {"load_rows", "read_items"} in clones
    assert report.report(a, set())["families"] == []
    one = resolve_name(a.symbols, "run").collect()
    assert len(one) == 1
    card = report.card(a, a.symbols.where(f"id = {one[0]['id']}").first())
    assert any("Box.__init__" in c for c in card["callees"]) and "facts" in report.card_text(card) and "role twins" in report.card_text(card)
    assert ambiguous(a.symbols, [0, 1], 15).endswith("+13 more")
    cache = str(tmp_path / "cache")
    hits = find.search(spark, repo, "load rows from a path", 2, cache_path=cache)
    assert hits[0]["qname"] == "load_rows" and hits == find.search(spark, repo, "load rows from a path", 2, cache_path=cache)
    b = git_log.detect_branch(repo)
    assert b.branch == "feature" and b.changed_files == {"pkg/c.py", "pkg/d.py"}
    rv = review.review(spark, repo)
    assert {s["qname"] for s in rv["symbols"]} == {"read_items", "untracked"}
    v = find.embed(a.symbols.selectExpr("id", "qname AS text", "qname AS doc_key"), spark.createDataFrame([], find.SCHEMA), find.hashed_vector).select("id", "v")
    assert rv["semantic_available"] and rv["symbols"][0]["nearest_existing"][0]["qname"] == "load_rows"
    x = Explorer(a, v, files=python_code.python_files(spark, repo), branch=b)
    ids = {r["qname"]: r["id"] for r in x.rows}
    status, both = x.respond("GET", f"/api/compare?id={ids['load_rows']}&b={ids['read_items']}")
    assert status == 200 and both["regions"] and both["a"]["toks"] and x.respond("GET", f"/api/compare?id={ids['load_rows']}")[0] == 200
    assert x.respond("GET", "/api/compare?id=0&b=99")[0] == 404 and x.respond("GET", "/api/compare?id=a")[0] == 400
    sub = x.respond("GET", "/api/sublayout?path=pkg")[1]
    assert sub["kind"] == "dir" and len(sub["ids"]) == a.n and x.respond("GET", "/api/sublayout?path=nope")[0] == 404 and x.respond("GET", "/api/sublayout?path=pkg/b.py")[1]["kind"] == "file"
    assert x.respond("GET", "/")[0] == 200 and x.respond("GET", "/favicon.ico")[0] == 204
    assert {r["qname"] for r in x.rows if r["branch_new"]} == {s["qname"] for s in rv["symbols"]}
    assert x.respond("GET", f"/api/explain?id={ids['read_items']}")[1]["nearest_existing"] is not None
    assert x.respond("POST", "/api/meta")[0] == 405 and x.respond("GET", "/api/edge?a=1")[0] == 400 and x.respond("GET", "/api/anchor?id=999")[0] == 404
    assert x.respond("GET", "/api/anchor?id=0")[1]["b_cos"][0] == 1.0 and len(x.respond("GET", "/api/symbols")[1]) == a.n
    assert signed(2**64 - 1) == -1


def test_coupling(spark):
    """50 joint changes, 50 of a alone, 30 of b alone."""
    from strata.operators import history

    commits, edits = [], []
    for i in range(130):
        commits.append(("r", f"c{i}", 1700000000 + i * 3600, "x", "m", 1))
        for p in (["a", "b"] if i < 50 else ["a"] if i < 100 else ["b"]):
            edits.append(("r", f"c{i}", p, 1, 0))
    commits.append(("r", "big", 1700900000, "x", "m", 1))
    edits += [("r", "big", p, 1, 0) for p in ["a", "b", *map(str, range(33))]]
    c = spark.createDataFrame(commits, "repo string, commit_id string, secs bigint, author string, message string, n_parents int")
    e = spark.createDataFrame(edits, "repo string, commit_id string, path string, added int, removed int")
    tree = spark.createDataFrame([("r", p, 10) for p in ["a", "b", *map(str, range(33))]], "repo string, path string, n_lines int")
    t = history.within_cap(history.transactions(c, e, tree))
    r = history.coupled_pairs(t, history.anchors(c)).collect()
    assert len(r) == 1 and r[0]["shared"] == 50 and r[0]["confidence_ab"] == 0.5 and r[0]["confidence_ba"] == 0.625 and abs(r[0]["degree"] - 55.5555) < 1e-3


def test_files_with_leading_underscores(spark, tmp_path):
    """Packages live in ``__init__.py``: names that the file source passes over are read as well, once each."""
    for name in ("__init__.py", "m.py", "_private.py", "_inner/a.py", "_inner/__init__.py", "__pycache__/x.py", ".hidden/_y.py", "p/__main__.py", "p/_data.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"X = {name!r}\n")
    got = {r["file"]: bytes(r["content"]).decode() for r in python_code.python_files(spark, str(tmp_path)).collect()}
    names = ["__init__.py", "m.py", "_private.py", "_inner/a.py", "_inner/__init__.py", "p/__main__.py"]
    assert got == {n: f"X = {n!r}\n" for n in names} and python_code.python_files(spark, str(tmp_path)).count() == len(names)


def test_scan_counts_every_function(spark, tmp_path):
    """A tree of 5,000 functions: none is lost while ids are given, and find sees them all."""
    from strata.operators.ids import dense_ids

    for k in range(100):
        folder = tmp_path / f"p{k % 9}"
        folder.mkdir(exist_ok=True)
        body = "\n".join(f"def f{k}_{i}(alpha, beta):\n    total = alpha * {i} + beta\n    if total > {i}:\n        return [total, alpha, beta, {k}]\n    return helper_{i}(total, alpha)\n" for i in range(50))
        (folder / f"m{k}.py").write_text(body)
    files = python_code.python_files(spark, str(tmp_path))
    s = dense_ids(python_code.scan_symbols(files, Config(min_nodes=8)).withColumn("start", F.col("span.s")), "file", "start")
    got = s.agg(F.count("*").alias("c"), F.count_distinct("id").alias("d"), F.max("id").alias("m"), F.count_distinct("qname").alias("q")).first()
    assert tuple(got) == (5000, 5000, 4999, 5000)
