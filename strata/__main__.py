"""Command line: scan, explain, find, explore, review. Operational errors exit with 2."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strata")
    sub = p.add_subparsers(dest="verb", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("root")
    scan.add_argument("--json", action="store_true")
    scan.add_argument("--only", action="append")
    scan.add_argument("--timings", action="store_true")
    for name, default in (("min-nodes", 30), ("wl-iters", 3)):
        scan.add_argument(f"--{name}", type=int, default=default)
    explain = sub.add_parser("explain")
    explain.add_argument("root")
    explain.add_argument("target", nargs="?")
    find = sub.add_parser("find")
    find.add_argument("root")
    find.add_argument("query")
    find.add_argument("--top", type=int, default=10)
    find.add_argument("--tests", action="store_true")
    find.add_argument("--json", action="store_true")
    find.add_argument("--cache")
    explore = sub.add_parser("explore")
    explore.add_argument("root")
    explore.add_argument("--port", type=int, default=4816)
    explore.add_argument("--tests", action="store_true")
    explore.add_argument("--base")
    review = sub.add_parser("review")
    review.add_argument("root")
    review.add_argument("--base")
    review.add_argument("--json", action="store_true")
    args = p.parse_args(argv)
    if not os.path.isdir(args.root):
        print(f"{args.root} is no folder", file=sys.stderr)
        return 2
    if args.verb == "scan" and not args.json:
        print("scan writes JSON: call it with --json", file=sys.stderr)
        return 2
    from strata.runtime import session

    spark = session("strata")
    return globals()[f"_{args.verb}"](spark, args)


def _scan(spark, args) -> int:
    from strata.config import Config
    from strata.plans import report
    from strata.plans.analysis import analyze

    a = analyze(spark, args.root, Config(min_nodes=args.min_nodes, wl_iters=args.wl_iters))
    print(report.to_json(report.report(a, set(args.only) if args.only else None)))
    if args.timings:
        for name, s in a.seconds.items():
            print(f"{name:<12}{s:8.2f} s", file=sys.stderr)
    return 0


def _explain(spark, args) -> int:
    from strata.config import Config
    from strata.plans import explain, report
    from strata.plans.analysis import analyze

    a = analyze(spark, args.root, Config(min_nodes=8))
    if not args.target:
        print("give a target, such as " + ", ".join(report.largest_targets(a)), file=sys.stderr)
        return 2
    file, _, line = args.target.rpartition(":")
    if file and line.isdigit():
        found = explain.innermost(a.symbols, file, int(line)).select("id").collect()
    else:
        found = explain.resolve_name(a.symbols, args.target).collect()
    if len(found) != 1:
        print(explain.ambiguous(a.symbols, [r["id"] for r in found], found[0]["n"] if found and "n" in found[0] else len(found)) if found else "no such symbol", file=sys.stderr)
        return 2
    print(report.card_text(report.card(a, a.symbols.where(F.col("id") == found[0]["id"]).first())))
    return 0


def _find(spark, args) -> int:
    from strata.plans import find, report

    hits = find.search(spark, args.root, args.query, args.top, args.tests, args.cache)
    print(report.to_json({"schema": "find/1", "query": args.query, "top": args.top, "hits": hits}) if args.json else find.render(args.query, hits))
    return 0


def _explore(spark, args) -> int:
    from strata.config import Config
    from strata.plans import find
    from strata.plans.analysis import analyze
    from strata.plans.explore import Explorer
    from strata.sources.git_log import detect_branch
    from strata.sources.python_code import python_files

    a = analyze(spark, args.root, Config(min_nodes=8))
    docs = a.symbols.select("id", F.concat("qname", F.lit("  ("), "file", F.lit(")\n"), "source").alias("text"), F.md5(F.concat_ws("\n", "qname", "file", "source")).alias("doc_key"))
    v = find.embed(docs, spark.createDataFrame([], find.SCHEMA), find.hashed_vector).select("id", "v")
    files = python_files(spark, args.root)
    Explorer(a, v, lambda q: find.search(spark, args.root, q), files, detect_branch(args.root, args.base), args.tests).serve(args.port)
    return 0


def _review(spark, args) -> int:
    from strata.plans import report, review
    from strata.sources.git_log import git

    if git(args.root, "rev-parse", "--is-inside-work-tree") is None:
        print("no git repository", file=sys.stderr)
        return 2
    if args.base and git(args.root, "rev-parse", "--verify", "-q", args.base) is None:
        print(f"no such base: {args.base}", file=sys.stderr)
        return 2
    r = review.review(spark, args.root, args.base)
    print(report.to_json(r) if args.json else review.render(r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
