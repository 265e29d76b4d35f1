"""Git history through the git binary on the driver: commits, edits, head files and branches."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strata.config import Config
from strata.sources.python_code import symbols_of

COMMITS = "repo string, commit_id string, pos int, secs bigint, author string, message string, n_parents int"
EDITS = "repo string, commit_id string, path string, prev_blob string, blob string, added int, removed int"
HEAD = "repo string, path string, n_lines int, is_binary boolean"


def git(root: str, *args: str) -> str | None:
    """Output of a git command, null on any failure."""
    try:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    except OSError:
        return None
    return got.stdout.decode("utf-8", "replace") if got.returncode == 0 else None


def history(spark: SparkSession, root: str, repo: str = ".") -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(commits, edits, head files) of the first-parent chain; null if the folder is not the root of a repository.

    Seconds are local: committer time plus offset. Renames are a removal and an addition.
    """
    top = git(root, "rev-parse", "--show-toplevel")
    if top is None or os.path.realpath(top.strip()) != os.path.realpath(root):
        return None
    text = git(root, "log", "--first-parent", "--reverse", "--no-renames", "--diff-merges=first-parent", "--diff-algorithm=histogram", "--raw", "--no-abbrev", "--numstat", "-z", "--date=raw", "--format=%x02%H%x01%P%x01%cd%x01%ae%x01%B%x03")
    if text is None:
        return None
    commits, edits = [], []
    for pos, block in enumerate(b for b in text.split("\x02") if b.strip("\x00\n")):
        head, _, body = block.partition("\x03")
        commit, parents, date, author, message = head.split("\x01", 4)
        secs, zone = date.split()
        shift = (int(zone[1:3]) * 3600 + int(zone[3:5]) * 60) * (-1 if zone[0] == "-" else 1)
        commits.append((repo, commit, pos, int(secs) + shift, author, message.strip(), len(parents.split())))
        fields = [f for f in body.replace("\n", "\x00").split("\x00") if f]
        blobs: dict[str, tuple[str | None, str | None]] = {}
        counts: dict[str, tuple[int, int]] = {}
        i = 0
        while i < len(fields):
            if fields[i].startswith(":"):
                _, _, old, new, _ = fields[i].split()[:5]
                blobs[fields[i + 1]] = (None if set(old) == {"0"} else old, None if set(new) == {"0"} else new)
                i += 2
            else:
                added, removed, path = fields[i].split("\t", 2)
                counts[path] = (int(added) if added != "-" else 0, int(removed) if removed != "-" else 0)
                i += 1
        edits += [(repo, commit, p, *blobs[p], *counts.get(p, (0, 0))) for p in blobs]
    return spark.createDataFrame(commits, COMMITS), spark.createDataFrame(edits, EDITS), spark.createDataFrame(head_files(root, repo), HEAD)


def head_files(root: str, repo: str) -> list[tuple[str, str, int, bool]]:
    """Files at HEAD with their lines; one with a NUL in its first 8000 bytes is binary."""
    found = []
    for entry in (git(root, "ls-tree", "-r", "-z", "HEAD") or "").split("\0"):
        if entry:
            meta, path = entry.split("\t", 1)
            _, kind, blob = meta.split()
            if kind == "blob":
                found.append((path, blob))
    out = []
    for (path, _), data in zip(found, blobs(root, [b for _, b in found]), strict=True):
        data = data or b""
        lines = data.count(b"\n") + (1 if data and not data.endswith(b"\n") else 0)
        out.append((repo, path, lines, b"\0" in data[:8000]))
    return out


def blobs(root: str, names: list[str]) -> Iterator[bytes | None]:
    """The contents of objects, null for those that are none, one after the other from one process."""
    if not names:
        return
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as p:
        for name in names:
            if "\n" in name:  # no name the protocol can ask for
                yield None
                continue
            p.stdin.write(name.encode() + b"\n")
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) == 3 and head[2].isdigit():
                data = p.stdout.read(int(head[2]))
                p.stdout.read(1)
                yield data if head[1] == b"blob" else None
            else:
                yield None
        p.stdin.close()


@dataclass
class Branch:
    branch: str
    base: str
    changed_files: set[str]
    base_roots: set[int]


def detect_branch(root: str, base: str | None = None) -> Branch | None:
    """The branch's Python files that differ from the merge base (committed, in the work tree or untracked), and the structural hashes these had there.

    The base is the given one, else origin's HEAD, else main, else master. Null if there
    is no repository, no base, or HEAD is the merge base itself with a detached head.
    """
    if git(root, "rev-parse", "--is-inside-work-tree") is None:
        return None
    name = (git(root, "symbolic-ref", "--short", "-q", "HEAD") or "").strip()
    if not name and base is None:
        return None
    if base is None:
        origin = (git(root, "symbolic-ref", "--short", "-q", "refs/remotes/origin/HEAD") or "").strip()
        base = next((b for b in (origin, "main", "master") if b and git(root, "rev-parse", "--verify", "-q", b)), None)
    if base is None or (start := git(root, "merge-base", "HEAD", base)) is None:
        return None
    start = start.strip()
    if start == (git(root, "rev-parse", "HEAD") or "").strip():
        return None
    changed = set()
    for args in (("diff", "--name-only", "-z", "--no-renames", start, "HEAD"), ("diff", "--name-only", "-z", "--no-renames", "HEAD"), ("ls-files", "-o", "--exclude-standard", "-z")):
        changed |= {p for p in (git(root, *args) or "").split("\0") if p.endswith(".py")}
    roots = set()
    names = sorted(changed)
    for p, data in zip(names, blobs(root, [f"{start}:{p}" for p in names]), strict=True):
        if data is not None:
            roots |= {s["merkle_root"] for s in symbols_of(p, data, Config(min_nodes=0))}
    return Branch(name or "HEAD", base, changed, roots)
