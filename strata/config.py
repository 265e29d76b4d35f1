"""Thresholds and constants that change results."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400


@dataclass(frozen=True)
class Config:
    """The seven thresholds of a scan."""

    min_nodes: int = 30
    wl_iters: int = 3
    theta_clone: float = 0.60
    theta_b: float = 0.55
    theta_a_low: float = 0.30
    theta_family: float = 0.35
    theta_b_family: float = 0.16


SIZE_RATIO = 0.5
REP_RELAX = 0.8
MINHASH_FUNCTIONS = 64
LSH_ROWS = 2
BUCKET_CAP = 200
MIN_TERMS, MIN_SHARED_TERMS, MIN_SHARED_MASS = 5, 3, 0.30
DEAD_AFTER, GROWING_WITHIN = 180 * DAY, 90 * DAY
MAX_CHANGESET, MIN_REVS, MIN_SHARED_REVS, MIN_DEGREE, HALF_LIFE_DAYS = 30, 10, 5, 30.0, 182.5
KNN = 8

# Terms that alone say nothing about a pair.
LOW_SIGNAL_TERMS = ["eq", "repr", "str", "hash", "other", "class", "name", "args", "kwargs", "any", "dict", "list", "int", "key", "value", "bool", "isinstance", "typing"]

# Subwords that are no vocabulary.
STOPWORDS = ["self", "cls", "none", "true", "false", "return", "the"]

# Identifiers that are no evidence of a shared statement.
STOPLIST_IDENTS = ["self", "cls", "args", "kwargs", "result", "ret", "res", "retval", "value", "val", "data", "out", "obj", "tmp", "item"]

# Folders that are not walked.
SKIP_DIRS = [".git", ".hg", ".venv", "venv", "env", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".ruff_cache", ".pytest_cache", "build", "dist", "site-packages", ".eggs"]

# Names that any Python object may answer to.
AMBIENT_NAMES = [
    "join", "split", "rsplit", "splitlines", "strip", "lstrip", "rstrip", "startswith", "endswith", "find", "rfind", "index", "rindex", "replace", "encode", "decode", "format", "format_map", "lower", "upper", "title",
    "capitalize", "casefold", "center", "ljust", "rjust", "zfill", "count", "partition", "rpartition", "translate", "expandtabs",
    "keys", "values", "items", "get", "setdefault", "update", "pop", "popitem", "clear", "copy", "fromkeys", "append", "extend", "insert", "remove", "sort", "reverse", "add", "discard", "union", "intersection", "difference",
    "read", "write", "close", "readline", "readlines", "writelines", "flush", "seek", "tell",
    "debug", "info", "warning", "warn", "error", "exception", "critical", "log",
    "match", "fullmatch", "search", "sub", "subn", "findall", "finditer",
    "open", "print", "len", "iter", "next", "filter", "map", "sorted", "reversed", "enumerate", "zip", "range", "isinstance", "issubclass", "getattr", "setattr", "hasattr", "repr", "hash", "type", "super", "min", "max", "sum", "abs", "round", "any", "all", "compile",
]
