"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(c: Column) -> Column:
    """A path with forward slashes, none doubled, no leading ``./`` and no blanks at the end; null if nothing is left."""
    p = F.regexp_replace(F.regexp_replace(c, r"\s+$", ""), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when(p != "", p)


def is_test_path(path: Column) -> Column:
    """``conftest.py``, or a segment ``tests``, ``test``, ``test_*`` or ``*_test.py``."""
    return F.lower(path).rlike(r"(^|/)(conftest\.py$|tests?(/|$)|test_|[^/]*_test\.py(/|$))")


def is_noise_path(path: Column) -> Column:
    """Lock files, generated or minified files, and vendored or built folders."""
    return path.rlike(r"\.lock$|(^|/)package-lock\.json$|_pb2\.py$|\.min\.[^/]*$|(^|/)(vendor|node_modules|dist|target)(/|$)")


def dir_of(path: Column) -> Column:
    """The folder of a path, ``.`` for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def dir_key(path: Column, depth: int) -> Column:
    """The first ``depth`` folders of a path, ``.`` if it has none."""
    parts = F.split(path, "/")
    key = F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")
    return F.when(F.size(parts) > 1, key).otherwise(F.lit("."))


def module_suffixes(path: Column) -> Column:
    """Every dotted suffix under which a Python file can be imported; a trailing ``__init__`` is dropped."""
    parts = F.split(F.regexp_replace(path, r"\.py$", ""), "/")
    parts = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    joined = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.size(parts) > 0, joined).otherwise(F.array().cast("array<string>"))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it, segment by segment."""
    return (path == prefix) | path.startswith(prefix + "/")
