"""Which parts of two functions correspond: equal subtrees as anchors, statements in the gaps between them."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import STOPLIST_IDENTS
from strata.sources.python_code import IDENTIFIERS, KEYWORDS, Tree, hash_text, merkle_hashes

STATEMENTS = frozenset(hash_text(k) for k in [*KEYWORDS, "Expr"] if k[0].isupper() and k not in ("Lambda", "IfExp", "Await", "Yield", "YieldFrom", "NamedExpr"))
"""Labels of nodes that are statements."""

# Bounds of the alignment.
ANCHOR, SIM, WL_FLOOR, JACCARD, MIN_TOKENS = 8, 0.66, 0.5, 0.25, 3
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]+")


class Side:
    def __init__(self, tree: Tree, source: str, base: int, statements: frozenset[int]):
        self.t, self.base, self.statements = tree, base, statements
        self.source = source.encode()
        self.hash = merkle_hashes(tree)
        self.size: list[int] = []
        for kids in tree.children:
            self.size.append(1 + sum(self.size[k] for k in kids))

    def text(self, n: int) -> str:
        s, e = self.t.spans[n]
        return " ".join(self.source[s - self.base : e - self.base].decode("utf-8", "replace").split())

    def leaves(self, n: int) -> list[int]:
        kids = self.t.children[n]
        return [x for k in kids for x in self.leaves(k)] if kids else [self.t.labels[n]]

    def distinctive(self, n: int) -> set[str]:
        """The names among the identifier leaves below a node that are evidence of a shared statement; words in strings and comments are none."""
        kids = self.t.children[n]
        if kids:
            return set().union(*(self.distinctive(k) for k in kids))
        name = self.text(n) if self.t.labels[n] in IDENTIFIERS else ""
        return {name} if _IDENT.fullmatch(name) and not keyword.iskeyword(name) and name not in STOPLIST_IDENTS else set()

    def parts(self, nodes: list[int]) -> list[int]:
        """The statements at or below the nodes; a node without any stands for itself."""
        out = []
        for n in nodes:
            inner = [k for k in self.t.children[n] if self.t.children[k]]
            out += [n] if self.t.labels[n] in self.statements or not inner else self.parts(inner)
        return out


def lcs(a: list[int], b: list[int]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def align(a: Side, b: Side, wl_cosine: float) -> list[tuple[tuple[int, int], tuple[int, int], int]]:
    """(span of a, span of b, tier) of corresponding regions; tier 1 if their texts are equal but for white space.

    Equal subtrees of at least 8 nodes anchor; between them a lone pair of equal labels is
    entered and everything else aligned statement by statement. Without an anchor and with
    a shape cosine below one half, nothing corresponds.
    """
    pairs: list[tuple[int, int]] = []
    anchored = False

    def similarity(x: int, y: int) -> float:
        if a.hash[x] == b.hash[y]:
            return 1.0
        p, q = a.leaves(x), b.leaves(y)
        return 2 * lcs(p, q) / (len(p) + len(q)) if p or q else 0.0

    def accept(x: int, y: int, s: float) -> bool:
        p, q = a.distinctive(x), b.distinctive(y)
        both = len(p & q)
        if both < 1:
            return False
        return a.hash[x] == b.hash[y] or (s >= SIM and min(len(a.leaves(x)), len(b.leaves(y))) >= MIN_TOKENS and both > JACCARD * len(p | q))

    def statements(xs: list[int], ys: list[int]) -> None:
        """The pairing of largest summed similarity; of its pairs those that are evidence enough count."""
        nonlocal anchored
        xs, ys = a.parts(xs), b.parts(ys)
        s = [[similarity(x, y) for y in ys] for x in xs]
        best = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i in range(len(xs) - 1, -1, -1):
            for j in range(len(ys) - 1, -1, -1):
                best[i][j] = max(s[i][j] + best[i + 1][j + 1], best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(xs) and j < len(ys):
            if best[i][j] == s[i][j] + best[i + 1][j + 1]:
                if s[i][j] > 0 and accept(xs[i], ys[j], s[i][j]):
                    pairs.append((xs[i], ys[j]))
                    anchored = anchored or (a.hash[xs[i]] == b.hash[ys[j]] and a.size[xs[i]] >= ANCHOR)
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1

    def gap(xs: list[int], ys: list[int]) -> None:
        if len(xs) == 1 and len(ys) == 1 and a.t.labels[xs[0]] == b.t.labels[ys[0]] and a.t.children[xs[0]] and b.t.children[ys[0]] and a.hash[xs[0]] != b.hash[ys[0]] and a.t.labels[xs[0]] not in a.statements:
            enter(xs[0], ys[0])
        elif xs and ys:
            statements(xs, ys)

    def enter(x: int, y: int) -> None:
        nonlocal anchored
        if a.hash[x] == b.hash[y]:
            pairs.append((x, y))
            anchored = anchored or a.size[x] >= ANCHOR
            return
        xs, ys = a.t.children[x], b.t.children[y]
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        same = lambda p, q: a.hash[p] == b.hash[q] and a.size[p] >= ANCHOR
        for i in range(len(xs) - 1, -1, -1):
            for j in range(len(ys) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], a.size[xs[i]] + best[i + 1][j + 1] if same(xs[i], ys[j]) else 0)
        i = j = p = q = 0
        while i < len(xs) and j < len(ys):
            if same(xs[i], ys[j]) and best[i][j] == a.size[xs[i]] + best[i + 1][j + 1]:
                gap(xs[p:i], ys[q:j])
                pairs.append((xs[i], ys[j]))
                anchored = True
                i, j = i + 1, j + 1
                p, q = i, j
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
        gap(xs[p:], ys[q:])

    if not a.t.labels or not b.t.labels:
        return []
    enter(len(a.t.labels) - 1, len(b.t.labels) - 1)
    if not anchored and wl_cosine < WL_FLOOR:
        return []
    out = [(a.t.spans[x], b.t.spans[y], 1 if a.text(x) == b.text(y) else 2) for x, y in pairs]
    return sorted(out)


def align_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, a_s, a_e, b_s, b_e, tier) of pairs with both sides' source, span start, labels, children and spans, and the cosine of their shapes."""
    def side(r, end: str) -> Side:
        t = Tree([int(x) & 0xFFFFFFFFFFFFFFFF for x in r[f"labels_{end}"]], [list(k) for k in r[f"children_{end}"]], [(x["s"], x["e"]) for x in r[f"spans_{end}"]])
        return Side(t, r[f"source_{end}"], r[f"start_{end}"], STATEMENTS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                rows += [(r["a"], r["b"], *x, *y, tier) for x, y, tier in align(side(r, "a"), side(r, "b"), r["cos"])]
            yield pd.DataFrame(rows, columns=["a", "b", "a_s", "a_e", "b_s", "b_e", "tier"])

    return pairs.mapInPandas(run, "a bigint, b bigint, a_s int, a_e int, b_s int, b_e int, tier int")


def sides(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """What ``align_pairs`` takes, for pairs (a, b, cos) of symbols with their trees."""
    for end in ("a", "b"):
        own = symbols.select(F.col("id").alias(end), F.col("source").alias(f"source_{end}"), F.col("span.s").alias(f"start_{end}"), *(F.col(c).alias(f"{c}_{end}") for c in ("labels", "children", "spans")))
        pairs = pairs.join(own, end)
    return pairs
