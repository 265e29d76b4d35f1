"""Python source trees: walking files, and one row per function or method with its normalized tree and fingerprints.

The standard library's syntax tree stands for a concrete one: each construct is a named
node, each keyword or operator a leaf of its own, punctuation and comments leave no node.
A function that does not parse is left out, and so is a broken statement; the rest of the file is read.
"""

from __future__ import annotations

import ast
import keyword
import os
import re
import tokenize
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import MINHASH_FUNCTIONS, SKIP_DIRS, STOPWORDS, Config

SYMBOL = (
    "file string, qname string, line int, last_line int, span struct<s:int,e:int>, node_count int, merkle_root bigint, wl array<struct<label:bigint,w:double>>, minhash array<bigint>, vocab_tf map<string,int>,"
    " calls array<struct<base:string,module:string>>, is_test boolean, source string, labels array<bigint>, children array<array<int>>, spans array<struct<s:int,e:int>>"
)
TEST = re.compile(r"(^|/)(conftest\.py$|tests?(/|$)|test_|[^/]*_test\.py(/|$))")


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, content): the ``.py`` files below a folder, without pruned and hidden folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    base = root.rstrip("/") + "/"
    found = raw.select(F.substring_index(F.col("path"), base, -1).alias("file"), "content").unionByName(_underscored(spark, root))
    parts = F.split("file", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return found.where(~F.exists(folders, lambda p: p.isin(SKIP_DIRS) | p.startswith(".")))


def _underscored(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of what the file source passes over: files, or all files of folders, whose names begin with an underscore, such as ``__init__.py``. Names are listed here, contents are read by the executors."""
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    base = base.rstrip("/") + "/"
    names = [i.path.removeprefix(base) for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.type == pafs.FileType.File and i.path.endswith(".py")]
    passed = [(n,) for n in sorted(names) if any(p.startswith("_") and "=" not in p for p in n.split("/"))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            contents = []
            for f in files:
                with fs.open_input_stream(base + f) as stream:
                    contents.append(stream.read())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=["file", "content"])

    rows = spark.createDataFrame(passed, "file string")
    return rows.mapInArrow(read, "file string, content binary")


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def hash_text(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


def hash_ints(xs: list[int], seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in xs), seed=seed)


def subwords(name: str) -> list[str]:
    """Lower-case subwords of an identifier, as ``functions.text.subwords`` gives them."""
    t = re.sub(r"([^\W\d_A-Z])([A-Z])", r"\1 \2", name)
    t = re.sub(r"([^\W_])([A-Z][^\W\d_A-Z])", r"\1 \2", t)
    return [w.lower() for w in re.split(r"[\W_]+", t) if len(w.encode()) >= 2 and not w.isnumeric() and w.lower() not in STOPWORDS]


@dataclass
class Tree:
    """Post-order arrays; the root is last."""

    labels: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, label: str, children: list[int], span: tuple[int, int]) -> int:
        self.labels.append(hash_text(label))
        self.children.append(children)
        self.spans.append(span)
        return len(self.labels) - 1


def parse(content: bytes) -> ast.Module | None:
    """The module; what does not parse is replaced by ``pass`` of the same length: the function around an error or before it, whichever lets more be read, a statement outside of any, or the whole top-level block if nothing else helps. Null if that does not either."""
    lines = content.splitlines(keepends=True)
    for _ in range(len(lines) + 1):
        module, at = _try(lines)
        if module is not None or at is None:
            return module
        before = next((k for k in range(at - 1, -1, -1) if lines[k].strip()), at)
        best = None
        for block in (_block(lines, at, False), _block(lines, before, False), _block(lines, at, True), _block(lines, before, True)):
            new = _blanked(lines, block)
            if new != lines:
                got, further = _try(new)
                rank = (len(lines) + 1 if got is not None else -1 if further is None else further, -len(block))
                if best is None or rank > best[0]:
                    best = rank, new
        if best is None:
            return None
        lines = best[1]
    return None


def _try(lines: list[bytes]) -> tuple[ast.Module | None, int | None]:
    """The module, or the line of the first error."""
    try:
        return ast.parse(b"".join(lines)), None
    except SyntaxError as e:
        return None, min(max(e.lineno or 1, 1), len(lines)) - 1 if lines else None
    except (ValueError, RecursionError):
        return None, None


_DEF = re.compile(rb"[ \t]*(async[ \t]+)?def\b")


def _indent(line: bytes) -> int:
    return len(line) - len(line.lstrip(b" \t")) if line.strip() else 1 << 30


def _block(lines: list[bytes], at: int, whole: bool) -> range:
    """The innermost function around a line, or the line; with ``whole`` everything from the last line without indent to the next."""
    first = at
    if whole:
        while first and _indent(lines[first]) > 0:
            first -= 1
        depth = 0
    else:
        depth = _indent(lines[at])
        up = at
        while up >= 0 and not (_DEF.match(lines[up]) and (up == at or _indent(lines[up]) < depth)):
            depth = min(depth, _indent(lines[up]))
            up -= 1
        if up < 0:
            return range(at, at + 1)
        first, depth = up, _indent(lines[up])
    last = first + 1
    while last < len(lines) and (last <= at or _indent(lines[last]) > depth):
        last += 1
    return range(first, last)


def _blanked(lines: list[bytes], block: range) -> list[bytes]:
    """The lines with a block blanked; its first line becomes ``pass``, if it is long enough, so that what is around it keeps a body."""
    out = list(lines)
    for k in block:
        body = lines[k].rstrip(b"\r\n")
        indent = min(_indent(lines[k]), len(body))
        new = body[:indent] + (b"pass" if k == block[0] and len(body) - indent >= 4 else b"")
        out[k] = new.ljust(len(body)) + lines[k][len(body) :]
    return out


def imports_of(module: ast.AST, file: str) -> dict[str, tuple[str, str | None]]:
    """Local name -> (module, symbol or None), over the whole file; a later binding replaces an earlier one."""
    out: dict[str, tuple[str, str | None]] = {}
    for n in ast.walk(module):
        if isinstance(n, ast.Import):
            for a in n.names:
                out[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], None)
        elif isinstance(n, ast.ImportFrom):
            base = relative_module(file, n.level, n.module)
            if base is None:
                continue
            for a in n.names:
                if a.name != "*":
                    out[a.asname or a.name] = (f"{base}.{a.name}", None) if n.module is None else (base, a.name)
    return out


def relative_module(file: str, level: int, module: str | None) -> str | None:
    """The dotted module of an import with ``level`` leading dots; null if it climbs beyond the root."""
    if level == 0:
        return module
    folders = file.split("/")[:-1]
    if level - 1 > len(folders):
        return None
    return ".".join(folders[: len(folders) - level + 1] + ([module] if module else [])) or None


def locals_of(fn: ast.AST) -> dict[str, int]:
    """Names bound in a function, numbered by first binding: parameters, then the body in source order."""
    out: dict[str, int] = {}

    def bind(name: str | None) -> None:
        if name:
            out.setdefault(name, len(out))

    a = fn.args
    for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
        bind(p.arg)

    def walk(n: ast.AST) -> None:
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            bind(n.id)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            bind(n.name)
        elif isinstance(n, ast.ExceptHandler):
            bind(n.name)
        elif isinstance(n, (ast.MatchAs, ast.MatchStar)):
            bind(n.name)
        elif isinstance(n, ast.comprehension):
            walk(n.target)
        for c in ast.iter_child_nodes(n):
            walk(c)

    for s in fn.body:
        walk(s)
    return out


# The keywords a statement or expression shows, as leaves before its parts.
KEYWORDS = {
    "FunctionDef": ["def"], "AsyncFunctionDef": ["async", "def"], "ClassDef": ["class"], "Return": ["return"], "Delete": ["del"], "For": ["for", "in"], "AsyncFor": ["async", "for", "in"], "While": ["while"], "If": ["if"],
    "With": ["with"], "AsyncWith": ["async", "with"], "Raise": ["raise"], "Try": ["try"], "TryStar": ["try"], "Assert": ["assert"], "Global": ["global"], "Nonlocal": ["nonlocal"], "Pass": ["pass"], "Break": ["break"],
    "Continue": ["continue"], "Lambda": ["lambda"], "IfExp": ["if", "else"], "Await": ["await"], "Yield": ["yield"], "YieldFrom": ["yield", "from"], "ExceptHandler": ["except"], "comprehension": ["for", "in"],
    "Assign": ["="], "AugAssign": ["="], "AnnAssign": ["="], "NamedExpr": [":="], "Match": ["match"], "match_case": ["case"], "Import": ["import"], "ImportFrom": ["from", "import"],
}


class Normalizer:
    """The normalized tree, the vocabulary and the calls of one function."""

    def __init__(self, fn: ast.AST, imports: dict, line_starts: list[int]):
        self.names, self.imports, self.starts = locals_of(fn), imports, line_starts
        self.tree, self.vocab = Tree(), Counter()
        self.calls: set[tuple[str, str | None]] = set()
        self.build(fn)

    def span(self, n: ast.AST, outer: tuple[int, int]) -> tuple[int, int]:
        if getattr(n, "lineno", None) is None:
            return outer
        return self.starts[n.lineno - 1] + n.col_offset, self.starts[n.end_lineno - 1] + n.end_col_offset

    def ident(self, name: str, span: tuple[int, int], local: bool = True, skip: int = 0) -> int:
        """A name that stands ``skip`` bytes into ``span``."""
        self.vocab.update(subwords(name))
        span = (span[0] + skip, min(span[1], span[0] + skip + len(name.encode())))
        i = self.names.get(name) if local else None
        return self.tree.add("EXT" if i is None else f"x{i}", [], span)

    def build(self, n: ast.AST, outer: tuple[int, int] = (0, 0)) -> int | None:
        kind, span, add = type(n).__name__, self.span(n, outer), self.tree.add
        if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            return None
        if isinstance(n, ast.Name):
            return self.ident(n.id, span)
        if isinstance(n, ast.Constant):
            v = n.value
            label = "STR" if isinstance(v, (str, bytes)) else str(v).lower() if v is None or isinstance(v, bool) else "..." if v is ... else "NUM"
            return add(label, [], span)
        if isinstance(n, ast.JoinedStr):
            parts = [self.build(v.value, span) for v in n.values if isinstance(v, ast.FormattedValue)]
            return add("FSTR" if parts else "STR", [p for p in parts if p is not None], span)
        if isinstance(n, (ast.operator, ast.cmpop, ast.boolop, ast.unaryop)):
            return add(kind, [], outer)
        if isinstance(n, ast.expr_context):
            return None
        if isinstance(n, ast.Call):
            self.record(n.func)
        parts: list[int | None] = [self.tree.add(k, [], span) for k in KEYWORDS.get(kind, [])]
        if isinstance(n, ast.arg):
            parts.append(self.ident(n.arg, span))
            parts.append(self.build(n.annotation, span) if n.annotation else None)
        elif isinstance(n, ast.Attribute):
            parts += [self.build(n.value, span), self.ident(n.attr, (span[1] - len(n.attr.encode()), span[1]), False)]
        elif isinstance(n, ast.keyword):
            parts += [self.ident(n.arg, span, False) if n.arg else None, self.build(n.value, span)]
        elif isinstance(n, ast.alias):
            parts += [self.ident(x, span, False) for x in (n.name, n.asname) if x]
        else:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                parts += [self.build(x, span) for x in n.decorator_list]
                # A function's own name is no local of it; a nested one's name is. Its keywords are taken to be followed by one blank.
                parts.append(self.ident(n.name, span, skip=sum(len(k) + 1 for k in KEYWORDS[kind])))
            elif isinstance(n, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and n.name:
                parts.append(self.ident(n.name, span))
            elif isinstance(n, (ast.Global, ast.Nonlocal)):
                parts += [self.ident(x, span) for x in n.names]
            for name, value in ast.iter_fields(n):
                if name == "decorator_list" or name.startswith("type_"):
                    continue
                for c in value if isinstance(value, list) else [value]:
                    if isinstance(c, ast.AST):
                        parts.append(self.build(c, span))
        return add(kind, [p for p in parts if p is not None], span)

    def record(self, f: ast.AST) -> None:
        if isinstance(f, ast.Name):
            module, name = self.imports.get(f.id, (None, None)) if f.id not in self.names else (None, None)
            self.calls.add((name, module) if name else (f.id, None))
        elif isinstance(f, ast.Attribute):
            v = f.value
            dotted = []
            while isinstance(v, ast.Attribute):
                dotted.insert(0, v.attr)
                v = v.value
            module = None
            if isinstance(v, ast.Name) and v.id not in self.names and v.id in self.imports and self.imports[v.id][1] is None:
                module = ".".join([self.imports[v.id][0], *dotted])
            self.calls.add((f.attr, module))


# The labels of identifier leaves, a global one or the n-th local of its function.
IDENTIFIERS = frozenset([hash_text("EXT"), *(hash_text(f"x{i}") for i in range(4096))])


def merkle_hashes(t: Tree) -> list[int]:
    out: list[int] = []
    for label, kids in zip(t.labels, t.children, strict=True):
        out.append(hash_ints([label, *(out[k] for k in kids)]))
    return out


def wl_histogram(t: Tree, rounds: int) -> dict[int, float]:
    """Label weights: each round relabels a node by itself, its parent (0 at the root) and its children; round i adds weight i."""
    parent = [0] * len(t.labels)
    for i, kids in enumerate(t.children):
        for k in kids:
            parent[k] = i
    labels, out = t.labels, Counter()
    root = len(labels) - 1
    for i in range(1, rounds + 1):
        labels = [hash_ints([labels[n], 0 if n == root else labels[parent[n]], *(labels[k] for k in t.children[n])]) for n in range(len(labels))]
        for h in labels:
            out[h] += float(i)
    return out


def minhashes(labels: list[int], functions: int = MINHASH_FUNCTIONS) -> list[int]:
    if not labels:
        return [signed((1 << 64) - 1)] * functions
    raw = [x.to_bytes(8, "little") for x in labels]
    return [signed(min(xxhash.xxh3_64_intdigest(b, seed=s) for b in raw)) for s in range(functions)]


def is_overload(fn: ast.AST) -> bool:
    return any((isinstance(d, ast.Name) and d.id == "overload") or (isinstance(d, ast.Attribute) and d.attr == "overload") for d in fn.decorator_list)


def symbols_of(file: str, content: bytes, cfg: Config) -> list[dict]:
    """The functions and methods of a file at any depth, in source order; overload stubs are dropped, small ones kept with no prints."""
    module = parse(content)
    if module is None:
        return []
    starts = [0]
    for line in content.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    imports = imports_of(module, file)
    out: list[dict] = []

    def walk(n: ast.AST, names: list[str]) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if not is_overload(c):
                    out.append(one(c, ".".join([*names, c.name])))
                walk(c, [*names, c.name])
            elif isinstance(c, ast.ClassDef):
                walk(c, [*names, c.name])
            else:
                walk(c, names)

    def one(fn: ast.AST, qname: str) -> dict:
        norm = Normalizer(fn, imports, starts)
        t = norm.tree
        first = min([fn, *fn.decorator_list], key=lambda x: (x.lineno, x.col_offset))
        s = starts[first.lineno - 1] + first.col_offset - (1 if first is not fn else 0)
        e = starts[fn.end_lineno - 1] + fn.end_col_offset
        small = len(t.labels) < cfg.min_nodes
        wl = {} if small else wl_histogram(t, cfg.wl_iters)
        return {
            "file": file, "qname": qname, "line": fn.lineno, "last_line": fn.end_lineno, "span": {"s": s, "e": e}, "node_count": len(t.labels), "merkle_root": signed(merkle_hashes(t)[-1]),
            "wl": [{"label": k, "w": w} for k, w in sorted((signed(h), w) for h, w in wl.items())], "minhash": [] if small else minhashes(list(wl)), "vocab_tf": dict(norm.vocab),
            "calls": [{"base": b, "module": m} for b, m in sorted(norm.calls, key=lambda c: (c[0], c[1] or ""))], "is_test": bool(TEST.search(file.lower())), "source": content[s:e].decode("utf-8", "replace"),
            "labels": [signed(x) for x in t.labels], "children": t.children, "spans": [{"s": a, "e": b} for a, b in t.spans],
        }

    walk(module, [])
    return out


TOKENS = "file string, s int, toks array<struct<s:int,e:int,kind:string,base:string,module:string>>"


def scan_sources(files: DataFrame) -> DataFrame:
    """(file, s, toks): for each function of (file, content), by the start of its span, what its text shows: tokens with UTF-16 offsets into it.

    kind is kw, str, com, num, def or call, or null for a plain name; base and module say
    what a name may refer to. Locals, names of definitions, of keyword arguments and of
    modules refer to nothing. A text that is no UTF-8 has no tokens.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(file, s, toks) for file, content in zip(f["file"], f["content"], strict=True) for s, toks in _viewed(file, bytes(content))]
            yield pd.DataFrame(rows, columns=["file", "s", "toks"])

    return files.mapInPandas(run, TOKENS)


def _viewed(file: str, content: bytes) -> Iterator[tuple[int, list[dict]]]:
    module = parse(content)
    if module is None:
        return
    imports = imports_of(module, file)
    starts = [0]
    for line in content.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    for fn in ast.walk(module):
        if isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)) and not is_overload(fn):
            first = min([fn, *fn.decorator_list], key=lambda x: (x.lineno, x.col_offset))
            s = starts[first.lineno - 1] + first.col_offset - (1 if first is not fn else 0)
            try:
                text = content[s : starts[fn.end_lineno - 1] + fn.end_col_offset].decode()
            except UnicodeDecodeError:
                yield s, []
                continue
            yield s, view(text, locals_of(fn), imports)


def view(text: str, names: dict[str, int], imports: dict[str, tuple[str, str | None]]) -> list[dict]:
    """The tokens of a function's text; ``names`` are its locals."""
    lines, at = text.splitlines(keepends=True), [0]
    for line in lines:
        at.append(at[-1] + len(line.encode("utf-16-le")) // 2)

    def place(row: int, col: int) -> int:
        return at[min(row, len(at)) - 1] + (len(lines[row - 1][:col].encode("utf-16-le")) // 2 if row <= len(lines) else 0)

    toks: list[tokenize.TokenInfo] = []
    try:
        toks.extend(t for t in tokenize.generate_tokens(iter(lines).__next__) if t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER))
    except (tokenize.TokenError, SyntaxError, StopIteration):
        pass  # what was read until then is shown
    out, depth, importing, quoted = [], 0, -1, []
    for k, t in enumerate(toks):
        kind = base = from_module = None
        before = toks[k - 1].string if k else ""
        after = toks[k + 1].string if k + 1 < len(toks) else ""
        name = tokenize.tok_name[t.type]
        if t.string in "([{" and t.type == tokenize.OP:
            depth += 1
        elif t.string in ")]}" and t.type == tokenize.OP:
            depth -= 1
        if name == "FSTRING_START":
            quoted.append(t)
        if name.startswith("FSTRING") or t.type == tokenize.STRING:
            kind = "str"
            if name == "FSTRING_END" and quoted:
                quoted.pop()
        elif t.type == tokenize.COMMENT:
            kind = "com"
        elif t.type == tokenize.NUMBER:
            kind = "num"
        elif t.type == tokenize.NAME and keyword.iskeyword(t.string):
            kind = "kw"
            if t.string in ("import", "from") and before not in ("yield", "raise") and importing != t.start[0]:
                importing = t.start[0]
        elif t.type == tokenize.NAME:
            if before in ("def", "class"):
                kind = "def"
            elif importing == t.start[0] or (after == "=" and depth > 0 and before in ("(", ",")):
                continue
            else:
                kind = "call" if after == "(" else None
                if before == ".":
                    of = imports.get(toks[k - 2].string) if k > 1 and (k < 3 or toks[k - 3].string != ".") and toks[k - 2].string not in names else None
                    base, from_module = t.string, of[0] if of and of[1] is None else None
                elif t.string not in names:
                    module, original = imports.get(t.string, (None, None))
                    if original or module is None:
                        base, from_module = original or t.string, module
        if kind or base:
            out.append({"s": place(*t.start), "e": place(*t.end), "kind": kind, "base": base, "module": from_module})
    return out


def scan_symbols(files: DataFrame, cfg: Config) -> DataFrame:
    """One row per function of (file, content), also of those below ``min_nodes``, whose prints are empty."""
    columns = ["file", "qname", "line", "last_line", "span", "node_count", "merkle_root", "wl", "minhash", "vocab_tf", "calls", "is_test", "source", "labels", "children", "spans"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for file, content in zip(f["file"], f["content"], strict=True) for r in symbols_of(file, bytes(content), cfg)]
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, SYMBOL)


def file_docs(files: DataFrame) -> DataFrame:
    """(file, is_test, has_docstring): whether the first statement of a module is a plain string."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"file": f["file"], "is_test": [bool(TEST.search(x.lower())) for x in f["file"]], "has_docstring": [has_docstring(bytes(c)) for c in f["content"]]})

    return files.mapInPandas(run, "file string, is_test boolean, has_docstring boolean")


def has_docstring(content: bytes) -> bool:
    module = parse(content)
    body = module.body if module else []
    return bool(body) and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)
