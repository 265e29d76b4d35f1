"""Garbled text from wrong character encoding: substitution ciphers per source, learnt by expectation-maximisation."""

from __future__ import annotations

import copy
import functools
import re
from collections import Counter
from collections.abc import Iterator
from encodings.aliases import aliases

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.runtime import Stage

# The code pages texts are wrongly read with, and those, besides UTF-8, they are written in.
READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "iso8859-2", "iso8859-5", "iso8859-15", "mac_cyrillic", "cp1253", "cp1254", "cp932", "gbk", "big5"]
SWAPS = [
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("cp1251", "mac_cyrillic"),
    ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1252"), ("cp866", "latin-1"), ("cp866", "cp1252"), ("cp866", "cp437"), ("cp1251", "cp437"), ("cp1251", "mac_roman"), ("cp1251", "cp850"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp437", "latin-1"), ("cp850", "latin-1"),
    ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("cp852", "cp1250"), ("cp852", "cp1252"), ("cp1250", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1250", "cp1251"), ("cp1252", "iso8859-2"),
    ("euc_jp", "latin-1"), ("euc_jp", "cp1252"), ("cp932", "latin-1"), ("cp932", "cp1252"), ("gbk", "latin-1"), ("gbk", "cp1252"), ("euc_kr", "latin-1"), ("big5", "latin-1"), ("cp932", "mac_roman"), ("euc_jp", "mac_roman"), ("euc_jp", "cp932"),
]

PAIR_BITS, CHAR_BITS = 20, 16
"""Slots, as powers of two, of the hashed tables of bigrams and of first characters; fixed, whatever the corpus."""
RARE = 0.02
"""A bigram in a smaller share of the texts is rare; letters are learnt from runs that are rare for the most part."""
SOME = 2.0
"""Log likelihood gained from which a cipher of a text counts as evidence."""
EM_ROUNDS = 3
FIRST_UTF8, FIRST_SHARE, WEIGHT = 0.02, 0.002, 500
"""Share of a cipher, of UTF-8 or another, in a source before any is learnt, and how many texts that belief weighs."""
LEAST = 0.0
"""Log odds from which a document is garbled: it is more likely than not."""
FAINT = 1.5
"""Log likelihood that a run has to gain to count: what the model itself may be wrong by, which long texts would add up."""
FIT = -3.5
"""Mean log probability of a bigram from which a reading looks like the texts."""
STRANGE = -5.0
"""Mean log probability of a character's bigrams in the other sources below which it may stand for another letter."""
LETTERS, EACH = 12, 6
"""A table of letters is learnt where at least so many letters stand, each in so many bigrams on average; fewer do not determine it."""
WORSE = 1.25
"""How far the mean log probability of a bigram under a learnt table may stay below that of the texts."""
COVER = 0.8
"""Share of the bigrams with a letter of a learnt table that it has to read whole."""
MORE = 2.5
"""How much more likely, in log units a bigram, a learnt table has to make what it reads."""
LEARN_ROUNDS = 30
NOISE = -6.0
"""Log probability of a bigram with a character that is no letter of the table."""
LEARNT = "learnt"

# Code pages whose letters a learnt table may lead to. Which character stands for which letter is learnt.
ALPHABETS = ["cp1251", "mac_cyrillic", "latin-1", "cp1250", "cp1253", "cp1254", "cp1257", "cp1255"]

RUN = re.compile("[^\x00-\x7f]+")
RUNS = re.compile("([\x00-\x7f])([^\x00-\x7f]+)(?=([\x00-\x7f]))")
"""Runs with their neighbours, in a text with blanks around it."""
SPLIT = re.compile("([^\x00-\x7f]+)")
LOST = re.compile("\ufffd(?=\\w)|(?<=\\w)\ufffd|\ufffd\ufffd")
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
MARK = "\xef\xbb\xbf"
_FOLD = np.array([ord(chr(i).lower()) if chr(i).isalpha() else 48 if chr(i).isdigit() else 32 if chr(i).isspace() else 46 for i in range(128)], np.uint32)


def folded(text: str) -> np.ndarray:
    """Code points with blanks around the text; ASCII letters without case, digits, blanks and marks as one of each."""
    c = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = c < 128
    c[low] = _FOLD[c[low]]
    c[c == 0xA0] = 32
    return c


def _slot(a: np.ndarray, bits: int) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _slot(a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64), PAIR_BITS)


def pair_slots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a bigram with a character beyond ASCII begins, its slot, and the slot of its first character."""
    at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
    a, b = c[at].astype(np.uint64), c[at + 1].astype(np.uint64)
    return at, _slot(a << np.uint64(21) | b, PAIR_BITS), _slot(a, CHAR_BITS)


class Bigrams:
    """Bigram shares over the texts, in hashed tables of fixed size."""

    def __init__(self, texts: int, slots: np.ndarray, counts: np.ndarray):
        self.texts = max(texts, 1)
        self.pair, self.first = np.zeros(1 << PAIR_BITS, np.float32), np.zeros(1 << CHAR_BITS, np.float32)
        is_pair = slots >= 0
        self.pair[slots[is_pair]] = counts[is_pair]
        self.first[-1 - slots[~is_pair]] = counts[~is_pair]

    def score(self, *texts: str) -> np.ndarray:
        """Log probability of the bigrams of each text, a run with its neighbours; 0 if none has a character beyond ASCII."""
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        low = c < 128
        c[low] = _FOLD[c[low]]
        c[c == 0xA0] = 32
        at, p, f = pair_slots(c)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        of = np.searchsorted(ends, at, "right")
        inside = at + 1 < ends[of]
        return np.bincount(of[inside], np.log((self.pair[p] + 0.02) / (self.first[f] + 40))[inside], len(texts))

    def without(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Bigrams:
        """The model less so many texts with each bigram."""
        out = copy.copy(self)
        out.pair, out.first = self.pair.copy(), self.first.copy()
        pair, first = _pair_slot(a, b), _slot(a.astype(np.uint64), CHAR_BITS)
        np.subtract.at(out.pair, pair, n)
        np.subtract.at(out.first, first, n)
        np.maximum(out.pair, 0, out=out.pair)
        np.maximum(out.first, 0, out=out.first)
        return out

    def log_p(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.log((self.pair[_pair_slot(a, b)] + 0.02) / (self.first[_slot(a, CHAR_BITS)] + 40))

    def table(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log probabilities of each of ``b`` after each of ``a``."""
        return np.log((self.pair[_pair_slot(a[:, None], b[None, :])] + 0.02) / (self.first[_slot(a, CHAR_BITS)] + 40)[:, None])


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``folded`` of all texts, one after the other, and where each ends."""
    return folded("  ".join(texts)), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2)


def fit_bigrams(texts: DataFrame, text: str) -> Bigrams:
    """Counts in how many distinct texts each bigram occurs. Copies of a text count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                c, ends = joined(batch.column(0).slice(at, 256).to_pylist())
                where, p, f = pair_slots(c)
                once, index = np.unique(np.searchsorted(ends, where, "right") << PAIR_BITS | p, return_index=True)
                np.add.at(pair, once & (1 << PAIR_BITS) - 1, 1)
                np.add.at(first, f[index], 1)
        p, c = np.flatnonzero(pair), np.flatnonzero(first)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[p, -1 - c].astype(np.int32)), pa.array(np.r_[pair[p], first[c]])], names=["slot", "n"])

    distinct = texts.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(F.col(text).alias("t")).distinct()
    got = distinct.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most a row per slot
    return Bigrams(texts.count(), got["slot"].to_numpy(), got["n"].to_numpy())


def _written(run: str, page: str) -> bytes | None:
    """The bytes that read as ``run`` in a code page; what the page leaves undefined stands for itself."""
    try:
        return run.encode(page)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in run:
        try:
            out += ch.encode(page)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) <= 0x9F:
                return None
            out.append(ord(ch))
    return bytes(out)


def _swapped(page: str, read: str) -> dict[int, str]:
    """The letters of a swap of two single-byte code pages, for translate()."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(read))] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            if read == "cp1252":
                try:
                    out[b] = bytes([b]).decode(page)
                except UnicodeDecodeError:
                    pass
    return out


MULTI = {"euc_jp", "cp932", "gbk", "euc_kr", "big5"}
TABLES = {(w, r): _swapped(w, r) for w, r in SWAPS if w not in MULTI and r not in MULTI}


LETTERS_OF = {pair: frozenset(map(chr, table)) for pair, table in TABLES.items()}
PAGES = {page: frozenset(ch for b in range(128, 256) if (ch := bytes([b]).decode(page, "ignore"))) | frozenset(map(chr, range(0x80, 0xA0))) for page in READ_AS if page not in MULTI}
"""What a page of single bytes can have made, with the characters that stand for bytes it leaves undefined."""


def readings(run: str) -> Iterator[tuple[str, str]]:
    """(cipher, plain text) for every code-page swap under which the run is a text."""
    chars = set(run)
    if len(run) > 1:
        for page in READ_AS:
            if (page not in PAGES or chars <= PAGES[page]) and (b := _written(run, page)):
                try:
                    yield f"utf-8>{page}", b.decode("utf-8")
                except UnicodeDecodeError:
                    plain = b.decode("utf-8", "ignore")
                    if len(b) >= 6 and 0 < len(plain) and len(plain.encode()) >= 0.7 * len(b) and max(plain) > "\x7f":
                        yield f"utf-8~{page}", plain
    for key in SWAPS:
        if key in TABLES:
            if chars <= LETTERS_OF[key]:
                plain = run.translate(TABLES[key])
                if plain != run and plain.isprintable():  # no page's blank or control character is a letter
                    yield f"{key[0]}>{key[1]}", plain
        elif len(run) > 1 and (key[1] not in PAGES or chars <= PAGES[key[1]]) and (b := _written(run, key[1])):
            try:
                plain = b.decode(key[0])
            except UnicodeDecodeError:
                continue
            if plain.isprintable():
                yield f"{key[0]}>{key[1]}", plain


class Reader:
    """What each run of characters beyond ASCII, between its neighbours, reads as; kept for runs that come again."""

    def __init__(self, model: Bigrams):
        self.model, self.known = model, {}

    def __call__(self, key: tuple[str, str, str]) -> tuple[float, list, list, list]:
        """(log probability, readings, gains, odd): readings are (log probability, cipher, plain text), gains (cipher, gain), odd
        the bigrams of a run that is rare for the most part and that no cipher makes look like the texts."""
        if key not in self.known:
            self.meet({key})
        return self.known[key]

    def meet(self, keys: set[tuple[str, str, str]]) -> None:
        """Reads those of the runs that are new, all together."""
        if len(self.known) > 1 << 17:
            self.known.clear()
        new = [key for key in keys if key not in self.known]
        if not new:
            return
        read = [list(readings(run)) for _, run, _ in new]
        scores = self.model.score(*(x for (a, run, b), r in zip(new, read, strict=True) for x in (a + run + b, *(a + plain + b for _, plain in r))))
        at = 0
        for key, r in zip(new, read, strict=True):
            own = scores[at : at + len(r) + 1].tolist()
            at += len(r) + 1
            self.known[key] = self._rated(key, own[0], [(s - (3.0 if "~" in name else 0.0), name, plain) for s, (name, plain) in zip(own[1:], r, strict=True)])

    def _rated(self, key: tuple[str, str, str], base: float, read: list) -> tuple[float, list, list, list]:
        gain = [(name, after - base) for after, name, _ in read if after - base >= FAINT]
        likely = max((after / (len(plain) + 1) for after, name, plain in read if after > base), default=-np.inf)
        odd: list[int] = []
        if likely < FIT:
            c = folded("".join(key))[1:-1].astype(np.int64)
            rare = self.model.pair[_pair_slot(c[:-1], c[1:])] < RARE * self.model.texts + 1
            if 2 * rare.sum() > len(rare):
                odd = (c[:-1] << 21 | c[1:]).tolist()
        return base, read, gain, odd


def runs_of(text: str) -> Counter:
    p = SPLIT.split(f" {text} ")
    return Counter(zip([x[-1] for x in p[:-1:2]], p[1::2], [x[0] for x in p[2::2]], strict=True))


def gains(text: str, reader: Reader, odd: set | None = None) -> dict[str, float]:
    """For each cipher by how much it makes the runs of a text more likely. ``odd`` gets the bigrams of runs that stay unlikely."""
    out: dict[str, float] = {}
    for key, n in runs_of(text).items():
        _, _, gain, strange = reader(key)
        for name, g in gain:
            out[name] = out.get(name, 0.0) + n * g
        if odd is not None and strange:
            odd.update(strange)
    return out


@functools.cache
def single_byte() -> np.ndarray:
    """The characters beyond ASCII that some page of single bytes has: no other comes out of a swap of such pages."""
    out: set[int] = set()
    for page in set(aliases.values()):
        try:
            if bytes(range(32, 127)).decode(page) == "".join(map(chr, range(32, 127))):
                out.update(ord(ch) for b in range(128, 256) if len(ch := bytes([b]).decode(page, "ignore")) == 1)
        except (LookupError, UnicodeDecodeError, TypeError, ValueError):
            continue
    return np.array(sorted(c for c in out if c > 127))


def _em(a: np.ndarray, b: np.ndarray, n: np.ndarray, log_p: np.ndarray, unit: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Expectation-maximisation of a letter table: expected counts of (plain letter, character).

    ``a`` and ``b`` number the characters of bigrams seen ``n`` times, ``log_p`` has the log
    probabilities of plain bigrams, ``unit`` those of plain letters, ``emit`` those of a letter's characters.
    """
    joint, may = np.exp(log_p) * unit[:, None], emit > 0
    count = emit
    is_a, is_b = np.zeros((len(n), emit.shape[1])), np.zeros((len(n), emit.shape[1]))
    is_a[np.arange(len(n)), a] = is_b[np.arange(len(n)), b] = 1
    for _ in range(LEARN_ROUNDS):
        left, right = joint @ emit, joint.T @ emit
        pa, pb = emit[:, a] * left[:, b], emit[:, b] * right[:, a]
        pa *= n / np.maximum(pa.sum(0), 1e-300)
        pb *= n / np.maximum(pb.sum(0), 1e-300)
        count = pa @ is_a + pb @ is_b
        emit = (count + 1e-3) * may
        emit /= np.maximum(emit.sum(1, keepdims=True), 1e-300)
    return count


def _climb(a: np.ndarray, b: np.ndarray, n: np.ndarray, log_p: np.ndarray, to: np.ndarray, free: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Moves and swaps of single letters of a table, as long as one makes the bigrams more likely."""
    best, moved = float((n * log_p[to[a], to[b]]).sum()), True
    while moved:
        moved = False
        for c in free:
            start, stop = (a == c) & (b != c), (b == c) & (a != c)
            rough = (n[start] * log_p[:, to[b[start]]]).sum(1) + (n[stop] * log_p[to[a[stop]], :].T).sum(1)
            for p in np.r_[letters[np.argsort(-rough[letters])][:12], len(log_p) - 1]:
                if p == to[c]:
                    continue
                new = to.copy()
                if p < len(log_p) - 1:
                    new[free[to[free] == p]] = to[c]
                new[c] = p
                got = float((n * log_p[new[a], new[b]]).sum())
                if got > best + 1e-6:
                    best, to, moved = got, new, True
    return to


def learn_letters(a: np.ndarray, b: np.ndarray, n: np.ndarray, model: Bigrams) -> dict[int, str]:
    """The letter table of an unknown code-page swap, from how many texts of a source have each bigram no listed cipher explains.

    The characters beyond ASCII are cipher letters, those of ASCII stand for themselves.
    For the letters of every alphabet the model knows, the table is learnt by
    expectation-maximisation, from a blank start and from every listed swap that covers
    most of the characters, and settled by single moves. A character that fits no letter
    is left out, with its bigrams at ``NOISE``. The most likely table counts if its
    bigrams are about as likely as those of the texts themselves, which a language that
    is only rare does not reach; otherwise there is none.
    """
    model = model.without(a, b, n)
    chars, at = np.unique(np.r_[a, b], return_inverse=True)
    total = np.bincount(at, np.r_[n, n])
    base = model.log_p(a, b)
    strange = np.bincount(at, np.r_[n * base, n * base]) < STRANGE * total
    seen = chars[strange & (total >= 3) & np.isin(chars, single_byte())]
    ok = ((a < 128) | np.isin(a, seen)) & ((b < 128) | np.isin(b, seen))
    if len(seen) < LETTERS or n[ok].sum() < EACH * LETTERS:
        return {}
    a, b, n, base = a[ok], b[ok], n[ok].astype(float), base[ok]
    marks = np.unique(np.r_[a[a < 128], b[b < 128]])
    m, cipher = len(marks), np.r_[marks, seen]
    ia, ib = np.searchsorted(cipher, a), np.searchsorted(cipher, b)
    free = np.arange(m, len(cipher))
    often = np.bincount(np.r_[ia, ib], np.r_[n, n], len(cipher))[m:]
    best: tuple[float, dict[int, str]] = (-np.inf, {})
    for page in ALPHABETS:
        abc = np.array(sorted({ord(ch) for i in range(128, 256) if (ch := bytes([i]).decode(page, "ignore")) and ch.isalpha()}))
        abc = abc[model.first[_slot(abc, CHAR_BITS)] >= 20]
        k = len(abc)
        if k < LETTERS:
            continue
        plain = np.r_[marks, abc]
        log_p, pairs = model.table(plain, plain), model.pair[_pair_slot(plain[:, None], plain[None, :])].astype(float)
        log_p[:m, :m], pairs[:m, :m] = -12.0, 0.0  # bigrams of ASCII alone are not counted
        typical = float((pairs * log_p).sum() / max(pairs.sum(), 1))
        log_p = np.pad(log_p, (0, 1), constant_values=NOISE)  # the last plain letter is none
        unit = np.r_[np.maximum(pairs.sum(1), 0.02), pairs.sum() / 20]
        unit /= unit.sum()
        blank = np.zeros((m + k + 1, len(cipher)))
        blank[np.arange(m), np.arange(m)] = 1
        rank = np.argsort(np.argsort(-unit[m : m + k])) / k
        blank[m : m + k, m:] = np.exp(-2 * np.abs(rank[:, None] - (np.argsort(np.argsort(-often)) / len(free))[None, :]))
        blank[-1, m:] = 1
        starts = [blank]
        for t in TABLES.values():
            hit = [(int(p[0]), c) for c in free if (q := t.get(int(cipher[c]))) and len(p := np.flatnonzero(abc == ord(q)))]
            if 2 * len(hit) >= min(len(free), k):
                start = blank.copy()
                for p, c in hit:
                    start[m + p, c] += 20
                starts.append(start)
        for start in starts:
            count = _em(ia, ib, n, log_p, unit, start / np.maximum(start.sum(1, keepdims=True), 1e-300))
            to = np.r_[np.arange(m), np.full(len(free), m + k)]
            for x in np.argsort(-count[m : m + k, m:], axis=None):
                p, c = divmod(int(x), len(free))
                if count[m + p, m + c] >= 1 and to[m + c] == m + k and m + p not in to[m:]:
                    to[m + c] = m + p
            read = (to[ia] < m + k) & (to[ib] < m + k)
            if (n * (log_p[to[ia], to[ib]] - base))[read].sum() <= 0:
                continue  # right tables are far above before their last letters are settled
            to = _climb(ia, ib, n, log_p, to, free, np.arange(m, m + k))
            got = log_p[to[ia], to[ib]]
            read = (to[ia] < m + k) & (to[ib] < m + k)
            letters = free[to[free] < m + k]
            if len(letters) < LETTERS or n[read].sum() < EACH * len(letters):
                continue
            gain = float((n * (got - base))[read].sum()) - len(letters) * np.log(k)
            touched = np.isin(ia, letters) | np.isin(ib, letters)
            if n[read].sum() < COVER * n[touched].sum():
                continue
            if np.average(got[read], weights=n[read]) >= typical - WORSE and gain > max(best[0], MORE * n[read].sum()):
                near = [read & ((ia == c) | (ib == c)) for c in letters]
                best = gain, {int(cipher[c]): chr(plain[to[c]]) for c, r in zip(letters, near, strict=True) if r.any() and np.average(got[r], weights=n[r]) >= typical - 2 * WORSE}
    return best[1]


class Learnt:
    """A source's learnt letters, and the model without what they are learnt from."""

    def __init__(self, letters: dict[int, str], a: np.ndarray, b: np.ndarray, n: np.ndarray, model: Bigrams):
        self.letters, self.model, self.known = letters, model.without(a, b, n), {}

    def reading(self, key: tuple[str, str, str]) -> tuple[str, float] | None:
        """The plain text of a run and how much more likely it is; null if the table lacks a character or the text is unlike the texts."""
        if key not in self.known:
            if len(self.known) > 1 << 17:
                self.known.clear()
            self.known[key] = self._read(*key)
        return self.known[key]

    def _read(self, before: str, run: str, after: str) -> tuple[str, float] | None:
        if not all(ord(ch) in self.letters for ch in run):
            return None
        plain = run.translate(self.letters)
        got, base = self.model.score(before + plain + after, before + run + after).tolist()
        gain = got - base
        return (plain, gain) if gain >= FAINT and got / (len(plain) + 1) >= FIT else None

    def gain(self, text: str) -> float:
        """Summed over the runs of a text."""
        return float(sum(n * r[1] for key, n in runs_of(text).items() if (r := self.reading(key))))

    @staticmethod
    def of(source: str, tables: dict, model: Bigrams, last: dict) -> Learnt | None:
        """That of a source; ``last`` keeps the latest one only, as rows come sorted by source."""
        if source not in tables:
            return None
        if source not in last:
            last.clear()
            last[source] = Learnt(*tables[source], model)
        return last[source]


def _read_back(text: str, cipher: str, reader: Reader, learnt: Learnt | None, first: bool) -> str:
    """The text with each run read back once where the cipher makes it more likely, but for the ``first`` cipher only if none reads it better; a run with lost bytes stays as it is."""

    def back(m: re.Match) -> str:
        key = m.groups()
        run = key[1]
        if cipher == LEARNT:
            got = learnt.reading(key) if learnt else None
            return key[0] + (got[0] if got else run)
        base, read, _, _ = reader(key)
        if first:
            return key[0] + next((plain for after, name, plain in read if name == cipher and after > base), run)
        sure = [x for x in read if x[1].startswith("utf-8")] or read  # bytes that form UTF-8, even with some lost, hardly are anything else
        best = max((x[0] for x in sure), default=base)
        return key[0] + next((plain for got, name, plain in sure if name == cipher and base < got >= best), run)

    return RUNS.sub(back, f" {text} ")[1:-1]


def restore(text: str, cipher: str, reader: Reader, learnt: Learnt | None = None) -> str:
    """The text read back under its cipher, again and again, then under any other that is as sure in what is left, until nothing changes."""
    if "~" in cipher:  # bytes are lost: what is left of them would be read under any cipher that takes them
        return text
    start, seen, idle = text, {text}, set()
    while True:
        plain = _read_back(text, cipher, reader, learnt, text is start and not idle)
        if plain in seen:
            idle.add(cipher)
            sure = [(g, name) for name, g in gains(text, reader).items() if "~" not in name and name not in idle and g + np.log(FIRST_UTF8 if name.startswith("utf-8") else FIRST_SHARE) >= LEAST]
            if not sure:
                return text
            cipher = max(sure)[1]
        else:
            text = plain
            seen.add(text)
            idle.clear()


def garbled_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents with a passage that was decoded otherwise than it was written, and their text read back.

    Every code-page swap is a substitution cipher. Bigrams of characters over all distinct
    texts are the language model. The runs of characters beyond ASCII of a text
    are read under every cipher, each distinct run once a task; the gain in log likelihood, summed over
    the text, is its evidence. Expectation-maximisation learns for each source how common
    each cipher is there: the expectation is a text's posterior over the ciphers, the
    maximisation their shares by source. What no listed cipher makes look like the texts
    goes into a table of letters learnt for its source (``learn_letters``), one cipher
    more there. A text is garbled if the posterior odds of all
    ciphers together exceed ``LEAST``.

    Some damage shows without a model: control characters of the C1 range, replacement
    characters next to letters, and a byte order mark read as three letters. These
    documents are found too, even if nothing can be read back.

    Null ids and texts give no rows; a null source is a source of its own; repeated rows
    give repeated rows. No documents, no rows. Whole texts are read.

    Returns (doc_id, cipher, score, restored): cipher is null where only damage shows and
    ``learnt`` where a source's own table was used,
    restored is null where it is not known.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "garbled")
    pick = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("t"))
    model = spark.sparkContext.broadcast(fit_bigrams(pick, "t"))

    kind = pick.schema[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for batch in batches:
            keep, damage, got, odd = [], [], [], []
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 512):  # runs that are new are read together
                reader.meet({key for t in texts[at : at + 512] for key in runs_of(t)})
            for k, t in enumerate(texts):
                hurt = bool(CONTROL.search(t) or "\ufffd" in t and LOST.search(t) or t.startswith(MARK))
                strange: set[int] = set()
                gain = [{"cipher": c, "gain": g} for c, g in gains(t, reader, strange).items() if g >= SOME]
                if hurt or gain or strange:
                    keep.append(k)
                    damage.append(hurt)
                    got.append(gain)
                    odd.append(list(strange))
            kept = batch.take(pa.array(keep, pa.int64()))
            types = pa.list_(pa.struct([("cipher", pa.string()), ("gain", pa.float64())])), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(damage, pa.bool_()), pa.array(got, types[0]), pa.array(odd, types[1])], names=["doc_id", "source", "t", "damage", "got", "odd"])

    schema = f"doc_id {kind}, source string, t string, damage boolean, got array<struct<cipher:string,gain:double>>, odd array<bigint>"
    scored = stage.keep(pick.where(F.col("t").rlike("[^\\x00-\\x7f]")).mapInArrow(score, schema), "scored").withColumn("source", F.coalesce("source", F.lit("")))
    evidence = scored.select("doc_id", "source", F.xxhash64("t").alias("h"), F.explode("got").alias("g")).select("doc_id", "source", "h", "g.cipher", "g.gain")
    tables, own = _learn_tables(scored, model), None
    if tables:
        own = spark.sparkContext.broadcast(tables)

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last: dict = {}
            for f in frames:
                got = [Learnt.of(s, own.value, model.value, last).gain(t) for s, t in zip(f["source"], f["t"], strict=True)]
                f["cipher"], f["gain"] = LEARNT, np.array(got, float)
                yield f.loc[f["gain"] > 0, ["doc_id", "source", "h", "cipher", "gain"]]

        some = scored.where(F.col("source").isin(list(tables))).select("doc_id", "source", F.xxhash64("t").alias("h"), "t").repartition("source").sortWithinPartitions("source")
        more = some.mapInPandas(read, evidence.schema)
        evidence = evidence.unionByName(stage.keep(more, "learnt"))
    size = pick.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    shares: DataFrame | None = None
    for _ in range(EM_ROUNDS):
        post = _posterior(evidence, shares)
        shares = stage.keep(post.groupBy("source", "cipher").agg(F.sum("p").alias("m")).join(size, "source").select("source", "cipher", ((F.col("m") + WEIGHT * _first()) / (F.col("n") + WEIGHT)).alias("share")), "shares")
    final = _posterior(evidence, shares)
    best = final.groupBy("doc_id", "h").agg(F.max("odds").alias("score"), F.max_by("cipher", F.struct("odds", "cipher")).alias("cipher"))
    out = scored.withColumn("h", F.xxhash64("t")).join(best, ["doc_id", "h"], "left").where(F.col("damage") | (F.col("score") >= LEAST))

    def read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict = {}
        reader = Reader(model.value)
        for f in frames:
            f["restored"] = [
                restore(t, c, reader, Learnt.of(source, own.value, model.value, last) if own else None) if isinstance(c, str) and s >= LEAST else None
                for t, c, s, source in zip(f["t"], f["cipher"], f["score"], f["source"], strict=True)
            ]
            f["restored"] = [r if r != t else None for r, t in zip(f["restored"], f["t"], strict=True)]
            yield f[["doc_id", "cipher", "score", "restored"]]

    out = out.select("doc_id", "source", "t", "cipher", "score")
    if own:
        out = out.repartition("source").sortWithinPartitions("source")
    return out.mapInPandas(read_back, f"doc_id {pick.schema[0].dataType.simpleString()}, cipher string, score double, restored string")


def _learn_tables(scored: DataFrame, model: Broadcast) -> dict[str, tuple]:
    """For each source with an unknown swap its letters, and the bigrams (a, b, n) they are learnt from."""
    pairs = scored.select("source", F.xxhash64("t").alias("h"), F.explode("odd").alias("pair")).distinct().groupBy("source", "pair").agg(F.count("*").cast("double").alias("n"))

    def learn(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pair")
        pair, n = f["pair"].to_numpy(), f["n"].to_numpy()
        a, b = pair >> 21, pair & ((1 << 21) - 1)
        got = learn_letters(a, b, n, model.value)
        return pd.DataFrame([(f["source"].iloc[0], list(got), list(got.values()), a, b, n)] if got else [], columns=["source", "read", "plain", "a", "b", "n"])

    rows = pairs.repartition(4 * scored.sparkSession.sparkContext.defaultParallelism, "source").groupBy("source").applyInPandas(learn, "source string, read array<int>, plain array<string>, a array<bigint>, b array<bigint>, n array<double>").collect()
    return {r["source"]: (dict(zip(r["read"], r["plain"], strict=True)), *(np.array(r[c]) for c in "abn")) for r in rows}


def _first() -> Column:
    return F.when(F.col("cipher").startswith("utf-8>"), FIRST_UTF8).otherwise(FIRST_SHARE)


def _posterior(evidence: DataFrame, shares: DataFrame | None) -> DataFrame:
    """Evidence with the log odds of each cipher in its text and its posterior p."""
    rated = evidence.withColumn("share", _first()) if shares is None else evidence.join(shares, ["source", "cipher"])
    odds = rated.withColumn("odds", F.col("gain") + F.log("share"))
    total = odds.groupBy("doc_id", "h").agg(F.sum(F.exp(F.least("odds", F.lit(500.0)))).alias("z"))
    return odds.join(total, ["doc_id", "h"]).withColumn("p", F.exp(F.least("odds", F.lit(500.0))) / (1 + F.col("z")))
