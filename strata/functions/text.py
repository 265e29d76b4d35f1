"""Column functions on words, identifiers and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.config import STOPWORDS

TICKET = r"(#[0-9]+|(?<![A-Za-z0-9])[A-Z]+-[0-9]+(?![A-Za-z0-9]))"


def subwords(text: Column) -> Column:
    """Lower-case subwords of identifiers in a text: split at case boundaries and at everything but letters and digits.

    Words of fewer than two bytes, numbers and stopwords are dropped. Null gives null.
    """
    t = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    t = F.regexp_replace(t, r"([\p{L}\p{N}])(\p{Lu}\p{Ll})", "$1 $2")
    words = F.split(t, r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.rlike(r"^\p{N}+$"))
    return F.filter(F.transform(kept, F.lower), lambda w: ~w.isin(STOPWORDS))


def first_ticket(message: Column) -> Column:
    """The first ``#123`` (no boundary needed) or word-bounded ``ABC-123`` of a message; null if there is none."""
    found = F.regexp_extract(message, TICKET, 1)
    return F.when(found != "", found)


def base_name(qname: Column) -> Column:
    """What follows the last dot of a qualified name."""
    return F.substring_index(qname, ".", -1)


def class_of_init(qname: Column) -> Column:
    """Everything before ``.__init__``, else null."""
    return F.when(qname.endswith(".__init__"), F.regexp_replace(qname, r"\.__init__$", ""))


def is_dunder(name: Column, least: int = 5) -> Column:
    """``__name__``; families want something between the underscores (5 characters or more), links do not (``least=0``)."""
    return name.startswith("__") & name.endswith("__") & (F.length(name) >= least)


def collapse_ws(text: Column) -> Column:
    """ASCII white space collapsed to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\r\f]+", " "), r"^ | $", "")


def line_count(text: Column) -> Column:
    """Newlines, and one more if the text does not end in one; 0 for an empty text."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(newlines + F.when(text.endswith("\n"), 0).otherwise(1))


def looks_binary(text: Column) -> Column:
    """A NUL among the first 8000 characters."""
    return F.instr(F.substring(text, 1, 8000), "\0") > 0


def utf16_length(text: Column) -> Column:
    """UTF-16 code units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def query_param(query: Column, name: str) -> Column:
    """The first value of a parameter in ``a=b&c=d``, decoded: ``+`` is a blank, an escape without two hexadecimal digits stays as it is, bytes that are no UTF-8 become replacement characters."""
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    kept = F.regexp_replace(F.replace(raw, F.lit("+"), F.lit(" ")), "%(?![0-9A-Fa-f]{2})", "%25")
    # Parts between escapes and runs of escapes, decoded run by run.
    parts = F.regexp_extract_all(kept, F.lit("((?:%[0-9A-Fa-f]{2})+|[^%]+)"), 1)
    bytes_of = lambda p: F.decode(F.unhex(F.replace(p, F.lit("%"), F.lit(""))), "UTF-8")
    decoded = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("%"), bytes_of(p)).otherwise(p)), "")
    return F.when(query.rlike(rf"(?:^|&){name}="), decoded)
