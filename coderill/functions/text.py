"""Text functions as Column expressions: tokenizers, name cleaning, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_tokens(text: str | Column) -> Column:
    """Tokens of the lexical index: camel case is split, snake case stays one token, single characters are dropped."""
    spaced = F.regexp_replace(F.regexp_replace(_col(text), "([a-z])([A-Z])", "$1 $2"), "[^a-zA-Z0-9_]+", " ")
    return F.filter(F.split(F.lower(spaced), " +"), lambda t: F.length(t) > 1)


def vocabulary_tokens(text: str | Column) -> Column:
    """Tokens of the vocabulary: camel case, acronyms and snake case are all split; distinct, in order of appearance."""
    return F.array_distinct(_vocabulary_words(text))


def _vocabulary_words(text: str | Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(_col(text), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(split, r"[_\-./\\:@#\s]+", " ")), " +"), lambda t: F.length(t) > 1)


def spaced_words(text: str | Column) -> Column:
    """The words of the vocabulary as they occur, with blanks between them."""
    return F.array_join(_vocabulary_words(text), " ")


def singular(word: str | Column) -> Column:
    """Rule-based singular of an English noun in lower case."""
    w = F.lower(_col(word))
    n = F.length(w)
    less = lambda k: F.left(w, n - k)
    # Endings and the lengths from which they count.
    y, es, s = (n > 4) & w.endswith("ies"), w.rlike("(?:sh|ch|ss|x)es$"), (n > 2) & w.rlike("s$") & ~w.rlike("(?:s|i|u)s$")
    return F.when(y, F.concat(less(3), F.lit("y"))).when(es, less(2)).when(s, less(1)).otherwise(w)


def clean_symbol(text: str | Column) -> Column:
    """A symbol as asked for: without quotes, a leading article, brackets of a call and a trailing kind word."""
    c = F.regexp_replace(_col(text), "[\"'`?]", "")
    c = F.regexp_replace(F.trim(c), r"\(\)$", "")
    c = F.regexp_replace(c, "^(?i:the|a|an) ", "")
    return F.regexp_replace(c, "(?i: (function|method|class|module|file|symbol))$", "")


def djb2(text: str | Column) -> Column:
    """The djb2 hash with 32-bit wrap-around, as a non-negative long; null for null."""
    codes = F.filter(F.split(_col(text), ""), lambda c: c != "")
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return F.abs(F.aggregate(codes, F.lit(5381).cast("long"), lambda a, c: wrap(a * 33 + F.ascii(c))))


def redact(text: str | Column) -> Column:
    """Key material in an error or snippet replaced by a placeholder."""
    c = F.regexp_replace(_col(text), r"(?i)(bearer|basic|token) [A-Za-z0-9+/=._-]{12,}", "$1 [REDACTED_SECRET]")
    c = F.regexp_replace(c, r"([a-z]{2,6}_[a-z]*_?)[A-Za-z0-9]{20,}", "$1[REDACTED_SECRET]")
    return F.regexp_replace(c, r"AIza[A-Za-z0-9_-]{20,}", "[REDACTED_SECRET]")


def indent(line: str | Column) -> Column:
    """Leading blanks and tabs of a line, in characters."""
    c = _col(line)
    return F.length(c) - F.length(F.regexp_replace(c, r"^[ \t]+", ""))
