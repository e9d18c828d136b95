"""Text to terms: the same rule as a column expression and as a Python function."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word is, and where a word in camel case is cut.
WORD = r"(\p{IsAlphabetic}+|\p{N}+)"
HUMP = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})"

_WORD, _HUMP = regex.compile(r"\p{Alphabetic}+|\p{N}+"), regex.compile(r"(?<=\p{Lowercase})(?=\p{Uppercase})", regex.V1)


_MARK = "\x01"


def tokens(text: Column) -> Column:
    """The terms of a text, in order: its runs of letters and its runs of digits in small letters; of a run in camel case
    the first part, the whole and the other parts. Null gives no terms.

    One pass marks where camel case is cut, so that words are looked at one by one only in texts that have any.
    """
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARK, " "), HUMP, _MARK)
    words = lambda t: F.regexp_extract_all(t, F.lit(rf"((?:\p{{IsAlphabetic}}|{_MARK})+|\p{{N}}+)"), F.lit(1))
    whole = lambda p: F.concat(F.slice(p, 1, 1), F.array(F.array_join(p, "")), F.slice(p, 2, F.size(p) - 1))
    parts = lambda w: F.when(F.contains(w, F.lit(_MARK)), F.transform(F.array(F.split(w, _MARK)), whole)[0]).otherwise(F.array(w))
    cut = lambda t: F.when(F.contains(t, F.lit(_MARK)), F.flatten(F.transform(words(t), parts))).otherwise(words(t))
    return F.transform(F.transform(F.array(marked), cut)[0], F.lower)


def tokenize(text: str | None) -> list[str]:
    out: list[str] = []
    for word in _WORD.findall(text or ""):
        parts = _HUMP.split(word)
        out += [parts[0], word, *parts[1:]] if len(parts) > 1 else parts
    return [t.lower() for t in out]


def spelling_terms(text: str | None) -> list[str]:
    """The words of a spelling request: cut at white space, in small letters, nothing else taken off."""
    return (text or "").lower().split()


def valid_collection(name: Column) -> Column:
    """Whether a collection name has only letters, digits and hyphens."""
    return name.rlike(r"^[\p{IsAlphabetic}\p{N}-]*$")


def escaped(text: Column) -> Column:
    """Text on one line: line feeds, carriage returns and backslashes are written with a backslash."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescaped(text: Column) -> Column:
    """The text that `escaped` was given. Null if a backslash stands before anything else than n, r or a backslash."""
    cut = F.regexp_extract_all(text, F.lit(r"(?s)(\\.?|[^\\]+)"), F.lit(1))
    one = lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\\\", "\\").when(~p.startswith("\\"), p)
    parts = F.transform(cut, one)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
