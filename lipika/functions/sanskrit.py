"""Transliteration and folding. Spark has no compatibility decomposition, so these run as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from lipika.functions import fixed
from lipika.functions.text import meta_line

_UNITS = re.compile(f"([{''.join(fixed.CONSONANTS)}])([{fixed.VIRAMA}{''.join(fixed.VOWEL_SIGNS)}{''.join(fixed.SIGNS)}])?|[ऀ-ॿ]")
_PLAIN = fixed.VOWELS | fixed.VOWEL_SIGNS | fixed.SIGNS | {fixed.VIRAMA: ""}
_FOLD_IAST = str.maketrans(fixed.IAST_LETTERS, fixed.ASCII_LETTERS)
_TOKEN = re.compile(r"\w+")
# non-spacing marks; those beyond the first plane apart, as a character class of them alone is searched one by one
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) == "Mn") + "]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def to_iast(text: str | None) -> str:
    """Devanagari to IAST; a consonant without vowel sign or virama carries `a`. '' for null."""

    def unit(m: re.Match[str]) -> str:
        if not m[1]:
            return _PLAIN.get(m[0], m[0])
        sign = m[2] or ""
        vowel = "" if sign == fixed.VIRAMA else fixed.VOWEL_SIGNS.get(sign) or "a" + fixed.SIGNS.get(sign, "")
        return fixed.CONSONANTS[m[1]] + vowel

    return _UNITS.sub(unit, text or "")


def to_ascii(text: str | None) -> str:
    """IAST to ASCII letters, further combining marks dropped. '' for null."""
    return "".join(c for c in unicodedata.normalize("NFKD", (text or "").translate(_FOLD_IAST)) if not unicodedata.combining(c))


def fold(text: str | None) -> str:
    """Compatibility decomposition without non-spacing marks, case-folded. '' for null.

    Devanagari vowel signs that are non-spacing marks go as well; that is the index's definition."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    plain = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if _BEYOND.search(plain):
        plain = _BEYOND.sub(lambda m: "" if unicodedata.category(m[0]) == "Mn" else m[0], plain)
    return plain.casefold()


def tokenize(text: str | None) -> list[str]:
    """Word characters of the folded text."""
    return _TOKEN.findall(fold(text))


def spellings(text: str) -> list[str]:
    """The text and its transliterations, without blanks and repeats, in order."""
    if any("ऀ" <= c <= "ॿ" for c in text):
        found = [text, to_iast(text), to_ascii(to_iast(text))]
    else:
        respelt = text
        for a, b in fixed.PHONETIC:
            respelt = respelt.replace(a, b)
        found = [text, to_ascii(text), respelt, to_ascii(respelt)]
    return list(dict.fromkeys(x.strip() for x in found if x.strip()))


def expand_query(query: str) -> list[str]:
    """Ordered variants of a query: itself, its spellings, itself with equivalents, tokens with equivalents."""
    base = query.strip()
    tokens, extra = tokenize(base), []
    for t in tokens:
        extra += fixed.EXPANSIONS.get(t, [])
        for s in spellings(t):
            if s != t:
                extra.append(s)
            extra += [e for e in fixed.EXPANSIONS.get(s, []) if e not in extra]
    found = [base, *spellings(base)]
    if extra:
        found += [f"{base} {' '.join(dict.fromkeys(extra))}", " ".join(dict.fromkeys(tokens + extra))]
    return list({v.strip().lower(): v.strip() for v in reversed(found) if v.strip()}.values())[::-1]


def _mapped(function, kind):
    @F.pandas_udf(kind)
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([function(t) for t in s], dtype=object)

    return column


def fold_col(c: Column) -> Column:
    """Column form of `fold`."""
    return _mapped(fold, StringType())(c)


def iast_col(c: Column) -> Column:
    """Column form of `to_iast`."""
    return _mapped(to_iast, StringType())(c)


def ascii_col(c: Column) -> Column:
    """Column form of `to_ascii`."""
    return _mapped(to_ascii, StringType())(c)


def _split(joined: Column) -> Column:
    """Tokens of a space-joined string: strings cross from Python much faster than arrays of them."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def tokens_col(c: Column) -> Column:
    """Column form of `tokenize`."""
    return _split(_mapped(lambda t: " ".join(tokenize(t)), StringType())(c))


def spellings_col(c: Column) -> Column:
    """Column form of `spellings`; null gives an empty array."""
    return _mapped(lambda t: spellings(t or ""), ArrayType(StringType()))(c)


def chunk_tokens(meta: str | None, text: str | None) -> list[str]:
    """Tokens of a chunk: its metadata line, that in ASCII, its text; so metadata counts twice."""
    return tokenize(f"{meta}\n{to_ascii(meta)}\n{text or ''}" if meta else text)


def chunk_tokens_col(title: Column, work: Column, locator: Column, heading: Column, text: Column) -> Column:
    """Column form of `chunk_tokens`."""

    @F.pandas_udf(StringType())
    def column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for meta, body in batches:
            yield pd.Series([" ".join(chunk_tokens(m, t)) for m, t in zip(meta, body, strict=True)], dtype=object)

    return _split(column(meta_line(title, work, locator, heading), text))
