"""Text put together from hits and witnesses: prompts, reference blocks, cache keys; and what models answer, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lipika.functions import text as T

#: Order in which a verse's source text is taken.
SOURCE_ROLES = ("sa", "iast", "en")


def source_text(witnesses: Column) -> Column:
    """Text of the first witness with text, by role order; null if there is none."""

    def of(role: str) -> Column:
        found = F.filter(witnesses, lambda w: (w["role"] == role) & (T.strip(F.coalesce(w["text"], F.lit(""))) != ""))
        return F.get(found, F.lit(0))["text"]

    return F.coalesce(*(of(r) for r in SOURCE_ROLES))


def reference_block(witnesses: Column) -> Column:
    """`[role] text` lines of the witnesses that have text."""
    kept = F.filter(witnesses, lambda w: T.strip(F.coalesce(w["text"], F.lit(""))) != "")
    return F.array_join(F.transform(kept, lambda w: F.concat(F.lit("["), w["role"], F.lit("] "), w["text"])), "\n")


def prompt(question: Column, context: Column, preamble: str) -> Column:
    """struct(system, user): the question after its context; without context the question alone."""
    user = F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question))
    return F.struct(F.lit(preamble).alias("system"), user.alias("user"))


def meaning(text: Column, size: int = 700) -> Column:
    """White space collapsed, cut to `size`: the part of a meaning that goes into a picture's prompt."""
    return F.substring(T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{T.SPACE}+", " ")), 1, size)


def cache_key(verse_id: Column, language: Column, *parts: Column) -> Column:
    """File-safe name of a derived text: verse, language and a digest of what it was made from."""
    digest = F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 16)
    return F.concat_ws("-", T.safe_name(verse_id), language, digest)


def missing_from_cache(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Work still to do."""
    return wanted.join(cache.select(key), key, "left_anti")


def parse_words(answer: Column) -> Column:
    """array of words of an answer that holds `{"words": [...]}` somewhere, fenced or with text around; empty if it can't be read."""
    kind = "struct<words: array<struct<word: string, lemma: string, meaning: string>>>"
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    found = F.coalesce(F.from_json(answer, kind)["words"], F.from_json(inner, kind)["words"])
    return F.coalesce(found, F.array().cast("array<struct<word: string, lemma: string, meaning: string>>"))


def strict_marker(marker: Column) -> Column:
    """Whether an expected title is a hymn number or the name of one hymn, and so decides alone."""
    return F.coalesce(marker.rlike(r"(?iu)\b\d{1,2}\.\d{1,3}\b|n[aā]sad[iī]ya|नासदीय"), F.lit(False))


def strict_title_match(title: str, markers: list[str]) -> bool:
    """Whether a title has an expected marker; strict markers, where there are any, count alone."""
    import re

    markers = [m.strip() for m in markers if m and m.strip()]
    strict = [m for m in markers if re.search(r"\b\d{1,2}\.\d{1,3}\b|n[aā]sad[iī]ya|नासदीय", m, re.I)]

    def has(m: str) -> bool:
        if re.fullmatch(r"\d{1,2}\.\d{1,3}", m):
            return re.search(rf"(?<![\d.]){re.escape(m)}(?!\d)", title or "") is not None
        return m.lower() in (title or "").lower()

    return any(has(m) for m in strict or markers)


