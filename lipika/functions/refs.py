"""Works, verse ids, locators and references as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lipika.functions import fixed
from lipika.functions.text import strip


def _contains_any(c: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(n) for n in needles))


def detect_work(title: Column, url: Column, tradition: Column | None = None) -> Column:
    """Structural work named by title or address (or tradition), else null. The order of the tests matters."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    yoga = F.lower(F.coalesce(tradition, F.lit(""))) == "yoga" if tradition is not None else F.lit(False)
    return (
        F.when(blob.contains("atharva") | blob.rlike(r"\bav\s+\d{1,2}\.\d{1,3}\b"), "atharvaveda")
        .when(_contains_any(blob, "yajur", "vajasaneyi", "vajasneyi", "mādhyandina", "madhyandina") | blob.rlike(r"\bvs\s+\d{1,2}\b"), "yajurveda")
        .when(_contains_any(blob, "samaveda", "sama-veda", "sāmaveda", "hymns of the sama") | blob.rlike(r"\bsv\s+\d{1,2}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), "samaveda")
        .when(_contains_any(blob, "rigveda", "rig veda", "ṛgveda") | blob.rlike(r"\brv\s+\d{1,2}\.\d{1,3}\b") | blob.rlike(r"rv\d{5}\.html?"), "rigveda")
        .when((blob.contains("yoga") & _contains_any(blob, "sutra", "sūtra", "patanjali", "patañjali")) | (yoga & blob.contains("sutra")), "yoga-sutra")
        .when(_contains_any(blob, "bhagavad", "song celestial") | blob.rlike(r"(?U)\bg[iī]t[aā]\b"), "bhagavad-gita")
    )


def _pair(blob: Column, pattern: str, names: tuple[str, str] = ("book", "hymn")) -> Column:
    found = [F.regexp_extract(blob, pattern, i).try_cast("int") for i in (1, 2)]
    return F.when(found[0].isNotNull(), F.struct(*(x.alias(n) for x, n in zip(found, names, strict=True))))


def work_reference(work: Column, title: Column, url: Column) -> Column:
    """struct(book, hymn) that title or address gives for a document of `work`; null where there is none."""
    t, u = F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))
    both = F.concat_ws(" ", t, u)
    rv = F.coalesce(_pair(t, r"(?i)\bRV\s+(\d{1,2})\.(\d{1,3})\b"), _pair(u, r"(?i)\bRV\s+(\d{1,2})\.(\d{1,3})\b"), _pair(u, r"(?i)rv(\d{2})(\d{3})\.html?"))
    vs = F.regexp_extract(both, r"(?i)\bVS\s+(\d{1,2})\b", 1).try_cast("int")
    sv = [F.regexp_extract(both, r"(?i)\bSV\s+(\d{1,2})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", i).try_cast("int") for i in (1, 2, 3, 4)]
    return (
        F.when(work == "rigveda", rv)
        .when(work == "atharvaveda", _pair(both, r"(?i)\bAV\s+(\d{1,2})\.(\d{1,3})\b"))
        .when((work == "yajurveda") & vs.isNotNull(), F.struct(vs.alias("book"), F.lit(None).cast("int").alias("hymn")))
        .when((work == "samaveda") & sv[0].isNotNull(), pack_samaveda(*sv))
    )


def portal_reference(url: Column) -> Column:
    """struct(book, hymn) that a portal address gives."""
    return F.coalesce(
        *(_pair(url, p) for p in (r"(?i)/m(\d{2})-(\d{3})/?$", r"(?i)mandala?-(\d+)-sukta-(\d+)", r"(?i)kanda-(\d+)-sukta-(\d+)")),
        *(F.when((n := F.regexp_extract(url, p, 1).try_cast("int")).isNotNull(), F.struct(n.alias("book"), F.lit(None).cast("int").alias("hymn"))) for p in (r"(?i)kanva-samhita-chapter-(\d+)", r"(?i)chapter-(\d+)/?$")),
    )


def pack_samaveda(part: Column, book: Column, chapter: Column, hymn: Column) -> Column:
    """struct(book, hymn) of a four-part reference."""
    return F.struct((part * 100 + book).cast("int").alias("book"), (chapter * 1000 + hymn).cast("int").alias("hymn"))


def unpack_samaveda(book: Column, hymn: Column) -> Column:
    """struct(part, book, chapter, hymn); null counts as 0."""
    b, h = F.coalesce(book, F.lit(0)), F.coalesce(hymn, F.lit(0))
    return F.struct(F.floor(b / 100).cast("int").alias("part"), (b % 100).alias("book"), F.floor(h / 1000).cast("int").alias("chapter"), (h % 1000).alias("hymn"))


def _prefix(work: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in fixed.WORK_PREFIX.items() for v in kv))
    return F.coalesce(F.element_at(table, work), F.substring(F.upper(work), 1, 2))


def _number(c: Column, null: str = "0") -> Column:
    return F.coalesce(c.cast("string"), F.lit(null))


def verse_id(work: Column, book: Column, hymn: Column, verse: Column, passage: Column | None = None) -> Column:
    """Canonical id: RV.b.h[.v], SV with four numbers, BG.b[.v or .pN], YS.b.v; a missing number is 0 (verse: left out)."""
    p, sv = _prefix(work), unpack_samaveda(book, hymn)
    v = verse.cast("string")
    extra = F.when(verse.isNull() & passage.isNotNull(), F.concat(F.lit("p"), passage.cast("string"))) if passage is not None else F.lit(None).cast("string")
    return (
        F.when(work.isin("rigveda", "atharvaveda"), F.concat_ws(".", p, _number(book), _number(hymn), v))
        .when(work == "samaveda", F.concat_ws(".", p, sv["part"], sv["book"], sv["chapter"], sv["hymn"], v))
        .when(work.isin("bhagavad-gita", "yajurveda"), F.concat_ws(".", p, _number(book), F.coalesce(v, extra)))
        .when(work == "yoga-sutra", F.concat_ws(".", p, _number(book), _number(verse)))
        .otherwise(p)
    )


def locator(work: Column, book: Column, hymn: Column, verse: Column, verse_end: Column) -> Column:
    """Display form, `RV 10.129.1–2`."""
    p, sv = _prefix(work), unpack_samaveda(book, hymn)
    b = _number(book, "None")
    base = F.when(work.isin("rigveda", "atharvaveda"), F.concat(p, F.lit(" "), b, F.lit("."), _number(hymn, "None"))).when(work == "samaveda", F.concat(p, F.lit(" "), F.concat_ws(".", sv["part"], sv["book"], sv["chapter"], sv["hymn"]))).when(work.isin("bhagavad-gita", "yajurveda", "yoga-sutra"), F.concat(p, F.lit(" "), b))
    tail = F.concat(F.lit("."), verse.cast("string"), F.when(verse_end != verse, F.concat(F.lit("–"), verse_end.cast("string"))).otherwise(""))
    return F.when(base.isNull(), p).when(verse.isNull(), base).otherwise(F.concat(base, F.coalesce(tail, F.concat(F.lit("."), verse.cast("string")))))


def parse_verse_id(c: Column) -> Column:
    """struct(work, prefix, book, hymn, verse), or null. `pN` counts as the number N, so BG.2.p3 reads as BG.2.3."""
    parts = F.split(strip(c), r"\.")
    prefix = F.upper(parts[0])
    work = F.element_at(F.create_map(*(F.lit(v) for k, p in fixed.WORK_PREFIX.items() for v in (p, k))), prefix)
    tokens = F.slice(parts, 2, 20)
    valid = (F.size(parts) >= 2) & F.forall(tokens, lambda t: t.rlike("^[pP]?[0-9]+$"))
    n = F.transform(tokens, lambda t: F.regexp_replace(t, "^[pP]", "").try_cast("int"))
    g = lambda i: F.get(n, F.lit(i))

    def made(book: Column, hymn: Column, verse: Column) -> Column:
        return F.struct(work.alias("work"), prefix.alias("prefix"), book.cast("int").alias("book"), hymn.cast("int").alias("hymn"), verse.cast("int").alias("verse"))

    packed = pack_samaveda(g(0), g(1), g(2), g(3))
    none = F.lit(None)
    return (
        F.when(~valid | work.isNull(), None)
        .when(work.isin("rigveda", "atharvaveda"), F.when(F.size(n) >= 2, made(g(0), g(1), g(2))))
        .when(work == "samaveda", F.when(F.size(n) >= 4, made(packed["book"], packed["hymn"], g(4))))
        .otherwise(made(g(0), none, g(1)))
    )


def hymn_in_blob(blob: Column, hymn: str) -> Column:
    """Whether `10.5` stands in the blob and not as part of 10.50 or 110.5."""
    import re

    return F.coalesce(blob.rlike(rf"(?<![\d.]){re.escape(hymn.strip())}(?!\d)"), F.lit(False)) if hymn.strip() else F.lit(False)


def witness_role(title: Column, language: Column) -> Column:
    """Edition class of a row: iast, sa, en, pt, another code, or other."""
    t, code = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(language, F.lit("")))
    return (
        F.when(_contains_any(t, "vedaweb", "zürich", "zurich", "iso-15919"), "iast")
        .when(code == "sa", "sa").when(code.isin("en", "eng"), "en").when(code.startswith("pt"), "pt").when(code == "", "other").otherwise(code)
    )
