"""Line parsers: the text of a scripture into verse units.

A text is read once, line by line, by a small machine whose events are: a header (changes book, hymn or heading), a
numbered line (opens a verse), a blank line, other text. The dialects differ in which of these exist."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lipika.functions import fixed, refs

UNIT = StructType([StructField(n, StringType() if n in ("work", "text", "heading", "verse_id", "locator") else IntegerType()) for n in ("work", "book", "hymn", "verse", "passage", "text", "heading", "verse_id", "locator")])

# What headers, numbers and ends look like.
HYMN = re.compile(r"HYMN\s+(?:([IVXLCDM]+|\d+)\.(\d+)|([IVXLCDM]+|\d+)\.)\s*(?:[—–:-]\s*)?(.*)$", re.I)
CHAPTER = re.compile(r"CHAPTER\s+([IVXLCDM]+|\d+)\b(?:\s*[.—–:-]+\s*(.*))?", re.I)
ADHYAYA = re.compile(r"ADHYAYA\s+([IVXLCDM]+|\d+)\b(?:\s*[.—–:-]+\s*(.*))?", re.I)
CHAPTER_END = re.compile(r"HERE\s+END(?:ETH|S)\s+CHAPTER\s+([IVXLCDM]+|\d+)", re.I)
PADA = re.compile(r"(?:SAMADHI|SADHANA|VIBHUTI|KAIVALYA)\s+PADA\b", re.I)
STOP = re.compile(r"notes?\s+for\s+pipeline\b|\*\*\*\s*END OF (?:THE )?PROJECT GUTENBERG", re.I)
SKIP = re.compile(r"click|next hymn|previous hymn|home\b|index\b|sacred[- ]texts", re.I)
PAIR = re.compile(r"(\d{1,2})\.(\d{1,3})\s+(.*)$", re.S)
SUTRA = re.compile(r"(\d)\.(\d{1,3})\s+(.*)$")
NUMBER = re.compile(r"(\d{1,3})[.)]\s+(.*)$", re.S)
LOOSE = re.compile(r"(\d{1,3})([.)]?)\s+(.*)$")
MARK = re.compile(r"(?:॥|।।)\s*([0-9०-९]+)\s*(?:॥|।।)")

_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def number(token: str | None) -> int | None:
    """Positive integer in decimal or Roman numerals."""
    raw = (token or "").strip().upper().replace(" ", "")
    if raw.isdigit():
        return int(raw) or None
    if not raw or set(raw) - set(_ROMAN):
        return None
    values = [_ROMAN[c] for c in raw]
    # a value smaller than the greatest to its right is subtracted
    total, top = 0, 0
    for v in reversed(values):
        total += v if v >= top else -v
        top = max(top, v)
    return total if total > 0 else None


@dataclass
class Machine:
    """Collects units; `open` is the verse being read (None: prose), `lines` its text."""

    work: str
    book: int | None = None
    hymn: int | None = None
    heading: str | None = None
    open: int | None = None
    lines: list[str] = field(default_factory=list)
    units: list[dict] = field(default_factory=list)

    def unit(self, verse: int | None, text: str, passage: int | None = None) -> bool:
        """Add one unit; blank text or a missing book adds none."""
        text = text.strip()
        if not text or self.book is None:
            return False
        self.units.append({"work": self.work, "book": self.book, "hymn": self.hymn, "verse": verse, "passage": passage, "text": text, "heading": self.heading})
        return True

    def head(self, rest: str | None, strip: str = " —–-") -> None:
        """Take a header's title, if it has one."""
        self.heading = (rest or "").strip(strip).strip() or self.heading


def _lines(text: str) -> Iterator[str]:
    for line in re.split(r"\r\n|\r|\n", text):
        line = line.strip()
        if STOP.match(line):
            return
        yield line


def hymns(text: str, work: str, book: int | None, hymn: int | None) -> list[dict]:
    """Hymn headers, numbered verses with continuation lines, prose after a header. Book and hymn come from headers or arguments."""
    m, started = Machine(work, book, hymn), False

    def flush() -> None:
        if m.hymn is not None:
            m.unit(m.open, "\n".join(m.lines))
        m.open, m.lines = None, []

    for line in _lines(text):
        if not line or SKIP.match(line):
            continue
        if h := HYMN.match(line):
            flush()
            if h[2]:
                m.book, m.hymn = number(h[1]), number(h[2])
            else:
                m.hymn = number(h[3]) or m.hymn
            m.head(h[4], " —–-.")
            started = True
        elif m.book is not None and m.hymn is not None and (v := LOOSE.match(line)) and 1 <= int(v[1]) <= 200 and (v[2] or v[3][:1].isalpha() or v[3][:1] in "\"“‘"):
            flush()
            m.open, m.lines, started = int(v[1]), [v[3].strip()] if v[3].strip() else [], True
        elif m.open is not None or (started and m.book is not None and m.hymn is not None):
            m.lines.append(line)
    flush()
    return m.units


def _anchor(chapter: int | None, text: str) -> int | None:
    low = text.lower()
    return next((v for v, phrase in fixed.VERSE_PHRASES.get(chapter, ()) if phrase in low), None)


def chapters(text: str) -> list[dict]:
    """Chapters of blocks parted by blank lines: `c.v`, `n.`, or a known phrase gives the verse; else a counted passage,
    unless the chapter has numbered verses."""
    m = Machine("bhagavad-gita")
    passage, numbered, block = 0, False, []

    def flush() -> None:
        nonlocal passage, numbered, block
        body, block = "\n".join(block).strip(), []
        if not body or m.book is None:
            return
        if p := PAIR.match(body):
            chapter, m.book = m.book, int(p[1])
            m.unit(int(p[2]), p[3].strip() or body)
            m.book, numbered = chapter, True
        elif (n := NUMBER.match(body)) and 1 <= int(n[1]) <= 80:
            numbered = m.unit(int(n[1]), n[2].strip() or body) or numbered
        elif (verse := _anchor(m.book, body)) is not None or not numbered:
            passage += 1
            m.unit(verse, body, None if verse else passage)

    for line in _lines(text):
        if CHAPTER_END.search(line):
            flush()
            m.book = None
        elif h := CHAPTER.match(line):
            flush()
            m.book, passage, numbered = number(h[1]), 0, False
            m.head(h[2])
        elif not line:
            flush()
        elif p := PAIR.match(line):
            flush()
            m.book, block = int(p[1]), [line]
        elif m.book is not None:
            n = NUMBER.match(line)
            if n and (numbered or (1 <= int(n[1]) <= 80 and len(n[2]) > 8)):
                flush()
                block = []
            block.append(line)
    flush()
    return m.units


def sutras(text: str) -> list[dict]:
    """`p.n text` with continuation lines and part headings."""
    m = Machine("yoga-sutra")

    def flush() -> None:
        if m.open is not None:
            m.unit(m.open, "\n".join(m.lines))
        m.open, m.lines = None, []

    for line in _lines(text):
        if PADA.match(line):
            flush()
            m.heading = line.title()
        elif s := SUTRA.match(line):
            flush()
            m.book, m.open, m.lines = int(s[1]), int(s[2]), [s[3].strip()]
        elif line and m.open is not None:
            m.lines.append(line)
    flush()
    return m.units


def numbered(text: str, work: str, book: int | None, hymn: int | None = None, header: re.Pattern[str] | None = None, most: int = 400) -> list[dict]:
    """Blocks that begin with `n.` or `c.v`, under chapter headers where the work has them."""
    m, block = Machine(work, book, hymn), []

    def flush() -> None:
        nonlocal block
        body, block = "\n".join(block).strip(), []
        if p := PAIR.match(body):
            m.unit(int(p[2]), p[3].strip() or body)
        elif (n := NUMBER.match(body)) and 1 <= int(n[1]) <= most:
            m.unit(int(n[1]), n[2].strip() or body)

    for line in _lines(text):
        if header and (h := header.match(line)):
            flush()
            m.book = number(h[1]) or m.book
            m.head(h[2])
        elif not line:
            flush()
        elif PAIR.match(line) or ((n := NUMBER.match(line)) and 1 <= int(n[1]) <= most):
            flush()
            block = [line]
        elif m.book is not None:
            block.append(line)
    flush()
    return m.units


def marked_verses(text: str | None) -> tuple[str | None, list[tuple[int, str]]]:
    """(heading, [(number, text)]) of verses closed by `॥n॥`; a first line with a single danda is the heading."""
    body, heading = (text or "").strip(), None
    first, _, rest = body.partition("\n")
    if "।" in first and "॥" not in first and "।।" not in first:
        heading, body = re.sub(r"^[0-9०-९]+\s*", "", first.strip()).strip(" ।") or None, rest
    parts = MARK.split(body)
    return heading, [(n, t) for t, d in zip((p.strip() for p in parts[::2]), parts[1::2]) if t and (n := int(d))]


def document_units(work: str | None, book: int | None, hymn: int | None, ref: tuple[int | None, int | None], text: str | None) -> list[dict]:
    """Units of one document; none where no structure is known. `book` and `hymn` are the record's, `ref` the metadata's."""
    if not work or not (text or "").strip():
        return []
    if book is not None and work in ("rigveda", "atharvaveda", "yajurveda") and any("ऀ" <= c <= "ॿ" for c in text):
        heading, verses = marked_verses(text)
        if verses:
            return [{"work": work, "book": book, "hymn": hymn, "verse": n, "passage": None, "text": " ".join(t.split()), "heading": heading} for n, t in verses]
    if work in ("rigveda", "atharvaveda"):
        return hymns(text, work, *ref)
    if work == "yajurveda":
        return numbered(text, work, ref[0], header=ADHYAYA, most=500)
    if work == "samaveda":
        return numbered(text, work, *ref) if ref[0] is not None else []
    return {"bhagavad-gita": chapters, "yoga-sutra": sutras}.get(work, lambda _: [])(text)


def grouped(units: list[dict], size: int = 900, most: int = 2) -> list[list[dict]]:
    """Consecutive verses of one work, book and hymn, at most `most` together, within `size` code points (200 at least).

    A single unit is never split."""
    limit, groups, used = max(200, size), [], 0
    for u in units:
        last = groups[-1][-1] if groups else None
        follows = last and last["verse"] is not None and u["verse"] == last["verse"] + 1 and all(u[k] == last[k] for k in ("work", "book", "hymn"))
        if follows and len(groups[-1]) < max(1, most) and used + len(u["text"]) <= limit:
            groups[-1].append(u)
            used += len(u["text"])
        else:
            groups.append([u])
            used = len(u["text"])
    return groups


_RAW = StructType([f for f in UNIT.fields if f.name not in ("verse_id", "locator")])


def _parsed(docs: DataFrame, kind: ArrayType, finish: Callable, *carried: str) -> DataFrame:
    """(doc_id, carried, raw): units of every document as `finish` arranges them and the text."""
    work = F.coalesce(F.nullif("work", F.lit("")), refs.detect_work(F.col("title"), F.col("source_url"), F.col("tradition")))
    rows = docs.withColumn("work", work).withColumn("ref", refs.work_reference(F.col("work"), F.col("title"), F.col("source_url")))

    @F.pandas_udf(kind)
    def parsed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        def whole(x):
            return None if x is None or x != x else int(x)

        for columns in batches:
            yield pd.Series([finish(document_units(w, whole(b), whole(h), (whole(rb), whole(rh)), t), t) for w, b, h, rb, rh, t in zip(*columns, strict=True)], dtype=object)

    return rows.select("doc_id", *carried, parsed("work", F.col("book").cast("int"), F.col("hymn").cast("int"), F.col("ref.book"), F.col("ref.hymn"), "text").alias("raw"))


def _named(u):
    return F.struct(
        *(u[c].alias(c) for c in ("work", "book", "hymn", "verse", "passage", "text", "heading")),
        refs.verse_id(u["work"], u["book"], u["hymn"], u["verse"], u["passage"]).alias("verse_id"),
        refs.locator(u["work"], u["book"], u["hymn"], u["verse"], u["verse"]).alias("locator"),
    )


def parse_units(docs: DataFrame) -> DataFrame:
    """(doc_id, units): array of verse units with ids and locators for every document; empty where there is no structure."""
    return _parsed(docs, ArrayType(_RAW), lambda units, _: units).select("doc_id", F.transform("raw", _named).alias("units"))


def parse_groups(docs: DataFrame, size: int = 900, most: int = 2, otherwise: Callable[[str | None], list[str]] = lambda _: []) -> DataFrame:
    """(columns of `docs` but text, chunk_index, g): groups of units of the documents that have a structure; of the others
    the pieces that `otherwise` makes of the text, each a group of one unit without work. One pass over the texts."""
    blank = {f.name: None for f in _RAW.fields}

    def finish(units: list[dict], text: str | None) -> list[list[dict]]:
        return grouped(units, size, most) or [[blank | {"text": piece}] for piece in otherwise(text)]

    rows = _parsed(docs, ArrayType(ArrayType(_RAW)), finish, *(c for c in docs.columns if c not in ("doc_id", "text", "work", "book", "hymn")))
    rows = rows.select("*", F.posexplode("raw").alias("chunk_index", "g")).drop("raw")
    return rows.withColumn("g", F.transform("g", _named))
