"""Problem 3: one form for texts that look the same.

Method: normalization quick-check properties find the unstable segments of a text; each is extended to
its boundary context (the preceding base character and all following marks), normalised, and spliced
back between the untouched stretches. Stable text, the vast majority, is never rebuilt.

Folded away are: canonical composition (NFC), width and font variants, letters of another script that have the
same shape, invisible characters and the kind of a space. Compatibility differences one can see
(superscripts, fractions, the long s) stay; ligatures of Latin letters are drawn as the letters and fold.

Letters of equal shape fold by the script of their word, which its other letters tell; a word of such letters only
goes with the script most words of the text show, if it can be written in it, else it is Latin. Joiners are seen where they change a shape: after
a virama, between Arabic letters and between pictures they stay; elsewhere they are invisible.

Null text has a null form; the empty text is its own form.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType

from lipika.session import cut_lineage

# Letters of other scripts that have the shape of a Latin letter. (Mathematical and full-width letters
# come from the Unicode data instead.)
LOOKALIKES = {
    "cyrillic": ("АВЕЅІЈКМНОРСТУХԌԚԜасеѕіјорухһԁԛԝӏ", "ABESIJKMHOPCTYXGQWacesijopyxhdqwl"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj"),
    "armenian": ("ՕՍՏհոսցօզ", "OUShnugoq"),
    "cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRWSVLCPKB"),
}
# The blocks of these scripts.
BLOCKS = {"cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽἀ-῿", "armenian": "Ա-֏", "cherokee": "Ꭰ-ᏽꭰ-ꮿ"}
# Code points that leave no mark, as inclusive ranges.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE01EF))
# Hyphens drawn like the ASCII one.
HYPHENS = "‐‑"
# Ligatures of Latin letters, drawn as the letters are.
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"


def _ranges(points: list[int]) -> str:
    """A regular-expression class body for the sorted code points."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str | None], re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    """(what a code point folds to; patterns of code points of the first plane that may change, of unstable segments in the
    first plane, and in all). A class that reaches beyond the first plane is searched much more slowly."""
    fold: dict[int, str | None] = {p: None for a, b in INVISIBLE for p in range(a, b + 1)}
    fold |= dict.fromkeys(map(ord, HYPHENS), "-")
    fold |= {ord(c): "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split()[1:]) for c in LIGATURES}
    unstable, marks = set(fold), []
    for p in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= p <= 0xD7A3 or 0xD800 <= p <= 0xDFFF or 0x3400 <= p <= 0x9FFF or 0x20000 <= p < 0xE0000 and not 0x2F800 <= p < 0x2FA20:
            continue
        c = chr(p)
        category = unicodedata.category(c)
        if category in ("Cn", "Co"):
            continue
        if category == "Zs":
            fold[p] = " "
            unstable.add(p)
        parts = unicodedata.decomposition(c)
        if parts.startswith(("<wide>", "<narrow>", "<font>")):
            fold[p] = unicodedata.normalize("NFKC", c)
            unstable.add(p)
        elif parts and parts[0] != "<":
            if not unicodedata.is_normalized("NFC", c):
                unstable.add(p)  # quick check: no
            elif len(pair := parts.split()) == 2:
                unstable.add(int(pair[1], 16))  # quick check: maybe
            if any(int(x, 16) in fold for x in parts.split()):
                unstable.add(p)  # its base folds
        if unicodedata.combining(c):
            marks.append(p)
    unstable |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals
    folding = sorted({p for p in unstable if unicodedata.is_normalized("NFC", chr(p)) and unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(p)).translate(fold)) != chr(p)} | set(fold))

    def segments(last: int) -> re.Pattern[str]:
        u, m = (_ranges(sorted(p for p in points if p <= last)) for points in (unstable, marks))
        return re.compile(f"[^{u}\\n]?[{u}][{u}{m}]*|[^\\n][{m}]{{2,}}")

    return fold, re.compile(f"[{_ranges([p for p in folding if p < 0x10000])}\u200c\u200d{''.join(BLOCKS.values())}]"), segments(0xFFFF), segments(sys.maxunicode)


@lru_cache(maxsize=1)
def _joiners() -> re.Pattern[str]:
    """Joiners and non-joiners that change no shape."""
    viramas = [p for p in range(0x900, 0x1B00) if unicodedata.combining(chr(p)) == 9] + [p for p in range(0xA800, 0xAC00) if unicodedata.combining(chr(p)) == 9]
    arabic, pictures = "\u0620-\u074f\u0750-\u077f\u08a0-\u08c9", "\u2190-\u2bff\U0001f000-\U0001faff"
    seen = f"(?<=[{_ranges(viramas)}])\u200d|(?<=[{_ranges(viramas)}])\u200c|(?<=[{arabic}])[\u200c\u200d](?=[{arabic}])|(?<=[{pictures}])\u200d(?=[{pictures}])"
    return re.compile(f"({seen})|[\u200c\u200d]")


_LATIN = {ord(a): b for letters, latin in LOOKALIKES.values() for a, b in zip(letters, latin, strict=True)}
#: From Latin back to each script, the first letter of a shape.
_BACK = {script: {b: a for a, b in reversed(list(zip(letters, latin, strict=True)))} for script, (letters, latin) in LOOKALIKES.items()}
_OTHER = re.compile(f"[{''.join(BLOCKS.values())}]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_OWN = {script: re.compile(f"(?![{LOOKALIKES[script][0]}])[{block}]") for script, block in BLOCKS.items()}
_WORD = re.compile(f"(?:[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ{''.join(BLOCKS.values())}][\u0300-\u036f\u0483-\u0487]*)+")


def _letters(word: str) -> str:
    """Letters of a word without marks, those of equal shape as Latin ones."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if c.isalpha()).translate(_LATIN)


def _fold_letters(text: str) -> str:
    """Letters of equal shape in the script of their word; only looks decide, so equal looks end equal."""
    scripts: list[str] = []

    def main() -> str:
        if not scripts:
            votes = dict.fromkeys((*BLOCKS, "latin"), 0)
            for m in _WORD.finditer(text):
                plain = _letters(m[0])
                own = [s for s in BLOCKS if _OWN[s].search(plain)]
                if len(own) == 1:
                    votes[own[0]] += 1
                elif not own and not any(set(plain) <= _BACK[s].keys() for s in BLOCKS):
                    votes["latin"] += 1
            best = max(BLOCKS, key=lambda s: votes[s])
            scripts.append(best if votes[best] > votes["latin"] else "latin")
        return scripts[0]

    def word(m: re.Match[str]) -> str:
        plain = _letters(m[0])
        own = [s for s in BLOCKS if _OWN[s].search(plain)]
        script = "latin"
        if len(own) == 1 and all(c in _BACK[own[0]] or _OTHER.match(c) for c in plain):
            script = own[0]
        elif not own and any(set(plain) <= back.keys() for back in _BACK.values()) and (said := main()) != "latin" and set(plain) <= _BACK[said].keys():
            script = said
        parts = unicodedata.normalize("NFD", m[0]).translate(_LATIN)
        if script != "latin":
            parts = "".join(_BACK[script].get(c, c) for c in parts)
        return unicodedata.normalize("NFC", parts)

    return _WORD.sub(word, text)


def canonical_text(text: str | None) -> str | None:
    """The one form of `text`."""
    if text is None or text.isascii():
        return text
    fold, changing, segments, everywhere = _tables()
    may_change = changing.search(text)
    if _BEYOND.search(text):
        may_change, segments = True, everywhere
    if not may_change and unicodedata.is_normalized("NFC", text):
        return text
    text = segments.sub(lambda s: unicodedata.normalize("NFC", unicodedata.normalize("NFD", s[0]).translate(fold)), text)
    if may_change and ("\u200c" in text or "\u200d" in text):
        text = segments.sub(lambda s: unicodedata.normalize("NFC", s[0]), _joiners().sub(lambda m: m[1] or "", text))
    return _fold_letters(text) if may_change and _OTHER.search(text) else text


@F.pandas_udf(StringType())
def canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of `canonical_text`."""
    for s in texts:
        yield pd.Series([canonical_text(t) for t in s], dtype=object)


@F.pandas_udf(BinaryType())
def _digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from hashlib import blake2b

    for s in texts:
        yield pd.Series([None if t is None else blake2b(canonical_text(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in s], dtype=object)


def look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per distinct id: `item`, `class` (digest of the canonical text) and `variant` (digest of the stored text).

    Rows without text have no class and are left out; of several rows under one id each distinct variant counts once."""
    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), _digest(F.col(text_col)).alias("class"), F.unhex(F.md5(F.col(text_col))).alias("variant")
    )


def look_groups(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of `look_classes`, variants of the classes that hold two or more).

    A variant has `representative` (its smallest id) and `copies`; copies of one text are counted before the exchange."""
    rows = cut_lineage(look_classes(df, id_col, text_col).distinct())  # read by every later step
    variants = rows.groupBy("class", "variant").agg(F.min("item").alias("representative"), F.count("*").alias("copies"))
    mixed = variants.groupBy("class").agg(F.count("*").alias("variants"), F.sum("copies").alias("members"), F.min("representative").alias("first")).where("variants > 1")
    return rows, variants.join(mixed, "class")


def look_members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id and text of every class with several texts: (item, class, representative, first, variants, members, links).

    `representative` is the smallest id with the same text, `first` the smallest of the class, `links` the number of
    rows with another text of the same look. Linear in the rows, whatever the size of a class."""
    rows, variants = look_groups(df, id_col, text_col)
    found = rows.join(variants, ["class", "variant"])
    return found.select("item", F.lower(F.hex("class")).alias("class"), "representative", "first", "variants", "members", (F.col("members") - F.col("copies")).alias("links"))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (item_a < item_b) whose texts are different strings of one canonical form.

    Every row meets the representative of each other text of its class, so no link between two texts is lost and copies
    are not expanded: rows times other texts, not rows times rows. Only digests travel. Ids repeat once."""
    rows, variants = look_groups(df, id_col, text_col)
    other = variants.select("class", F.col("variant").alias("other_variant"), "representative")
    pairs = rows.join(other, "class").where("variant <> other_variant and item <> representative")
    return pairs.select(F.least("item", "representative").alias("item_a"), F.greatest("item", "representative").alias("item_b")).distinct()


def canonical_column(df: DataFrame, text_col: str, out: str = "canonical_text") -> DataFrame:
    """`df` with the canonical form of one column beside it; other columns are passed through."""
    return df.withColumn(out, canonical(F.col(text_col)))


def changed(text: Column, form: Column) -> Column:
    """Whether a text was not yet in its form; null texts are unchanged."""
    return F.coalesce(text != form, F.lit(False))
