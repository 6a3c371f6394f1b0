"""Problem 1: splitting oversized items at natural boundaries.

Method: lexical-cohesion segmentation. The similarity of the word blocks on both sides of every verse, line and sentence
end, and of every word end in a window that has none of these, is computed by a sliding block; its valleys mark topic
boundaries. Within the window a piece may end in, the cut of the highest score is chosen: the depth of its valley plus
the weight of its kind. A depth is at most 2, so a verse always goes before others, while a deep valley at a sentence's
end goes before a line end without one. Where nothing can be cut, any code point is. The next piece starts `overlap` code
points earlier, moved to a boundary.

Each piece tells the verses it really holds: those whose printed number lies in it. Numbers are read in the styles
`[n]`, `n.`, `c.n` at a line's start and `॥n॥`, `॥c.n॥` (also //, ||, ।।) at a verse's end; digits of any script and
look-alike or invisible characters are understood. An item's style is the one with most hits.

Lengths are code points after trimming. Null, empty and short texts give no pieces; repeated rows are split alike
and kept once if wholly equal.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lipika.llm.canonical import canonical_text
from lipika.llm.labels import strip

DOCUMENT_LIMIT, CHUNK_LIMIT = 4000, 800
#: Share of the limit a piece must reach before it may end.
LEAST_FILL = 0.5
#: Words on either side of a possible cut that are compared.
BLOCK = 40

_END = r"(?:॥|।।|//|\|\|)"
_STYLES = tuple(
    re.compile(p)
    for p in (r"(?m)^[^\S\n]*\[(?:\d+\.)?(\d+)\](?=\s)", r"(?m)^[^\S\n]*(\d+)\.(?=\s)", r"(?m)^[^\S\n]*\d+\.(\d+)(?=\s)", rf"{_END}[^\S\n]*(?:\d+\.)?(\d+)[^\S\n]*{_END}")
)
_CUTS = re.compile(r"\n+|[^\S\n]+")
_SENTENCE = re.compile(r"(?:[^\W\d][.!?]|[.!?।॥]{2,}|[!?।॥]|[)\]”’\"'»][.])[\"'”’»)\]]*$")
_STOPS = frozenset(".!?।॥\"'”’»)]")
#: What the kind of a cut adds to the depth of its valley.
WEIGHTS = {"verse": 4.0, "line": 0.5, "sentence": 0.25, "word": 0.0}


def verse_marks(text: str) -> list[tuple[int, int, int]]:
    """(position of the verse's start, position of its number, number) of the printed verses, in text order.

    Positions refer to `text` as given; where canonical form changes lengths they are found line by line."""
    form = canonical_text(text)
    hits: list[tuple[re.Match[str], ...]] = [tuple(p.finditer(form)) for p in _STYLES]
    best = max(hits, key=len)
    if not best:
        return []
    at_end = best is hits[-1]
    where = _positions(text, form)
    marks, previous_end = [], 0
    for m in best:
        if at_end:
            start = previous_end
            while start < m.start() and form[start].isspace():
                start += 1
            previous_end = m.end()
        else:
            start = m.start()
        marks.append((where(start), where(m.start(1)), int(m[1])))
    return marks


def _positions(text: str, form: str):
    """Maps a position in the canonical form to one in the text; exact at line starts, else within the line."""
    if len(text) == len(form):
        return lambda i: i
    a, b = [0], [0]
    for x, y in zip(text.split("\n"), form.split("\n"), strict=True):
        a.append(a[-1] + len(x) + 1)
        b.append(b[-1] + len(y) + 1)

    def where(i: int) -> int:
        k = bisect_right(b, i) - 1
        return min(a[k] + (i - b[k]), len(text)) if k + 1 >= len(a) else min(a[k] + (i - b[k]), a[k + 1] - 1)

    return where


def _cohesion(words: list[tuple[int, str]], cuts: list[int]) -> dict[int, float]:
    """Cosine similarity of the blocks of BLOCK words before and after each cut, by sliding both blocks: their product and
    norms change with each word that enters or leaves."""
    left, right = defaultdict(int), defaultdict(int)
    for _, w in words[:BLOCK]:
        right[w] += 1
    dot, norm_left, norm_right = 0, 0, sum(c * c for c in right.values())
    out, i, n = {}, 0, len(words)
    for cut in cuts:
        while i < n and words[i][0] < cut:
            w = words[i][1]
            dot += right[w] - left[w] - 1
            norm_left += 2 * left[w] + 1
            norm_right -= 2 * right[w] - 1
            left[w] += 1
            right[w] -= 1
            if i >= BLOCK:
                w = words[i - BLOCK][1]
                dot -= right[w]
                norm_left -= 2 * left[w] - 1
                left[w] -= 1
            if i + BLOCK < n:
                w = words[i + BLOCK][1]
                dot += left[w]
                norm_right += 2 * right[w] + 1
                right[w] += 1
            i += 1
        out[cut] = dot / (norm_left * norm_right) ** 0.5 if norm_left and norm_right else 0.0
    return out


def _depths(score: dict[int, float]) -> dict[int, float]:
    """Depth of each cut's valley: how far the similarity climbs on both sides before it falls again."""
    keys = list(score)
    values = [score[k] for k in keys]
    n = len(values)
    rise_left, rise_right = values[:], values[:]
    for i in range(1, n):
        if values[i - 1] >= values[i]:
            rise_left[i] = rise_left[i - 1]
    for i in range(n - 2, -1, -1):
        if values[i + 1] >= values[i]:
            rise_right[i] = rise_right[i + 1]
    return {k: rise_left[i] + rise_right[i] - 2 * values[i] for i, k in enumerate(keys)}


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str, float, float]]:
    """(start, end, kind of the cut, depth of its valley, mean depth in its window) of the pieces of a text, each within
    the limit after trimming, together holding all of it. The last piece's kind is `end`."""
    first = len(text) - len(text.lstrip())
    last = len(text.rstrip())
    if last - first <= limit:
        return [(first, last, "end", 0.0, 0.0)] if last > first else []
    verse_starts = {s for s, _, _ in verse_marks(text) if s > first}
    kinds: dict[str, list[int]] = {"verse": sorted(verse_starts), "line": [], "sentence": [], "word": []}
    for m in _CUTS.finditer(text, first, last):
        if m.end() not in verse_starts:
            at = m.start()
            ends = text[at - 1] in _STOPS and _SENTENCE.search(text, max(first, at - 6), at)
            kinds["line" if text[at] == "\n" else "sentence" if ends else "word"].append(m.end())
    words = [(m.start(), m[0].lower()) for m in re.finditer(r"\S+", text)]
    kind_of = {c: k for k in ("verse", "line", "sentence") for c in kinds[k]}
    natural = sorted(kind_of)
    depth = _depths(_cohesion(words, natural))
    starts = [p for p, _ in words]

    def among(cuts: list[int], low: int, high: int) -> list[int]:
        return cuts[bisect_left(cuts, low) : bisect_right(cuts, high)]

    pieces, start = [], first
    while last - start > limit:
        low, high = start + max(overlap + 1, int(limit * LEAST_FILL)), start + limit
        valley = depth
        if not (found := among(natural, low, high)) and (found := among(kinds["word"], low, high)):
            valley = _depths(_cohesion(words[max(0, bisect_left(starts, found[0]) - BLOCK) : bisect_right(starts, found[-1]) + BLOCK], found))
        if found:
            end = max(found, key=lambda c: (valley[c] + WEIGHTS[kind_of.get(c, "word")], c))
            pieces.append((start, end, kind_of.get(end, "word"), valley[end], sum(valley[c] for c in found) / len(found)))
        else:
            end = high
            pieces.append((start, end, "none", 0.0, 0.0))
        begin = end
        if overlap:
            begin = floor = max(start + 1, end - overlap)
            for cuts in kinds.values():
                if found := among(cuts, floor, end - 1):
                    begin = found[0]
                    break
        start = begin
    pieces.append((start, last, "end", 0.0, 0.0))
    return pieces


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    return [(a, b) for a, b, *_ in cut_text(text, limit, overlap)]


_PIECES = "item_id string, piece_no int, start int, end int, piece string, verse int, verse_end int, verses array<int>, cut string, depth double, typical double"


def split_items(items: DataFrame, limit: int, overlap: int, id_col: str, text: str = "text") -> DataFrame:
    """(item_id, piece_no, start, end, piece, verse, verse_end, verses, cut, depth, typical) of every item longer than the
    limit.

    `start` and `end` are code points of the stored text; `verses` lists the numbers printed in the piece; `cut` is the
    kind of its end, `depth` the depth of the valley there and `typical` the mean depth in its window."""
    long = items.where(F.length(text) > limit).where(F.length(strip(F.col(text))) > limit)
    long = long.select(F.col(id_col).cast("string").alias("item_id"), F.col(text).alias("text"))
    # Python's time goes with the text, of which a task gets a fourth of a file split: more tasks than the bytes alone ask for
    parts = max(2 * items.sparkSession.sparkContext.defaultParallelism, 4 * long.rdd.getNumPartitions())
    long = long.repartition(parts, "item_id").distinct()
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip([x.split()[0] for x in _PIECES.split(", ")], kinds, strict=True)))

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                marks = verse_marks(body)
                for k, (i, j, *cut) in enumerate(cut_text(body, limit, overlap)):
                    held = [n for _, p, n in marks if i <= p < j]
                    rows.append((item, k, i, j, body[i:j], held[0] if held else None, held[-1] if held else None, held, *cut))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return long.mapInArrow(cut_all, _PIECES)


def cut_quality(pieces: DataFrame, *by: str) -> DataFrame:
    """(by, cut, pieces, depth, typical): how deep the valleys are at the cuts, beside the mean of their windows."""
    rows = pieces.where("cut <> 'end'").groupBy(*by, "cut")
    return rows.agg(F.count("*").alias("pieces"), F.round(F.avg("depth"), 4).alias("depth"), F.round(F.avg("typical"), 4).alias("typical"))
