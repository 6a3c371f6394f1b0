"""Problem 2: tokens under an existing tokenizer, by source, language and tradition.

Method: a piece of text is kept as a linked list of symbols with a priority queue of merges; what survives
is counted, weighted by how often the piece occurs and rolled up exactly. The queue's order is the
tokenizer's rule. For byte-pair merges it is the merge rank. For a greedy longest-prefix vocabulary it is
(start, longest first): a span may merge only if its first symbol still stands alone, and spans that start
inside a merged one are dead.

White space is Unicode's White_Space. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from lipika.llm.labels import language_code, plain_label, strip

#: Vocabularies travel with the task closure; the largest public one has about 50 000 entries.
MAX_VOCABULARY = 500_000
#: Words whose count is remembered by a Python worker before it starts over.
WORD_CACHE = 400_000
_ASCII_CONTROLS = re.compile("[\x1c-\x1f]")


def merge_symbols(symbols: list[str], ranks: dict[str, int]) -> list[str]:
    """Byte-pair merging of `symbols` by rank: linked list and priority queue, lowest rank first, leftmost on ties."""
    n = len(symbols)
    text, nxt, prv = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    queue: list[tuple[int, int, str, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := nxt[i]) >= 0 and (r := ranks.get(text[i] + text[j])) is not None:
            heapq.heappush(queue, (r, i, text[i], text[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = nxt[i]
        if j < 0 or text[i] != a or text[j] != b or prv[j] != i:
            continue  # one side has merged since
        text[i], text[j] = a + b, ""
        nxt[i] = nxt[j]
        nxt[j] = -1
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        offer(prv[i])
        offer(i)
    return [x for x in text if x] if n else []


class Pieces:
    """Greedy longest-prefix pieces: plain at a word's start, `##` after it; an unmatched code point is one token."""

    def __init__(self, pieces: Iterable[str]) -> None:
        pieces = {p for p in pieces if p}
        self.heads = {p for p in pieces if not p.startswith("##")}
        self.tails = {p[2:] for p in pieces if p.startswith("##") and len(p) > 2}
        self.longest = max(map(len, self.heads | self.tails), default=1)
        self.known: dict[str, int] = {}

    def symbols(self, word: str) -> list[str]:
        """The surviving symbols of one lower-case word."""
        n = len(word)
        queue = []
        for i in range(n):
            among = self.tails if i else self.heads
            for m in range(2, min(self.longest, n - i) + 1):
                if word[i : i + m] in among:
                    queue.append((i, -m))
        heapq.heapify(queue)
        nxt = list(range(1, n + 1))  # nxt[i]: where the symbol that starts at i ends
        alone = [True] * n
        while queue:
            i, m = heapq.heappop(queue)
            if alone[i] and nxt[i] == i + 1:
                nxt[i] = i - m
                alone[i + 1 : i - m] = [False] * (-m - 1)
        return [word[i : nxt[i]] for i in range(n) if alone[i]]

    def count_word(self, word: str) -> int:
        """Tokens of one lower-case word, remembered."""
        if (c := self.known.get(word)) is None:
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            c = self.known[word] = len(self.symbols(word))
        return c

    def words(self, text: str) -> list[str]:
        """Lower-case words of a text."""
        if _ASCII_CONTROLS.search(text):  # Python splits at these, Unicode's White_Space does not hold them
            return _split_white_space(text)
        return text.lower().split()

    def count(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        known, total = self.known, 0
        for w in self.words(text):
            total += known.get(w) or self.count_word(w)
        return total

    def count_weighted(self, words: Counter[str]) -> int:
        """Tokens of a bag of words."""
        return sum(self.count_word(w) * k for w, k in words.items())


def _split_white_space(text: str) -> list[str]:
    hidden = str.maketrans({c: 0xF0000 + c for c in range(0x1C, 0x20)})
    shown = {0xF0000 + c: c for c in range(0x1C, 0x20)}
    return [w.translate(shown) for w in text.translate(hidden).lower().split()]


def load_pieces(spark: SparkSession, vocabulary: DataFrame) -> Pieces:
    """The vocabulary as a driver-side object; refuses one beyond MAX_VOCABULARY."""
    rows = vocabulary.select("piece").where("piece is not null").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary has more than {MAX_VOCABULARY} pieces")
    return Pieces(r[0] for r in rows)


def token_count(pieces: Pieces, text: Column) -> Column:
    """Tokens of a text column."""

    @F.pandas_udf(LongType())
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([pieces.count(t) for t in s], dtype="int64")

    return counted(text)


def slice_tokens(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """(source, language, tradition, documents, characters, tokens) totals over `docs`.

    Labels are brought to one spelling first: language codes lower-case without region, `und` where none is named;
    `unknown` for a missing source or tradition. Each batch counts a slice's words once, weights them by frequency
    and emits one partial row per slice, so the exchange holds labels and sums only."""
    rows = docs.select(
        F.coalesce(F.nullif(strip(F.col("source")), F.lit("")), F.lit("unknown")).alias("source"),
        F.coalesce(language_code(F.col("language")), F.lit("und")).alias("language"),
        plain_label(F.col("tradition"), "unknown").alias("tradition"),
        F.col(text).alias("text"),
    )
    schema = "source string, language string, tradition string, documents bigint, characters bigint, tokens bigint"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags: dict[tuple[str, str, str], list] = {}
            for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bag = bags.setdefault(tuple(key), [0, 0, Counter()])
                bag[0] += 1
                if text:
                    bag[1] += len(text)
                    bag[2].update(pieces.words(text))
            rows = [(*k, d, c, pieces.count_weighted(w)) for k, (d, c, w) in bags.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i in range(6)],
                    names=["source", "language", "tradition", "documents", "characters", "tokens"],
                )

    parts = rows.mapInArrow(partial, schema)
    return parts.groupBy("source", "language", "tradition").agg(*(F.sum(c).alias(c) for c in ("documents", "characters", "tokens")))
