"""Problem 6: missing or wrong document language labels.

Method: rank-order profiles. Each language has a list of its most frequent letter n-grams; a stretch of text gets the
language whose ranks are nearest to its own by out-of-place distance. Profiles are learnt here from a bounded sample
of labelled documents, cleaned once of documents that its own first profiles assign to another language.

Lines get a first language from the distances of their words (each distinct word is measured once), neighbouring
lines of one language join to a stretch, and every stretch is measured as a whole. The
headword of a glossary line is a stretch of its own. A language written in two scripts has two profiles.

Blank and null texts have no segments. A label names the code before its first `-` or `_`. Texts are read in
canonical form, so look-alike letters and invisible characters don't disturb.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lipika.llm.canonical import canonical_text
from lipika.llm.labels import hash_sample, language_code

#: Bound of the training sample, in documents and in code points of one document.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 2500, 20_000
#: N-grams of a profile, longest n-gram, share of a label's documents a script needs to have a profile.
PROFILE, LONGEST, SCRIPT_SHARE = 400, 3, 0.12
#: A second script's documents this near (as a ratio) to another language's profile are wrongly labelled.
ALIKE = 1.2
WORD_CACHE = 200_000
FOUND_SHARE = 0.20

_HEADWORD = re.compile(r"^(\s*[^\s—–][^—–;.]*?) [—–] (?=[^;]*; )")
_EDGE = re.compile(r"^[^\wऀ-෿]+|[^\wऀ-෿]+$")
_INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2070), 0xFEFF])


def script(word: str) -> str:
    """Block of the first letter: enough to keep a language's scripts apart."""
    for c in word:
        if c.isalpha():
            return "latin" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else f"{ord(c) >> 7:x}"
    return ""


def grams(word: str) -> list[str]:
    """N-grams up to LONGEST of the word between boundary marks."""
    w = f"_{word}_"
    n = len(w)
    return [w[i : i + k] for k in range(1, LONGEST + 1) for i in range(n - k + 1) if w[i : i + k] != "_"]


def clean(token: str) -> str:
    """A token without edge punctuation; empty if it holds a digit or no letter."""
    w = _EDGE.sub("", token)
    return w if w and not any(c.isdigit() for c in w) and any(c.isalpha() for c in w) else ""


_LIVE: dict[str, Profiles] = {}


class Profiles:
    """Ranks of n-grams per (language, script)."""

    def __init__(self, counts: dict[tuple[str, str], Counter[str]]) -> None:
        self.names = sorted(counts)
        self.languages = [n for n, _ in self.names]
        tops = {k: [g for g, _ in sorted(counts[k].items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for k in self.names}
        self.ids = {g: i for i, g in enumerate(sorted({g for t in tops.values() for g in t}))}
        self.ranks = np.full((len(self.names), len(self.ids) + 1), PROFILE, dtype=np.float32)
        for row, k in enumerate(self.names):
            for r, g in enumerate(tops[k]):
                self.ranks[row, self.ids[g]] = r
        self.key = blake2b(repr((self.names, sorted(tops.items()))).encode(), digest_size=16).hexdigest()
        self._reset()

    def live(self) -> "Profiles":
        """This object, or the one of the same profiles a reused worker has measured words with."""
        if self.key not in _LIVE:
            _LIVE.clear()
            _LIVE[self.key] = self
        return _LIVE[self.key]

    def _reset(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.grams: list[np.ndarray] = [np.zeros(0, dtype=np.int32)]
        self.far = np.zeros((4096, len(self.names)), dtype=np.float32)
        self.size = np.zeros(4096, dtype=np.float32)

    def word(self, token: str) -> int:
        """Index of a token, measured on first sight."""
        if (i := self.words.get(token)) is not None:
            return i
        w = clean(token)
        if not w:
            self.words[token] = 0
            return 0
        i = len(self.grams)
        if i >= len(self.far):
            self.far = np.vstack([self.far, np.zeros_like(self.far)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        ids = np.array([self.ids.get(g, len(self.ids)) for g in grams(w)], dtype=np.int32)
        self.far[i] = self.ranks[:, ids].sum(axis=1)
        self.size[i] = len(ids)
        self.grams.append(ids[ids < len(self.ids)])
        self.words[token] = i
        return i

    def distance(self, words: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a stretch to each profile, as a share of the greatest possible."""
        distinct, counts = np.unique(words, return_counts=True)
        parts = [self.grams[i] for i in distinct]
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        if not len(ids):
            return np.ones(len(self.names), dtype=np.float32)
        totals = np.bincount(ids, weights=np.repeat(counts, [len(p) for p in parts]))
        present = np.flatnonzero(totals)
        order = present[np.lexsort((present, -totals[present]))][:PROFILE]
        return np.abs(self.ranks[:, order] - np.arange(len(order), dtype=np.float32)).sum(axis=1) / (PROFILE * len(order))

    def nearest(self, far: np.ndarray) -> tuple[str, float]:
        """Language of the smallest distance, and how clear it is of the next language."""
        order = np.argsort(far, kind="stable")
        best = self.languages[order[0]]
        other = next((far[i] for i in order if self.languages[i] != best), None)
        if other is None:
            return best, 1.0
        return best, float(max(0.0, min(1.0, (other - far[order[0]]) / max(float(other), 1e-6))))

    def segments(self, text: str) -> list[list]:
        """[first_line, last_line, language, confidence, characters] of a text's stretches."""
        if len(self.grams) > WORD_CACHE:
            self._reset()
        text = canonical_text(text).lower()
        spans, indices, sizes = [], [], []  # one entry per line, two for a glossary line
        known = self.words
        for no, line in enumerate(text.split("\n"), 1):
            parts = [line]
            if " — " in line or " – " in line:
                if m := _HEADWORD.match(line):
                    parts = [m[1], line[m.end(1) :]]
            for k, part in enumerate(parts):
                tokens = part.split()
                if tokens:
                    found = [known[t] if t in known else self.word(t) for t in tokens]
                    spans.append((no, len(parts) > 1 and k == 0))
                    indices.append(found)
                    sizes.append(sum(map(len, tokens)))
        if not spans:
            return []
        flat = np.fromiter((i for x in indices for i in x), dtype=np.int64)
        starts = np.cumsum([0, *map(len, indices[:-1])])
        far = np.add.reduceat(self.far[flat], starts, axis=0)
        weight = np.add.reduceat(self.size[flat], starts)
        best = np.argmin(far, axis=1)
        out: list[list] = []
        members: list[list[int]] = []
        for k, ((no, head), b, w) in enumerate(zip(spans, best.tolist(), weight.tolist(), strict=True)):
            language = self.languages[b] if w else None
            if out and not head and not out[-1][5] and (language is None or out[-1][2] in (language, None)):
                out[-1][1] = no
                out[-1][2] = out[-1][2] or language
                out[-1][4] += sizes[k]
                members[-1].append(k)
            else:
                out.append([no, no, language, 0.0, sizes[k], head])
                members.append([k])
        for row, ks in zip(out, members, strict=True):
            words = [i for k in ks for i in indices[k] if i]
            if words:
                row[2], row[3] = self.nearest(self.distance(np.array(words)))
        return [row[:5] for row in out]


def learn(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Profiles:
    """Profiles from about `sample` documents, chosen by hash of their id; the labelled among them count."""
    labelled = docs.select("doc_id", language_code(F.col("language")).alias("code"), "text").where(F.col("code").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = hash_sample(labelled, "doc_id", sample, docs.count()).select("code", "text").collect()
    bags = []
    for code, text in rows:
        by_script: dict[str, Counter[str]] = defaultdict(Counter)
        for token, n in Counter(canonical_text(text).lower().split()).items():
            if w := clean(token):
                by_script[script(w)][w] += n
        if by_script:
            main, words = max(by_script.items(), key=lambda x: sum(len(w) * n for w, n in x[1].items()))
            whole = sum(len(w) * n for b in by_script.values() for w, n in b.items())
            if sum(len(w) * n for w, n in words.items()) >= 0.85 * whole:
                bags.append((code, main, words))
    if not bags:
        return Profiles({("und", "latin"): Counter()})
    seen = Counter((c, s) for c, s, _ in bags)
    label = Counter(c for c, _, _ in bags)
    kept = {k for k, n in seen.items() if n >= max(2, SCRIPT_SHARE * label[k[0]])} or set(seen)
    kept = _own_scripts(bags, kept)
    profiles = _profiles(bags, kept)
    agreed = []
    for bag in bags:
        words = np.array([i for w, n in bag[2].items() for i in [profiles.word(w)] * min(n, 50)])
        if bag[:2] in kept and profiles.nearest(profiles.distance(words))[0] == bag[0]:
            agreed.append(bag)
    return _profiles(agreed or bags, kept)


def _own_scripts(bags: list[tuple[str, str, Counter[str]]], kept: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """`kept` without profiles that wrong labels made: those whose documents lie as near to another language's profile
    of that script, learnt without them, as that profile's own documents do."""
    sizes = Counter(b[:2] for b in bags)
    main = {max((k for k in kept if k[0] == code), key=lambda k: sizes[k]) for code, _ in kept}
    for key in sorted(kept - main, key=lambda k: sizes[k]):
        others = {k for k in kept if k[1] == key[1] and k[0] != key[0] and sizes[k] > sizes[key]}
        if not others:
            continue
        profiles = _profiles(bags, others)
        near: dict[tuple[str, str], list[float]] = defaultdict(list)
        for bag in bags:
            if bag[:2] in others or bag[:2] == key:
                words = np.array([i for w, n in bag[2].items() for i in [profiles.word(w)] * min(n, 50)])
                far = profiles.distance(words)
                near[bag[:2]].append(float(far.min() if bag[:2] == key else far[profiles.names.index(bag[:2])]))
        typical = float(np.median([np.median(near[k]) for k in others]))
        if float(np.median(near[key])) <= ALIKE * typical:
            kept = kept - {key}
    return kept


def _profiles(bags: list[tuple[str, str, Counter[str]]], kept: set[tuple[str, str]]) -> Profiles:
    counts: dict[tuple[str, str], Counter[str]] = {k: Counter() for k in kept}
    totals: dict[tuple[str, str], Counter[str]] = {k: Counter() for k in kept}
    for code, main, words in bags:
        if (code, main) in kept:
            totals[code, main].update(words)
    for k, words in totals.items():
        for w, n in words.items():
            for g in grams(w):
                counts[k][g] += n
    return Profiles(counts)


def segments(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, label, segment_no, first_line, last_line, language, confidence, characters) of every document."""
    rows = docs.select("doc_id", language_code(F.col("language")).alias("label"), "text")
    fields = [("doc_id", pa.int64()), ("label", pa.string()), ("segment_no", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("characters", pa.int64())]
    schema = pa.schema(fields)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = profiles.live()
        for b in batches:
            out = []
            for doc, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text:
                    out += [(doc, label, k, *row) for k, row in enumerate(known.segments(text))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(assign, "doc_id bigint, label string, segment_no int, first_line int, last_line int, language string, confidence double, characters bigint")


def by_language(parts: DataFrame) -> DataFrame:
    """(doc_id, label, language, characters, share, confidence): shares are of the characters in any language."""
    sums = parts.where("language is not null").groupBy("doc_id", "label", "language").agg(F.sum("characters").alias("characters"), (F.sum(F.col("confidence") * F.col("characters")) / F.sum("characters")).alias("confidence"))
    entry = F.struct("language", "characters", "confidence")
    docs = sums.groupBy("doc_id", "label").agg(F.sum("characters").alias("all"), F.collect_list(entry).alias("parts"))  # at most one entry per language
    return docs.select("doc_id", "label", "all", F.explode("parts").alias("p")).select("doc_id", "label", "p.language", "p.characters", (F.col("p.characters") / F.col("all")).alias("share"), "p.confidence")


def documents(parts: DataFrame) -> DataFrame:
    """(doc_id, label, language, share, confidence): the language of most characters of each document."""
    best = F.struct("characters", F.col("language"), "share", "confidence")
    rows = by_language(parts).groupBy("doc_id", "label").agg(F.max(best).alias("b"))
    return rows.select("doc_id", "label", "b.language", "b.share", "b.confidence")


def unnamed(parts: DataFrame, least: float = FOUND_SHARE) -> DataFrame:
    """(doc_id, language) of the languages with at least `least` of a document that its label doesn't name."""
    rows = by_language(parts)
    return rows.where((F.col("share") >= least) & ~F.col("language").eqNullSafe(F.col("label"))).select("doc_id", "language").distinct()
