"""Problem 7: noise in text from scanned pages.

Method: words are counted over all documents; skip-gram vectors are learnt for the frequent ones from the pairs they
form in all scans. A word of a scan that is not established is linked to its neighbours: established words a plausible
glyph edit away, whose vectors fit the words around. Count, letter sequence and context together must reach the evidence
a correction needs. A word with a scanner's sign inside and no such neighbour is reported, and left as it is. Then page
furniture goes, words broken at line ends are joined and the lines are reflowed into paragraphs.

Bounded models: the frequent words (FREQUENT) spare the exchange the words everybody knows; the VECTORS most frequent
have vectors, fitted by full-batch gradient of the skip-gram objective with negative sampling over their pairs with the
CONTEXTS most frequent, counted over all scans. Words without vector have no evidence from context. Everything else
(counts, candidate search, decisions) covers all data: rare words meet the counts in a join.

A word is established if it occurs outside scans at ESTABLISHED of its rate in scans or more (and twice): misreadings that
some clean source copied don't become words as the data grows.

A document is a scan if it has page lines, if at least SCAN_SHARE of its source's documents have, or, without source, if
it has broken words. Null and empty texts have no noise and come out as they are. Repeated rows are treated alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lipika.llm.labels import checked
from lipika.session import cut_lineage

SCAN_SHARE = 0.05
FREQUENT, VECTORS, CONTEXTS, DIMENSIONS, NEGATIVES, WINDOW = 20_000, 8_192, 1_024, 32, 5, 2
#: Share of its rate in scans at which a word must occur outside them, and the least number of occurrences there.
ESTABLISHED, LEAST = 0.02, 2
#: Evidence (natural logarithms) a correction needs; how much of the context's counts, and at most.
NEEDED, CONTEXT_WEIGHT, CONTEXT_MOST = 4.0, 0.5, 4.0
#: Pairs of a word at which its vector counts half.
HALF_PAIRS = 30

# What a scanner prints, and what stands on the page.
GLYPHS = (
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("c", "e"), ("e", "c"), ("1", "l"), ("1", "i"), ("l", "i"), ("0", "o"), ("5", "s"), ("6", "ö"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("!", "i"), ("!", "l"), ("|", "l"), ("b", "h"), ("h", "b"), ("q", "g"), ("g", "q"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ii", "u"), ("ii", "ü"), ("u", "n"), ("n", "u"), ("vv", "w"), ("ſ", "s"), ("ſ", "f"), ("f", "ſ"), ("li", "h"), ("h", "li"), ("tl", "d"),
)
HYPHENS = "-‐‑¬\xad"
_CLOSERS = tuple(".!?।॥:;")
_SCAN_SIGNS = re.compile(r"(?<=[^\W\d_])[\d!|]|[\d!|](?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|['’!|](?=[^\W_])|[-‐‑](?=[^\W\d_]))*[!|]?(?<!!)(?:!(?=[,;:]|\s+[a-zäöü]))?|[!|][^\W\d_]+")
_NUMBER_LINE = re.compile(r"^\s*[\[(<—–-]*\s*(?:(?:[Pp][\w!]{2}[ec]|PAGE|S\.|p\.)\s*)?(?:[\dOlI]{0,3}\d[\dOlI]{0,3}|m{0,2}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\s*[\])>—–-]*\s*$")
_HEAD_NUMBER = re.compile(r"^\s*\d{1,4}\s{2,}\S|\S\s{2,}\d{1,4}\s*$")


def page_lines(lines: list[str]) -> set[int]:
    """Positions of lines that are only a page number or a running header.

    A header bears a number set apart or stands next to a page number, and shows itself by capitals, by recurring, by
    standing with the number between blank lines, or by being too short to be a wrapped line of running text."""
    numbers = {i for i, x in enumerate(lines) if x and x.strip() and _NUMBER_LINE.match(x)}
    wide = _width(lines)
    apart = {i for i, x in enumerate(lines) if i not in numbers and "  " in x and len(x) <= wide and _HEAD_NUMBER.search(x)}
    capitals = {i for i, x in enumerate(lines) if x.isupper() and _is_capitals(x) and len(x) <= wide}
    if not numbers and not apart and not capitals:
        return set()
    name = lambda i: re.sub(r"[\d\W]+", " ", lines[i]).strip().lower()
    near = {j for i in numbers for j in (i - 1, i + 1) if 0 <= j < len(lines) and j not in numbers and 4 < len(lines[j].strip()) <= wide and lines[j].lstrip()[:1].isupper()}
    times = Counter(map(name, near | apart | capitals))
    inner = sorted(len(x) for x, y in zip(lines, lines[1:], strict=False) if x.strip() and y.strip())
    width = inner[len(inner) // 2] if inner else 0
    blank = lambda i: not 0 <= i < len(lines) or not lines[i].strip()
    found = set(numbers)
    for i in near | apart | capitals:
        if "|" in lines[i] or "<<" in lines[i]:
            continue
        if i in capitals:
            ok = i in near or i in apart or times[name(i)] > 1
        elif times[name(i)] > 1 or i in apart:
            ok = True
        else:
            alone = all(j in numbers or j == i for j in (i - 1, i + 1) if not blank(j)) and blank(i + 1 if i - 1 in numbers else i - 1) and blank(i - 2 if i - 1 in numbers else i + 2)
            after = "" if blank(i + 1) else lines[i + 1].split()[0]
            short = i - 1 in numbers and after != "" and i + 1 not in numbers and len(lines[i].rstrip()) + 1 + len(after) <= width
            ok = alone or short
        if ok:
            found.add(i)
    return found


def _width(lines: list[str]) -> int:
    """What a line printed across the page may measure: the width nine in ten running lines keep to, and a third more."""
    inner = sorted(len(x) for x, y in zip(lines, lines[1:], strict=False) if x.strip() and y.strip())
    return max(90, inner[len(inner) * 9 // 10] * 4 // 3) if inner else 90


def _is_capitals(line: str) -> bool:
    return sum(map(str.isalpha, line)) >= 6 and "|" not in line and "<<" not in line


def words_of(line: str) -> list[str]:
    """Words of a line, inner hyphens and misread signs kept."""
    return [m[0] for m in _TOKEN.finditer(line)]


def broken_words(lines: list[str], skip: set[int]) -> list[tuple[int, int, str, str]]:
    """(line, next line of running text, left part, right part) where a line ends in a hyphen.

    Lines in between that begin with a capital (a header, a note of the site) can't go on with a word and are passed over,
    if one follows that can before the next line that ends in a hyphen too."""
    out = []
    for i, line in enumerate(lines):
        text = line.rstrip()
        if i in skip or not text or text[-1] not in HYPHENS or len(text) < 2 or not text[-2].isalpha():
            continue
        left = re.search(r"[^\s]+$", text[:-1])[0].lstrip("“\"'(‘")
        first = target = None
        for j in range(i + 1, len(lines)):
            body = lines[j].strip()
            if not body or j in skip:
                continue
            first = j if first is None else first
            if not body[0].isupper():
                target = j
                break
            if body[-1] in HYPHENS:
                break
        target = first if target is None else target
        if target is not None and (right := re.match(r"\s*([^\W\d_]+(?:[-‐][^\W\d_]+)*)", lines[target])):
            out.append((i, target, left, right[1]))
    return out


_COUNTED = "source string, word string, n bigint, documents bigint, paged bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and source: each word with its count, and a row of (documents, documents with page lines)."""
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        bags: dict[str | None, Counter[str]] = defaultdict(Counter)
        documents, paged = Counter(), Counter()
        for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not text:
                continue
            lines = text.split("\n")
            skip = page_lines(lines)
            documents[source] += 1
            paged[source] += bool(skip)
            joins = broken_words(lines, skip)
            if not skip and not joins:
                bags[source].update(text.lower().split())
                continue
            ends, starts = {i for i, *_ in joins}, {j for _, j, *_ in joins}
            for i, line in enumerate(lines):
                if i not in skip:
                    found = line.lower().split()
                    bags[source].update(found[i in starts : len(found) - (i in ends)])
        rows = [(s, None, None, n, paged[s]) for s, n in documents.items()]
        for source, bag in bags.items():
            words: Counter[str] = Counter()
            for token, n in bag.items():
                for w in [token] if token.isalpha() else words_of(token):
                    if not w.isdigit():
                        words[w] += n
            rows += [(source, w, n, None, None) for w, n in words.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["source", "word", "n", "documents", "paged"])


def word_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, clean, scans, known) and (source): occurrences over all documents, outside scans and in them, combined per
    batch first, and whether that makes a word established; and the sources that hold scans. Documents without source
    count as scans."""
    rows = cut_lineage(docs.select("source", "text").mapInArrow(_counted, _COUNTED))
    sums = rows.where("word is null and source is not null").groupBy("source").agg(F.sum("documents").alias("documents"), F.sum("paged").alias("paged"))
    sources = cut_lineage(sums.where((F.col("paged") > 0) & (F.col("paged") >= F.col("documents") * SCAN_SHARE)).select("source"))
    words = rows.where("word is not null").join(sources.withColumn("scanned", F.lit(True)), "source", "left")
    scanned = F.col("scanned").isNotNull() | F.col("source").isNull()
    parts = F.sum(F.when(~scanned, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(scanned, F.col("n")).otherwise(0)).alias("scans")
    clean, scans = words.agg(*parts).first()
    often = F.col("clean") * (scans or 0) >= F.col("scans") * (ESTABLISHED * (clean or 0))
    return cut_lineage(words.groupBy("word").agg(*parts).withColumn("known", (F.col("clean") >= LEAST) & often)), sources


def sequence_counts(counts: DataFrame) -> dict[str, int]:
    """Established words holding each letter trigram, of the words in Latin letters, as only those have glyph edits;
    bounded by the alphabet."""
    w = F.concat(F.lit("_"), "word", F.lit("_"))
    grams = F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    rows = counts.where("known").where(F.col("word").rlike(r"^[a-z\x{df}-\x{17f}'’-]+$")).select(F.explode(F.array_distinct(grams)).alias("g")).groupBy("g").count()
    return {r[0]: r[1] for r in rows.collect()}


def skip_grams(pairs: np.ndarray, steps: int = 30, rate: float = 0.3, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors (words, contexts) with negative sampling, by full-batch gradient over a matrix of pair counts.

    Their products are near the pointwise information of word and context less log NEGATIVES."""
    met = (pairs / max(float(pairs.sum()), 1.0)).astype(np.float32)
    row, column = met.sum(axis=1), NEGATIVES * met.sum(axis=0)
    rng = np.random.default_rng(0)
    u = rng.normal(0, 0.1, (pairs.shape[0], DIMENSIONS)).astype(np.float32)
    v = rng.normal(0, 0.1, (pairs.shape[1], DIMENSIONS)).astype(np.float32)
    gu, gv = np.full_like(u, 1e-12), np.full_like(v, 1e-12)
    for _ in range(steps):
        du, dv = np.zeros_like(u), np.zeros_like(v)
        for at in range(0, len(u), block):
            part = slice(at, at + block)
            s = u[part] @ v.T
            np.exp(np.clip(np.negative(s, out=s), -20, 20, out=s), out=s)
            s += 1  # the chance of a pair is 1 / s
            g = met[part] - (met[part] + np.outer(row[part], column)) / s
            du[part] = g @ v
            dv += g.T @ u[part]
        gu += du * du
        gv += dv * dv
        u += rate * du / np.sqrt(gu)
        v += rate * dv / np.sqrt(gv)
    return u, v


def edits(word: str, longest: int, most: int = 2) -> list[str]:
    """Words that `word` may be a misreading of, by up to `most` glyph edits; none of a word so long that no established
    word, of at most `longest` letters, is within reach."""
    if len(word) > longest + most:
        return []
    seen, layer = {word}, [word]
    for _ in range(most):
        fresh = []
        for w in layer:
            for a, b in GLYPHS:
                i = w.find(a)
                while i >= 0:
                    c = w[:i] + b + w[i + len(a) :]
                    if c not in seen:
                        seen.add(c)
                        fresh.append(c)
                    i = w.find(a, i + 1)
        layer = fresh
    seen.discard(word)
    return sorted(c for c in seen if c.replace("-", "").isalpha() and "ſ" not in c)


class Reader:
    """What the workers know: letter sequences, and vectors of frequent words and contexts."""

    def __init__(self, sequences: dict[str, int], vocabulary: list[str], words: np.ndarray, contexts: np.ndarray, met: np.ndarray) -> None:
        self.sequences, self.words, self.contexts, self.trust = sequences, words, contexts, met / (met + HALF_PAIRS)
        self.ids = {w: i for i, w in enumerate(vocabulary)}

    def plausible(self, word: str) -> float:
        """Logarithm of the rarest letter sequence's count."""
        w = f"_{word}_"
        return min((math.log1p(self.sequences.get(w[i : i + 3], 0)) for i in range(len(w) - 2)), default=0.0)

    def context(self, words: list[str]) -> np.ndarray | None:
        """Vectors of the context words around."""
        found = [i for w in words if (i := self.ids.get(w, len(self.contexts))) < len(self.contexts)]
        return self.contexts[found] if found else None

    def fits(self, word: str, context: np.ndarray | None) -> float:
        """Evidence of the words around for `word`: their information about it, within CONTEXT_MOST (half of it against the word), less the fewer pairs
        its vector comes from; 0 without vectors."""
        if context is None or (i := self.ids.get(word)) is None:
            return 0.0
        return float(self.trust[i] * np.clip(CONTEXT_WEIGHT * (context @ self.words[i] + math.log(NEGATIVES)).sum(), -CONTEXT_MOST / 2, CONTEXT_MOST))

    def best(self, word: str, own: int, candidates: list[tuple[str, int]], around: list[str]) -> tuple[str | None, float] | None:
        """The correction with the most evidence: count against count, letter sequences, context; None below NEEDED.

        A sign of the scanner inside a word is evidence enough that it is misread; without correction the first is None."""
        found = None
        base, sign = self.plausible(word), 6.0 if _SCAN_SIGNS.search(word) or "ſ" in word else 0.0
        context = self.context(around)
        for c, n in candidates:
            score = math.log((n + 1) / (own + 1)) + max(0.0, self.plausible(c) - base) + sign + self.fits(c, context)
            if score >= (NEEDED if n else NEEDED + 1.5) and (found is None or score > found[1]):
                found = (c, score)
        if found is None and _SCAN_SIGNS.search(word) and any(ch.isalpha() for ch in word):
            return None, sign
        return found


def frequent_words(counts: DataFrame) -> list[str]:
    """The FREQUENT most frequent established words, most frequent first."""
    return [r[0] for r in counts.where("known").orderBy(F.desc("clean"), "word").limit(FREQUENT).select("word").collect()]


def learn(seen: DataFrame, counts: DataFrame, frequent: list[str]) -> Reader:
    """The bounded models, from the counts over all documents and the pairs of all scans."""
    vocabulary = frequent[:VECTORS]
    pairs = np.zeros((len(vocabulary), min(CONTEXTS, len(vocabulary))), dtype=np.float32)
    # at most VECTORS x CONTEXTS rows
    for b in seen.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").cast("float").alias("n")).toArrow().to_batches():
        a, c, n = (x.to_numpy(zero_copy_only=False) for x in b.columns)
        pairs[a, c] = n
    return Reader(sequence_counts(counts), vocabulary, *skip_grams(pairs), pairs.sum(axis=1))


_OBSERVED = "doc_id bigint, line_no int, kind string, word string, other string, around array<string>, a int, b int, n bigint"


def observed(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """What a scan among the documents (doc_id, text, expected) shows line by line: `page` lines, `join` (parts of a word over a line end), `word` (not frequent); and
    per batch the counts of each `pair` (a, b) of frequent words and contexts near it, as places in `frequent`. A document with a negative `expected` must have page lines to be a scan."""
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64())
    schema = pa.schema(list(zip([x.split()[0] for x in _OBSERVED.split(", ")], kinds, strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(frequent)})  # at most FREQUENT words
    contexts = min(CONTEXTS, len(frequent))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            rows, pairs = [], []
            for doc, text, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                lines = text.split("\n")
                skip = page_lines(lines)
                if expected < 0 and not skip:
                    continue
                rows += [(doc, i + 1, "page", None, None, None, None, None, None) for i in sorted(skip)]
                joins = broken_words(lines, skip)
                ends, starts = {i: (left, right) for i, _, left, right in joins}, {j for _, j, *_ in joins}
                rows += [(doc, i + 1, "join", left.lower(), right.lower(), None, None, None, None) for i, _, left, right in joins]
                for i, line in enumerate(lines):
                    words = words_of(line)
                    if i in skip and not line.lstrip()[:1].isalpha():
                        continue
                    low = [w.lower() for w in words]
                    stop = len(words) - (i in ends)
                    places = [ids.get(w, -1) for w in low]
                    if i not in skip:
                        pairs.append(places[i in starts : stop])
                    for k in range(1 if i in starts else 0, stop):
                        w = low[k]
                        if places[k] < 0 and not w.isdigit():
                            rows.append((doc, i + 1, "word", w, None, low[max(0, k - WINDOW) : k] + low[k + 1 : min(stop, k + 1 + WINDOW)], None, None, None))
            if counted := _pairs(pairs, contexts):
                rows += counted
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return cut_lineage(docs.select("doc_id", "text", "expected").mapInArrow(look, _OBSERVED))


def _pairs(lines: list[list[int]], contexts: int) -> list[tuple]:
    """Rows of the pairs within WINDOW in lines of word numbers; -1 is no frequent word and parts no neighbours."""
    if not lines or not contexts:
        return []
    gap = [-1] * WINDOW  # lines are no neighbours
    flat = np.array([i for x in lines for i in (*x, *gap)], dtype=np.int64)
    flat[flat >= VECTORS] = -1
    codes = []
    for d in range(1, WINDOW + 1):
        for a, b in ((flat[:-d], flat[d:]), (flat[d:], flat[:-d])):
            ok = (a >= 0) & (b >= 0) & (b < contexts)
            codes.append(a[ok] * contexts + b[ok])
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return [(None, None, "pair", None, None, None, a, b, k) for a, b, k in zip((code // contexts).tolist(), (code % contexts).tolist(), n.tolist(), strict=True)]


def corrections(seen: DataFrame, counts: DataFrame, reader: Reader) -> DataFrame:
    """(doc_id, line_no, word, correction): misread words with what was printed, null if no neighbour tells. Rare words
    are linked by a join."""
    words = seen.where("kind = 'word'").select("doc_id", "line_no", "word", "around")
    asked = words.select("word").distinct().join(counts, "word", "left").where(~F.coalesce("known", F.lit(False))).select("word", F.coalesce("clean", F.lit(0)).alias("own"))
    known = counts.where("known").select(F.col("word").alias("candidate"), "clean")
    longest = known.agg(F.max(F.length("candidate"))).first()[0] or 0

    def options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, c) for w in b["word"] for c in edits(w, longest)]
            yield pd.DataFrame(rows, columns=["word", "candidate"])

    links = asked.select("word").mapInPandas(options, "word string, candidate string").join(known, "candidate", "left").withColumn("n", F.coalesce("clean", F.lit(0)))
    # of the unestablished candidates only the letter sequences count
    per_word = links.groupBy("word").agg(F.collect_list(F.struct("candidate", "n")).alias("candidates"))  # the edits of one word
    tokens = words.join(asked.join(per_word, "word", "left"), "word")
    shared = seen.sparkSession.sparkContext.broadcast(reader)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value
        for b in batches:
            rows = []
            for doc, line, word, around, own, candidates in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if best := reader.best(word, own, [(c["candidate"], c["n"]) for c in candidates or ()], around or []):
                    rows.append((doc, line, word, best[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "line_no", "word", "correction"])

    return tokens.select("doc_id", "line_no", "word", "around", "own", "candidates").mapInArrow(decide, "doc_id bigint, line_no int, word string, correction string")


def breaks(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, line_no, joined): words that continue on the next line and are printed without hyphen otherwise.

    The counts decide between the joined and the hyphenated form; a word known in neither is taken as broken."""
    j = seen.where("kind = 'join'").select("doc_id", "line_no", F.concat("word", "other").alias("joined"), F.concat_ws("-", "word", "other").alias("hyphened"))
    n = F.col("clean") * 4 + F.col("scans")
    one, two = counts.select(F.col("word").alias("joined"), n.alias("n1")), counts.select(F.col("word").alias("hyphened"), n.alias("n2"))
    j = j.join(one, "joined", "left").join(two, "hyphened", "left")
    return j.where(F.coalesce("n1", F.lit(0)) >= F.coalesce("n2", F.lit(0))).select("doc_id", "line_no", "joined")


def noise(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(page lines, breaks, corrections, scans) of the scans in `docs` (doc_id, source, text).

    The last are the documents read as scans (doc_id, text): those of the sources and those without source that show it."""
    counts, sources = word_counts(docs)
    frequent = frequent_words(counts)
    # one row per source, so the texts stay where they are read
    marked = docs.join(checked(sources.withColumn("said", F.lit(True))), "source", "left")
    marked = marked.select("doc_id", "text", F.when(F.col("said"), 1).when(F.col("source").isNull(), 0).otherwise(-1).alias("expected"))
    seen = observed(marked, frequent)
    reader = learn(seen, counts, frequent)
    joined = breaks(seen, counts)
    pages = seen.where("kind = 'page'").select("doc_id", "line_no")
    shown = pages.select("doc_id").union(joined.select("doc_id")).distinct()
    not_scans = docs.where("source is null").select("doc_id").join(shown, "doc_id", "left_anti")
    scans = marked.where("expected = 1").select("doc_id", "text").unionByName(marked.where("expected < 1").select("doc_id", "text").join(shown, "doc_id", "left_semi"))
    return pages, joined, corrections(seen, counts, reader).join(not_scans, "doc_id", "left_anti"), scans


def noisy_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, noise)."""
    pages, joined, fixes, _ = noise(docs)
    parts = [(pages, "page"), (joined, "break"), (fixes, "glyph")]
    rows = [d.select("doc_id", "line_no", F.lit(kind).alias("noise")) for d, kind in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).distinct()


def repair_text(text: str, fixes: list[tuple[int, str, str]], broken: set[int]) -> str:
    """Continuous paragraphs of one text: furniture out, words corrected and joined, lines reflowed."""
    lines = text.split("\n")
    skip = page_lines(lines)
    joins = {i: j for i, j, *_ in broken_words(lines, skip)}
    by_line: dict[int, dict[str, str]] = defaultdict(dict)
    for no, word, right in fixes:
        by_line[no - 1][word] = right
    paragraphs, parts, size, glue = [], [], 0, False
    for i, line in enumerate(lines):
        if i in skip:
            continue
        if not line.strip():
            if parts and not glue and (size < 80 or parts[-1].rstrip("\"'”’)»")[-1:] in _CLOSERS):
                paragraphs.append("".join(parts))
                parts, size = [], 0
            continue
        if words := by_line.get(i):
            line = _TOKEN.sub(lambda m: _as(m[0], words[m[0].lower()]) if m[0].lower() in words else m[0], line)
        line = line.strip()
        if parts and not glue:
            parts.append(" ")
        glue = i in joins
        if glue and i + 1 in broken:
            line = line.rstrip(HYPHENS)
        parts.append(line)
        size += len(line) + 1
    return "\n\n".join([*paragraphs, "".join(parts)] if parts else paragraphs)


def _as(old: str, new: str) -> str:
    """`new` in the case of `old`."""
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def repaired(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every scan as continuous paragraphs."""
    _, joined, fixes, scans = noise(docs)
    lists = fixes.where("correction is not null").groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "word", "correction")).alias("fixes"))
    ends = joined.groupBy("doc_id").agg(F.collect_set("line_no").alias("broken"))
    rows = scans.where("text is not null").join(lists, "doc_id", "left").join(ends, "doc_id", "left")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [
                repair_text(t, [(x["line_no"], x["word"], x["correction"]) for x in (f if f is not None else ())], set(e if e is not None else ()))
                for t, f, e in zip(b["text"], b["fixes"], b["broken"], strict=True)
            ]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts})

    return rows.mapInPandas(repair, "doc_id bigint, text string")
