"""Problem 10: text cut off by field limits.

Method: per source, a log-normal length distribution is fitted by maximum likelihood with the values at candidate
limits taken as right-censored; a length's censoring posterior is the part of its values the fitted density and its
Poisson spread don't explain, nor the lengths around it, as a misfit of the density shows there too. It is the prior of
the value's being cut; away from limits the prior is the source's rate of cuts without limit. The evidence of an ending is
the ratio of its frequencies among cut and whole values. These
frequencies and the rate are learnt by expectation maximisation: over all sources first, then per source with the
common ones as a prior. Two fits compete: in one, whole values end openly no more often than WHOLE says; in the other as
often as the source shows. The second, open endings as a style, must be likelier by STYLE_COST, with no more evidence than
MOST_EVIDENCE values give: beyond that the misfit of either fit, which grows with the values, would decide. So in a source that often ends
without punctuation only values at a limit are cut, and a value that ends well at an overfull limit may be.

Endings: a mark of cutting (ellipsis, bracketed dots, a replacement character); closing punctuation that closes
something; a line whose frame (digits and names masked) also stands before other lines of its own text, or of several
texts and more often than chance brings, as page furniture and colophons do; an entry of a list with a tail that entries have; else open. Blank lines and page numbers at the end are passed over. Frames are counted over all documents, and only lines
that are followed by another line count, as no cut line is. What chance brings grows with the documents and is measured:
every text is also cut inside a line, and it is counted how often the frames of these stumps stand before other lines. A
stored size beyond the text's length is weak evidence.

Null and blank texts are not truncated. Repeated rows are judged alike, and copies of a text are one value in every count
but that of tails, which is a share. Documents without source form one source.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lipika.llm.canonical import canonical_text
from lipika.session import cut_lineage

#: Endings; what they are among cut and among whole values before any is seen, and how many values that is worth.
STATES = ("marked", "open", "entry", "known", "closed")
CUT, WHOLE = (0.25, 0.70, 0.02, 0.01, 0.02), (0.001, 0.0005, 0.0485, 0.25, 0.70)
STRENGTH = 20.0
#: How much likelier (natural logarithm) a style of open endings must be than cuts.
STYLE_COST = 10.0
#: Values whose evidence counts in that comparison.
MOST_EVIDENCE = 10_000.0
#: A stored size beyond the length, likewise.
CUT_MORE, WHOLE_MORE = 0.4, 0.1
#: Chance of a cut away from any limit, how many values that is worth, and the most it can be: what ends openly beyond
#: that is style.
BASE_RATE, RATE_STRENGTH, MOST_RATE = 0.02, 10.0, 0.15
#: Texts in which a frame must stand before another line.
FRAME_TEXTS = 2
#: Lengths to each side that tell what is usual around one, as a share of it and at least.
AROUND, LEAST_AROUND = 0.05, 10
#: Texts whose length, opening and last line are alike, but for digits, are copies.
OPENING = 200
#: Share a tail needs among the entry lines of all documents.
TAIL_SHARE = 0.01

_MARK = re.compile(r"(?:…|\.\.\.|�|[\[(<]\s*(?:…|\.\.\.|more|truncated)\s*[\])>])\s*$")
_CLOSED = re.compile(r"[.!?।॥|/]\s*['\"”’»)\]]*\s*$")
#: Closing signs that close nothing: a bare verse number, half of a verse's end mark.
_HALF = re.compile(r"^\W*\d+(?:\.\d+)?[.)]?\s*$|(?://|\|\||॥|।।)\s*[\d.]+\s*[/|।]\s*$")
#: A page number alone: the text before it tells how the text ends.
_PAGE = re.compile(r"^\s*[\[(—–-]*\s*(?:[Pp]ag[ec]\s+)?(?:\d{1,4}|[ivxlc]{1,8})\s*[\])—–-]*\s*$")
_ENTRY = re.compile(r"^\S.{0,60}? [—–] [^;]+; ")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"(?<!^)\b[A-ZÀ-ÞĀĪŪṚṢŚṬḌ][\w-]*")
_SPACE = re.compile(r"\s+")


def _forms(line: str) -> tuple[str, str]:
    """Two frames of a line: lower-cased with digits masked, and with names masked as well."""
    plain = _DIGITS.sub("#", _SPACE.sub(" ", line).strip())
    return plain.lower(), _NAME.sub("@", plain)


def _tail(line: str) -> str:
    """The last two tokens, names masked."""
    return " ".join(_NAME.sub("@", " " + " ".join(line.split()[-2:])).split())


def ending(line: str) -> str:
    """What the last line alone shows: marked, closed, entry or open."""
    if _MARK.search(line):
        return "marked"
    if _CLOSED.search(line) and not _HALF.search(line) and line.rfind("(") <= line.rfind(")") and line.rfind("“") <= line.rfind("”"):
        return "closed"
    return "entry" if _ENTRY.match(line) else "open"


def _hash(s: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _stump(text: str, at: int) -> tuple[str, str] | None:
    """Frames of the last line of `text` cut at `at`, if that is inside a line and leaves an open ending."""
    start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    piece, line = text[start:at].strip(), text[start : end if end >= 0 else len(text)].strip()
    if not piece or len(piece) == len(line) or _PAGE.match(piece) or ending(piece := canonical_text(piece)) != "open":
        return None
    return _forms(piece)


_FEATURES = "kind int, doc_id bigint, source string, length int, more boolean, state string, frame bigint, frame2 bigint, n bigint, copy bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document one row (kind 0), one per frame (kind 1) and one for its stump (kind 3); per batch the counts of
    entries' tails (kind 2)."""
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    for b in batches:
        rows, tails = [], Counter()
        for doc, source, size, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if text is None:
                continue
            lines, copy = text.split("\n"), _hash(f"{len(text)} {_forms(text[:OPENING])[0]}")
            while lines and (not lines[-1].strip() or len(lines[-1]) < 20 and _PAGE.match(lines[-1])):
                lines.pop()
            if not lines:
                rows.append((0, doc, source, len(text), False, "blank", None, None, None, copy))
                continue
            last = canonical_text(lines.pop())
            state = ending(last)
            forms = _forms(last)
            more = size is not None and size > len(text)
            entry = _hash(_tail(last)) if state == "entry" else None
            frames = set()
            for line in lines:
                if not line or _CLOSED.search(line):
                    continue  # a frame that ends closed is whole anyway
                if not line.isascii():
                    line = canonical_text(line)
                if _ENTRY.match(line):
                    tails[_tail(line)] += 1
                elif line.strip():
                    frames.update(_forms(line))
            if state in ("open", "entry") and forms[0] in frames:
                state = "known"
            rows.append((0, doc, source, len(text), more, state, _hash(forms[0]), _hash(forms[1]), entry, copy))
            rows += [(1, None, None, None, None, None, _hash(f), None, None, copy) for f in frames]
            if stump := _stump(text, copy % len(text)):
                rows.append((3, None, None, None, None, None, _hash(stump[0]), _hash(stump[1]), None, copy))
        rows += [(2, None, None, None, None, None, _hash(f), None, n, None) for f, n in tails.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fit_lengths(lengths: list[int], counts: list[int], rounds: int = 6) -> dict[int, float]:
    """Censoring posterior of each length (ascending) of one source that holds several values and more than chance brings there.

    Log-normal by maximum likelihood: values at a limit are censored with their posterior weight and enter through
    their expected logarithm beyond it; fit and posteriors alternate. What the lengths around hold, but for their censored
    values, is expected as well. Lengths must be positive."""
    x, c = np.array(lengths, dtype=np.float64), np.array(counts, dtype=np.float64)
    n, y = c.sum(), np.log(x)
    mean = float((c * y).sum() / n)
    sd = max(0.05, float((c * (y - mean) ** 2).sum() / n) ** 0.5)
    several = c >= 2
    w = np.where(several, 0.5, 0.0)
    reach = np.maximum(LEAST_AROUND, np.floor(x * AROUND))
    first_around, last_around = np.searchsorted(x, x - reach), np.searchsorted(x, x + reach, "right")
    for _ in range(rounds if several.any() else 0):
        z = (y - mean) / sd
        density = np.exp(-z * z / 2) / (2 * math.pi) ** 0.5
        survive = np.array([0.5 * math.erfc(v / 2**0.5) for v in z])
        hazard = np.where(survive > 1e-12, density / np.maximum(survive, 1e-300), z)
        beyond, square = mean + sd * hazard, mean**2 + sd**2 + sd * hazard * (y + mean)
        first, second = float((c * ((1 - w) * y + w * beyond)).sum()), float((c * ((1 - w) * y * y + w * square)).sum())
        mean = first / n
        sd = max(0.05, max(0.0, second / n - mean**2) ** 0.5)
        z = (y - mean) / sd
        expected = n * np.exp(-z * z / 2) / (2 * math.pi) ** 0.5 / sd / x
        free = np.concatenate([[0.0], np.cumsum((1 - w) * c)])
        expected = np.maximum(expected, (free[last_around] - free[first_around] - (1 - w) * c) / (2 * reach))
        w = np.where(several, np.maximum(0.0, 1 - (expected + 3 * expected**0.5 + 1) / c), 0.0)
    return {int(k): float(v) for k, v in zip(lengths, w, strict=True) if v > 0}


class Endings:
    """Frequencies of endings among cut and whole values, and the rate of cuts away from limits."""

    def __init__(self, cut: np.ndarray, whole: np.ndarray, rate: float) -> None:
        self.cut, self.whole, self.rate = cut, whole, rate  # (ending, with or without a larger stored size), each summing to 1

    @staticmethod
    def prior() -> "Endings":
        """What is known before any value is seen."""
        return Endings(*(np.outer(p, (1 - m, m)) for p, m in ((CUT, CUT_MORE), (WHOLE, WHOLE_MORE))), BASE_RATE)

    def odds(self, censored: np.ndarray, state: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Odds of being cut."""
        prior = np.clip(np.maximum(censored, self.rate), 1e-9, 1 - 1e-9)
        return prior / (1 - prior) * self.cut[state, more] / self.whole[state, more]

    def _step(self, prior: "Endings", style: bool, censored: np.ndarray, state: np.ndarray, more: np.ndarray, n: np.ndarray) -> "Endings":
        p = 1 - 1 / (1 + self.odds(censored, state, more))
        cut, whole = STRENGTH * prior.cut, STRENGTH * prior.whole
        np.add.at(cut, (state, more), n * p)
        np.add.at(whole, (state, more), n * (1 - p))
        whole /= whole.sum()
        if not style:
            whole[1] = np.minimum(whole[1], prior.whole[1])
        whole[0] = np.minimum(whole[0], prior.whole[0])  # a mark of cutting is no style
        whole[2:] *= (1 - whole[:2].sum()) / whole[2:].sum()
        away = censored <= self.rate
        rate = (RATE_STRENGTH * prior.rate + float((n * p)[away].sum())) / (RATE_STRENGTH + float(n[away].sum()))
        return Endings(cut / cut.sum(), whole, min(rate, MOST_RATE))

    def _likelihood(self, censored: np.ndarray, state: np.ndarray, more: np.ndarray, n: np.ndarray) -> float:
        at = np.clip(np.maximum(censored, self.rate), 1e-9, 1 - 1e-9)
        return float((n * np.log(at * self.cut[state, more] + (1 - at) * self.whole[state, more])).sum())

    @staticmethod
    def fit(prior: "Endings", censored: np.ndarray, state: np.ndarray, more: np.ndarray, n: np.ndarray, rounds: int = 60, style_cost: float = STYLE_COST) -> "Endings":
        """The fit with open endings as cuts or, if that is likelier by `style_cost`, as style."""
        seen = STRENGTH * prior.whole
        np.add.at(seen, (state, more), n * ((censored <= prior.rate) & (state > 0)))
        plain, style = prior, Endings(prior.cut, seen / seen.sum(), prior.rate / 10)
        for _ in range(rounds):
            plain = plain._step(prior, False, censored, state, more, n)
            style = style._step(prior, True, censored, state, more, n)
        gain = style._likelihood(censored, state, more, n) - plain._likelihood(censored, state, more, n)
        return style if gain * min(1.0, MOST_EVIDENCE / float(n.sum())) > style_cost else plain


def known_levels(counts: dict[tuple[int, int], int]) -> list[int]:
    """Levels (see `judged`) at which fewer than half of the open endings are what chance brings cut texts.

    `counts` holds the endings by (0, level) and the stumps by (3, level). Level 0 is that of frames in too few texts."""
    stumps = sum(n for (kind, _), n in counts.items() if kind == 3)
    chance = lambda level: (counts.get((3, level), 0) + 0.5) / (stumps + 1)
    cut = counts.get((0, 0), 0)
    return sorted(level for (kind, level), n in counts.items() if kind == 0 and level > 0 and n > 2 * cut * chance(level))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, source, length, state, p_cut, truncated) of every document with text.

    `docs` needs doc_id, source, n_chars and text. One pass over the texts; what follows moves hashes and numbers. The fits
    see one row per source, length and ending, or per source, posterior (in hundredths) and ending."""
    rows = cut_lineage(docs.select("doc_id", "source", F.col("n_chars").cast("bigint"), "text").mapInArrow(_scan, _FEATURES))
    ends = rows.where("kind = 0").select("doc_id", "source", "length", "more", "state", "frame", "frame2", F.col("n").alias("tail"), "copy")
    asked = rows.where("kind = 3 or kind = 0 and state in ('open', 'entry')")
    wanted = asked.select(F.explode(F.array("frame", "frame2")).alias("frame")).distinct()
    texts = rows.where("kind = 1").select("frame", "copy").join(wanted, "frame", "left_semi").distinct().groupBy("frame").agg(F.count("*").alias("n"))
    texts = cut_lineage(texts.where(F.col("n") >= FRAME_TEXTS))
    # the level of a row: the binary order of the texts its better frame stands in
    level = F.coalesce(F.floor(F.log2(F.greatest("n1", "n2"))), F.lit(0)).cast("int").alias("level")

    def levelled(df: DataFrame) -> DataFrame:
        df = df.join(texts.select("frame", F.col("n").alias("n1")), "frame", "left")
        return df.join(texts.select(F.col("frame").alias("frame2"), F.col("n").alias("n2")), "frame2", "left").select("*", level).drop("n1", "n2")

    values = asked.where("kind = 3 or state = 'open'").select("kind", "length", "frame", "frame2", "copy").distinct()
    known = known_levels({(r[0], r[1]): r[2] for r in levelled(values).groupBy("kind", "level").count().collect()})
    total = rows.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    tails = rows.where("kind = 2").groupBy("frame").agg(F.sum("n").alias("n"))
    tails = tails.where(F.col("n") >= total * TAIL_SHARE).select(F.col("frame").alias("tail"))  # at most 1 / TAIL_SHARE rows
    ends = levelled(ends)
    ends = ends.join(F.broadcast(tails.withColumn("t", F.lit(True))), "tail", "left")
    state = F.when(F.col("state").isin("open", "entry") & F.col("level").isin(known), "known").when((F.col("state") == "entry") & F.col("t").isNull(), "open").otherwise(F.col("state"))
    ends = ends.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("key"), "length", "frame", "frame2", "copy", F.coalesce("more", F.lit(False)).cast("int").alias("more"), state.alias("state"))

    def lengths(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("length")
        found = fit_lengths(group["length"].tolist(), group["values"].tolist())
        return pd.DataFrame({"key": group["key"].iloc[0], "length": list(found), "censored": list(found.values())})

    # copies of a text are one value: only different ones show a limit
    counts = ends.where("length > 0").select("key", "length", "frame", "frame2", "copy").distinct().groupBy("key", "length").agg(F.count("*").alias("values"))
    limits = counts.groupBy("key").applyInPandas(lengths, "key string, length int, censored double")
    number = F.array_position(F.array(*(F.lit(x) for x in STATES)), F.col("state")).cast("int") - 1
    ends = ends.join(limits, ["key", "length"], "left").withColumns({"censored": F.round(F.coalesce("censored", F.lit(0.0)), 2), "ending": number})
    ends = cut_lineage(ends)

    cells = ends.where("ending >= 0").select("key", "length", "frame", "frame2", "copy", "censored", "ending", "more").distinct().groupBy("key", "censored", "ending", "more").agg(F.count("*").alias("n"))
    arrays = lambda d: (d["censored"].to_numpy(np.float64), d["ending"].to_numpy(np.int64), d["more"].to_numpy(np.int64), d["n"].to_numpy(np.float64))
    common = cells.groupBy("censored", "ending", "more").agg(F.sum("n").alias("n")).toPandas()  # 101 posteriors, 5 endings, 2 sizes
    prior = Endings.fit(Endings.prior(), *arrays(common), style_cost=math.inf) if len(common) else Endings.prior()

    def endings(group: pd.DataFrame) -> pd.DataFrame:
        censored, state, more, _ = values = arrays(group)
        odds = Endings.fit(prior, *values).odds(censored, state, more)
        return pd.DataFrame({"key": group["key"], "censored": censored, "ending": state, "more": more, "p_cut": odds / (1 + odds)})

    learnt = cells.groupBy("key").applyInPandas(endings, "key string, censored double, ending int, more int, p_cut double")
    found = ends.join(learnt, ["key", "censored", "ending", "more"], "left").withColumn("p_cut", F.coalesce("p_cut", F.lit(0.0)))
    return found.select("doc_id", "source", "length", "state", "p_cut", (F.col("p_cut") > 0.5).alias("truncated"))


def rates(judgements: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate)."""
    per = judgements.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("truncated").alias("truncated"))
    return per.withColumn("rate", F.col("truncated") / F.col("documents"))
