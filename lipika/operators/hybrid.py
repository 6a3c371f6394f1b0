"""Hybrid retrieval: semantic and lexical candidates, rule injections, fused score, boosts, diversification.

A search compiles one query's rules into Column predicates; scoring runs over the pool only, which is bounded by the
over-fetch sizes, while candidate generation is one filtered scan per signal."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from lipika.functions import fixed, refs, text as T
from lipika.functions.sanskrit import fold, fold_col, tokenize, tokens_col
from lipika.operators import lexical, ranking
from lipika.session import cut_lineage


def _rlike(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?iu){pattern}"), F.lit(False))


def _blob() -> Column:
    return T.metadata_blob(F.col("title"), F.col("locator"), F.col("heading"), F.col("work"))


def hymn_variants(hymn: str) -> list[str]:
    """`10.129` also as `X.129`."""
    book, _, n = hymn.partition(".")
    return [hymn, *([f"{fixed.ROMAN_BOOKS[int(book) - 1]}.{n}"] if n and book.isdigit() and 1 <= int(book) <= 10 else [])]


@dataclass(frozen=True)
class Intent:
    """What a query names: hymns, works, a deity."""

    query: str
    hymns: tuple[str, ...]
    works: tuple[str, ...]
    deity: str | None

    @staticmethod
    def of(query: str) -> Intent:
        """Names come before numbers: a number that disagrees with a named hymn is ignored."""
        named = list(dict.fromkeys(h for p, h in fixed.NAMED_HYMNS if re.search(p, query, re.I)))
        explicit = [a or b for a, b in re.findall(fixed.EXPLICIT_HYMN, query, re.I)]
        hymns = tuple(dict.fromkeys(named + [h for h in explicit if not named or h in named]))
        works = tuple(dict.fromkeys(w for p, w in fixed.NAMED_WORKS if re.search(p, query, re.I)))
        tokens = tokenize(query)
        deity = None
        if 0 < len(tokens) <= 3 and not hymns and not works:
            deity = next((d for d, p in fixed.DEITY.items() if re.search(p, query, re.I) and not set(tokens) - {d, *fixed.DEITY_EXTRA}), None)
        return Intent(query, hymns, works, deity)


def names_hymn(hymn: str) -> tuple[Column, Column]:
    """(title names the hymn, text names it): by number, Roman spelling or distinctive name."""

    def found(c: Column) -> Column:
        hits = [refs.hymn_in_blob(c, v) for v in hymn_variants(hymn)]
        if hymn in fixed.NAMES_IN_TEXT:
            hits.append(_rlike(c, fixed.NAMES_IN_TEXT[hymn]))
        return reduce(lambda a, b: a | b, hits)

    return found(_blob()), found(F.coalesce("text", F.lit("")))


def names_work(work: str) -> Column:
    """Metadata names the work and none of what rules it out."""
    match, exclude, _ = fixed.WORK_RULES[work]
    return _rlike(_blob(), match) & ~_rlike(_blob(), exclude)


def names_deity(deity: str) -> Column:
    """Metadata names a hymn to the deity, and neither an epic nor an anthology."""
    return _rlike(_blob(), fixed.DEITY_TITLE[deity]) & ~_rlike(_blob(), fixed.EPIC_TITLE) & ~_rlike(_blob(), fixed.ANTHOLOGY)


def injections(chunks: DataFrame, intent: Intent, exclude: DataFrame, per: int = fixed.INJECTIONS) -> DataFrame | None:
    """Chunks whose metadata names what the query asks for, `per` of each name, none already in `exclude` or for an
    earlier name; anthologies never. Adds `source` and `rank`. A query names one or two things, so they are taken in turn."""
    anthology = _rlike(_blob(), fixed.ANTHOLOGY)
    wishes = []
    for h in intent.hymns:
        level = reduce(lambda a, b: a | b, (refs.hymn_in_blob(F.coalesce("locator", F.lit("")), v) & ~F.coalesce("locator", F.lit("")).rlike(rf"{re.escape(v)}\.\d") for v in hymn_variants(h)))
        wishes.append((names_hymn(h)[0], F.when(level, 0).otherwise(1)))
    for w in intent.works:
        wishes.append((names_work(w), F.when(_rlike(_blob(), fixed.WORK_RULES[w][2]), 0).otherwise(1)))
    if intent.deity:
        wishes.append((names_deity(intent.deity), F.lit(0)))
    found = None
    for n, (wanted, level) in enumerate(wishes):
        rows = chunks.where(wanted & ~anthology).join(exclude.select("chunk_id"), "chunk_id", "left_anti")
        if found is not None:
            rows = rows.join(found.select("chunk_id"), "chunk_id", "left_anti")
        rows = rows.withColumn("_level", level).orderBy("_level", "ord").limit(per).drop("_level").withColumn("source", F.lit(2 + n)).withColumn("rank", F.col("ord"))
        found = rows if found is None else found.unionByName(rows)
    return found


def search(chunks: DataFrame, semantic: DataFrame, query: str, top_k: int = 8, per_document: int = fixed.PER_DOCUMENT, scores: DataFrame | None = None) -> DataFrame:
    """Ranked hits of one query.

    `chunks` needs chunk_id, doc_id, ord (corpus order), title, locator, heading, work and text; `semantic` is (chunk_id,
    score, rank) of the dense candidates; `scores` are the query's lexical ones where an index has them, else one pass
    over the texts makes them. Empty inputs give no hits."""
    spark = chunks.sparkSession
    intent = Intent.of(query)
    terms = lexical.query_terms(spark, {"q": query})
    if scores is None:
        scores = lexical.bm25(cut_lineage(lexical.with_hits(chunks, terms).select("chunk_id", "dl", "hits")), terms)
    lexical_top = lexical.top(scores, max(4 * top_k, 20)).select("chunk_id", F.lit(1).alias("source"), "rank")
    first = semantic.select("chunk_id", F.lit(0).alias("source"), "rank").unionByName(lexical_top)
    ids = cut_lineage(ranking.union_first(first.withColumn("query_id", F.lit("q")), ["source", "rank"]).select("chunk_id", "source", "rank").repartition(1))  # over-fetch rows
    pool = chunks.join(F.broadcast(ids), "chunk_id")  # at most over-fetch rows
    if (more := injections(chunks, intent, ids)) is not None:
        pool = pool.unionByName(more.select(pool.columns))
    pool = pool.join(semantic.select("chunk_id", F.col("score").alias("dense"), F.col("rank").alias("dense_rank")), "chunk_id", "left")
    pool = cut_lineage(lexical.with_hits(pool.repartition(1), terms))  # some dozens of rows that scoring reads again and again
    return ranking.diversify(score(pool, intent, terms).withColumn("query_id", F.lit(query)), top_k, per_document, "pool_ord")


def score(pool: DataFrame, intent: Intent, terms: DataFrame) -> DataFrame:
    """The pool with `score` and the parts of it. The BM25 statistics are the pool's own."""
    everything = Window.partitionBy()
    lex = lexical.bm25(pool, terms).select("chunk_id", F.col("score").alias("lex"))
    pool = pool.join(lex, "chunk_id", "left")
    dense = F.coalesce(F.nullif("dense", F.lit(0.0)), F.when(F.col("dense_rank").isNotNull(), F.greatest(F.lit(0.0), 1 - 0.02 * (F.col("dense_rank") - 1))))
    pool = pool.withColumn("sem", dense).withColumn("sem", F.coalesce("sem", F.min("sem").over(everything), F.lit(0.0)))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.coalesce(F.nullif(F.max(c).over(everything), F.lit(0.0)), F.lit(1.0))
    total = F.round(fixed.SEMANTIC_WEIGHT * share("sem") + (1 - fixed.SEMANTIC_WEIGHT) * share("lex"), 4)
    pool = pool.withColumn("fused", total).withColumn("pool_ord", F.row_number().over(Window.partitionBy().orderBy("source", "rank", "chunk_id")))

    q_tokens = sorted(set(tokenize(intent.query)))
    title = F.coalesce("title", F.lit(""))
    size = F.length(F.coalesce("text", F.lit("")))
    epic = _rlike(title, fixed.EPIC_TITLE)
    asks_epic = bool(set(q_tokens) & {fold(x) for x in fixed.EPIC_HINTS})
    overlap = F.size(F.array_intersect(tokens_col(title), F.array(*(F.lit(t) for t in q_tokens)))) / len(q_tokens) if q_tokens else F.lit(0.0)
    shape = (
        fixed.OVERLAP_BOOST * overlap
        + F.when(_rlike(title, fixed.HYMN_TITLE), fixed.HYMN_NAME_BOOST).otherwise(0.0)
        + F.when((size > 0) & (size < 2500), fixed.SHORT_BOOST).when((size > 8000) & F.lit(not asks_epic), -fixed.LONG_PENALTY).otherwise(0.0)
        + (F.lit(0.0) if asks_epic else F.when(epic, -fixed.EPIC_PENALTY).otherwise(0.0))
    )
    anthology = _rlike(_blob(), fixed.ANTHOLOGY)
    pool = pool.withColumn("_anthology", anthology)
    hymn_flags = [names_hymn(h) for h in intent.hymns]
    any_of = lambda xs: reduce(lambda a, b: a | b, xs, F.lit(False))
    in_title = any_of(t for t, _ in hymn_flags)
    in_text = any_of(t for _, t in hymn_flags)
    of_work = any_of(names_work(w) for w in intent.works)
    in_pool = lambda c: F.max((c & ~F.col("_anthology")).cast("int")).over(everything) == 1
    specific = in_pool(in_title | of_work)
    hymn_boost = F.when(F.col("_anthology") & in_pool(in_title), 0.0).when(in_title, fixed.HYMN_TITLE_BOOST).when(in_text, fixed.HYMN_TEXT_BOOST).otherwise(0.0)
    work_boost = F.when(of_work & ~F.col("_anthology"), fixed.WORK_BOOST).otherwise(0.0)
    deity_boost = F.when(names_deity(intent.deity), fixed.DEITY_BOOST).otherwise(0.0) if intent.deity else F.lit(0.0)
    phrase = F.when(lexical.phrase_in(fold_col(F.coalesce("text", F.lit(""))), fold(intent.query).strip()), fixed.PHRASE_BOOST).otherwise(0.0)
    demotion = F.when(F.col("_anthology") & specific, fixed.ANTHOLOGY_DEMOTION).otherwise(0.0) if intent.hymns or intent.works else F.lit(0.0)
    parts = {"shape": shape, "hymn_boost": hymn_boost, "work_boost": work_boost, "deity_boost": deity_boost, "phrase_boost": phrase, "demotion": -demotion}
    pool = pool.withColumns({k: v.cast("double") for k, v in parts.items()})
    final = F.col("fused")
    for k in parts:
        if k == "phrase_boost":
            pool = pool.withColumn("before_phrase", final)
            final = F.col("before_phrase")
        final = F.round(final + F.col(k), 4)
    order = Window.partitionBy().orderBy(F.desc("before_phrase"), "pool_ord")  # ties keep the order the boosts gave
    return pool.withColumn("score", final).withColumn("pool_ord", F.row_number().over(order)).drop("_anthology")


def rerank(hits: DataFrame, query: str, scorer: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], weight: float = 0.5) -> DataFrame:
    """Hits with `score` blended with the sigmoid of a cross-encoder's logit, ranked anew. Opt-in.

    The factory loads the model once per worker; where it or the scoring fails, the hits keep their order."""
    @F.pandas_udf(DoubleType())
    def logit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            score = scorer()
        except Exception:  # noqa: BLE001 - no model, no change
            score = None
        for texts in batches:
            try:
                yield pd.Series([1 / (1 + math.exp(-x)) for x in score([(query, t or "") for t in texts])], dtype="float64")
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(texts), dtype="float64")

    rows = hits.withColumn("cross_score", logit("text"))
    complete = F.count("cross_score").over(Window.partitionBy()) == F.count("*").over(Window.partitionBy())  # top_k rows
    rows = rows.withColumn("score", F.when(complete, F.round((1 - weight) * F.col("score") + weight * F.col("cross_score"), 4)).otherwise(F.col("score")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "rank")))
