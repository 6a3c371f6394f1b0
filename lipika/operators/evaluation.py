"""Gold-query suites, their comparison, and weak training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lipika.functions import text as T

#: Hits that look right for a named hymn and are not: kept as hard negatives.
HARD_NEGATIVE_HYMNS = ("10.125", "10.5")
PINNED_TRAIN = ("nasadiya",)


def title_matches(title: Column, expected: Column) -> Column:
    """Any expected string is part of the title, whatever the case; false for null or no expectations."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(F.exists(expected, lambda p: (p != "") & low.contains(F.lower(p))), F.lit(False))


def suite(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, hits, matched, ok) per gold query (id, min_hits, expect_title_any): enough hits, and one with an expected title."""
    joined = gold.join(hits.select(F.col("query_id").alias("id"), "title"), "id", "left")
    flag = title_matches(F.col("title"), F.col("expect_title_any"))
    per = joined.groupBy("id", "min_hits").agg(F.count("title").alias("hits"), F.coalesce(F.bool_or(flag), F.lit(False)).alias("matched"))
    return per.select("id", "hits", "matched", ((F.col("hits") >= F.col("min_hits")) & F.col("matched")).alias("ok"))


def pass_rate(results: DataFrame) -> DataFrame:
    """(passed, total, rate); the rate of no queries is 0."""
    s = results.agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
    return s.withColumn("rate", F.coalesce(F.col("passed") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, left_ok, right_ok, change) of two suites over the same or different queries."""
    both = left.select("id", F.col("ok").alias("left_ok")).join(right.select("id", F.col("ok").alias("right_ok")), "id", "full")
    change = F.when(F.col("left_ok").isNull(), "only right").when(F.col("right_ok").isNull(), "only left").when(F.col("left_ok") & ~F.col("right_ok"), "lost").when(~F.col("left_ok") & F.col("right_ok"), "won").otherwise("same")
    return both.withColumn("change", change)


def gate(comparison: DataFrame) -> bool:
    """Whether a change may go ahead: no query that was answered before is lost."""
    return comparison.where("change = 'lost'").isEmpty()


def exit_code(results: DataFrame, least: float = 1.0) -> int:
    """0 if at least that share of the queries passed, 1 if not, 2 if there was none."""
    row = pass_rate(results).first()
    return 2 if not row["total"] else 0 if row["rate"] >= least else 1


def splits(query_ids: DataFrame, ratio: float = 0.2, pinned: tuple[str, ...] = PINNED_TRAIN) -> DataFrame:
    """(query_id, split): the last round(n * ratio) ids in order that are not pinned are held out; at least one of two or more."""
    ids = query_ids.select("query_id").where("query_id is not null").distinct()
    n = ids.count()
    hold = max(1, round(n * ratio)) if n >= 2 and ratio > 0 else 0
    free = ids.where(~F.col("query_id").isin(*pinned)) if pinned else ids
    last = F.row_number().over(Window.orderBy(F.desc("query_id")))  # the gold set is small by nature
    held = free.withColumn("rn", last).where(F.col("rn") <= hold).select("query_id", F.lit("eval").alias("split"))
    return ids.join(held, "query_id", "left").select("query_id", F.coalesce("split", F.lit("train")).alias("split"))


def pairs(hits: DataFrame, most_negatives: int = 8) -> DataFrame:
    """Weak labels of candidate hits (query_id, query, rank, title, locator, heading, text, expect_title_any, split).

    Positive: an expected title. Hard negative: a hit of a hymn known to be confused, for the query it is confused with.
    Others: the first `most_negatives` by rank. Hits without text give no pair."""
    from lipika.functions.refs import hymn_in_blob

    blob = T.metadata_blob(F.col("title"), F.col("locator"), F.col("heading"))
    asked = F.lower(F.concat_ws(" ", F.coalesce("query_id", F.lit("")), F.coalesce("query", F.lit(""))))
    confusable = asked.contains("nasadiya") | asked.contains("nāsadīya") | asked.contains("नासदीय") | asked.contains("नासदासीन्")
    hard = confusable & (hymn_in_blob(blob, HARD_NEGATIVE_HYMNS[0]) | hymn_in_blob(blob, HARD_NEGATIVE_HYMNS[1]))
    kind = F.when(title_matches(F.col("title"), F.col("expect_title_any")), "positive").when(hard, "hard_negative").otherwise("negative")
    rows = hits.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("pair_kind", kind)
    rank = F.row_number().over(Window.partitionBy("query_id", "pair_kind").orderBy("rank"))
    rows = rows.withColumn("_n", rank).where((F.col("pair_kind") != "negative") | (F.col("_n") <= most_negatives))
    return rows.select("query_id", "query", "text", (F.col("pair_kind") == "positive").cast("int").alias("label"), F.coalesce("title", F.lit("")).alias("doc_title"), "split", "pair_kind", "rank")


def pair_summary(rows: DataFrame) -> DataFrame:
    """(split, pairs, positives, negatives, queries) per split and, as split 'all', in total."""
    made = rows.groupingSets([["split"], []], "split").agg(F.count("*").alias("pairs"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), F.countDistinct("query_id").alias("queries"), F.grouping_id().alias("g"))
    return made.select(F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), "pairs", "positives", "negatives", "queries")


def train_rows(rows: DataFrame) -> DataFrame:
    """Pairs that are not held out; all of them if none is left."""
    held = F.lower(F.coalesce("split", F.lit(""))).isin("holdout", "eval", "test", "valid", "validation", "dev")
    free = rows.where(~held)
    return rows if free.isEmpty() else free
