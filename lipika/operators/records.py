"""Shaping: manifest rows and texts into document records, records into listing rows, chunks and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lipika.functions import refs, text as T

#: Licences a source may carry to be ingested; a parameter of `gate`.
LICENSES = ("public-domain", "cc0", "cc-by", "cc-by-sa", "odbl", "authorized", "official-api", "gov-ind")


def gate(sources: DataFrame, licenses: tuple[str, ...] = LICENSES) -> DataFrame:
    """`sources` with `reason`: 'ok', or the first test failed, in the order license missing, license, url, download."""
    license_ = T.strip(F.lower(F.coalesce("license", F.lit(""))))
    reason = (
        F.when(license_ == "", "license missing")
        .when(~license_.isin(*licenses), "license not allowed")
        .when(T.strip(F.coalesce("url", F.lit(""))) == "", "url missing")
        .when(F.col("download").eqNullSafe(False), "catalogue only")
        .otherwise("ok")
    )
    return sources.withColumn("reason", reason)


def label(c: str, missing: str) -> Column:
    """Lower-case label, `missing` for null and ''."""
    return F.lower(T.or_default(F.col(c), missing))


def build_records(sources: DataFrame, text: str = "text", retrieved_at: Column | None = None) -> DataFrame:
    """Document records of sources with their extracted text."""
    digest = T.content_fingerprint(F.col(text))
    return sources.select(
        T.stable_id(F.col("url"), F.col("title"), F.substring(digest, 1, 16)).alias("id"),
        F.col(text).alias("text"),
        F.col("url").alias("source_url"),
        "title",
        label("tradition", "unknown").alias("tradition"),
        label("language", "und").alias("language"),
        F.lower(F.col("license")).alias("license"),
        (retrieved_at if retrieved_at is not None else T.iso_now()).alias("retrieved_at"),
        digest.alias("fingerprint"),
        F.length(text).alias("char_count"),
    )


def summaries(docs: DataFrame) -> DataFrame:
    """Listing rows: labels with defaults, detected work, size, preview. A stored size of null or 0 is the text's length."""
    return docs.select(
        "id",
        "doc_id",
        T.or_default(F.col("title"), "").alias("title"),
        label("tradition", "unknown").alias("tradition"),
        label("language", "und").alias("language"),
        F.coalesce("license", F.lit("")).alias("license"),
        F.coalesce(F.nullif("n_chars", F.lit(0)), F.length("text").cast("bigint"), F.lit(0)).alias("char_count"),
        F.coalesce(F.nullif("work", F.lit("")), refs.detect_work(F.col("title"), F.col("source_url"), F.col("tradition"))).alias("work"),
        T.preview(F.col("text")).alias("preview"),
    )


def long_enough(records: DataFrame, least: int = 80) -> DataFrame:
    """Records whose text has at least `least` code points; null texts go."""
    return records.where(F.length("text") >= least)


def answers(hits: DataFrame, top: int = 3, size: int = 400) -> DataFrame:
    """One row with the extractive answer: the first hits' labels and snippets."""
    part = F.concat(T.citation_label(F.col("locator"), F.col("title")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, size))
    best = hits.orderBy("rank").limit(top).select("rank", part.alias("part"))
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("answer"))


def context_blocks(hits: DataFrame, budget: int = 9000) -> DataFrame:
    """(rank, block) of numbered context blocks within a budget of code points; the first always stays.

    A running sum over one query's hits, a set bounded by its top_k."""
    from pyspark.sql import Window

    body = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.citation_label(F.col("locator"), F.col("title")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = hits.select("query_id", "rank", body.alias("block"))
    used = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank"))
    return rows.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1)).drop("used")


def chat_messages(turns: DataFrame, last: int = 8, size: int = 4000) -> DataFrame:
    """(conv_id, turn, role, text): the last turns of each conversation, then only user and assistant with text, cut."""
    from pyspark.sql import Window

    recent = turns.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("rn") <= last)
    body = T.strip(F.coalesce("text", F.lit("")))
    return recent.where(F.col("role").isin("user", "assistant") & (body != "")).select("conv_id", "turn", "role", F.substring(body, 1, size).alias("text"))
