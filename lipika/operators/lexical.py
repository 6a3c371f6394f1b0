"""BM25 for a set of queries at once: over a token column, in one pass over the texts, or from stored postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from lipika.functions import fixed
from lipika.functions.sanskrit import chunk_tokens, chunk_tokens_col, tokenize
from lipika.functions.text import meta_line

#: Buckets of terms that stored postings fall into.
BUCKETS = 64


def with_tokens(chunks: DataFrame) -> DataFrame:
    """`chunks` with `tokens`: what an index keeps, so that a query reads tokens and not text."""
    return chunks.withColumn("tokens", chunk_tokens_col(F.col("title"), F.col("work"), F.col("locator"), F.col("heading"), F.col("text")))


def _meta() -> Column:
    return meta_line(F.col("title"), F.col("work"), F.col("locator"), F.col("heading"))


def with_hits(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """`chunks` with `dl`, the number of their tokens, and `hits`, the (term, tf) of the asked terms: one pass over the texts
    that leaves numbers and asked terms only."""
    wanted = frozenset(r[0] for r in terms.select("term").distinct().collect())

    @F.pandas_udf(StringType())
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for meta, text in batches:
            out = []
            for m, t in zip(meta, text, strict=True):
                tokens = chunk_tokens(m, t)
                found = Counter(x for x in tokens if x in wanted)
                out.append(" ".join([str(len(tokens)), *(f"{x} {n}" for x, n in found.items())]))
            yield pd.Series(out, dtype=object)

    rows = chunks.withColumn("_p", F.split(count(_meta(), F.col("text")), " "))  # tokens hold no spaces
    pair = lambda i: F.struct(F.get("_p", 2 * i - 1).alias("term"), F.get("_p", 2 * i).cast("bigint").alias("tf"))
    n = ((F.size("_p") - 1) / 2).cast("int")
    hits = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), pair)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
    return rows.withColumn("dl", F.get("_p", F.lit(0)).cast("int")).withColumn("hits", hits).drop("_p")


def query_terms(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    """(query_id, pos, alt, term): per query token the token itself (alt 0) and its equivalents in order.

    Equivalents that are no single folded token can match nothing and are left out; a repeated token counts again."""
    rows = [
        (qid, pos, alt, term)
        for qid, q in queries.items()
        for pos, t in enumerate(tokenize(q))
        for alt, term in enumerate([t, *fixed.EXPANSIONS.get(t, [])])
        if alt == 0 or tokenize(term) == [term]
    ]
    return spark.createDataFrame(rows, "query_id string, pos int, alt int, term string")


def bm25(chunks: DataFrame, terms: DataFrame, id_col: str = "chunk_id", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """(query_id, id, score) of the rows with a positive score, to six decimals.

    `chunks` has `tokens`, or `dl` and `hits`. A query token that a row lacks is replaced by its first equivalent the row
    has; `terms` is as small as the query set and is broadcast. Null tokens count as none."""
    if "hits" not in chunks.columns:
        size = F.greatest(F.size(F.coalesce("tokens", F.array().cast("array<string>"))), F.lit(0))
        wanted = [r[0] for r in terms.select("term").distinct().collect()]
        asked = F.filter("tokens", lambda t: t.isin(*wanted)) if wanted else F.array().cast("array<string>")
        hits = chunks.select(id_col, size.alias("dl"), F.explode(asked).alias("term")).groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))
        n, avgdl = chunks.agg(F.count("*"), F.coalesce(F.avg(size), F.lit(0.0))).first()
    else:
        hits = chunks.select(id_col, "dl", F.explode("hits").alias("h")).select(id_col, "dl", "h.term", "h.tf")
        n, avgdl = chunks.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    return scored(hits, n, avgdl, terms, id_col, k1, b)


def scored(hits: DataFrame, n: int, avgdl: float, terms: DataFrame, id_col: str = "chunk_id", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """`bm25` from (id, dl, term, tf) of the asked terms and the statistics of all rows."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(F.broadcast(df), "term")  # one row per asked term
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest("dl", F.lit(1)) / (avgdl or 1.0)))
    parts = hits.select(id_col, "term", part.alias("part")).join(F.broadcast(terms), "term")
    best = parts.groupBy("query_id", id_col, "pos").agg(F.min_by("part", "alt").alias("part"))
    return best.groupBy("query_id", id_col).agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")


def write_postings(chunks: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Store `postings` (bucket, term, chunk_id, tf, dl), by buckets of terms and sorted by term, and `statistics` (n, total).

    Chunks without tokens count in n; ids must be distinct."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ids, tfs, dls = [], [], [], []
            for chunk, meta, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = chunk_tokens(meta, text)
                found = Counter(tokens)
                terms += found
                tfs += found.values()
                ids += [chunk] * len(found)
                dls += [len(tokens)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, pa.string()), pa.array(tfs, pa.int32()), pa.array(dls, pa.int32())], names=["term", "chunk_id", "tf", "dl"])

    rows = chunks.select("chunk_id", _meta().alias("meta"), "text").mapInArrow(count, "term string, chunk_id string, tf int, dl int")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a term of every chunk is no task's list: rows spread by term and chunk, a bucket gets several files
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(4))
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings.parquet")
    total = chunks.sparkSession.read.parquet(f"{folder}/postings.parquet").agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("bigint").alias("total"))
    total.withColumn("n", F.lit(chunks.count())).write.mode("overwrite").parquet(f"{folder}/statistics.parquet")


def bm25_stored(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    """`bm25` from stored postings: only the buckets of the asked terms are read."""
    wanted = [r[0] for r in terms.select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    buckets = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    n, total = spark.read.parquet(f"{folder}/statistics.parquet").select("n", "total").first()
    hits = spark.read.parquet(f"{folder}/postings.parquet").where(F.col("bucket").isin(*buckets) & F.col("term").isin(*wanted))
    return scored(hits.select("chunk_id", "dl", "term", "tf"), n, total / max(n, 1), terms)


def top(scores: DataFrame, n: int, tie: str = "chunk_id") -> DataFrame:
    """The `n` best rows of each query with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def phrase_in(folded_text: Column, folded_query: str) -> Column:
    """Whether a folded text holds the folded query, with or without its spaces; false under 8 non-space letters."""
    compact = folded_query.replace(" ", "")
    if len(compact) < 8:
        return F.lit(False)
    return folded_text.contains(folded_query) | F.replace(folded_text, F.lit(" "), F.lit("")).contains(compact)
