"""Listing, facets, statistics and lookups over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lipika.functions import text as T

# Traditions in display order.
TRADITIONS = ("vedic", "upanishad", "itihasa", "purana", "yoga", "vaishnava", "tantra", "grammar", "jyotisha")


def matching(docs: DataFrame, tradition: str | None = None, language: str | None = None, q: str | None = None) -> DataFrame:
    """Documents of a tradition and language (any case) that hold `q` in title, first 4 000 code points of text, or address."""
    if tradition:
        docs = docs.where(F.lower("tradition") == tradition.lower())
    if language:
        docs = docs.where(F.lower("language") == language.lower())
    if q:
        blob = T.metadata_blob(F.col("title"), F.substring("text", 1, 4000), F.col("source_url"))
        docs = docs.where(F.contains(F.lower(blob), F.lit(q.lower())))
    return docs


def page(docs: DataFrame, order: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in corpus order."""
    return docs.orderBy(order).offset(offset).limit(limit)


def page_total(docs: DataFrame) -> DataFrame:
    """(total): rows a listing has before it is cut into pages."""
    return docs.agg(F.count("*").alias("total"))


def facets(docs: DataFrame) -> DataFrame:
    """(facet, value, documents) over all documents, spelled as stored; null values are no facet value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("tradition", "language")))).alias("f")
    return docs.select(pairs).select("f.facet", "f.value").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("documents"))


def stats(docs: DataFrame) -> DataFrame:
    """(facet, value, documents, characters): totals (facet 'all') and by lower-case tradition and language, in one pass.

    A stored size of null or 0 is the text's length. An empty table has no rows, not even a total."""
    size = F.coalesce(F.nullif("n_chars", F.lit(0)), F.length("text").cast("bigint"), F.lit(0))
    rows = docs.select(F.lower(T.or_default(F.col("tradition"), "unknown")).alias("tradition"), F.lower(T.or_default(F.col("language"), "und")).alias("language"), size.alias("size"))
    grouped = rows.groupingSets([["tradition"], ["language"], []], "tradition", "language").agg(F.count("*").alias("documents"), F.sum("size").alias("characters"), F.grouping_id().alias("gid"))
    facet = F.when(F.col("gid") == 1, "tradition").when(F.col("gid") == 2, "language").otherwise("all")
    return grouped.select(facet.alias("facet"), F.coalesce("tradition", "language", F.lit("")).alias("value"), "documents", F.coalesce("characters", F.lit(0)).alias("characters"))


def raw_stats(docs: DataFrame) -> DataFrame:
    """(tradition, language, documents, hymns) as spelled, null its own value; `hymns` counts titles or addresses of the Rigveda."""
    is_hymn = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("rigveda rv")) | F.contains(F.lower(F.coalesce("source_url", F.lit(""))), F.lit("/rigveda/"))
    return docs.groupBy("tradition", "language").agg(F.count("*").alias("documents"), F.count_if(is_hymn).alias("hymns"))


def tradition_table(docs: DataFrame) -> DataFrame:
    """(position, tradition, documents) of the known traditions; 0 where there are none. A nine-row dimension is broadcast."""
    spark = docs.sparkSession
    dim = spark.createDataFrame(list(enumerate(TRADITIONS, 1)), "position int, tradition string")
    counts = docs.groupBy(T.strip(F.lower("tradition")).alias("tradition")).agg(F.count("*").alias("documents"))
    return F.broadcast(dim).join(counts, "tradition", "left").select("position", "tradition", F.coalesce("documents", F.lit(0)).alias("documents"))


def lookup(docs: DataFrame, id_: str, order: str = "doc_id") -> DataFrame:
    """The first document of an id; the filter reaches the scan."""
    return docs.where(F.col("id") == id_).orderBy(order).limit(1)


def counts(**tables: DataFrame) -> DataFrame:
    """(table, rows) of the named tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
