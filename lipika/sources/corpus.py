"""Corpora, manifests, gold sets and other JSON inputs; JSONL and Parquet outputs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lipika.functions import fixed
from lipika.functions.text import strip


def _struct(strings: str, **others) -> StructType:
    return StructType([StructField(n, StringType()) for n in strings.split()] + [StructField(n, t) for n, t in others.items()])


DOCUMENT = _struct("id text source_url title tradition language license retrieved_at fingerprint attribution work", char_count=LongType(), book=IntegerType(), hymn=IntegerType())
SOURCE = _struct("title url tradition language license source_class note attribution", download=BooleanType(), tags=ArrayType(StringType()))
GOLD = _struct("id query tradition language", top_k=IntegerType(), min_hits=IntegerType(), expect_title_any=ArrayType(StringType()))
HIT = _struct("title text locator heading", score=DoubleType())
PAIR = _struct("query text passage document label query_id doc_title split pair_kind")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_corpus(spark: SparkSession, path: str, schema: StructType = DOCUMENT) -> DataFrame:
    """Records of a JSONL corpus. A missing path is the empty corpus; blank and malformed lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    rows = spark.read.text(path).where(strip(F.col("value")) != "").select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("r.*").where(F.col("_bad").isNull()).drop("_bad")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines of a JSONL corpus that are no JSON objects."""
    rows = spark.read.text(path).where(strip(F.col("value")) != "")
    return rows.where(F.try_parse_json("value").isNull() | ~F.startswith(strip(F.col("value")), F.lit("{")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text): stripped, non-empty texts of a corpus."""
    return read_corpus(spark, path).select(strip(F.col("text")).alias("text")).where("text <> ''")


def _listed(spark: SparkSession, path: str, field: str, kind: StructType) -> DataFrame:
    whole = spark.read.option("wholetext", "true").text(path)
    item = ArrayType(kind)
    nested = F.from_json("value", StructType([StructField(field, item)]))[field]
    bare = F.from_json("value", item)
    rows = F.when(strip(F.col("value")).startswith("["), bare).otherwise(nested)
    return whole.select(F.posexplode(rows).alias("ord", "r")).select("ord", "r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a manifest, `{"sources": [...]}` or a bare list, with their place in it."""
    return _listed(spark, path, "sources", SOURCE)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold queries, `{"queries": [...]}` or a bare list."""
    return _listed(spark, path, "queries", GOLD)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, hit columns) of rerank candidates: `{"queries": [{"id", "hits"}]}` or a map of id to hits."""
    item = StructType([StructField("id", StringType()), StructField("query_id", StringType()), StructField("hits", ArrayType(HIT)), StructField("candidates", ArrayType(HIT))])
    whole = spark.read.option("wholetext", "true").text(path)
    listed = F.from_json("value", StructType([StructField("queries", ArrayType(item))]))["queries"]
    by_list = whole.select(F.explode(listed).alias("q")).select(F.coalesce("q.id", "q.query_id").alias("query_id"), F.coalesce("q.hits", "q.candidates").alias("hits"))
    by_map = whole.where(listed.isNull()).select(F.explode(F.from_json("value", "map<string,array<struct<title:string,text:string,locator:string,heading:string,score:double>>>")).alias("query_id", "hits"))
    rows = by_list.unionByName(by_map).where(F.coalesce("query_id", F.lit("")) != "")
    return rows.select("query_id", F.posexplode("hits").alias("pos", "h")).select("query_id", (F.col("pos") + 1).alias("rank"), "h.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, text, label, query_id, doc_title, split, pair_kind) of a JSONL of training pairs.

    The text may be called text, passage or document; labels are numbers, true/false or positive/negative words; rows
    without query, text or a readable label are dropped."""
    rows = read_corpus(spark, path, PAIR)
    word = F.lower(strip(F.col("label")))
    label = F.when(word.isin("true", "yes", "positive", "pos", "relevant"), 1.0).when(word.isin("false", "no", "negative", "neg", "irrelevant"), 0.0).otherwise(word.try_cast("double"))
    text = F.coalesce(*(F.nullif(strip(F.col(c)), F.lit("")) for c in ("text", "passage", "document")))
    made = rows.select(F.nullif(strip(F.col("query")), F.lit("")).alias("query"), text.alias("text"), label.alias("label"), "query_id", "doc_title", F.coalesce("split", F.lit("train")).alias("split"), "pair_kind")
    return made.where("query is not null and text is not null and label is not null")


def read_config(path: str, default: dict | None = None) -> dict:
    """A small JSON document; the default where it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return dict(default or {})


def append(records: DataFrame, path: str) -> int:
    """Append records to a JSONL corpus; returns how many, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    records.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return int(seen.get["n"])


def rewrite(records: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace a stored table by way of a staging folder, so that a plan may read what it replaces."""
    spark = records.sparkSession
    staging, old = f"{path}.staging", f"{path}.old"
    records.write.mode("overwrite").format(form).save(staging)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.Path(old), True)
    if fs.exists(jvm.Path(path)):
        fs.rename(jvm.Path(path), jvm.Path(old))
    if not fs.rename(jvm.Path(staging), jvm.Path(path)):
        fs.rename(jvm.Path(old), jvm.Path(path))
        raise OSError(f"could not put {staging} in place of {path}")
    fs.delete(jvm.Path(old), True)
    spark.catalog.refreshByPath(path)


def hymn_manifest(spark: SparkSession, books: str = "1-10") -> DataFrame:
    """One source per hymn of the given books, `1,3-5` style."""
    spans = F.explode(F.flatten(F.transform(F.split(F.lit(books), ","), lambda s: F.sequence(F.split_part(s, F.lit("-"), F.lit(1)).cast("int"), F.split_part(s, F.lit("-"), F.lit(-1)).cast("int"))))).alias("book")
    many = F.element_at(F.array(*(F.lit(n) for n in fixed.HYMNS_PER_BOOK)), F.col("book"))
    rows = spark.range(1).select(spans).where("book between 1 and 10").select("book", F.explode(F.sequence(F.lit(1), many)).alias("hymn"))
    return rows.select(
        F.format_string("Rigveda RV %d.%d (Griffith, sacred-texts)", "book", "hymn").alias("title"),
        F.format_string("https://archive.sacred-texts.com/hin/rigveda/rv%02d%03d.htm", "book", "hymn").alias("url"),
        F.lit("vedic").alias("tradition"), F.lit("en").alias("language"), F.lit("public-domain").alias("license"), F.lit(True).alias("download"), F.lit("sacred-texts").alias("source_class"),
        F.array(F.lit("rigveda"), F.format_string("mandala-%d", "book")).alias("tags"),
    )


def sitemap_urls(pages: DataFrame, host: str) -> DataFrame:
    """(url): distinct addresses of one host in sitemap texts (column `value`), sorted."""
    urls = pages.select(F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url"))
    return urls.where(F.lower(F.try_parse_url("url", F.lit("HOST"))) == host.lower()).distinct().orderBy("url")
