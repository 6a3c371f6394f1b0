"""A manifest run: gate, fetched texts, records by kind of source, dedupe against the corpus, counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lipika.functions import fixed, refs, text as T
from lipika.operators import dedupe, records
from lipika.session import cut_lineage
from lipika.sources import files, scripture

COUNTERS = ("total_sources", "accepted", "skipped_license", "skipped_download_flag", "failed", "empty_or_short", "duplicates", "added")
RECORD = ("id", "text", "source_url", "title", "tradition", "language", "license", "fingerprint", "char_count", "attribution", "work", "book", "hymn")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("title", StringType())]))
def _page(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Scripture and title of portal pages."""
    for s in pages:
        yield pd.DataFrame([(files.scripture(p), files.html_title(p)) for p in s], columns=["text", "title"])


def portal_records(rows: DataFrame) -> DataFrame:
    """Records of portal pages (ord, url, title, tradition, attribution, text): their Devanagari lines; pages without any give none."""
    stem = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"([^/_.-]+)[^/]*/?$", 1)
    rows = rows.withColumn("page", _page("text")).where(F.coalesce("page.text", F.lit("")) != "")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("page.title", F.lit("")), F.nullif(F.initcap(stem), F.lit("")), F.lit(fixed.PORTAL_TITLE))
    body = F.regexp_replace("page.text", "\n{3,}", "\n\n")
    made = rows.select("ord", "url", title.alias("title"), "tradition", "attribution", body.alias("text"), T.content_fingerprint(body).alias("fingerprint"), refs.portal_reference(F.col("url")).alias("ref"))
    return made.select(
        "ord", F.lit(1).alias("pos"), T.stable_id(F.col("url"), F.col("title"), F.substring("fingerprint", 1, 16)).alias("id"), "text", F.col("url").alias("source_url"), "title",
        F.lower(T.or_default(F.col("tradition"), "vedic")).alias("tradition"), F.lit("sa").alias("language"), F.lit(fixed.PORTAL_LICENSE).alias("license"), "fingerprint", F.length("text").alias("char_count"), "attribution",
        refs.detect_work(F.col("title"), F.col("url")).alias("work"), "ref.book", "ref.hymn",
    )


def ingest(sources: DataFrame, fetched: DataFrame, existing: DataFrame | None = None, min_chars: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new records, counters, errors) of one run over a manifest.

    `sources` has ord (unique, the order of the run), title, url, tradition, language, license, download, source_class and
    attribution; `fetched` has url (once each), text and error; `existing` the fingerprint and source_url of the corpus.
    A source passes the gate, then its page must be there; portal pages and structured payloads give their own records, other
    texts one each if they have `min_chars`. Records are deduplicated in order against the corpus and each other. Counters are
    (counter, value) rows; errors (url, error)."""
    gated = cut_lineage(records.gate(sources).join(fetched.select("url", "text", "error"), "url", "left"))
    broken = F.col("source_class").eqNullSafe(fixed.STRUCTURED_CLASS) & F.try_parse_json("text").isNull()
    ok = gated.where("reason = 'ok'").withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), "not fetched").when(broken, "no JSON")))
    failed = ok.where("error is not null").select("url", "error")
    there = ok.where("error is null")
    kind = F.when(F.col("source_class").eqNullSafe(fixed.PORTAL_CLASS), "portal").when(F.col("source_class").eqNullSafe(fixed.STRUCTURED_CLASS) | scripture.shape(F.col("text")).isNotNull(), "structured").otherwise("plain")
    there = cut_lineage(there.withColumn("kind", kind))
    plain = there.where("kind = 'plain'")
    long = plain.where(F.length("text") >= min_chars)
    built = records.build_records(long.withColumn("char_count", F.lit(None)), retrieved_at=F.col("ord").cast("string")).withColumn("ord", F.col("retrieved_at").cast("bigint"))
    built = built.join(long.select("ord", "attribution"), "ord")
    parts = [
        built.withColumn("pos", F.lit(1)),
        scripture.expand(there.where("kind = 'structured'").select("ord", "tradition", "license", "attribution", F.col("text").alias("payload"))),
        portal_records(there.where("kind = 'portal'")),
    ]
    made = None
    for part in parts:
        for c, t in (("work", "string"), ("book", "int"), ("hymn", "int")):
            if c not in part.columns:
                part = part.withColumn(c, F.lit(None).cast(t))
        part = part.select("ord", "pos", *RECORD)
        made = part if made is None else made.unionByName(part)
    made = cut_lineage(made.withColumn("place", F.col("ord") * 1_000_000 + F.col("pos")))
    new = cut_lineage(dedupe.greedy(made, "place", ("fingerprint", "source_url"), existing))
    none = there.where("kind <> 'plain'").select("ord").join(made.select("ord").distinct(), "ord", "left_anti")
    counts = {
        "total_sources": gated, "accepted": ok, "skipped_license": gated.where("reason not in ('ok', 'catalogue only')"), "skipped_download_flag": gated.where("reason = 'catalogue only'"),
        "failed": failed, "empty_or_short": plain.where(F.length("text") < min_chars).select("ord").unionByName(none), "duplicates": made.select("place").join(new.select("place"), "place", "left_anti"), "added": new,
    }
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "value")
        out = one if out is None else out.unionByName(one)
    return new.drop("place"), out, failed
