"""Corpus digest, profile checks, data expectations."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from lipika.functions.text import content_fingerprint


def _line() -> Column:
    """"id|fingerprint"; a missing id is the address or the title, a missing fingerprint is made from the text."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.coalesce(some("id"), some("source_url"), some("title"), F.lit("")), F.lit("|"), F.coalesce(some("fingerprint"), content_fingerprint(F.coalesce("text", F.lit("")))))


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """(fingerprint): digest of the corpus's "id|fingerprint" lines whatever their order; '' for no rows.

    Lines are digested per bucket (the first four hex digits of their md5), so that no task sorts them all; the at most
    65 536 bucket digests are digested once more in bucket order. Repeated lines count."""
    rows = docs.select(_line().alias("line")).withColumn("bucket", F.substring(F.md5("line"), 1, 4))
    per = rows.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), "\n")
    return per.agg(F.when(F.count("*") > 0, F.sha2(whole, 256)).otherwise("").alias("fingerprint"))


def stored_fingerprint(docs: DataFrame) -> DataFrame:
    """(fingerprint): sha256 of all sorted lines at once, as older locks have it; '' for no rows.

    The sort is distributed; the digest is sequential by definition, so one task streams over the sorted lines and holds
    one batch of them."""

    def digest(batches):
        import hashlib

        import pyarrow as pa

        h, any_line = hashlib.sha256(), False
        for b in batches:
            for line in b.column(0).to_pylist():
                h.update((b"\n" if any_line else b"") + line.encode())
                any_line = True
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest() if any_line else ""])], names=["fingerprint"])

    found = docs.select(_line().alias("line")).orderBy("line").coalesce(1).mapInArrow(digest, "fingerprint string")
    return found.agg(F.coalesce(F.max("fingerprint"), F.lit("")).alias("fingerprint"))  # no rows have no partition


def lock(docs: DataFrame, profile: str | None = None) -> dict:
    """The lock document of a corpus: its summary, its digest, and the profile it was built for."""
    facts = summary(docs).first().asDict()
    return facts | {"fingerprint": stored_fingerprint(docs).first()[0], "profile": profile}


def write_json(document: dict, path: str) -> None:
    """Write a small document in one step, so that a reader sees the old or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fresh = target.with_name(f".{target.name}.{os.getpid()}")
    fresh.write_text(json.dumps(document, ensure_ascii=False, sort_keys=True, default=str), encoding="utf-8")
    fresh.replace(target)


def changed(docs: DataFrame, locked: dict) -> bool:
    """Whether a corpus is another than its lock says."""
    return stored_fingerprint(docs).first()[0] != locked.get("fingerprint")


def summary(docs: DataFrame) -> DataFrame:
    """(documents, characters, traditions, languages, works) in one row."""
    size = F.coalesce(F.nullif("n_chars", F.lit(0)), F.length("text").cast("bigint"), F.lit(0))
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(size), F.lit(0)).alias("characters"), *(F.countDistinct(F.lower(c)).alias(f"{c}s") for c in ("tradition", "language", "work")))


def matching_profiles(facts: DataFrame, profiles: dict[str, dict]) -> DataFrame:
    """(profile, ok, issue) of each profile's bounds (min_documents, max_documents, expected_documents) on a one-row summary."""
    spark = facts.sparkSession
    rows = [(k, *(v.get(f"{b}_documents") for b in ("min", "max", "expected"))) for k, v in profiles.items()]
    bounds = spark.createDataFrame(rows, "profile string, low long, high long, expected long")
    n = facts.first()["documents"]
    issue = F.when(F.col("low") > n, "too few documents").when(F.col("high") < n, "too many documents").when(F.col("expected") != n, "not the expected number")
    return bounds.select("profile", issue.isNull().alias("ok"), F.coalesce(issue, F.lit("")).alias("issue"))


def expectations(docs: DataFrame) -> DataFrame:
    """(check, failures): counts of rows that break the data model."""
    checks = {
        "id missing": F.coalesce("id", F.lit("")) == "",
        "text missing": F.coalesce("text", F.lit("")) == "",
        "size wrong": F.coalesce("n_chars", F.lit(-1)) != F.length(F.coalesce("text", F.lit(""))),
        "license missing": F.coalesce("license", F.lit("")) == "",
        "language missing": F.coalesce("language", F.lit("")) == "",
    }
    one = docs.agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("failures")) for k in checks))).alias("c")).select("c.check", "c.failures")
