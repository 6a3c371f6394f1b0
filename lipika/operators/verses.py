"""Verse lookup over chunk ranges, witnesses of a verse, padas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lipika.functions import refs, text as T

ROLES = ("sa", "iast", "en", "pt")


#: Ranges up to this many verses are taken apart and joined verse by verse.
SHORT_RANGE = 64


def cover(requests: DataFrame, chunks: DataFrame, most: int = 60) -> DataFrame:
    """Chunks that cover the requested verse ids: the exact id, or same work, book and hymn with the verse in range.

    A request without verse takes the whole hymn. `requests` has verse_id; at most `most` rows each, in corpus order. All
    joins are by key: ids, verses of short ranges, hymns for whole hymns; only the rare longer ranges (wrong `verse_end`s
    among them) are compared within their hymn."""
    parsed = requests.select("verse_id", refs.parse_verse_id(F.col("verse_id")).alias("p")).where("p is not null")
    want = parsed.select(F.col("verse_id").alias("asked"), F.col("p.work").alias("w"), F.col("p.book").alias("b"), F.col("p.hymn").alias("h"), F.col("p.verse").alias("target"))
    rows = chunks.where("work is not null")
    exact = rows.join(want.select("asked"), F.col("verse_id") == F.col("asked")).withColumn("exact", F.lit(True))
    same = (F.col("work") == F.col("w")) & F.col("book").eqNullSafe(F.col("b")) & F.col("hymn").eqNullSafe(F.col("h"))
    last = F.coalesce("verse_end", "verse")
    short = F.coalesce((last >= F.col("verse")) & (last - F.col("verse") < SHORT_RANGE), F.lit(False))
    verse, hymn = want.where("target is not null"), want.where("target is null")
    parts = (
        rows.where(short).withColumn("_v", F.explode(F.sequence(F.col("verse"), last))).join(verse, same & (F.col("_v") == F.col("target"))),
        rows.where(last - F.col("verse") >= SHORT_RANGE).withColumn("_v", F.lit(0)).join(verse, same & F.col("target").between(F.col("verse"), last)),
        rows.withColumn("_v", F.lit(0)).join(hymn, same),
    )
    ranged = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*chunks.columns, "asked")
    both = exact.unionByName(ranged.where(~F.col("verse_id").eqNullSafe(F.col("asked"))).withColumn("exact", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("doc_id", "chunk_index", "chunk_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def witnesses(covering: DataFrame) -> DataFrame:
    """(asked, role, chunk_id, doc_id, locator, language, text): one row per edition class of a verse, the first in corpus
    order, an exact match before others."""
    rows = covering.withColumn("role", refs.witness_role(F.col("title"), F.col("language")))
    first = F.row_number().over(Window.partitionBy("asked", "role").orderBy(F.desc("exact"), "rank"))
    return rows.withColumn("_n", first).where("_n = 1").select("asked", "role", "chunk_id", "doc_id", "locator", "language", "text")


def bundles(covering: DataFrame) -> DataFrame:
    """(asked, witnesses, has_sanskrit): witnesses as an array in role order."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role")), F.lit(0)), F.lit(99))
    rows = witnesses(covering).select("asked", F.struct(place.alias("place"), "role", "language", "doc_id", "locator", "text").alias("w"))
    made = rows.groupBy("asked").agg(F.array_sort(F.collect_list("w")).alias("w"))  # one entry per role
    return made.select("asked", F.transform("w", lambda x: x.dropFields("place")).alias("witnesses"), F.exists("w", lambda x: x["role"] == "sa").alias("has_sanskrit"))


def verse_body(text: Column, verse_id: Column) -> Column:
    """Text between the verse's `[XX n.n]` tag and the next; without its tag what stands before the first, else the first's."""
    tag = r"\[[A-Za-z]{2,4}\s\d[\dp.]*\]"
    wanted = F.upper(F.regexp_replace(T.strip(verse_id), r"^([^.]*)\.", "$1 "))
    tags = F.transform(F.regexp_extract_all(text, F.lit(f"({tag})"), F.lit(1)), lambda t: F.upper(F.regexp_replace(t, r"[\[\]]", "")))
    bodies = F.split(text, tag, -1)
    own = F.array_position(tags, wanted).cast("int")
    return T.strip(F.when(F.size(tags) < 1, text).when(own > 0, F.get(bodies, own)).when(T.strip(F.get(bodies, F.lit(0))) != "", F.get(bodies, F.lit(0))).otherwise(F.get(bodies, F.lit(1))))


def pada_array(text: Column) -> Column:
    """Parts between dandas, without parts that hold Devanagari digits; leading parts without accent before accented ones go."""
    parts = F.filter(F.transform(F.split(text, r"[।॥|]+", -1), T.strip), lambda p: (p != "") & ~p.rlike("[०-९]"))
    accented = F.transform(parts, lambda p: p.rlike(r"[\x{951}\x{952}]"))
    first = F.array_position(accented, F.lit(True)).cast("int")
    return F.when((F.size(parts) > 1) & (first > 1), F.slice(parts, first, F.size(parts))).otherwise(parts)


def padas(bodies: DataFrame) -> DataFrame:
    """(verse_id, index, sa, iast) of rows (verse_id, sa, iast): by the Sanskrit text, IAST beside it if the counts agree.

    A text without any danda is one pada; neither text gives none."""
    rows = bodies.select("verse_id", *(T.strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("sa", "iast")))
    rows = rows.select("verse_id", "sa", "iast", pada_array(F.col("sa")).alias("s"), pada_array(F.col("iast")).alias("i")).where("sa <> '' or iast <> ''")
    none = F.array().cast("array<string>")
    whole = (F.size("s") == 0) & (F.size("i") == 0)
    i = F.when((F.size("s") > 0) & (F.size("s") != F.size("i")), none).otherwise(F.col("i"))
    rows = rows.select("verse_id", F.when(whole, F.array("sa")).otherwise(F.col("s")).alias("s"), F.when(whole, F.array("iast")).otherwise(i).alias("i"))
    rows = rows.select("verse_id", F.posexplode(F.arrays_zip("s", "i")).alias("pos", "p"))
    return rows.select("verse_id", (F.col("pos") + 1).alias("index"), F.coalesce("p.s", F.lit("")).alias("sa"), F.coalesce("p.i", F.lit("")).alias("iast"))
