"""Order-dependent deduplication, superseded rows, anti- and semi-joins on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lipika.session import cut_lineage

#: Works whose short sample texts a longer edition replaces, by title.
SAMPLE_WORKS = (
    ("bhagavad-gita", r"\bbhagavad[- ]?g[iī]t[aā]\b|\bg[iī]t[aā]\b"),
    ("yoga-sutra", r"\byoga[- ]s[uū]tras?\b|\bpatanjali\b|\bpatañjali\b"),
    ("isha-upanishad", r"\b[iī]sha\b|\b[iī]ś[aā]\b|\bisa upanishad\b"),
    ("ramayana", r"\br[aā]m[aā]yan|\bvalmiki\b|\bvālmīki\b"),
    ("mahabharata", r"\bmah[aā]bh[aā]rat|\bganguli\b"),
)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of the undirected `pairs` (u, v).

    Alternating stars: every node first hands its larger neighbours to its smallest one, then the smaller ones; the
    number of rounds grows with the logarithm of a component's length, and pairs never outgrow the nodes and pairs given."""
    edges = cut_lineage(pairs.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _walked(undecided: DataFrame, order: str, keys: tuple[str, str]) -> DataFrame:
    """(order, keys) of the rows that walking in order keeps, component by component of rows that share keys."""
    a, b = keys
    firsts = [undecided.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias("v")) for k in keys]
    links = [undecided.select(F.col(order).alias("u"), k).join(first, k).select("u", "v") for k, first in zip(keys, firsts, strict=True)]
    roots = components(links[0].unionByName(links[1]))
    rows = undecided.join(roots.withColumnRenamed("node", order), order, "left").withColumn("root", F.coalesce("root", F.col(order)))

    def walk(group):
        seen, keep = (set(), set()), []
        for row in group.sort_values(order)[[order, a, b]].itertuples(index=False):
            own = [(s, k) for s, k in zip(seen, row[1:], strict=True) if isinstance(k, str) and k]
            if not any(k in s for s, k in own):
                keep.append(row[0])
                for s, k in own:
                    s.add(k)
        return group[group[order].isin(keep)][[order, a, b]]

    return rows.select("root", order, a, b).groupBy("root").applyInPandas(walk, undecided.select(order, a, b).schema)


def greedy(records: DataFrame, order: str, keys: tuple[str, str], existing: DataFrame | None = None, rounds: int = 8) -> DataFrame:
    """Records kept by walking in `order` and dropping a row if either key was seen among rows kept before.

    An empty or null key never matches. Not two dropDuplicates: a dropped row does not register its other key. Rounds
    of "keep each undecided row that is first in both its groups, then drop what shares a key with a kept row" reach
    the same set; only (order, keys) take part, and each round's state is cut from its lineage. Duplicates of both
    keys settle before the rounds, so a third of all rows being copies costs one aggregation. What `rounds` leave
    undecided are long chains of shared keys; they are walked within their connected components.

    `existing` (same key columns) counts as kept before. Repeated order values are allowed if the rows are equal."""
    a, b = keys
    clean = [F.nullif(F.col(k), F.lit("")).alias(k) for k in keys]
    todo = records.select(order, *clean)
    if existing is not None:
        for k in keys:
            seen = existing.select(F.nullif(F.col(k), F.lit("")).alias(k)).where(F.col(k).isNotNull()).distinct()
            todo = todo.join(seen, k, "left_anti")
    firsts = todo.where(F.col(a).isNotNull() | F.col(b).isNotNull()).groupBy(a, b).agg(F.min(order).alias(order))
    free = todo.where(F.col(a).isNull() & F.col(b).isNull()).select(order)
    undecided, kept = cut_lineage(firsts), free
    for _ in range(rounds):
        # a row is first in a group if it is the group's minimum: aggregations combine before the exchange, windows don't
        winners = undecided
        for k in keys:
            first = undecided.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(order)).select(order)
            winners = winners.join(first.unionByName(undecided.where(F.col(k).isNull()).select(order)), order, "left_semi")
        winners = cut_lineage(winners.select(order, a, b))
        kept = kept.unionByName(winners.select(order))
        rest = undecided.join(winners.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(winners.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
        undecided = cut_lineage(rest.select(order, a, b))
        if undecided.isEmpty():
            break
    else:
        kept = kept.unionByName(_walked(undecided, order, keys).select(order))
    return records.join(kept, order, "left_semi")


def preferred(rows: DataFrame, keys: list[str], url: str, order: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row per keys, of several the one with the longest address, then the first; addresses in `drop` go first.
    Rows without keys stay. Sorted by keys and address."""
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    rows = rows.where(~F.coalesce(F.col(url).isin(*drop), F.lit(False))) if drop else rows
    best = first_per_key(rows.where(named), keys, [F.desc(F.length(url)), F.col(order)])
    return best.unionByName(rows.where(~named)).orderBy(*keys, url)


def superseded_samples(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """`docs` without sample rows (address under fixtures/) of a work and language that has another text at least three times as long."""
    work = F.lit(None).cast("string")
    for name, pattern in reversed(SAMPLE_WORKS):
        work = F.when(F.coalesce(F.lower(F.col("title")).rlike(f"(?iu){pattern}"), F.lit(False)), name).otherwise(work)
    url = F.trim(F.coalesce("source_url", F.lit("")))
    sample = url.startswith("fixtures/") | url.contains("/fixtures/")
    language = F.lower(F.coalesce(F.nullif("language", F.lit("")), F.lit("en")))
    rows = docs.select(order, work.alias("work_key"), language.alias("lang_key"), sample.alias("sample"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    best = rows.where(~F.col("sample") & F.col("work_key").isNotNull()).groupBy("work_key", "lang_key").agg(F.max("size").alias("best"))
    gone = rows.where("sample").join(best, ["work_key", "lang_key"]).where(F.col("best") >= 3 * F.greatest("size", F.lit(1))).select(order)
    return docs.join(gone, order, "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in `order`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(target: DataFrame, source: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """`target` with `source` merged in by key; columns in `keep` of an existing row stay as they were.

    `source` must hold a key once. Columns are the target's."""
    old = target.select(key, *(F.col(c).alias(f"_old_{c}") for c in keep), F.lit(True).alias("_known"))
    new = source.join(old, key, "left")
    for c in keep:
        new = new.withColumn(c, F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    return target.join(source.select(key), key, "left_anti").unionByName(new.select(*target.columns))


def replace_documents(index: DataFrame, fresh: DataFrame, doc: str = "doc_id", changed: DataFrame | None = None) -> DataFrame:
    """`index` with all rows of the changed documents replaced by those of `fresh`; without `changed`, of the documents in
    `fresh`. A changed document without fresh rows is gone from the index; rows of others stay as they are."""
    gone = (fresh if changed is None else changed).select(doc).distinct()
    return index.join(gone, doc, "left_anti").unionByName(fresh.select(*index.columns))


def synced(target: DataFrame, source: DataFrame, key: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(target after the run, counters): all of `source` merged in, then rows whose key is not in it purged.

    An empty source purges everything. Counters are (counter, value) rows: synced and purged."""
    kept, purged = purge(upsert(target, source, key, keep), source, key)
    counts = source.agg(F.count("*").alias("value")).select(F.lit("synced").alias("counter"), "value").unionByName(purged.agg(F.count("*").alias("value")).select(F.lit("purged").alias("counter"), "value"))
    return kept, counts


def purge(target: DataFrame, kept: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in `kept`, rows whose key is not)."""
    ids = kept.select(key)
    return target.join(ids, key, "left_semi"), target.join(ids, key, "left_anti")


def cascade(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents that exist and embeddings of those chunks."""
    chunks = chunks.join(docs.select("doc_id"), "doc_id", "left_semi")
    return chunks, embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
