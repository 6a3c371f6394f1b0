"""Problem 4: lines repeated across one site's documents.

Method: a per-site table of line counts is kept incrementally. A new partition of documents becomes a
delta (map-side combined counts), deltas merge by addition, the merge tells which lines crossed the
threshold, up or down. Rebuilt are the documents of the partition that hold a line over it, and of the older ones only
those that hold a line that crossed; always from the stored text and without all lines that are over then.

Two lines are the same if equal after collapsing white space, trimming, lower-casing and replacing each
run of 0-9 by `#`. A line counts once per document however often it stands there. Null texts have no
lines; documents without site belong to no site and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lipika.llm.labels import SPACE, site
from lipika.session import cut_lineage

MIN_CHARS, MIN_DOCS, MIN_SHARE = 20, 5, 0.10


def line_form(line: Column) -> Column:
    """The form in which lines are compared."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " "))), "[0-9]+", "#")


def keyed(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, site, keys): per line the 96-bit key of site and form, null for a line too short to count; columns to be
    carried along follow.

    This is the only pass over the text; it is written to the shared folder, as counting and finding both read it."""
    rows = docs.select("doc_id", *carried, site(F.col("source_url")).alias("site"), F.split("text", "\n", -1).alias("lines")).where("site is not null and lines is not null")

    def key(form: Column) -> Column:
        return F.when(F.length(form) >= MIN_CHARS, F.struct(F.xxhash64("site", form).alias("key"), F.hash(form, "site").alias("key2")))

    # lower-casing makes a string at most three times as long: shorter lines cannot reach the minimum
    forms = F.transform("lines", lambda x: F.when(F.length(x) * 3 >= MIN_CHARS, line_form(x)))
    return cut_lineage(rows.select("doc_id", "site", F.transform(forms, key).alias("keys"), *carried))


def line_delta(lines: DataFrame) -> DataFrame:
    """Line counts of one partition of `keyed` documents: (site, key, key2, n_docs).

    Distinctness within a document is settled before the exchange; the count is combined map-side."""
    rows = lines.select("site", F.explode(F.array_distinct(F.array_compact("keys"))).alias("k"))
    return rows.groupBy("site", "k.key", "k.key2").agg(F.count("*").alias("n_docs"))


def site_delta(docs: DataFrame) -> DataFrame:
    """Documents per site of one partition: (site, site_docs); documents with null text count."""
    return docs.select(site(F.col("source_url")).alias("site")).where("site is not null").groupBy("site").agg(F.count("*").alias("site_docs"))


def merge_counts(state: DataFrame | None, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The table after a delta: sums by key, cut from its lineage so that a state doesn't grow a plan. A missing state
    is the empty table."""
    return delta if state is None else cut_lineage(state.unionByName(delta).groupBy(*keys).agg(F.sum(value).alias(value)))


def crossed(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, key, key2) of the lines over the threshold. Rows under MIN_DOCS go before the join."""
    over = lines.where(F.col("n_docs") >= MIN_DOCS).join(sites, "site")
    return over.where(F.col("n_docs") >= F.col("site_docs") * MIN_SHARE).select("site", "key", "key2")


def newly_crossed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines over the threshold now and not before."""
    return after.join(before, ["site", "key", "key2"], "left_anti")


def repeated_lines(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, line_no) of the lines of `keyed` documents whose key is among `keys`."""
    rows = lines.select("doc_id", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("doc_id", (F.col("pos") + 1).alias("line_no"), "k.key", "k.key2")
    return rows.join(keys.select("key", "key2"), ["key", "key2"], "left_semi").select("doc_id", "line_no")


def rebuild(docs: DataFrame, lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, text, removed) of the documents that hold a line among `keys`, without those lines."""
    found = repeated_lines(lines, keys).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i + 1))
    return docs.join(found, "doc_id").select("doc_id", F.array_join(kept, "\n").alias("text"), F.size("gone").alias("removed"))


class LineCounts:
    """The incremental state: counts by (site, line) and by site, and the lines over the threshold.

    Lines once over may fall under it as a site grows; `add` returns those newly over, `over` those over now, `fallen`
    those that fell with the last partition (None before the second)."""

    def __init__(self, lines: DataFrame | None = None, sites: DataFrame | None = None) -> None:
        self.lines, self.sites = lines, sites
        self.over = crossed(lines, sites) if lines is not None and sites is not None else None
        self.fallen: DataFrame | None = None

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LineCounts:
        """The state a `save` left."""
        return LineCounts(spark.read.parquet(f"{folder}/lines.parquet"), spark.read.parquet(f"{folder}/sites.parquet"))

    def save(self, folder: str) -> None:
        """Write the state, to another folder than it was loaded from."""
        self.lines.write.parquet(f"{folder}/lines.parquet")
        self.sites.write.parquet(f"{folder}/sites.parquet")

    def add(self, docs: DataFrame, lines: DataFrame) -> DataFrame:
        """Merge a partition (documents and their `keyed` form); returns the lines newly over the threshold."""
        self.lines = merge_counts(self.lines, line_delta(lines), ["site", "key", "key2"], "n_docs")
        self.sites = merge_counts(self.sites, site_delta(docs), ["site"], "site_docs")
        before, self.over = self.over, crossed(self.lines, self.sites)
        self.fallen = None if before is None else newly_crossed(self.over, before)
        return self.over if before is None else newly_crossed(before, self.over)


def grown(*parts: DataFrame) -> DataFrame:
    """What `rebuild` gives for all documents together, reached partition by partition: after each, its own documents and
    those of the older ones that hold a line whose standing changed are rebuilt against all lines that are over then."""
    counts, docs, seen, state = LineCounts(), None, None, None
    for new in parts:
        lines = keyed(new)
        crossing = counts.add(new, lines)
        counts.over = cut_lineage(counts.over)
        fresh = rebuild(new, lines, counts.over)
        if state is None:
            docs, seen, state = new, lines, fresh
            continue
        touched = cut_lineage(repeated_lines(seen, crossing.unionByName(counts.fallen)).select("doc_id").distinct())
        again = rebuild(docs, seen.join(touched, "doc_id", "left_semi"), counts.over)
        state = state.join(touched, "doc_id", "left_anti").unionByName(again).unionByName(fresh)
        docs, seen = docs.unionByName(new), seen.unionByName(lines)
    return state
