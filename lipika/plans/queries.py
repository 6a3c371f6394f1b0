"""Registered queries of the core: one per operator or small group, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lipika.functions import refs, text as T
from lipika.functions.sanskrit import fold_col, iast_col, spellings_col
from lipika.operators import catalog, chunking, dedupe, evaluation, hybrid, ingest, lexical, ranking, records, status, training, units, vectors, verses
from lipika.session import cut_lineage
from lipika.sources import scripture
from lipika.sources.corpus import hymn_manifest
from lipika.streaming import limiter
from lipika.tables import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

MODEL, SIZE = "mini-multi-64", 64
QUESTIONS = {"q1": "silent ocean of knowledge", "q2": "karma and dharma", "q3": "the dawn protects the altar", "q4": "agni"}
GOLD = (("q1", "silent ocean of knowledge", 3, ["ocean", "knowledge"]), ("q2", "karma and dharma", 1, ["duty"]), ("q3", "the dawn protects the altar", 5, ["dawn", "altar"]), ("q4", "agni", 1, ["fire"]))


def query(f: Query) -> Query:
    """Register under the function's name."""
    REGISTRY[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents", *columns)


def _texts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents whose texts are read in Python."""
    return spread_table(spark, sf, "documents", *columns)


@query
def flt_source_gate(spark, sf):
    """FLT-01: manifest rows with the first test they fail."""
    return records.gate(table(spark, sf, "manifest_sources")).select("title", "url", "reason")


@query
def prj_records(spark, sf):
    """PRJ-01, TXT-02, TXT-03: document records with stable ids and fingerprints."""
    rows = _docs(spark, sf, "source_url", "title", "tradition", "language", "license", "text").withColumnRenamed("source_url", "url")
    return records.build_records(rows, retrieved_at=F.lit("")).select("id", "fingerprint", "tradition", "language", "license", "char_count")


@query
def prj_summaries(spark, sf):
    """PRJ-06, PRJ-07, TXT-16: listing rows."""
    return records.summaries(_docs(spark, sf, "id", "doc_id", "title", "tradition", "language", "license", "n_chars", "text", "work", "source_url"))


@query
def txt_normalized(spark, sf):
    """TXT-01: digest of the white-space-normalised text."""
    return _docs(spark, sf, "doc_id", "text").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("digest"))


@query
def flt_devanagari(spark, sf):
    """FLT-05, AGG-17: documents with Devanagari and how much of it."""
    c = F.col("text")
    return _docs(spark, sf, "doc_id", "text").where(T.has_devanagari(c)).select("doc_id", T.devanagari_length(c).alias("letters"))


@query
def txt_iast(spark, sf):
    """TXT-05: digests of the texts with Devanagari in IAST."""
    return _texts(spark, sf, "doc_id", "text").where(T.has_devanagari(F.col("text"))).select("doc_id", F.md5(iast_col(F.col("text"))).alias("digest"))


@query
def txt_folded(spark, sf):
    """TXT-04: digests of the folded texts."""
    return _texts(spark, sf, "doc_id", "text").where("text is not null").select("doc_id", F.md5(fold_col(F.col("text"))).alias("digest"))


@query
def txt_spellings(spark, sf):
    """TXT-06, TXT-07: titles and their spellings, as a search tries them."""
    return _docs(spark, sf, "doc_id", "title").where("title is not null").select("doc_id", F.array_join(spellings_col(F.col("title")), "|").alias("spellings"))


@query
def txt_urls(spark, sf):
    """FLT-02 (without DNS), SRC-07, TXT-21, TXT-33: facts of addresses."""
    u = F.col("source_url")
    return _docs(spark, sf, "doc_id", "source_url").where("source_url is not null").select("doc_id", T.url_is_public(u).alias("public"), T.url_extension(u).alias("extension"), T.safe_name(T.canonical_url(u)).alias("name"))


@query
def txt_verse_ids(spark, sf):
    """TXT-12, TXT-13: ids and locators written from the structural columns."""
    rows = table(spark, sf, "chunks", "chunk_id", "work", "book", "hymn", "verse", "verse_end").where("work is not null").distinct()
    c = [F.col(x) for x in ("work", "book", "hymn", "verse")]
    return rows.select("chunk_id", refs.verse_id(*c).alias("made_id"), refs.locator(*c, F.col("verse_end")).alias("made_locator"))


@query
def txt_parsed_ids(spark, sf):
    """TXT-14: stored verse ids parsed."""
    rows = table(spark, sf, "chunks", "verse_id").where("verse_id is not null").distinct()
    return rows.select("verse_id", refs.parse_verse_id(F.col("verse_id")).alias("p")).select("verse_id", "p.work", "p.book", "p.hymn", "p.verse")


@query
def txt_citations(spark, sf):
    """PRJ-12: citation labels."""
    return table(spark, sf, "chunks", "locator", "title").groupBy(T.citation_label(F.col("locator"), F.col("title")).alias("label")).agg(F.count("*").alias("chunks"))


@query
def txt_slices(spark, sf):
    """WIN-09: texts in slices of 48 code points."""
    rows = table(spark, sf, "chunks", "chunk_id", "chunk_index", "text").distinct()
    rows = rows.select("chunk_id", "chunk_index", F.posexplode(T.slices(F.col("text"))).alias("pos", "piece"))
    return rows.groupBy("chunk_id", "chunk_index").agg(F.count("*").alias("pieces"), F.max_by("piece", "pos").alias("last"))


@query
def txt_vector_literals(spark, sf):
    """SNK-08: vectors as text."""
    rows = table(spark, sf, "chunk_embeddings", "chunk_id", "model_name", "created_at", "embedding").where((F.col("model_name") == MODEL) & vectors.usable(F.col("embedding"), SIZE))
    return rows.select("chunk_id", F.unix_micros("created_at").alias("at"), F.md5(T.vector_literal(F.col("embedding"))).alias("digest"))


@query
def agg_stats(spark, sf):
    """AGG-01, AGG-02: totals by tradition and language in one pass."""
    return catalog.stats(_docs(spark, sf, "tradition", "language", "n_chars", "text"))


@query
def agg_raw_stats(spark, sf):
    """AGG-03: counts as spelled."""
    return catalog.raw_stats(_docs(spark, sf, "tradition", "language", "title", "source_url"))


@query
def agg_facets(spark, sf):
    """SET-07, TOP-05: facet values."""
    return catalog.facets(_docs(spark, sf, "tradition", "language"))


@query
def agg_traditions(spark, sf):
    """JOI-10, TOP-08: the known traditions with their counts."""
    return catalog.tradition_table(_docs(spark, sf, "tradition"))


@query
def agg_table_counts(spark, sf):
    """AGG-04: rows of the three tables."""
    return catalog.counts(**{n: table(spark, sf, n) for n in ("documents", "chunks", "chunk_embeddings")})


@query
def agg_summary(spark, sf):
    """AGG-02: one-row summary."""
    return status.summary(_docs(spark, sf, "n_chars", "text", "tradition", "language", "work"))


@query
def agg_fingerprint(spark, sf):
    """AGG-05: order-independent digest of the corpus, as the stored locks have it."""
    return status.stored_fingerprint(_docs(spark, sf, "id", "fingerprint", "source_url", "title", "text"))


@query
def agg_bucket_fingerprint(spark, sf):
    """A digest of the same lines that no task has to sort whole."""
    return status.corpus_fingerprint(_docs(spark, sf, "id", "fingerprint", "source_url", "title", "text"))


@query
def agg_expectations(spark, sf):
    """AGG-14: rows that break the data model."""
    return status.expectations(_docs(spark, sf, "id", "text", "n_chars", "license", "language"))


@query
def agg_profiles(spark, sf):
    """FLT-23, AGG-14: which profiles the corpus meets."""
    facts = status.summary(_docs(spark, sf, "n_chars", "text", "tradition", "language", "work"))
    return status.matching_profiles(facts, {"tiny": {"max_documents": 100}, "some": {"min_documents": 101}, "many": {"min_documents": 5_000}, "exact": {"expected_documents": 1054}})


@query
def agg_embedding_quality(spark, sf):
    """SNK-07 (size check): usable vectors per model."""
    rows = table(spark, sf, "chunk_embeddings", "model_name", "embedding")
    return rows.groupBy("model_name").agg(F.count("*").alias("rows"), F.count_if(vectors.usable(F.col("embedding"), SIZE)).alias("usable"))


@query
def agg_metrics(spark, sf):
    """AGG-07, AGG-08: counts and sums by type and user group."""
    rows = table(spark, sf, "events", "event_type", "user_id", "value").withColumn("user_group", F.col("user_id") % 10)
    return limiter.counters(rows, "event_type", "user_group", value="value").withColumn("total", F.round("total", 4))


@query
def agg_exposition(spark, sf):
    """AGG-09: counters as sorted text lines."""
    return limiter.exposition(limiter.counters(table(spark, sf, "events", "event_type"), "event_type"), "events_total", ("event_type",))


@query
def top_total(spark, sf):
    """TOP-05: how many documents a filtered listing has in all."""
    return catalog.page_total(catalog.matching(_docs(spark, sf, "title", "text", "language", "source_url"), language="EN", q="ocean"))


@query
def snk_synced(spark, sf):
    """SNK-05: upsert, then purge of what the source doesn't hold; its counters."""
    target = dedupe.first_per_key(table(spark, sf, "manifest_sources", "url", "title", "language", "attribution"), ["url"], [F.col("title"), F.col("language")])
    return dedupe.synced(target, target.where("language = 'en'"), "url", ("attribution",))[1]


@query
def snk_replaced(spark, sf):
    """SNK-07: the chunks of changed documents in place of their old ones."""
    chunks = table(spark, sf, "chunks", "doc_id", "chunk_id", "chunk_index").distinct()
    changed = _docs(spark, sf, "doc_id", "retrieved_at").where("retrieved_at >= timestamp'2025-01-01'").select("doc_id")
    fresh = chunks.join(changed, "doc_id", "left_semi").where("chunk_index = 0").withColumn("chunk_id", F.concat(F.lit("new-"), "chunk_id"))
    return dedupe.replace_documents(chunks, fresh, changed=changed)


@query
def set_preferred(spark, sf):
    """SET-06: one hymn each, the one with the longest address."""
    rows = _docs(spark, sf, "doc_id", "book", "hymn", "source_url").where("source_url is not null and book is not null and hymn is not null")
    return dedupe.preferred(rows, ["book", "hymn"], "source_url", "doc_id")


@query
def top_page(spark, sf):
    """TOP-05, FLT-26: one page of a filtered listing."""
    return catalog.page(catalog.matching(_docs(spark, sf, "doc_id", "title", "text", "tradition", "language", "source_url"), language="EN", q="ocean"), "doc_id", 25, 10).select("doc_id", "title", "language")


@query
def top_lookup(spark, sf):
    """TOP-06: point lookup of the id that comes first in the alphabet."""
    docs = _docs(spark, sf, "doc_id", "id", "title")
    first = docs.agg(F.min("id")).first()[0] or ""
    return catalog.lookup(docs, first)


@query
def win_chunks(spark, sf):
    """WIN-04: character windows."""
    rows = chunking.window_chunks(_texts(spark, sf, "doc_id", "text"))
    return rows.select("doc_id", "chunk_index", F.md5("text").alias("digest"), "char_count")


DOCUMENT = ("doc_id", "id", "text", "title", "source_url", "tradition", "language", "license", "work", "book", "hymn")


@query
def par_units(spark, sf):
    """PAR-01..07: verse units of the documents that have a structure."""
    rows = units.parse_units(_texts(spark, sf, *DOCUMENT)).select("doc_id", F.posexplode("units").alias("pos", "u"))
    return rows.select("doc_id", "pos", "u.verse_id", "u.locator", "u.verse", "u.heading", F.md5("u.text").alias("digest"))


@query
def win_documents_chunked(spark, sf):
    """WIN-03, WIN-05, PRJ-04, PRJ-05: chunks of all documents."""
    rows = chunking.chunk_documents(_texts(spark, sf, *DOCUMENT))
    return rows.select("chunk_id", "doc_id", "chunk_index", "char_count", "work", "verse_id", "verse_end", "locator")


@query
def set_greedy(spark, sf):
    """SET-01: order-dependent dedupe by fingerprint or address."""
    return dedupe.greedy(_docs(spark, sf, "doc_id", "fingerprint", "source_url"), "doc_id", ("fingerprint", "source_url")).select("doc_id")


@query
def joi_new_records(spark, sf):
    """JOI-09, SET-08: dedupe of later records against earlier ones."""
    docs = _docs(spark, sf, "doc_id", "fingerprint", "source_url")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    return dedupe.greedy(docs.where(F.col("doc_id") > middle), "doc_id", ("fingerprint", "source_url"), docs.where(F.col("doc_id") <= middle)).select("doc_id")


@query
def joi_superseded(spark, sf):
    """JOI-05: sample texts that a longer edition replaces are dropped."""
    return dedupe.superseded_samples(_docs(spark, sf, "doc_id", "title", "source_url", "language", "text")).select("doc_id")


@query
def joi_cascade(spark, sf):
    """JOI-06, JOI-07, JOI-12: what stays when undated documents go."""
    docs = _docs(spark, sf, "doc_id", "retrieved_at").where("retrieved_at is not null")
    chunks, embeddings = dedupe.cascade(docs, table(spark, sf, "chunks", "doc_id", "chunk_id"), table(spark, sf, "chunk_embeddings", "chunk_id", "model_name"))
    return chunks.select("chunk_id", F.lit("").alias("model_name")).unionByName(embeddings)


@query
def snk_upsert(spark, sf):
    """SNK-04, SNK-05: manifest labels merged, keeping the stored attribution."""
    sources = table(spark, sf, "manifest_sources", "url", "title", "language", "attribution")
    target = dedupe.first_per_key(sources, ["url"], [F.col("title"), F.col("language")])
    new = target.where(F.col("language") == "en").select("url", F.upper("title").alias("title"), "language", F.lit("new").alias("attribution"))
    return dedupe.upsert(target, new, "url", ("attribution",))


@query
def joi_current_vectors(spark, sf):
    """JOI-01, SRC-19: chunks with their current vector (its size and first number)."""
    vec = vectors.current(table(spark, sf, "chunk_embeddings"), MODEL, SIZE)
    chunks = table(spark, sf, "chunks", "chunk_id", "doc_id", "language").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    return chunks.join(vec, "chunk_id").select("chunk_id", "doc_id", F.size("embedding").alias("size"), F.round(F.get("embedding", F.lit(0)), 5).alias("first"))


def _query_vector(vec: DataFrame) -> list[float]:
    row = vec.orderBy("chunk_id").limit(1).collect()
    return list(row[0]["embedding"]) if row else [0.0] * SIZE


@query
def top_vectors(spark, sf):
    """TOP-01, TOP-02, VEC-03: exact cosine top-k for one vector."""
    vec = vectors.current(table(spark, sf, "chunk_embeddings"), MODEL, SIZE)
    return vectors.top_k(vec, _query_vector(vec), 20)


@query
def top_vectors_batch(spark, sf):
    """TOP-04, QRY-01: exact cosine top-k for several vectors."""
    vec = vectors.current(spread_table(spark, sf, "chunk_embeddings", "chunk_id", "model_name", "created_at", "embedding"), MODEL, SIZE)
    rows = vec.orderBy("chunk_id").limit(5).collect()
    hits = vectors.top_k_batch(vec, {r["chunk_id"]: list(r["embedding"]) for r in rows}, 10)
    return hits.select("query_id", "chunk_id", F.round("score", 4).alias("score"))


CHUNK = ("chunk_id", "doc_id", "chunk_index", "created_at", "title", "work", "locator", "heading", "text")


def _first(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id."""
    return dedupe.first_per_key(chunks, ["chunk_id"], [F.col("created_at"), F.col("doc_id")])


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with the hits of the asked terms, terms): repeated chunks go when the text is gone."""
    terms = lexical.query_terms(spark, QUESTIONS)
    rows = lexical.with_hits(spread_table(spark, sf, "chunks", *CHUNK), terms).select("chunk_id", "doc_id", "created_at", "title", "dl", "hits")
    return cut_lineage(_first(rows)), terms


@query
def agg_bm25(spark, sf):
    """AGG-10, TOP-03, TXT-08, TXT-09: BM25 of a set of queries."""
    return lexical.top(lexical.bm25(*_hits(spark, sf)), 10).select("query_id", "rank", "chunk_id", F.round("score", 3).alias("score"))


@query
def win_diversified(spark, sf):
    """WIN-02: at most two hits of a document."""
    chunks, terms = _hits(spark, sf)
    hits = lexical.top(lexical.bm25(chunks, terms), 200).join(chunks.select("chunk_id", "doc_id", "title"), "chunk_id")
    return ranking.diversify(hits.drop("rank"), 10).select("query_id", "rank", "chunk_id", "doc_id")


def _two_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of each question: BM25 with and without regard to length."""
    chunks, terms = _hits(spark, sf)
    lists = [lexical.top(lexical.bm25(chunks, terms, b=b), 50).select("query_id", F.lit(n).alias("list"), "chunk_id", "rank") for n, b in enumerate((0.75, 0.0))]
    return lists[0].unionByName(lists[1])


@query
def win_fused(spark, sf):
    """WIN-01: reciprocal rank fusion of two rankings."""
    return ranking.reciprocal_rank_fusion(_two_lists(spark, sf)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query
def set_union(spark, sf):
    """SET-03: ordered union of two rankings, the first occurrence of a chunk counts."""
    return ranking.union_first(_two_lists(spark, sf), ["list", "rank"])


#: One question of each kind: none named, a hymn, a work, a deity.
ASKED = {"plain": "silent ocean of knowledge", "hymn": "rigveda 1.1", "work": "yoga sutra practice", "deity": "agni"}


@query
def qry_hybrid(spark, sf):
    """SCO-01..07, SET-04, TOP-10..12, QRY-01: hybrid search, one question of each kind."""
    chunks = spread_table(spark, sf, "chunks", *CHUNK).withColumn("ord", F.col("doc_id") * 100_000 + F.col("chunk_index"))
    terms = lexical.query_terms(spark, ASKED)
    # the lexical scores of all questions in one pass
    scores = lexical.bm25(cut_lineage(_first(lexical.with_hits(chunks, terms).select("chunk_id", "doc_id", "created_at", "dl", "hits"))), terms)
    scores = cut_lineage(lexical.top(scores, 36))
    chunks = _first(chunks)
    vec = vectors.current(table(spark, sf, "chunk_embeddings"), MODEL, SIZE)
    dense = cut_lineage(vectors.top_k(vec, _query_vector(vec), 36))
    dense = dense.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # 36 rows
    out = None
    for name, question in ASKED.items():
        mine = scores.where(F.col("query_id") == name).select(F.lit("q").alias("query_id"), "chunk_id", "score")
        hits = hybrid.search(chunks, dense, question, 8, scores=mine)
        hits = hits.select(F.lit(name).alias("question"), "rank", "chunk_id", "score", "fused", "shape", "hymn_boost", "work_boost", "deity_boost", "phrase_boost", "demotion")
        out = hits if out is None else out.unionByName(hits)
    return out


@query
def evl_suite(spark, sf):
    """AGG-11, AGG-12, FLT-22: a gold suite over the lexical hits."""
    chunks, terms = _hits(spark, sf)
    hits = lexical.top(lexical.bm25(chunks, terms), 10).join(chunks.select("chunk_id", "title"), "chunk_id")
    gold = spark.createDataFrame([(i, m, e) for i, _, m, e in GOLD], "id string, min_hits int, expect_title_any array<string>")
    return evaluation.suite(gold, hits).select("id", "hits", "matched", "ok")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    chunks, terms = _hits(spark, sf)
    gold = spark.createDataFrame([(i, q, e) for i, q, _, e in GOLD], "query_id string, query string, expect_title_any array<string>")
    hits = cut_lineage(lexical.top(lexical.bm25(chunks, terms), 40))  # 40 rows a question
    texts = _first(table(spark, sf, "chunks", *CHUNK).join(F.broadcast(hits.select("chunk_id").distinct()), "chunk_id", "left_semi"))
    hits = hits.join(texts.select("chunk_id", "title", "locator", "heading", "text"), "chunk_id").join(F.broadcast(gold), "query_id").withColumn("split", F.lit("train"))
    return evaluation.pairs(hits)


@query
def evl_pairs(spark, sf):
    """WIN-07, JOI-11, PRJ-08: weak training pairs."""
    return _pairs(spark, sf).select("query_id", "rank", "label", "pair_kind", "split", "doc_title", F.md5("text").alias("digest"))


@query
def evl_pair_summary(spark, sf):
    """AGG-06: weak training pairs, counted by split."""
    return evaluation.pair_summary(_pairs(spark, sf))


@query
def evl_splits(spark, sf):
    """WIN-06: hold-out by id, over the manifest's addresses."""
    return evaluation.splits(table(spark, sf, "manifest_sources").select(F.col("url").alias("query_id")), pinned=())


@query
def src_hymn_manifest(spark, sf):
    """SRC-28, SRC-29: generated manifest of all hymns."""
    return hymn_manifest(spark).groupBy(F.element_at("tags", 2).alias("book")).agg(F.count("*").alias("hymns"), F.max("url").alias("last"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks", "verse_id").where("verse_id is not null").distinct()


@query
def joi_verse_cover(spark, sf):
    """JOI-03, JOI-04, FLT-11: chunks that cover each stored verse id."""
    cols = ("chunk_id", "doc_id", "chunk_index", "verse_id", "work", "book", "hymn", "verse", "verse_end", "title", "language", "locator", "text")
    found = verses.cover(_requests(spark, sf), table(spark, sf, "chunks", *cols))
    return found.select("asked", "rank", "chunk_id", "exact")


@query
def agg_witnesses(spark, sf):
    """AGG-15, TXT-28: edition classes of each verse."""
    cols = ("chunk_id", "doc_id", "chunk_index", "verse_id", "work", "book", "hymn", "verse", "verse_end", "title", "language", "locator", "text")
    found = verses.bundles(verses.cover(_requests(spark, sf), table(spark, sf, "chunks", *cols)))
    return found.select("asked", F.array_join(F.transform("witnesses", lambda w: w["role"]), ",").alias("roles"), "has_sanskrit")


@query
def par_padas(spark, sf):
    """PAR-08: padas of Sanskrit chunks."""
    rows = table(spark, sf, "chunks", "chunk_id", "text", "verse_id", "language").where(F.lower("language") == "sa").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return rows.select("chunk_id", F.posexplode(verses.pada_array(F.col("text"))).alias("pos", "pada")).select("chunk_id", "pos", "pada")


@query
def str_rate_limit(spark, sf):
    """WIN-08, STR-02 (batch form): one-day windows anchored at each user's first event, two allowed."""
    rows = ranking.windows_by_first(table(spark, sf, "events", "event_id", "ts", "user_id"), ["user_id"], "ts", 86_400, 2, ("event_id",))
    return rows.select("event_id", "user_id", F.unix_micros("window_start").alias("started"), "allowed")


def _words() -> training.Encode:
    """The words of a text, numbered by their digest: an encoder that needs no file."""
    return lambda texts: [[zlib.crc32(w.encode()) & 0x7FFFFFFF for w in t.split()] for t in texts]


@query
def ml_packed_blocks(spark, sf):
    """ML-02 (data part): token blocks of fixed size, over the documents of each partition in turn."""
    return training.blocks(_texts(spark, sf, "text"), lambda: _words(), 512).select(F.size("block").alias("tokens"), F.md5(F.array_join("block", ",")).alias("digest"))


@query
def ml_compression(spark, sf):
    """AGG-13: code points per token of a tokenizer."""
    return training.compression(_texts(spark, sf, "text"), lambda: _words())


def _fetched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(sources with their place, pages): a source's page is the first document of its host."""
    host = lambda c: F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")
    sources = table(spark, sf, "manifest_sources", "title", "url", "tradition", "language", "license", "download", "source_class", "attribution")
    place = F.row_number().over(Window.orderBy("url", F.col("title").asc_nulls_first(), F.col("language").asc_nulls_first(), F.col("tradition").asc_nulls_first()))  # a manifest
    pages = _docs(spark, sf, "doc_id", "source_url", "text").withColumn("host", host(F.col("source_url"))).where("host is not null and text is not null").groupBy("host").agg(F.min_by("text", "doc_id").alias("text"))
    urls = sources.select("url", host(F.col("url")).alias("host")).where("host is not null").distinct()
    return sources.withColumn("ord", place.cast("bigint")), urls.join(pages, "host").select("url", "text", F.lit(None).cast("string").alias("error"))


@query
def qry_ingest(spark, sf):
    """QRY-06: a manifest run's counters, over pages found by host."""
    return ingest.ingest(*_fetched(spark, sf))[1]


@query
def jsn_records(spark, sf):
    """JSN-01..06, JSN-10, SRC-15, PRJ-02: hymns and chapters of the structured chunks, written as payloads and expanded."""
    cols = ("chunk_id", "work", "book", "hymn", "verse", "text")
    rows = table(spark, sf, "chunks", *cols).where("work in ('rigveda', 'atharvaveda', 'bhagavad-gita') and book is not null and verse is not null and text is not null").distinct()
    rows = rows.where("work = 'bhagavad-gita' or hymn is not null").groupBy("work", "book", "hymn", "verse").agg(F.min(T.normalize_whitespace(F.col("text"))).alias("text")).where("text <> ''")
    verse = F.transform(F.array_sort(F.collect_list(F.struct("verse", "text"))), lambda v: F.struct(v["verse"].alias("n"), v["text"].alias("text")))
    hymns = rows.groupBy("work", "book", "hymn").agg(verse.alias("verses"))
    item = F.struct("hymn", F.col("hymn").alias("sukta"), "verses")
    chapter = F.to_json(F.struct("work", F.col("book").alias("chapter"), F.transform("verses", lambda v: F.struct(v["n"].alias("verse"), v["text"].alias("text"))).alias("verses")))
    volume = F.to_json(F.struct("work", F.col("book").alias("mandala"), F.array(item).alias("suktas")))
    payload = F.when(F.col("work") == "bhagavad-gita", chapter).otherwise(volume)
    payloads = hymns.select(F.xxhash64("work", "book", "hymn").alias("ord"), F.lit(None).cast("string").alias("tradition"), F.lit("cc0").alias("license"), F.lit(None).cast("string").alias("attribution"), payload.alias("payload"))
    return scripture.expand(payloads).select("id", "title", "source_url", "tradition", "language", "license", "char_count", "fingerprint")


def queries() -> dict[str, Query]:
    """Name to query."""
    return dict(REGISTRY)
