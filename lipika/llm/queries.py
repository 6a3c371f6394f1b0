"""The registered queries of this package: pN_... over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lipika.llm import canonical, language, lines, mixture, neighbours, packing, scans, splitting, tokens, truncation
from lipika.session import cut_lineage
from lipika.tables import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]


def _pieces(spark: SparkSession, sf: str) -> tokens.Pieces:
    return tokens.load_pieces(spark, table(spark, sf, "tokenizer_vocab"))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the documents over 4 000 and the chunks over 800 code points."""
    docs = splitting.split_items(spread_table(spark, sf, "documents", "doc_id", "text"), splitting.DOCUMENT_LIMIT, 200, "doc_id")
    chunks = splitting.split_items(spread_table(spark, sf, "chunks", "chunk_id", "text"), splitting.CHUNK_LIMIT, 100, "chunk_id")
    return docs.withColumn("item_kind", F.lit("document")).unionByName(chunks.withColumn("item_kind", F.lit("chunk")))


def p1_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Where the pieces end: kinds of cuts, and the depth of the valleys at them beside that of their windows."""
    return splitting.cut_quality(p1_pieces(spark, sf), "item_kind")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items that had to be split, and the verses the pieces of verse chunks hold."""
    docs = splitting.split_items(spread_table(spark, sf, "documents", "doc_id", "text"), splitting.DOCUMENT_LIMIT, 200, "doc_id")
    # the two stored kinds of chunk go through one split: with a verse column, and without
    chunks = spread_table(spark, sf, "chunks", "chunk_id", "text", "verse")
    key = F.concat_ws(":", "chunk_id", F.col("verse").isNotNull().cast("string"))
    parts = splitting.split_items(chunks.withColumn("key", key), splitting.CHUNK_LIMIT, 100, "key")
    item, in_verse = F.split_part("item_id", F.lit(":"), F.lit(1)), F.split_part("item_id", F.lit(":"), F.lit(2)) == "true"
    held = F.concat(F.array(F.lit(0)), F.when(in_verse, F.col("verses")).otherwise(F.array().cast("array<int>")))
    chunk_rows = parts.select(F.lit("chunk").alias("item_kind"), item.alias("item_id"), F.explode(held).alias("verse_no"))
    return docs.select(F.lit("document").alias("item_kind"), "item_id", F.lit(0).alias("verse_no")).unionByName(chunk_rows).distinct()


def p2_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by source, language and tradition."""
    docs = spread_table(spark, sf, "documents", "source", "language", "tradition", "text")
    return tokens.slice_tokens(docs, _pieces(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents and of chunks that look the same and are different strings: every row with the representative
    of each other text of its look."""
    found = [
        canonical.lookalike_pairs(spread_table(spark, sf, name, key, "text"), key, "text").select(F.lit(kind).alias("item_kind"), "item_a", "item_b")
        for kind, name, key in (("document", "documents", "doc_id"), ("chunk", "chunks", "chunk_id"))
    ]
    return found[0].unionByName(found[1])


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and chunk that has another text of its look, with its class and the number of its links."""
    found = [canonical.look_members(spread_table(spark, sf, name, key, "text"), key, "text").withColumn("item_kind", F.lit(kind)) for kind, name, key in (("document", "documents", "doc_id"), ("chunk", "chunks", "chunk_id"))]
    return found[0].unionByName(found[1])


def p3_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and chunks whose text changes, with its canonical form."""
    found = []
    for kind, name, key in (("document", "documents", "doc_id"), ("chunk", "chunks", "chunk_id")):
        rows = canonical.canonical_column(spread_table(spark, sf, name, key, "text"), "text").where(canonical.changed(F.col("text"), F.col("canonical_text")))
        found.append(rows.select(F.lit(kind).alias("item_kind"), F.col(key).cast("string").alias("item_id"), "canonical_text"))
    # a chunk_id may be stored several times with one text
    return found[0].unionByName(found[1].distinct())


#: Times of retrieval at which the partitions of the incremental queries end.
PARTITION_ENDS = ("2024-07-01", "2025-01-01")


def _retrieved(docs: DataFrame) -> list[DataFrame]:
    """The partitions in which `docs` arrive, by time of retrieval; undated ones come first."""
    part = F.lit(0)
    for end in PARTITION_ENDS:
        part = part + F.coalesce(F.col("retrieved_at") >= F.lit(end).cast("timestamp"), F.lit(False)).cast("int")
    return [docs.where(part == n) for n in range(len(PARTITION_ENDS) + 1)]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines repeated on a site, counted in three partitions that arrive one after the other."""
    docs = spread_table(spark, sf, "documents", "doc_id", "source_url", "text", "retrieved_at")
    keyed, counts = lines.keyed(docs, "retrieved_at"), lines.LineCounts()
    for part, new in zip(_retrieved(docs), _retrieved(keyed), strict=True):
        counts.add(part, new)
    return lines.repeated_lines(keyed, counts.over)


def p4_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned documents, reached in three partitions by time of retrieval."""
    return lines.grown(*_retrieved(spread_table(spark, sf, "documents", "doc_id", "source_url", "text", "retrieved_at")))


def p4_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that lose lines, without them."""
    docs = spread_table(spark, sf, "documents", "doc_id", "source_url", "text")
    keyed = lines.keyed(docs)
    return lines.rebuild(docs, keyed, lines.LineCounts().add(docs, keyed))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks that are each among the other's 5 most similar, with cosine at least 0.90."""
    return neighbours.mutual_pairs(neighbours.forest_neighbours(neighbours.current_vectors(spread_table(spark, sf, "chunk_embeddings"))))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar other chunks of every chunk, however similar."""
    return neighbours.exact_neighbours(neighbours.current_vectors(spread_table(spark, sf, "chunk_embeddings")))


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: ids whose hash is divisible by 100."""
    return vectors.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0)


def p5_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar chunks, however similar, of the stated query set, against all rows."""
    vectors = neighbours.current_vectors(spread_table(spark, sf, "chunk_embeddings"))
    return neighbours.exact_neighbours(vectors, _asked(vectors))


def p5_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the forest against brute force over the ids whose hash is divisible by 100: of neighbours with cosine at
    least 0.90, which is what `p5_found` asks it for, and of the 5 nearest however similar."""
    vectors = neighbours.current_vectors(spread_table(spark, sf, "chunk_embeddings"))
    found = []
    for least in (neighbours.MIN_COSINE, -1.0):
        kept, _ = neighbours.without_copies(vectors)
        near = neighbours.neighbours(kept, neighbours.plant(kept), least=least)
        asked = _asked(kept)
        exact = neighbours.all_neighbours(kept, asked, least=least)
        found.append(neighbours.recall(near.join(asked.select("id"), "id", "left_semi"), exact).withColumn("least", F.lit(least)))
    return found[0].unionByName(found[1])


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_table(spark, sf, "documents", "doc_id", "language", "text")
    return language.segments(docs, language.learn(docs))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages a document holds and its label doesn't name."""
    return language.unnamed(_segments(spark, sf))


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Language of each document."""
    return language.documents(_segments(spark, sf))


def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language of each stretch of each document."""
    return _segments(spark, sf)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of scans with their noise."""
    return scans.noisy_lines(spread_table(spark, sf, "documents", "doc_id", "source", "text"))


def p7_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Scans as continuous paragraphs."""
    return scans.repaired(spread_table(spark, sf, "documents", "doc_id", "source", "text"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or its pieces, with its container."""
    return packing.pack(spread_table(spark, sf, "documents", "doc_id", "text"), _pieces(spark, sf))


def p8_usage(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    return packing.usage(p8_pack(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents the packing had to cut."""
    return packing.oversized(p8_pack(spark, sf))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sized = mixture.sized_documents(spread_table(spark, sf, "documents", "doc_id", "source", "text"), _pieces(spark, sf))
    targets = table(spark, sf, "mix_targets")
    return mixture.mix(sized, targets), mixture.budgets(sized, targets)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document enters the mix."""
    return _mixed(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.shares(*_mixed(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources too small for their share even at their cap."""
    return mixture.shares(*_mixed(spark, sf)).where("capped").select("source")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.judged(spread_table(spark, sf, "documents", "doc_id", "source", "n_chars", "text"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut off."""
    return _judged(spark, sf).where("truncated").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Truncated documents per source."""
    return truncation.rates(_judged(spark, sf))


def queries() -> dict[str, Query]:
    """Name to query."""
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_cuts, p2_budget, p3_found, p3_classes, p3_canonical, p4_found, p4_incremental, p4_cleaned, p5_found, p5_neighbours, p5_search, p5_recall, p6_found, p6_documents, p6_segments, p7_found, p7_repaired, p8_found, p8_pack, p8_usage, p9_found, p9_mix, p9_shares, p10_found, p10_rates)}
