"""The facade: one object over a folder of Parquet tables, and a command line over the object."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lipika.operators import assembly, catalog, chunking, dedupe, hybrid, ingest, lexical, records, status, vectors, verses
from lipika.session import build_session
from lipika.sources import corpus
from lipika.tables import table


@dataclass
class Engine:
    """Queries over `<folder>/documents.parquet` and `<folder>/index.parquet`.

    The index holds chunk columns and embedding in the same row, so they can't fall apart; postings by term and their
    statistics stand beside it."""

    spark: SparkSession
    folder: str
    embedder: object = staticmethod(vectors.hashing_embedder)

    def __post_init__(self) -> None:
        if not self.folder:
            raise ValueError("folder missing")

    def documents(self) -> DataFrame:
        """The corpus."""
        return table(self.spark, self.folder, "documents")

    def index(self) -> DataFrame:
        """The index."""
        return table(self.spark, self.folder, "index")

    def build_index(self, size: int = 800, overlap: int = 120) -> int:
        """Chunk, tokenise and embed the corpus; replaces the index and returns its rows."""
        if not 100 <= size <= 4000 or not 0 <= overlap < size:
            raise ValueError("chunk size must be within 100..4000 and the overlap below it")
        chunks = chunking.chunk_documents(self.documents(), size, overlap)
        chunks = chunks.withColumn("ord", F.col("doc_id") * 100_000 + F.col("chunk_index")).withColumn("embedding", vectors.embed_col(F.col("text"), self.embedder))
        corpus.rewrite(chunks, f"{self.folder}/index.parquet")
        lexical.write_postings(self.index(), f"{self.folder}/lexical")
        return self.index().count()

    def update_index(self, changed: DataFrame, size: int = 800, overlap: int = 120) -> int:
        """Chunk the documents whose doc_id is in `changed` anew and put them in place of their old chunks; documents that
        are gone leave the index. Returns the rows of the index."""
        docs = self.documents().join(changed.select("doc_id").distinct(), "doc_id", "left_semi")
        fresh = chunking.chunk_documents(docs, size, overlap).withColumn("ord", F.col("doc_id") * 100_000 + F.col("chunk_index")).withColumn("embedding", vectors.embed_col(F.col("text"), self.embedder))
        corpus.rewrite(dedupe.replace_documents(self.index(), fresh, changed=changed), f"{self.folder}/index.parquet")
        lexical.write_postings(self.index(), f"{self.folder}/lexical")
        return self.index().count()

    def index_stats(self) -> dict:
        """Whether there is an index, and what it holds."""
        if not corpus._exists(self.spark, f"{self.folder}/index.parquet"):
            return {"present": False, "chunks": 0, "documents": 0, "dimensions": 0}
        row = self.index().agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions")).first()
        return {"present": True} | row.asDict()

    def ingest(self, sources: DataFrame, fetched: DataFrame, min_chars: int = 80) -> dict:
        """Run a manifest over fetched pages and append what is new to the corpus; returns the counters and errors."""
        docs = self.documents()
        new, counters, errors = ingest.ingest(sources, fetched, docs.select("fingerprint", "source_url"), min_chars)
        last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        place = F.row_number().over(Window.orderBy("source_url", "id"))  # a manifest's records
        rows = new.withColumn("doc_id", F.lit(last) + place).withColumn("n_chars", F.col("char_count").cast("bigint"))
        columns = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
        corpus.rewrite(docs.unionByName(rows.select(*columns)), f"{self.folder}/documents.parquet")
        return {r["counter"]: r["value"] for r in counters.collect()} | {"errors": [f"{r['url']}: {r['error']}" for r in errors.orderBy("url").limit(100).collect()]}

    def dedupe(self) -> DataFrame:
        """The corpus without duplicates and superseded samples."""
        return dedupe.superseded_samples(dedupe.greedy(self.documents(), "doc_id", ("fingerprint", "source_url")))

    def search(self, query: str, top_k: int = 8, tradition: str | None = None, language: str | None = None) -> DataFrame:
        """Hybrid search; 1 <= top_k <= 50, a query of 1..4000 code points."""
        query = query.strip()
        if not query or len(query) > 4000 or not 1 <= top_k <= 50:
            raise ValueError("query must have 1..4000 code points and top_k lie within 1..50")
        from lipika.functions.sanskrit import expand_query

        index = self.index()
        for c, v in (("tradition", tradition), ("language", language)):
            if v:
                index = index.where(F.lower(c) == v.lower())
        model = self.embedder()
        variants = expand_query(query)[:3]
        batch = vectors.top_k_batch(index, {str(i): [float(x) for x in v] for i, v in enumerate(model(variants))}, max(2 * top_k, 36))
        first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("query_id", "rank"))
        dense = batch.withColumn("n", first).where("n = 1")
        dense = dense.withColumn("rank", F.row_number().over(Window.orderBy("query_id", "rank"))).select("chunk_id", F.round("score", 4).alias("score"), "rank")  # 3 x 36 rows at most
        # the statistics of stored postings are those of the whole index
        scores = None if tradition or language else lexical.bm25_stored(self.spark, f"{self.folder}/lexical", lexical.query_terms(self.spark, {"q": query}))
        return hybrid.search(index, dense, query, top_k, scores=scores)

    def ask(self, query: str, top_k: int = 8) -> dict:
        """Extractive answer with its citations."""
        hits = self.search(query, top_k)
        rows = hits.orderBy("rank").select("rank", "chunk_id", "title", "locator", "score").collect()  # top_k rows
        answer = records.answers(hits).first()[0]
        return {"query": query, "answer": answer, "hits": [r.asDict() for r in rows]}

    def ask_events(self, query: str, top_k: int = 8, size: int = 48):
        """The answer as a sequence of events: meta, token*, done; error where it fails."""
        try:
            found = self.ask(query, top_k)
            yield {"event": "meta", "data": found["hits"]}
            text = found["answer"] or ""
            for i in range(0, len(text), size):
                yield {"event": "token", "data": text[i : i + size]}
            yield {"event": "done", "data": {"characters": len(text)}}
        except Exception as e:  # noqa: BLE001 - the reader of the stream gets it
            yield {"event": "error", "data": str(e)[:160]}

    def verse(self, verse_id: str) -> DataFrame:
        """Witnesses of a verse."""
        asked = self.spark.createDataFrame([(verse_id,)], "verse_id string")
        return verses.bundles(verses.cover(asked, self.index()))

    def bundle(self, verse_id: str) -> dict | None:
        """The witnesses of a verse with its source text and padas, or None."""
        row = self.verse(verse_id).select("asked", "witnesses", "has_sanskrit", assembly.source_text(F.col("witnesses")).alias("source"), assembly.reference_block(F.col("witnesses")).alias("reference")).first()
        if row is None:
            return None
        padas = self.spark.createDataFrame([(row["source"],)], "t string").select(verses.pada_array(F.col("t"))).first()[0]
        return row.asDict(recursive=True) | {"padas": padas or []}

    def explain(self, verse_id: str, generate, task: str, language: str = "en") -> dict | None:
        """What `generate(prompt)` says of a verse. `task` is the instruction (explain, translate, analyse word by word); the
        prompt holds the witnesses. An answer with a list of words is read back as `words`."""
        found = self.bundle(verse_id)
        if found is None:
            return None
        cells = self.spark.createDataFrame([(f"{task} [{language}]: {found['source'] or ''}", found["reference"])], "q string, c string")
        made = cells.select(assembly.prompt(F.col("q"), F.col("c"), "Answer from the witnesses only.").alias("p")).first()["p"]
        answer = generate(made.asDict())
        words = self.spark.createDataFrame([(answer,)], "a string").select(assembly.parse_words(F.col("a"))).first()[0]
        return found | {"answer": answer, "words": [w.asDict() for w in words]}

    def listing(self, tradition: str | None = None, language: str | None = None, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """One page of the catalogue."""
        return catalog.page(catalog.matching(self.documents(), tradition, language, q), "doc_id", limit, offset)

    def stats(self) -> DataFrame:
        """Totals by tradition and language."""
        return catalog.stats(self.documents())

    def status(self) -> DataFrame:
        """Rows that break the data model."""
        return status.expectations(self.documents())


def main(argv: list[str] | None = None) -> int:
    """Command line over the engine."""
    p = argparse.ArgumentParser(prog="lipika")
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("build-index")
    for name in ("search", "ask"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--top-k", type=int, default=8)
    sub.add_parser("verse").add_argument("verse_id")
    for name in ("stats", "status", "dedupe", "facets", "summary", "fingerprint", "index-stats"):
        sub.add_parser(name)
    s = sub.add_parser("list")
    for option in ("--tradition", "--language", "--q"):
        s.add_argument(option)
    sub.add_parser("lock").add_argument("path")
    sub.add_parser("update-index").add_argument("doc_id", type=int, nargs="+")
    a = p.parse_args(argv)
    engine = Engine(build_session(), a.folder)
    if a.command == "build-index":
        print(engine.build_index())
    elif a.command == "ask":
        print(json.dumps(engine.ask(a.query, a.top_k), ensure_ascii=False))
    elif a.command == "search":
        engine.search(a.query, a.top_k).select("rank", "score", "title", "locator").orderBy("rank").show(a.top_k, False)
    elif a.command == "list":
        engine.listing(a.tradition, a.language, a.q).select("doc_id", "title", "tradition", "language").show(50, False)
    elif a.command in ("facets", "summary"):
        (catalog.facets if a.command == "facets" else status.summary)(engine.documents()).show(200, False)
    elif a.command == "fingerprint":
        print(status.stored_fingerprint(engine.documents()).first()[0])
    elif a.command == "index-stats":
        print(json.dumps(engine.index_stats()))
    elif a.command == "lock":
        status.write_json(status.lock(engine.documents()), a.path)
    elif a.command == "update-index":
        print(engine.update_index(engine.spark.createDataFrame([(i,) for i in a.doc_id], "doc_id long")))
    elif a.command == "verse":
        engine.verse(a.verse_id).show(truncate=False)
    else:
        getattr(engine, a.command)().show(100, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
