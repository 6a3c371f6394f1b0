"""Documents into character windows, verse units into groups, both into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from lipika.functions import text as T
from lipika.operators.units import parse_groups

PARENT = ("source_url", "title", "tradition", "language", "license")


def windows(text: str | None, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of character windows over a text.

    A window ends at its last line end or space if that lies beyond a third of the size; the next begins `overlap`
    before the end, or at the end where that would not advance."""
    out, start, n = [], 0, len(text or "")
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = max(text.rfind("\n", start, end), text.rfind(" ", start, end)) - start
            if cut > size // 3:
                end = start + cut
        out.append((start, end))
        if end >= n:
            break
        start = end - overlap if end - overlap > start else end
    return out


def pieces(text: str | None, size: int = 800, overlap: int = 120) -> list[str]:
    """Stripped, non-empty windows of the stripped text."""
    body = (text or "").strip()
    return [p for a, b in windows(body, size, overlap) if (p := body[a:b].strip())]


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    """Id of a chunk from its document, its place and its beginning."""
    return T.stable_id(doc, index, F.substring(text, 1, 48))


def window_chunks(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """(doc_id, chunk_index, text, char_count) by character windows; null and blank texts have none."""
    schema = "doc_id bigint, chunk_index int, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, i, p) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, p in enumerate(pieces(text, size, overlap))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "chunk_index", "text"])

    return docs.select("doc_id", "text").mapInArrow(cut, schema).withColumn("char_count", F.length("text"))


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 120, most: int = 2) -> DataFrame:
    """Chunks of every document: verse units where a structure is recognised, as `[locator] text` joined by blank lines and
    with structural columns; character windows elsewhere. One pass: a text is parsed once and its row carries the parent's
    columns along.

    `docs` needs doc_id, id, text, title, source_url, tradition, language, license, work, book, hymn."""
    from lipika.functions import refs

    columns = ("doc_id", "id", "text", *PARENT, "work", "book", "hymn")
    rows = parse_groups(docs.select(*columns), size, most, lambda text: pieces(text, size, overlap))
    first, last = F.element_at("g", 1), F.element_at("g", -1)
    structured = first["work"].isNotNull()
    joined = F.array_join(F.transform("g", lambda u: F.concat(F.lit("["), u["locator"], F.lit("] "), u["text"])), "\n\n")
    text = F.when(structured, joined).otherwise(first["text"])
    end = F.coalesce(last["verse"], first["verse"])
    locator = F.when(structured, refs.locator(first["work"], first["book"], first["hymn"], first["verse"], end))
    rows = rows.select(
        "doc_id", "id", *PARENT, "chunk_index", text.alias("text"), *(first[c].alias(c) for c in ("work", "book", "hymn", "verse")), F.when(structured, first["verse_id"]).alias("verse_id"), first["heading"].alias("heading"),
        end.alias("verse_end"), locator.alias("locator"),
    )
    return rows.withColumn("char_count", F.length("text")).withColumn("chunk_id", chunk_id(F.col("id"), F.col("chunk_index"), F.col("text"))).drop("id")
