"""Vectors: usable rows, exact cosine top-k in the JVM, a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

Embedder = Callable[[list[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, size: int) -> Column:
    """Whether a vector has `size` finite numbers that are not all 0."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == size) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def current(embeddings: DataFrame, model: str, size: int) -> DataFrame:
    """(chunk_id, embedding): the latest usable vector of the model per chunk, at unit length."""
    rows = embeddings.where((F.col("model_name") == model) & usable(F.col("embedding"), size))
    rows = rows.groupBy("chunk_id").agg(F.max_by("embedding", "created_at").alias("embedding"))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return rows.select("chunk_id", F.transform("embedding", lambda x: x.cast("double") / norm).alias("embedding"))


def top_k(vectors: DataFrame, query: list[float], k: int, tie: str = "chunk_id", digits: int = 4) -> DataFrame:
    """(chunk_id, score) of the `k` most similar rows; rounding comes after the sort. One TakeOrdered, no shuffle."""
    q = np.asarray(query, dtype=np.float64)
    q = q / max(float(np.linalg.norm(q)), 1e-12)
    rows = vectors.select("chunk_id", dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in q))).alias("score"))
    return rows.orderBy(F.desc("score"), tie).limit(k).select("chunk_id", F.round("score", digits).alias("score"))


def top_k_batch(vectors: DataFrame, queries: dict[str, list[float]], k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) for a set of queries: per batch one matrix product and a local top-k."""
    names = list(queries)
    q = np.array([queries[n] for n in names], dtype=np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            s = np.stack(b["embedding"].to_numpy()) @ q.T
            order = np.lexsort((np.broadcast_to(b["chunk_id"].to_numpy().astype(str)[:, None], s.shape), -s), axis=0)[:k]
            for i, n in enumerate(names):
                yield pd.DataFrame({"query_id": n, "chunk_id": b["chunk_id"].to_numpy()[order[:, i]], "score": s[order[:, i], i]})

    rows = vectors.select("chunk_id", "embedding").mapInPandas(score, "query_id string, chunk_id string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def hashing_embedder(size: int = 64) -> Embedder:
    """Offline default: signed hashing of tokens, so that texts with common words are near."""
    from lipika.functions.sanskrit import tokenize

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for row, t in zip(out, texts, strict=True):
            for token in tokenize(t):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-12)

    return embed


def embed_col(text: Column, embedder: Callable[[], Embedder]) -> Column:
    """Embedding column; the factory runs once per worker and batch stream. Null texts embed as ''."""

    @F.pandas_udf(ArrayType(FloatType()))
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for s in batches:
            yield pd.Series(list(model([t or "" for t in s])), dtype=object)

    return column(text)
