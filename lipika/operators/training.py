"""Data preparation for model training. Tokenizers are used, not trained."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

Encode = Callable[[list[str]], list[list[int]]]


def public_tokenizer(path: str) -> Callable[[], Encode]:
    """Factory of an encoder from a tokenizer file of the `tokenizers` library; the file is opened on the workers."""

    def make() -> Encode:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]

    return make


def encoded(text: Column, make: Callable[[], Encode]) -> Column:
    """Token ids; null texts have none."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in batches:
            yield pd.Series(encode([t or "" for t in s]), dtype=object)

    return column(text)


def compression(docs: DataFrame, make: Callable[[], Encode]) -> DataFrame:
    """(documents, characters, tokens, ratio, average) of a tokenizer over the documents with text."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in batches:
            yield pd.Series([len(x) for x in encode(list(s))], dtype="int64")

    rows = docs.where("text is not null and text <> ''").select(F.length("text").alias("c"), count("text").alias("t"))
    s = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("characters"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return s.withColumn("ratio", F.round(F.col("characters") / F.nullif(F.col("tokens"), F.lit(0)), 3)).withColumn("average", F.round(F.col("tokens") / F.nullif(F.col("documents"), F.lit(0)), 2))


def blocks(docs: DataFrame, make: Callable[[], Encode], size: int = 512) -> DataFrame:
    """(block): token ids concatenated and cut into blocks of `size`; a partition's remainder is dropped.

    Blocks run over the documents of one partition, so nothing is shuffled and no partition waits for another."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, rest = make(), []
        for b in batches:
            for ids in encode([t or "" for t in b["text"]]):
                rest += ids
            full = len(rest) // size
            if full:
                yield pd.DataFrame({"block": [rest[i * size : (i + 1) * size] for i in range(full)]})
                rest = rest[full * size :]

    return docs.select("text").mapInPandas(cut, "block array<int>")
