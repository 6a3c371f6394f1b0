"""Fusion and diversification of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score): sum of 1 / (k + rank) over the lists; `lists` has query_id, list, id and rank from 1."""
    return lists.groupBy("query_id", id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def diversify(hits: DataFrame, top_k: int, per_key: int = 2, tie: str = "chunk_id") -> DataFrame:
    """The `top_k` best hits of each query with at most `per_key` of one document (else title, else chunk), ranked from 1.

    Equal to walking the hits in order and skipping full documents."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.nullif("title", F.lit("")), F.col("chunk_id"))
    order = [F.desc("score"), F.col(tie)]
    rows = hits.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(*order))).where(F.col("_n") <= per_key)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_k).drop("_key", "_n")


def union_first(lists: DataFrame, order: list[str], id_col: str = "chunk_id") -> DataFrame:
    """Ordered union of lists: of each (query, id) the first row by `order` (priority of the list, then rank)."""
    rank = F.row_number().over(Window.partitionBy("query_id", id_col).orderBy(*order))
    return lists.withColumn("_first", rank).where("_first = 1").drop("_first")


def windows_by_first(events: DataFrame, key: list[str], ts: str, seconds: int, limit: int, tie: tuple[str, ...] = ()) -> DataFrame:
    """`events` with window_start and allowed: fixed windows per key anchored at the key's first event, at most `limit` each.

    Windows are sequential per key (the next begins with the first event after the last ended), so each key is folded
    in time order (`tie` columns order events of one moment); a key's events stream through one task in Arrow batches and are not held together."""
    import pandas as pd

    schema = events.schema.add("window_start", "timestamp").add("allowed", "boolean")
    rows = events.repartition(*key).sortWithinPartitions(*key, ts, *tie)

    def walk(batches):
        last, start, count = None, None, 0
        for b in batches:
            starts, allowed = [], []
            for k, t in zip(zip(*(b[c] for c in key), strict=True), b[ts], strict=True):
                if k != last or (t - start).total_seconds() >= seconds:
                    last, start, count = k, t, 0
                count += 1
                starts.append(start)
                allowed.append(count <= limit)
            yield b.assign(window_start=pd.Series(starts, index=b.index, dtype="datetime64[us]"), allowed=pd.Series(allowed, index=b.index, dtype=bool))

    return rows.mapInPandas(walk, schema)
