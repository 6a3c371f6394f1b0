"""Resumable ingest: files as a stream, deduplicated against the corpus batch by batch, exactly once by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lipika.functions import text as T
from lipika.operators import dedupe
from lipika.operators.records import long_enough
from lipika.session import cut_lineage
from lipika.sources import files


def _texts(rows: DataFrame) -> DataFrame:
    return rows.where("error is null and text is not null").select(T.stable_id(F.col("path"), T.content_fingerprint(F.col("text"))).alias("id"), F.col("path").alias("source_url"), "text", T.content_fingerprint(F.col("text")).alias("fingerprint"), F.length("text").alias("char_count"))


def ingest_folder(spark: SparkSession, folder: str, corpus: str, checkpoint: str, min_chars: int = 80, once: bool = True) -> StreamingQuery:
    """New files of a folder into a Parquet corpus. A restart goes on after the last finished batch; a batch that was
    written but not committed is recognised by its batch number and not written twice. Files that can't be read, or are over
    the size limit and so not read, are rows (path, error) of `<corpus>.errors`."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        small = batch.withColumn("content", F.when(F.col("length") <= files.MAX_BYTES, F.col("content")))
        read = cut_lineage(files.extract(small))
        failed = read.where("error is not null").select("path", "error").withColumn("batch", F.lit(number))
        failed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{corpus}.errors")
        records = long_enough(_texts(read), min_chars).withColumn("ord", F.monotonically_increasing_id())
        try:
            known = spark.read.parquet(corpus).where(F.col("batch") != number)
        except Exception:  # noqa: BLE001 - the first batch finds no corpus
            known = None
        fresh = dedupe.greedy(records, "ord", ("fingerprint", "source_url"), known)
        fresh.drop("ord").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(corpus)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
