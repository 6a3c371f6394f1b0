"""Access to a folder of parquet tables, one `<name>.parquet` each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """`table`, for work in Python: a table that is read in fewer tasks than there are cores, so a small one, is spread over
    them. A large one stays as it is read."""
    df = table(spark, folder, name, *columns)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read one table; naming columns keeps the scan to them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
