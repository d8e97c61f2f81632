"""Rows of streams kept as plain parquet, a folder for each batch; the state is one aggregate over them.

A batch writes its rows into `stream=…/batch=…`, which a repeated batch overwrites. Streams
have folders of their own, so any number of them may write at once. Rows are also parted by a
bucket of their key: whoever asks for the state of some keys reads those buckets only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("stream", "batch", "bucket")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; any other trouble with it stays an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_name(checkpoint: str) -> str:
    """The name of a stream: batch numbers count within its checkpoint."""
    return "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_batch(rows: DataFrame, path: str, keys: Sequence[str], stream: str, batch: int, buckets: int = 32) -> None:
    """Write a batch, or write it again. A hot key's rows of one batch make one file of a bucket."""
    rows.withColumn("bucket", bucket_of(keys, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/stream={stream}/batch={batch}")


def read_batches(spark: SparkSession, path: str, touched: DataFrame | None = None, keys: Sequence[str] = (), buckets: int = 32, but: tuple[str, int] | None = None) -> DataFrame | None:
    """All rows, or those whose key is among `touched`; without one batch if named. None before the first batch.

    `touched` has a row per key of a batch. Its buckets are a list of at most `buckets` numbers.
    """
    if not exists(spark, path):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if "bucket" not in rows.columns:
        return None
    if but:
        rows = rows.filter((F.col("stream") != but[0]) | (F.col("batch") != but[1]))
    if touched is not None:
        asked = touched.select(*keys).distinct()
        numbers = [r[0] for r in asked.select(bucket_of(keys, buckets)).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(numbers)).join(asked, list(keys), "left_semi")
    return rows
