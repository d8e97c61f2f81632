"""Helpers of the corpus operators: tables, stored intermediates, vectorised word hashes and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.session import checkpoint_dir, cut_lineage

#: Bytes of text that the vectorised code holds at once; a longer text is a slice of its own.
SLICE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: the plan restarts from files that outlive executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of whole texts, about `most` bytes at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset:]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


_RANDOM = np.random.default_rng(20240229)
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _VALUE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = n + n // 4
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased) and the number of words of each text.

    `apart` marks the bytes that separate words, ASCII white space if not given.

    One prefix sum of byte values times powers of an odd base gives the hash of any
    stretch, so no word is ever cut out as a string.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:n]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    power, inverse = _powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power, dtype=np.uint64)))
    hashes = mix((sums[last + 1] - sums[first]) * inverse[first])
    ends = np.searchsorted(first, offsets)
    return hashes, np.diff(ends)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each id of an edge reaches; ids without an edge are not returned.

    Every round an id takes the smallest label among its neighbours and then its label's own
    label, so distances halve; minima combine before each shuffle, and each round is checkpointed.
    """
    both = cut_lineage(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").distinct()
                       .select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*"))
    labels = cut_lineage(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("id")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("x") == F.col("id")).select("id", "label", F.least("label", "near").alias("near"))
        far = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        moved = cut_lineage(step.join(far, "near", "left").select("id", "label", F.least("near", F.coalesce("far", "near")).alias("new")))
        labels = moved.select("id", F.col("new").alias("label"))
        if moved.filter("new <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def local_components(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest rank that each row of a block reaches by the pairs (a, b)."""
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        by_rank = np.empty_like(new)
        by_rank[rank] = new
        new = by_rank[new]
        if (new == label).all():
            return label
        label = new
