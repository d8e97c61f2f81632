"""Embedding near-duplicates: all pairs of a label in blocks of matrix products, union of the links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.core import shuffle_width
from hirelens.llm.common import components, local_components, stored

#: Numbers of the vectors on one side of a block; a block is at most two sides.
SIDE = 1 << 21


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision of a column of equally long lists."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _linked(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the rows a of x and b of y reach the threshold, a bounded number at a time."""
    step = max(1, SIDE // x.shape[1])
    parts = [np.einsum("ij,ij->i", x[a[lo:lo + step]], y[b[lo:lo + step]]) >= threshold for lo in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, rows: int, same: bool):
    """(a, b) of rows of x and y with a cosine of `threshold` or more, `rows` rows of x at a time; of one block with itself each pair once.

    Products are taken in single precision; those that its error could turn are taken again in double precision.
    """
    small, other = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    error = (x.shape[1] + 8) * 2.0 ** -23
    for lo in range(0, len(x), rows):
        first = lo + 1 if same else 0
        if first >= len(y):
            return
        cosine = small[lo:lo + rows] @ other[:, first:]
        at = np.flatnonzero(cosine >= np.float32(threshold - 2 * error))
        if not len(at):
            continue
        a, b = np.divmod(at, cosine.shape[1])
        unsure = np.flatnonzero(cosine.ravel()[at] < np.float32(threshold + 2 * error))
        a, b = a + lo, b + first
        keep = b > a if same else np.ones(len(a), bool)
        keep[unsure] &= _linked(x, y, a[unsure], b[unsure], threshold)
        if keep.any():
            yield a[keep], b[keep]


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
                    leaf_rows: int = 256, block: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are cosines of `threshold` or more within a label.

    Equal vectors of a label become one with a weight. The vectors of a label are dealt into
    parts of about `block` (as many as `SIDE` numbers hold, if not given); every two parts
    meet in a task of their own, `leaf_rows` rows in one product, so every pair is compared
    once, in one task. What leaves a task is a sum and the smallest id a vector is tied to;
    nothing of the vectors reaches the driver. Comparisons grow with the square of a label.

    Null label, null or empty vector, null or non-finite component, zero vector: 0 links,
    stands alone. Vectors of different length are never linked. A row without an id stands
    alone (component null, kept). Rows of one id and vector count as two vectors. Other
    columns are left out. An empty table gives an empty result.
    """
    # Single precision stays as it is: half the bytes wherever vectors move.
    number = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(number).alias("v"))
    # Double.MaxValue and below only: NaN sorts above all numbers.
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= 1.7976931348623157e308)) & F.exists("v", lambda x: x != 0), F.lit(False))
    src = src.withColumn("ok", F.col("id").isNotNull() & F.col("label").isNotNull() & good)
    usable = src.filter("ok").select("id", "label", "v")
    kind = src.schema["id"].dataType.simpleString()
    reps = stored(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).withColumn("dim", F.size("v")))
    at = ["label", "dim"]
    side = F.lit(block) if block else F.greatest(F.lit(leaf_rows), F.floor(F.lit(SIDE) / F.col("dim")))
    sizes = reps.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / side).cast("int"))
    tasks = sizes.agg(F.sum(F.when(F.col("parts") > 1, F.col("parts") * (F.col("parts") + 1) / 2))).first()[0] or 0
    blocks = reps.join(sizes.select(*at, "parts"), at).withColumn("own", F.pmod(F.xxhash64("rep", "v"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    blocks = blocks.withColumn("pair", F.explode(pairs)).select(*at, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "rep", "m", "v")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim, i, j = (group.column(c)[0].as_py() for c in ("dim", "i", "j"))
        names_of = group.column("rep").chunk(0)
        rep, own, m = (group.column(c).chunk(0).to_numpy(zero_copy_only=False) for c in ("rep", "own", "m"))
        x = _matrix(group.column("v").chunk(0), dim)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        order = np.argsort(rep, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        links, label = np.zeros(len(rep), np.int64), rank
        for a, b in close_pairs(x[left], x[right], threshold, leaf_rows, i == j):
            a, b = left[a], right[b]
            np.add.at(links, a, m[b])
            np.add.at(links, b, m[a])
            # Sets found so far are joined by their smallest ranks, so pairs need not be held.
            p, q = label[a], label[b]
            apart = p != q
            if apart.any():
                label = local_components(np.arange(len(rep)), p[apart], q[apart])[label]
        root = order[label]
        tied = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
        return pa.Table.from_arrays([names_of.take(pa.array(tied)), pa.array(links[tied]), names_of.take(pa.array(root[tied]))], ["rep", "links", "root"])

    # A number of partitions of its own: adaptive execution would put blocks that are small but dear into one task.
    dealt = blocks.repartition(min(20_000, shuffle_width(vectors) + 2 * int(tasks)), *at, "i", "j")
    tied = stored(dealt.groupBy(*at, "i", "j").applyInArrow(compare, f"rep {kind}, links long, root {kind}"))
    sums = tied.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(tied.filter("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b")))
    known = reps.join(sums, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = src.join(known.withColumn("ok", F.lit(True)), ["label", "v", "ok"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
