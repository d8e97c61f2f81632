"""Near-duplicate documents by min-max hashing: minimum and maximum under every permutation, banded, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import components, local_components, mix, stored, text_slices, word_hashes


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, offsets of the rows) for slices of whole texts.

    A text with fewer words than a shingle has is one shingle; one without words has none.
    """
    for lo, hi, data, offsets in text_slices(texts):
        hashes, counts = word_hashes(data, offsets)
        ends = np.concatenate(([0], np.cumsum(counts)))
        with np.errstate(over="ignore"):
            whole = max(0, len(hashes) - words + 1)
            rolled = reduce(lambda h, i: mix(h * np.uint64(3) + hashes[i:i + whole]), range(words), np.full(whole, words, np.uint64))
        sets = []
        for i, n in enumerate(counts):
            a = ends[i]
            if n >= words:
                sets.append(np.unique(rolled[a:a + n - words + 1]))
            elif n:
                sets.append(reduce(lambda h, w: mix(h * np.uint64(3) + w), hashes[a:a + n], np.full(1, n, np.uint64)))
            else:
                sets.append(hashes[:0])
        yield lo, np.concatenate(sets) if sets else hashes[:0], np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def signatures(sets: np.ndarray, starts: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """Band keys of every non-empty set: each permutation is evaluated once and gives two values."""
    draw = np.random.default_rng(7).integers(0, 1 << 63, (2, permutations), dtype=np.uint64)
    values = np.empty((2 * permutations, len(starts)), np.uint64)
    for i in range(permutations):
        image = sets * (draw[0, i] * np.uint64(2) + np.uint64(1)) + draw[1, i]
        np.minimum.reduceat(image, starts, out=values[i])
        np.maximum.reduceat(image, starts, out=values[permutations + i])
    bands = 2 * permutations // rows
    keys = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        keys[:, band] = reduce(lambda h, v: mix(h * np.uint64(3) + v), values[band * rows:(band + 1) * rows], np.full(len(starts), band + 1, np.uint64))
    return keys


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80,
                    permutations: int = 80, rows: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; a component is what links of `percent` or more connect.

    Equal sets become one representative before anything is compared. Signatures hold the
    minimum and the maximum under each permutation; texts sharing a band meet. Within a band
    all first meet one head. Where a band still holds several components, the members of its
    head are compared with each other in blocks inside tasks, so no table of pairs is made and
    nothing is left out. Two of the 2 * permutations / rows bands must agree (at
    the threshold all but 4 in 100,000 pairs do); full sets of 64-bit hashes then decide.

    Null, empty or blank text: 0 shingles, linked with nothing. A row without an id stands
    alone (component null, kept). Rows of one id are one node and all returned. Other
    columns are left out. An empty table gives an empty result.
    """
    key_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def profile(batches):
        for batch in batches:
            for lo, sets, offsets in shingle_sets(batch.column(1), words):
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                starts = offsets[:-1][full]
                print_a, print_b = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                keys = np.zeros((0, 2 * permutations // rows), np.uint64)
                if len(full):
                    print_a[full] = np.add.reduceat(mix(sets), starts)
                    print_b[full] = np.add.reduceat(mix(sets ^ np.uint64(0xD6E8FEB86659FD93)), starts)
                    keys = signatures(sets, starts, permutations, rows)
                width = keys.shape[1]
                lengths = np.where(sizes > 0, width, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), pa.array(sizes), pa.array(print_a.view(np.int64)), pa.array(print_b.view(np.int64)), lists], ["id", "n", "pa", "pb", "bands"])

    profiles = stored(src.mapInArrow(profile, f"id {key_type}, n long, pa long, pb long, bands array<long>"))
    usable = profiles.filter("n > 0 AND id IS NOT NULL")
    same = ["pa", "pb", "n"]
    heads = usable.groupBy(*same).agg(F.min("id").alias("rep"))
    reps = stored(usable.join(heads.withColumnRenamed("rep", "id"), [*same, "id"]).dropDuplicates(["id", *same]).select("id", "n", "bands"))
    edges = _links(reps, src, words, percent)
    found = components(edges)
    # Rows of one id with different texts tie their groups together, as the id is one node.
    group = usable.join(heads, same).select("id", "rep").filter("id <> rep")
    ties = group.join(group.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("id"), "id", "left_semi")
    if not ties.isEmpty():
        found = components(edges.unionByName(ties.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    placed = profiles.join(heads, same, "left").withColumn("rep", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id")))
    out = placed.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(reps: DataFrame, src: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified edges (a, b) that connect every group of representatives."""
    spread = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    members = stored(spread.join(shared, "band"))
    # The head of a band is the member that meets most others in all its bands: it lies in the middle of a large group.
    fame = members.groupBy("id").agg(F.sum("met").alias("fame"))
    famed = members.join(fame, "id").select("band", "id", "n", "fame")
    heads = famed.groupBy("band").agg(F.max(F.struct("fame", "id")).alias("h")).select("band", F.col("h.id").alias("head"))
    members = stored(famed.join(heads, "band").select("band", "id", "head"))
    # All texts move once, to those that meet another; what follows reads these alone.
    texts = stored(src.join(members.select("id").distinct(), "id", "left_semi"))
    first = _compared(members.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), reps, texts, words, percent)
    edges = stored(first.filter("linked").select("a", "b"))
    # Members of one head are compared with each other, once for all bands of the head, in blocks.
    open_ = stored(_apart(members.select("band", "id", "head"), edges).select("head", "id", "component").distinct())
    return edges.unionByName(_block_links(open_, texts, words, percent))


def _block_links(members: DataFrame, src: DataFrame, words: int, percent: int, block: int = 512) -> DataFrame:
    """Edges between the components of each head's members: counts of common shingles by matrix product in each pair of blocks.

    No pair leaves a task, only a tie of each member to the smallest one it reaches.
    """
    kind = members.schema["id"].dataType.simpleString()
    parts = members.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = members.join(parts, "head").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    rows = placed.join(src, "id").withColumn("pair", F.explode(pairs)).select("head", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "id", "component", "text")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own, ids = group.column("own").to_numpy(), group.column("id").chunk(0)
        component = group.column("component").chunk(0).to_numpy(zero_copy_only=False)
        sets = [s[o[k]:o[k + 1]] for _, s, o in shingle_sets(group.column("text").chunk(0), words) for k in range(len(o) - 1)]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        names, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        a, b = _common(row, at, often, size, np.flatnonzero(own == i), np.flatnonzero(own == j), percent)
        new = component[a] != component[b]
        a, b = a[new], b[new]
        root = local_components(np.arange(len(sets)), a, b) if len(a) else np.arange(len(sets))
        tied = np.flatnonzero(root != np.arange(len(sets)))
        return pa.Table.from_arrays([ids.take(pa.array(root[tied])), ids.take(pa.array(tied))], ["a", "b"])

    return rows.groupBy("head", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def _common(row: np.ndarray, at: np.ndarray, often: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, width: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) whose sets share `percent` of their union; shingles of one set alone add nothing and are left out."""
    shared = often[at] > 1
    row, at = row[shared], at[shared]
    _, at = np.unique(at, return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    # The incidence matrix is built for some thousand shingles at a time.
    for lo in range(0, int(at.max()) + 1 if len(at) else 0, width):
        some = (at >= lo) & (at < lo + width)
        part = np.zeros((len(size), width), np.float32)
        part[row[some], at[some] - lo] = 1
        total += part[left] @ part[right].T
    every = size[left][:, None] + size[right][None, :] - total
    x, y = np.nonzero((total > 0) & (100 * total >= percent * every))
    return left[x], right[y]


def _apart(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of bands that hold more than one component, with their component; stored."""
    placed = stored(members.join(components(edges), "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    return stored(placed.join(mixed, "band", "left_semi"))


def _compared(pairs: DataFrame, reps: DataFrame, src: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) from the full sets of the pairs whose sizes and at least two bands agree."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"v{x}"))
    agree = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    likely = stored(pairs.join(side("a"), "a").join(side("b"), "b")
                    .filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (agree >= 2)).select("a", "b"))
    text = lambda x: src.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb")

    def compare(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sides = [[s[o[i]:o[i + 1]] for _, s, o in shingle_sets(part.column(c), words) for i in range(len(o) - 1)] for c in (2, 3)]
                for i, (x, y) in enumerate(zip(*sides)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked[lo + i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).append_column("linked", pa.array(linked))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(compare, f"a {kind}, b {kind}, linked boolean")
