"""Sequence packing: a configuration linear program over the length histogram, then every piece to its place."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelens.llm.common import stored
from hirelens.llm.pretokens import PieceTable, id_slices
from hirelens.llm.tokens import load_tokenizer


def best_configuration(lengths: np.ndarray, copies: np.ndarray, values: np.ndarray, room: int) -> Counter:
    """Pricing: the configuration of most value that fits, by dynamic programming over the room; lengths to copies."""
    items = []
    for length, most, value in zip(lengths.tolist(), copies.tolist(), values.tolist()):
        most, bundle = min(most, room // length), 1
        while most > 0:
            k = min(bundle, most)
            items.append((length, k, value * k))
            most -= k
            bundle *= 2
    best = np.zeros(room + 1)
    taken = np.zeros((len(items), room + 1), bool)
    for i, (length, k, value) in enumerate(items):
        with_it = best[:room + 1 - length * k] + value
        better = with_it > best[length * k:]
        taken[i, length * k:] = better
        best[length * k:][better] = with_it[better]
    out: Counter = Counter()
    left = room
    for i in range(len(items) - 1, -1, -1):
        if taken[i, left]:
            length, k, _ = items[i]
            out[length] += k
            left -= length * k
    return out


def solve_configurations(histogram: dict[int, int], room: int, rounds: int = 1500, considered: int = 96, eta: float = 2.0, seed: int = 5) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, number of such sequences)] holding every piece of the histogram once.

    The linear program minimises the number of sequences over all configurations. Multiplicative
    weights: the price of a length starts just above proportion, so short pieces stay for the gaps, and falls by exp(-eta) for its share
    packed so far, the dynamic program finds the configuration of the best price and that
    column grows by a part of what its scarcest length has left. Columns are rounded down and
    what the rounding leaves is packed by best fit. Size and time depend on the room only.
    """
    lengths = np.array(sorted(histogram), np.int64)
    total = np.array([histogram[k] for k in sorted(histogram)], np.float64)
    left = total.copy()
    columns: Counter = Counter()
    draw = np.random.default_rng(seed)
    weight_all = float(lengths @ total)
    for _ in range(rounds):
        open_ = np.flatnonzero(left >= 1)
        if not len(open_) or lengths @ left < 0.002 * weight_all:
            break
        # Priced are the lengths that hold most of what is left, besides random others; a column is best among those.
        mass = lengths[open_] * left[open_]
        top = open_[np.argsort(-mass)[:considered // 2]]
        pick = np.union1d(top, draw.choice(open_, min(len(open_), considered // 2), replace=False))
        price = lengths[pick] ** 1.02 * np.exp(-eta * (1 - left[pick] / total[pick]))
        found = best_configuration(lengths[pick], left[pick].astype(np.int64), price, room)
        at = np.searchsorted(lengths, list(found))
        counts = np.array(list(found.values()), np.float64)
        step = float((left[at] / counts).min())
        step = max(min(1.0, step), step / 3)
        columns[tuple(sorted(found.elements(), reverse=True))] += step
        left[at] -= step * counts
    out = [(config, int(x + 1e-9)) for config, x in columns.items() if x >= 1 - 1e-9]
    rest = dict(histogram)
    for config, n in out:
        for length in config:
            rest[length] -= n
    return out + best_fit({k: n for k, n in rest.items() if n}, room)


def best_fit(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, many equal sequences at a time."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            fit = min((f for f in free if f >= length), default=None)
            if fit is None:
                each = min(room // length, n)
                config, k = (length,) * each, n // each
                free.setdefault(room - length * each, []).append((config, k))
                n -= k * each
                continue
            config, k = free[fit].pop()
            if not free[fit]:
                del free[fit]
            each = min(fit // length, n)
            use = min(k, n // each)
            if use < k:
                free.setdefault(fit, []).append((config, k - use))
            free.setdefault(fit - length * each, []).append((config + (length,) * each, use))
            n -= use * each
    return [x for groups in free.values() for x in groups]


def pieces_of(docs: DataFrame, path: str, id_col: str, text_col: str, room: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth) of every piece; nth numbers equal lengths of a part. Stored."""
    key_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        tokenizer = load_tokenizer(path)
        table, part, seen = PieceTable(tokenizer), TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for batch in batches:
            for lo, rows, ids, offsets in id_slices(batch.column(1), tokenizer, table):
                where, piece, start, length, crc, nth = [], [], [], [], [], []
                for i in range(rows):
                    own = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), room)):
                        cut_ids = own[at:at + room]
                        where.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut_ids))
                        crc.append(zlib.crc32(cut_ids.tobytes()))
                        nth.append(seen[len(cut_ids)])
                        seen[len(cut_ids)] += 1
                names = batch.column(0).slice(lo, rows).take(pa.array(where, pa.int32()))
                yield pa.RecordBatch.from_arrays([names, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(where), pa.int64()), pa.array(nth, pa.int64())], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(src.mapInArrow(cut, f"id {key_type}, piece int, start long, length long, ids_crc32 long, part long, nth long"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = 4096, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    The texts are read once. The driver sees the histogram of lengths (`room` rows at most)
    and sends back the places: a table as long as the plan's configurations, whose number
    depends on `room` and not on the documents. Equal lengths are numbered by adding up the
    counts of the parts before, so a length that a third of all pieces have is no group.

    Null and empty texts are the end id alone. Rows are packed one for one, null ids and
    repeated rows too; other columns are left out. An empty table gives an empty result.
    """
    pieces = pieces_of(docs, path, id_col, text_col, room, end_id)
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select("part", "length", before.alias("ahead"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = solve_configurations(histogram, room)
    used: Counter = Counter()
    places, base = [], 0
    for config, n in plan:
        offset = 0
        for length in config:
            places.append((length << 40 | used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    table = np.array(sorted(places), np.int64).reshape(-1, 3)
    spread = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        keys, bases, offsets = spread.value.T
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            key = length << 40 | rank
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bases[at] + key - keys[at]), pa.array(offsets[at])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(ahead, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("ahead")).alias("rank"))
    kind = pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
