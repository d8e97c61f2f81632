"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import text_slices, word_hashes

#: Vote columns, in order. A labeller votes 1 (good), -1 (bad) or 0 (abstains).
LABELLERS = ["variety", "repeats", "capitals", "symbols", "bars", "short_words", "word_length"]
_KIND = np.full(256, ord("a"), np.uint8)
_KIND[:128] = np.arange(128)
_KIND[48:58] = ord("0")
_KIND[65:91] = ord("A")
_KIND[97:123] = ord("a")
_LETTER = (_KIND == ord("a")) | (_KIND == ord("A"))
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*!@^~+=<>{}[]\\_"])


_SCALE = 3 ** np.arange(len(LABELLERS))


def _vote(value: np.ndarray, good: tuple[float, float], bad_below: float = -np.inf, bad_above: float = np.inf) -> np.ndarray:
    return np.where((value < bad_below) | (value > bad_above), -1, np.where((value >= good[0]) & (value <= good[1]), 1, 0))


def read_slices(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(first row, rows, votes [row, labeller], features) for slices of whole texts.

    Features are (row, bucket, value): hashed words, hashed word shapes (`Word!!` and `Text!!`
    have one shape) and repetitions of the preceding word, as shares of the words of a row.
    """
    for lo, hi, data, offsets in text_slices(texts):
        rows = hi - lo
        hashes, counts = word_hashes(data, offsets)
        row = np.repeat(np.arange(rows), counts)
        # An upper-case letter of Latin-1 is C3 80 to C3 9E in UTF-8.
        kind = _KIND[data]
        lead = np.concatenate(([False], data[:-1] == 0xC3))
        kind = np.where(lead & (data >= 0x80) & (data <= 0x9E), np.uint8(ord("A")), kind)
        if len(data):
            kind = np.where((data >= 0xC2) & (np.append(kind[1:], np.uint8(97)) == ord("A")), np.uint8(ord("A")), kind)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        fold = edge[:-1] | (kind != np.concatenate((np.zeros(1, np.uint8), kind[:-1])))
        places = np.concatenate(([0], np.cumsum(fold)))
        # Shapes are hashed with upper case moved out of the way of lower-casing.
        shapes, _ = word_hashes(np.where(kind == ord("A"), np.uint8(1), kind)[fold], places[offsets])
        of = np.repeat(np.arange(rows), np.diff(offsets))
        tally = lambda mask: np.bincount(of[mask], minlength=rows).astype(float)
        words = np.maximum(counts, 1).astype(float)
        letters = np.maximum(tally(_LETTER[kind]), 1.0)
        again = np.zeros(len(row), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        repeats = np.bincount(row[again], minlength=rows) / words
        ends = np.concatenate(([0], np.cumsum(counts)))
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(ends[:-1], ends[1:])], float)
        spaces = tally((data == 32) | ((data >= 9) & (data <= 13)))
        length = (np.diff(offsets) - spaces) / words
        starts = np.zeros(len(data), bool)
        if len(data):
            gap = (data == 32) | ((data >= 9) & (data <= 13))
            starts = ~gap & (edge[:-1] | np.concatenate(([True], gap[:-1])))
        first = np.flatnonzero(starts)
        stop = np.append(first[1:], len(data)) if len(first) else first
        # Length of a word up to the following white space, at most.
        size = np.minimum(stop, np.append(offsets[1:], len(data))[of[first]] if len(first) else stop) - first - 1
        short = np.bincount(row[(size <= 3) & _LETTER[kind[first]]], minlength=rows) / words
        many = counts >= 8
        votes = np.stack([
            np.where(many, _vote(distinct / words ** 0.85, (0.6, np.inf), bad_below=0.25), 0),
            np.where(counts >= 3, _vote(repeats, (0.0, 0.1), bad_above=0.25), 0),
            np.where(letters >= 20, _vote(tally(kind == ord("A")) / letters, (0.0, 0.3), bad_above=0.6), 0),
            np.where(counts >= 3, _vote(tally(_SYMBOL[data]) / words, (0.0, 0.1), bad_above=0.7), 0),
            np.where(counts >= 3, _vote(tally(data == ord("|")) / words, (0.0, 0.02), bad_above=0.25), 0),
            np.where(many, _vote(short, (0.12, 0.75), bad_below=0.05, bad_above=0.95), 0),
            np.where(many, _vote(length, (3.0, 9.5), bad_below=1.5, bad_above=16.0), 0)], axis=1) if rows else np.zeros((0, len(LABELLERS)), int)
        top = np.uint64(64 - bits)
        bucket = np.concatenate([hashes >> top, shapes >> top, np.full(int(again.sum()), 1, np.uint64)]).astype(np.int64)
        where = np.concatenate([row, row, row[again]])
        key, n = np.unique(where << bits | bucket, return_counts=True)
        yield lo, rows, votes, (key >> bits, key & ((1 << bits) - 1), n / words[key >> bits])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation on the histogram of vote patterns: (vote probabilities [labeller, class, vote], posterior of each pattern).

    Labellers are independent given the class (0 bad, 1 good) and each has an accuracy for
    either class: a labeller that knows one kind of fault is right when it votes bad but sees
    nothing wrong in other faults. The start holds any vote for bad to be right.
    """
    votes = np.stack([patterns == -1, patterns == 1], axis=2).astype(float)
    posterior = np.where((patterns == -1).any(axis=1), 0.1, 0.95)
    chance = np.full((patterns.shape[1], 2, 2), 0.5)
    for _ in range(rounds if len(counts) else 0):
        belief = np.stack([(1 - posterior) * counts, posterior * counts])
        chance = np.einsum("cp,plv->lcv", belief, votes) + 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        prior = np.clip(belief.sum(axis=1) / belief.sum(), 0.01, 0.99)
        score = np.log(prior) + np.einsum("plv,lcv->pc", votes, np.log(chance))
        posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
    return chance, posterior


def fit_scorer(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, bits: int, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: (weights, bias), by adaptive gradient steps."""
    weights, bias, seen, seen_bias = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-6), 1e-6
    value = np.sqrt(value)
    for _ in range(rounds if len(target) else 0):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights[bucket] * value, len(target)) + bias)))
        pull = (p - target) / len(target)
        g = np.bincount(bucket, pull[row] * value, 1 << bits) + penalty * weights
        seen += g * g
        weights -= 0.3 * g / np.sqrt(seen)
        seen_bias += pull.sum() ** 2
        bias -= 0.3 * pull.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 16, sample: int = 4096) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, weak label of every vote pattern).

    Votes of all rows are counted by pattern (3 ^ labellers patterns at most) and the label
    model is fitted on that histogram. The scorer is fitted on at most `sample` rows, those
    with the smallest hash of their id, which stand for all as ids say nothing about texts.
    """
    src = docs.select(F.xxhash64(F.col(id_col), F.lit(11)).alias("h"), F.col(text_col).cast("string").alias("text"))

    def tally(batches):
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, rows, votes, (row, _, _) in read_slices(batch.column(0), bits):
                total += np.bincount((votes[np.unique(row)] + 1) @ _SCALE, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pattern", "n"])

    seen = src.select("text").mapInArrow(tally, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    pattern, counts = seen.column(0).to_numpy(), seen.column(1).to_numpy()
    _, posterior = fit_labellers(pattern[:, None] // _SCALE % 3 - 1, counts)
    weak = np.full(3 ** len(LABELLERS), 0.5)
    weak[pattern] = posterior

    def features(batches):
        for batch in batches:
            for lo, rows, votes, (row, bucket, value) in read_slices(batch.column(1), bits):
                ends = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(weak[(votes + 1) @ _SCALE]), pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value))], ["h", "weak", "bucket", "value"])

    share = min(1.0, 1.25 * sample / max(1, int(counts.sum())))
    picked = src.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = picked.mapInArrow(features, "h long, weak double, bucket array<int>, value array<double>").filter(F.size("bucket") > 0).orderBy("h").limit(sample).toArrow().combine_chunks()
    buckets, values = (rows.column(c).combine_chunks() for c in ("bucket", "value"))
    sizes = [len(x) for x in buckets]
    flat = [np.concatenate([x.values.to_numpy() for x in c]) if sizes else np.zeros(0, int) for c in (buckets, values)]
    weights, bias = fit_scorer(np.repeat(np.arange(len(sizes)), sizes), *flat, rows.column("weak").to_numpy(), bits)
    return weights, bias, weak


def _scored(texts: pa.Array, model: tuple, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    weights, bias, weak = model
    for lo, rows, votes, (row, bucket, value) in read_slices(texts, bits):
        some = np.bincount(row, minlength=rows) > 0
        p = 1 / (1 + np.exp(-(np.bincount(row, weights[bucket] * np.sqrt(value), rows) + bias)))
        yield lo, rows, np.where(some, weak[(votes + 1) @ _SCALE], 0.0), np.where(some, p, 0.0)


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 16, sample: int = 4096, threshold: float = 0.5) -> DataFrame:
    """(id, weak_label, score, kept) of every row: the label model's posterior and the linear scorer's probability of good text.

    Null, empty and blank texts have no word: score 0, not kept, no part in fitting. Rows are
    returned one for one, null ids too; other columns are left out. An empty table gives an
    empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, id_col, text_col, bits, sample))

    def score(batches):
        for batch in batches:
            for lo, rows, label, p in _scored(batch.column(1), model.value, bits):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(label), pa.array(p), pa.array(p >= threshold)], ["id", "weak_label", "score", "kept"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, weak_label double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 16, sample: int = 4096, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that classify_quality keeps, with all their columns: judged where they are read, without a join."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, id_col, text_col, bits, sample))
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for lo, rows, _, p in _scored(batch.column(at), model.value, bits):
                yield batch.slice(lo, rows).filter(pa.array(p >= threshold))

    return docs.mapInArrow(keep, docs.schema)
