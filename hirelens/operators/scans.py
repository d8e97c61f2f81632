"""Ranking by terms in scans of the texts, with the best rows kept per task.

The terms of a block of queries are sent to the tasks; a task reads its texts once, adds up the
scores of every query and keeps k rows of each. Postings never leave the task that read them, so
a term that most texts hold costs no shuffle, and what is shuffled are tasks × queries × k rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores (rows × queries) that a task holds at once.
CELLS = 1 << 22


def cells(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times): how often each known term stands in each list."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    at = pc.index_in(flat, terms).to_numpy(zero_copy_only=False)
    known = ~np.isnan(at) if at.dtype.kind == "f" else at >= 0
    pair, times = np.unique(row[known].astype(np.int64) * max(1, len(terms)) + at[known].astype(np.int64), return_counts=True)
    return pair // max(1, len(terms)), pair % max(1, len(terms)), times


class Postings:
    """Terms and the places (queries or facets) that ask each of them."""

    def __init__(self, terms: Sequence[str], places: Sequence[int]):
        self.terms = pa.array(sorted(set(terms)), pa.string())
        number = {t: i for i, t in enumerate(self.terms.to_pylist())}
        which = np.array([number[t] for t in terms], np.int64)
        order = np.argsort(which, kind="stable")
        self.place = np.asarray(places, np.int64)[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(number))))).astype(np.int64)

    def sums(self, row: np.ndarray, term: np.ndarray, amount: np.ndarray, rows: int, places: int) -> np.ndarray:
        """rows × places: the amounts of the terms that each place asks."""
        size = self.first[term + 1] - self.first[term]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = self.place[np.repeat(self.first[term] - (ends - size), size) + np.arange(total)]
        return np.bincount(np.repeat(row, size) * places + place, np.repeat(amount, size), rows * places).reshape(rows, places)


class Best:
    """The k best rows of each query seen so far, by scores (highest first) and then by key."""

    def __init__(self, k: int, kind: pa.DataType, columns: int):
        self.k, self.query, self.keys, self.scores = k, np.zeros(0, np.int64), pa.array([], kind), np.zeros((0, columns))

    def add(self, query: np.ndarray, keys: pa.Array, scores: np.ndarray) -> None:
        query, keys, scores = np.concatenate((self.query, query)), pa.concat_arrays([self.keys, keys]), np.concatenate((self.scores, scores))
        rank = pc.rank(keys, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        # Scores are compared as they are shown, so that ties fall to the key.
        shown = np.floor(np.round(scores, 10) * 1e8 + 0.5)
        order = np.lexsort((rank, *(-shown[:, i] for i in range(scores.shape[1] - 1, -1, -1)), query))
        head = np.searchsorted(query[order], query[order], "left")
        keep = order[np.arange(len(order)) - head < self.k]
        self.query, self.keys, self.scores = query[keep], keys.take(pa.array(keep)), scores[keep]


def frequencies(lists: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """(term, _df) of the asked terms: counts combine in the tasks before anything is joined."""
    counts = lists.select(F.explode(F.array_distinct(column)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    return counts.join(asked.select("term").distinct(), "term", "left_semi")


def scan(rows: DataFrame, score: Callable, names: pa.Array, k: int, kinds: tuple[str, str], columns: Sequence[str], width: int) -> DataFrame:
    """(query_id, _key, scores) of the k best rows of each query in every task.

    `score` gives (row, query, scores) for a batch; at most CELLS / width rows go in at once.
    """
    step = max(1, CELLS // max(1, width))

    def run(batches):
        best = None
        for batch in batches:
            best = best or Best(k, batch.column(0).type, len(columns))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                row, query, scores = score(part)
                best.add(query, part.column(0).take(pa.array(row)), scores)
        if best is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), best.keys, *(pa.array(best.scores[:, i]) for i in range(len(columns)))], ["query_id", "_key", *columns])

    return rows.mapInArrow(run, f"query_id {kinds[0]}, _key {kinds[1]}, " + ", ".join(f"{c} double" for c in columns))
