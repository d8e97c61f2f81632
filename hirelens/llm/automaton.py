"""Ranked lexical search by scanning texts: a broadcast Aho-Corasick automaton of all item terms counts them directly in every document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelens.llm.common import stored, text_slices

#: A term is a longest run of bytes that are no ASCII characters but letters and digits; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANK = 32
_FOLD = np.array([c if c > 127 or chr(c).isalnum() else _BLANK for c in range(256)], np.uint8)
_FOLD[65:91] += 32


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, id, terms, bytes): one row for each distinct pair of id and text, with its distinct terms. Stored, so that numbers stay."""
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(id_col).alias("id"), lower.alias("text")).distinct()
    rows = rows.select(F.monotonically_increasing_id().alias("item"), "id", F.array_distinct(F.regexp_extract_all("text", F.lit(f"({TERM})"), 1)).alias("terms"))
    return stored(rows.withColumn("bytes", F.aggregate("terms", F.lit(0), lambda total, term: total + F.octet_length(term) + 16)))


class Terms:
    """The terms of a block of items: their automaton, guarded by blanks on both sides, and the items of each term."""

    def __init__(self, rows: pa.Table):
        lists = rows.column("terms").combine_chunks()
        terms, items, number = [], [], {}
        for item, found in enumerate(lists.to_pylist()):
            for term in found:
                terms.append(number.setdefault(term, len(number)))
                items.append(item)
        self.names, self.items = list(number), len(lists)
        order = np.argsort(np.array(terms, np.int64), kind="stable")
        self.item_of = np.array(items, np.int64)[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(np.array(terms, np.int64), minlength=len(number))))).astype(np.int64)

    def automaton(self) -> ahocorasick.Automaton:
        """Works on bytes read as Latin-1; the guards make every term end at most one match at a place."""
        words = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, name in enumerate(self.names):
            words.add_word(" " + name.encode().decode("latin-1") + " ", i)
        words.make_automaton()
        return words

    def counts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, rows, terms of each row with repeats; row, term, occurrences): for slices of whole texts."""
        words = self.automaton() if self.names else None
        for lo, hi, data, offsets in text_slices(texts):
            rows = hi - lo
            # A blank before every text, and one after the last, parts the texts from each other.
            folded = np.insert(_FOLD[data], offsets[:-1], _BLANK)
            folded = np.append(folded, np.uint8(_BLANK))
            heads = offsets[:-1] + np.arange(rows)
            inside = folded != _BLANK
            begins = np.flatnonzero(inside[1:] & ~inside[:-1])
            held = np.bincount(np.searchsorted(heads, begins, "right") - 1, minlength=rows) if len(begins) else np.zeros(rows, np.int64)
            found = np.fromiter(words.iter(folded.tobytes().decode("latin-1")), np.dtype([("end", np.int64), ("term", np.int64)])) if words else np.zeros(0, [("end", np.int64), ("term", np.int64)])
            # The last byte of a match is the blank after the term, so the byte before it belongs to the row.
            row = np.searchsorted(heads, found["end"] - 1, "right") - 1
            pair, times = np.unique(row * max(1, len(self.names)) + found["term"], return_counts=True)
            yield lo, rows, held, pair // max(1, len(self.names)), pair % max(1, len(self.names)), times


def _div(amount: np.ndarray, times: int, by: int) -> np.ndarray:
    """amount * times div by, in whole numbers of any size."""
    if len(amount) and int(amount.max()) * times >= 1 << 63:
        return np.array([int(x) * times // by for x in amount], np.int64)
    return amount * times // by


def _best(item: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the k best of each item: highest score, then smallest id, null ids last."""
    rank = np.empty(len(ids), np.int64)
    rank[np.asarray(pc.array_sort_indices(ids, order="ascending"))] = np.arange(len(ids))
    order = np.lexsort((rank, -score, item))
    sorted_items = item[order]
    head = np.searchsorted(sorted_items, sorted_items, "left")
    return order[np.arange(len(order)) - head < k]


def scan_top_k(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               block_bytes: int = 1 << 24, block_items: int = 4096) -> DataFrame:
    """(item, rank, id, score): the k best documents of every item by a whole-number BM25, exactly.

    No index of the documents is made: their texts are scanned twice, first for the document
    frequencies of the item terms, the number of documents and their terms, then for the scores.
    Both scans run one automaton of all terms of the items over the bytes of whole texts; its
    output, a term, maps to the items that hold it. A task keeps k rows an item, and only those
    are shuffled, through salted groups first.

    Items come in blocks, by a hash, of about `block_bytes` bytes of terms and `block_items`
    items, which bounds the broadcast and what a task keeps; every block scans again. A single
    item is never divided. N counts the documents with a term, L all terms, n those of a
    document, df the documents with the term, tf its occurrences there. With
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 n N div L), a score is the sum of
    w * (10^9 tf div (1000 tf + 8m)) over the distinct terms of the item.

    Null and empty texts have no term. Documents without an id are counted and ranked, after
    all others of an equal score; repeated rows count and rank as often as they occur. Items of
    equal id and text are one; an id with several texts has a list for each. Items without a
    term, and documents with score 0, are not returned. Other columns are left out. Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    wanted = item_terms(items, item_col, item_text)
    asked = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-asked["n"] // block_items), -(-asked["bytes"] // block_bytes))
    found = spark.createDataFrame([], f"item long, id {kind}, score long")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    for i in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).select("item", "terms").toArrow()
        if rows.num_rows:
            found = found.unionByName(_scan_block(src, rows, k, kind))
    # A task gives k rows an item; salted groups first, so that no group grows with the number of tasks alone.
    first = found.withColumn("_salt", F.pmod(F.xxhash64("id", "score"), F.lit(64)))
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    some = first.withColumn("rank", F.row_number().over(W.partitionBy("item", "_salt").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return best.join(wanted.select("item", F.col("id").alias("_id")), "item").select(F.col("_id").cast(item_kind).alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _scan_block(src: DataFrame, rows: pa.Table, k: int, kind: str) -> DataFrame:
    spark = src.sparkSession.sparkContext
    terms = Terms(rows)
    sent = spark.broadcast(terms)

    def frequencies(batches):
        terms = sent.value
        seen, docs, length = np.zeros(len(terms.names), np.int64), 0, 0
        for batch in batches:
            for _, _, held, _, term, _ in terms.counts(batch.column(0)):
                seen += np.bincount(term, minlength=len(seen))
                docs += int(np.count_nonzero(held))
                length += int(held.sum())
        at = np.flatnonzero(seen)
        # Two more counters besides the terms: documents and length.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(seen[at], [docs, length]), pa.int64())], ["term", "n"])

    sums = src.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    known = dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist()))
    total, length = known.get(-1, 0), max(1, known.get(-2, 0))
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * known.get(i, 0) + 1))) for i in range(len(terms.names))], np.int64)
    numbers = rows.column("item").to_numpy()
    scales = spark.broadcast(weights)

    def search(batches):
        terms, weights = sent.value, scales.value
        top_item, top_score, top_id = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            ids = batch.column(0)
            top_id = ids.slice(0, 0) if top_id is None else top_id
            for lo, _, held, row, term, times in terms.counts(batch.column(1)):
                norm = 10 + _div(held, 90 * total, length)
                gain = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * norm[row]))
                # As many rows at once as keep rows x items at four million scores.
                some = max(1, (1 << 22) // max(1, terms.items))
                for start in range(0, len(held), some):
                    a, b = np.searchsorted(row, (start, start + some))
                    if a == b:
                        continue
                    size = terms.first[term[a:b] + 1] - terms.first[term[a:b]]
                    ends = np.cumsum(size)
                    item = terms.item_of[np.repeat(terms.first[term[a:b]] - (ends - size), size) + np.arange(ends[-1])]
                    cell = np.repeat(row[a:b] - start, size) * terms.items + item
                    cells = np.zeros(min(some, len(held) - start) * terms.items, np.int64)
                    np.add.at(cells, cell, np.repeat(gain[a:b], size))
                    floor = np.zeros(terms.items, np.int64)
                    counts = np.bincount(top_item, minlength=terms.items)
                    full = counts >= k
                    lowest = np.full(terms.items, np.iinfo(np.int64).max)
                    np.minimum.at(lowest, top_item, top_score)
                    floor[full] = lowest[full]
                    scores = cells.reshape(-1, terms.items)
                    at, which = np.nonzero((scores > 0) & (scores >= floor))
                    if not len(at):
                        continue
                    top_item, top_score = np.concatenate((top_item, which)), np.concatenate((top_score, scores[at, which]))
                    top_id = pa.concat_arrays([top_id, ids.take(pa.array(lo + start + at))])
                    keep = _best(top_item, top_score, top_id, k)
                    top_item, top_score, top_id = top_item[keep], top_score[keep], top_id.take(pa.array(keep))
        if top_id is not None:
            yield pa.RecordBatch.from_arrays([pa.array(numbers[top_item], pa.int64()), top_id, pa.array(top_score, pa.int64())], ["item", "id", "score"])

    return src.mapInArrow(search, f"item long, id {kind}, score long")


def scan_sql(k: int = 10) -> str:
    """The same result over `documents` and `benchmark` in SQL."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH words AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({lower}, '{TERM}')) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
whole AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, total),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower}, '{TERM}')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // length))))::BIGINT AS score
 FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {k}"""
