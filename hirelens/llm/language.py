"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import text_slices

_TABLES: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower-case form where that is one code point."""
    if not _TABLES:
        point = lambda c: " " if 0xD800 <= c < 0xE000 else chr(c)
        lower = (point(c).lower() for c in range(0x110000))
        _TABLES.extend((np.fromiter((point(c).isalpha() for c in range(0x110000)), bool, 0x110000), np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(lower)), np.uint32, 0x110000)))
    return _TABLES[0], _TABLES[1]


def gram_buckets(texts: pa.Array, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """(first row, rows, [(buckets, row of each)] by n-gram size, letters of each row) for slices of whole texts.

    Letters are lower-cased; each stretch of other characters is one space.
    """
    is_letter, lower = _letters()
    for lo, hi, data, offsets in text_slices(texts):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        row = np.repeat(np.arange(hi - lo), np.diff(heads[offsets]))
        letter = is_letter[points]
        keep = letter | np.concatenate(([False], letter[:-1]))
        code, row, letter = np.where(letter, lower[points], np.uint32(32))[keep].astype(np.uint64), row[keep], letter[keep]
        grams = []
        for size in sizes:
            n = max(0, len(code) - size + 1)
            h = np.full(n, size, np.uint64)
            for i in range(size):
                h = (h ^ code[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            same = row[:n] == row[size - 1:size - 1 + n]
            grams.append(((h[same] >> np.uint64(64 - bits)).astype(np.int64), row[:n][same]))
        yield lo, hi - lo, grams, np.bincount(row[letter], minlength=hi - lo)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sizes: tuple[int, ...] = (1, 2, 3), bits: int = 16, smoothing: float = 0.1,
        most: int = 500) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities [language, bucket]) from every row with text and language.

    Each task counts into a language x bucket table and sends its cells, which Spark adds up:
    the traffic is a table for each task and the model a table in all. A language takes one
    row of it, so more than `most` languages (the bound of the broadcast) is an error.
    """
    width = 1 << bits

    def count(batches):
        tables: dict[str, np.ndarray] = {}

        def cells():
            for lang, t in tables.items():
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(t[at], pa.int64())})
            tables.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, rows, grams, letters in gram_buckets(batch.column(0), sizes, bits):
                names = sorted(set(langs[lo:lo + rows]))
                of = np.array([names.index(x) for x in langs[lo:lo + rows]])
                total = np.zeros((len(names), width + 1), np.int64)
                for buckets, row in grams:
                    total[:, :width] += np.bincount(of[row] * width + buckets, minlength=len(names) * width).reshape(len(names), width)
                total[:, width] = np.bincount(of[letters > 0], minlength=len(names))
                for i, name in enumerate(names):
                    tables[name] = tables[name] + total[i] if name in tables else total[i]
            if len(tables) > 64:
                yield from cells()
        yield from cells()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Cut beyond the bound before anything reaches the driver; the test below turns it into an error.
    cells = sums.limit((most + 1) * (width + 1)).toArrow()
    names = sorted(set(cells.column("lang").to_pylist())) if cells.num_rows else []
    if len(names) > most:
        raise ValueError(f"more than {most} languages")
    counts = np.zeros((len(names), width + 1))
    at = {n: i for i, n in enumerate(names)}
    counts[[at[x] for x in cells.column("lang").to_pylist()], cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
    documents = counts[:, width]
    names = [n for n, k in zip(names, documents) if k]
    counts = counts[documents > 0, :width] + smoothing
    return names, np.log(documents[documents > 0] / max(1, documents.sum())), np.log(counts / counts.sum(axis=1, keepdims=True))


def _scored(texts: pa.Array, model: tuple, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, log likelihoods with prior [language, row], n-grams of each row, does it have a letter) for slices of whole texts."""
    names, prior, table = model
    for lo, rows, grams, letters in gram_buckets(texts, sizes, bits):
        sums = np.repeat(prior[:, None], rows, axis=1) if names else np.zeros((1, rows))
        for buckets, row in grams:
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            for i in range(len(names) if len(starts) else 0):
                sums[i, row[starts]] += np.add.reduceat(table[i][buckets], starts)
        yield lo, rows, sums, sum(np.bincount(row, minlength=rows) for _, row in grams), (letters > 0) & bool(names)


def _posterior(sums: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known, 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0), 0.0)


def noise_level(model: tuple[list[str], np.ndarray, np.ndarray]) -> np.ndarray:
    """Per language the mean log-probability of an n-gram halfway between the language's own texts and chance.

    The first is what the model expects of itself, the sum of p log p; the second is that of
    buckets drawn evenly. Both are means for an n-gram, so the level holds for texts of any length.
    """
    table = model[2]
    return ((np.exp(table) * table).sum(axis=1) - np.log(table.shape[1])) / 2


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
                     sizes: tuple[int, ...] = (1, 2, 3), bits: int = 16) -> DataFrame:
    """The rows of docs (id, held_out) with lang_pred and score, the posterior of the language predicted.

    Null texts and texts without a letter, and all if nothing was learned: `und`, score 0. Ties
    go to the first language by name. Rows are returned one for one; other columns are left out.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            names = spread.value[0]
            for lo, rows, sums, _, known in _scored(batch.column(1), spread.value, sizes, bits):
                part, share = batch.slice(lo, rows), _posterior(sums, known)
                found = [names[b] if k else "und" for b, k in zip(sums.argmax(axis=0), known)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.string()), pa.array(share)], ["id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return src.mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_languages(docs: DataFrame, model: tuple, least: float = 0.5, languages: tuple[str, ...] | None = None, text_col: str = "text",
                   sizes: tuple[int, ...] = (1, 2, 3), bits: int = 16) -> DataFrame:
    """The rows whose language is predicted with a score of `least` or more, of those wanted if any are named; all columns, no join.

    The posterior of a whole text is near 1 for any text, as it only compares languages. So the
    mean log-likelihood of its n-grams must also reach the `noise_level` of the language
    found: text that is nearer to chance than to the language goes, whatever its length.
    Null texts, texts without a letter and, if nothing was learned, all rows go.
    """
    spread, at = docs.sparkSession.sparkContext.broadcast((model, noise_level(model))), docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            (names, prior, table), level = spread.value
            wanted = np.array([languages is None or n in languages for n in names], bool)
            for lo, rows, sums, count, known in _scored(batch.column(at), (names, prior, table), sizes, bits):
                good = known & (_posterior(sums, known) >= least)
                if names:
                    best = sums.argmax(axis=0)
                    mean = (sums[best, np.arange(rows)] - prior[best]) / np.maximum(count, 1)
                    good &= wanted[best] & (mean >= level[best])
                yield batch.slice(lo, rows).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from rows that are not held out and predict for all.

    Rows without an id, text or language teach nothing; a row without an id is not held out.
    """
    taught = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    return predict_language(docs, fit(taught, text_col, lang_col), id_col, text_col)
