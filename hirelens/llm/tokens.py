"""Token counts: pieces are counted once per distinct pre-token and summed over each text's pre-token frequencies."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import stored, text_slices

#: Texts of these characters alone are lower-cased and cut here; all others go through the tokenizer's own normaliser and splitter.
PLAIN = re.compile("[\t\n\r -~¡-įı-ž]*")
#: Fixed value: the splitting pattern of word_bpe_49k.json.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def load_tokenizer(path: str):
    """The tokenizer, without threads of its own: Spark's tasks run side by side already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokenizer(tokenizer) -> Callable[[str], tuple[list[str], list[str]]]:
    """A function from a text to its pre-tokens, special strings among them in place.

    Special strings are found in the raw text first, as the library does by default. The
    short way is taken only if the tokenizer splits by PRE_TOKEN and the text is PLAIN.
    """
    import json
    import unicodedata

    set_up = json.loads(tokenizer.to_str())
    specials = [t["content"] for t in set_up["added_tokens"]]
    split = (set_up.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    ours = split[0].get("pattern", {}).get("Regex") == PRE_TOKEN.pattern and len(split) == 2
    cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    known = set(specials)
    find, plain, nfc, library, normal = PRE_TOKEN.findall, PLAIN.fullmatch, unicodedata.normalize, tokenizer.pre_tokenizer, tokenizer.normalizer
    # The library returns byte-level images; offsets give the pre-token itself.

    def piece(text: str) -> list[str]:
        if ours and plain(text):
            return find(nfc("NFC", text).lower())
        text = normal.normalize_str(text) if normal else text
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    def tokens(text: str) -> list[str]:
        if cut is None or "<" not in text or not cut.search(text):
            return piece(text)
        out: list[str] = []
        for part in cut.split(text):
            out += [part] if part in known else piece(part)
        return out

    return tokens


def _texts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for lo, hi, _, _ in text_slices(texts):
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, hot: int = 1 << 17) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, whole texts.

    First pass: frequencies of all pre-tokens, combined in each task and then by key. Each
    distinct pre-token is encoded once. The `hot` most frequent ones (that number bounds the
    broadcast) are looked up where the text is read; all others travel as (text, pre-token,
    count) to a join with the table of pieces. The sums are the same for any `hot`.

    Null or empty text: 0 bytes and tokens. Null ids are kept, repeated rows are returned as
    often as they occur, other columns are left out. An empty table gives an empty result.
    """
    key_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def vocabulary(batches):
        tokens = pre_tokenizer(load_tokenizer(path))
        seen: Counter = Counter()
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                for text in texts:
                    seen.update(tokens(text))
                if len(seen) > 400_000:
                    yield pa.RecordBatch.from_pydict({"token": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    def encoded(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            sizes = [len(e.ids) for lo in range(0, len(rows), 2048) for e in tokenizer.encode_batch_fast(rows[lo:lo + 2048], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["token", "n", "pieces"])

    vocab = src.select("text").mapInArrow(vocabulary, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = stored(vocab.mapInArrow(encoded, "token string, n long, pieces long"))
    top = pieces.orderBy(F.desc("n"), "token").limit(hot).select("token", "pieces").toArrow()
    spread = docs.sparkSession.sparkContext.broadcast((top.column(0).to_pylist(), top.column(1).to_pylist()))

    def counted(batches):
        tokens, known = pre_tokenizer(load_tokenizer(path)), dict(zip(*spread.value))
        for batch in batches:
            for lo, texts in _texts(batch.column(1)):
                sums, rest, sizes = [], [], []
                for text in texts:
                    total, other = 0, Counter()
                    for token in tokens(text):
                        if (size := known.get(token)) is None:
                            other[token] += 1
                        else:
                            total += size
                    sums.append(total)
                    rest.append(list(other.items()))
                part = batch.slice(lo, len(texts))
                flat = [x for r in rest for x in r]
                sizes = [0]
                for r in rest:
                    sizes.append(sizes[-1] + len(r))
                pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64())], ["token", "k"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)], ["id", "n_bytes", "mark", "sum", "rest"])

    marked = src.select("id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64("text").alias("mark"))
    rows = marked.mapInArrow(counted, f"id {key_type}, n_bytes long, mark long, sum long, rest array<struct<token:string,k:long>>")
    flat = rows.select("id", "n_bytes", "mark", "sum", F.posexplode_outer("rest").alias("pos", "r")).select(
        "id", "n_bytes", "mark", F.coalesce("pos", F.lit(0)).alias("pos"), "sum", "r.k",
        # A key that no pre-token has, different for every row, so texts without a rare one spread evenly.
        F.coalesce("r.token", F.concat(F.lit("\u0000"), F.col("mark").cast("string"), F.lit("9"))).alias("token"))
    joined = flat.join(pieces.select("token", "pieces"), "token", "left")
    # Equal rows fall into one group: their sums are divided by their number and they are given back one by one.
    per = joined.groupBy("id", "n_bytes", "mark").agg(
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies"),
        F.sum(F.coalesce(F.col("k") * F.col("pieces"), F.lit(0)) + F.when(F.col("pos") == 0, F.col("sum")).otherwise(0)).alias("total"))
    one = per.select("id", "n_bytes", F.expr("total div copies").alias("n_tokens"), F.explode(F.expr("sequence(1L, copies)")).alias("_copy"))
    return one.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
