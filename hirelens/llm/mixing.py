"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling of documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelens.llm.common import stored

#: What a missing value of a margin counts as.
NONE = "none"
WORD = r"[^\x20\x09-\x0D]+"


def surface_topic(text: str | Column) -> Column:
    """A topic from the surface of a text: `table` rows, `long` texts of seven lines or more, `prose`."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.when(F.contains(t, F.lit(" | ")), "table").when(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) >= 6, "long").otherwise("prose"))


def rake(cells: DataFrame, margins: Mapping[str, float | Mapping[str, float]], rounds: int = 10) -> DataFrame:
    """Cells (margins, tokens) with `weight`: tokens fitted to the target share of every margin in turn, `rounds` times.

    A number is a power: the share of a value goes with its tokens to that power, so 1 keeps
    the shares and 0 makes them equal. A mapping gives shares; values it does not name share
    what is left of 1 by their tokens. The windows run over cells, whose number is that of
    the combinations of values, not of documents.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for name, target in margins.items():
        sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("mass"))
        if isinstance(target, Mapping):
            given = F.create_map(*[F.lit(x) for pair in target.items() for x in pair]) if target else F.create_map().cast("map<string,double>")
            share = F.element_at(given, F.col(name)).cast("double")
            rest = max(0.0, 1.0 - sum(target.values()))
            left = sums.agg(F.sum(F.when(share.isNull(), F.col("mass"))).alias("left"))
            sums = sums.crossJoin(F.broadcast(left)).withColumn("aim", F.coalesce(share, F.col("mass") * rest / F.col("left"), F.lit(0.0)))
        else:
            sums = sums.withColumn("aim", F.when(F.col("mass") > 0, F.pow("mass", F.lit(float(target)))).otherwise(0.0))
        whole = sums.agg(F.sum("aim").alias("aims"), F.sum("mass").alias("all"))
        sums = sums.crossJoin(F.broadcast(whole)).select(name, (F.col("aim") / F.col("aims") * F.col("all")).alias(f"aim_{name}"))
        out = out.join(sums, name)
    out = stored(out)
    for _ in range(rounds):
        for name in margins:
            total = F.sum("weight").over(W.partitionBy(name))
            out = out.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"aim_{name}") / total).otherwise(0.0))
    return out.drop(*[f"aim_{name}" for name in margins])


def mix(docs: DataFrame, margins: Mapping[str, float | Mapping[str, float]], tokens: str = "tokens", id_col: str = "doc_id", rounds: int = 10, seed: str = "mix") -> DataFrame:
    """The rows of docs with `ratio`, `probability`, `epochs`, `kept` and `copies`.

    Tokens are added up by the combination of margin values in each task first. The ratio of a
    cell is its fitted weight over its tokens. A document is kept if the uniform number made
    from its id is below the probability, the ratio or 1; `epochs`, ratio over probability,
    is how often kept documents are to be seen, so kept tokens times epochs meet the targets.
    `copies` is the same in whole rows: the ratio rounded down, and one more if the number is
    below what is left; tokens times copies meet the targets (see `repeated`).

    Null margin values are the value `none`; null ids are kept with the number 0, so always
    unless the ratio is 0, and their copies are rounded up; rows of one id share their fate within a cell; rows without tokens
    go with their cell. Columns of docs are returned as they are; `ratio`, `probability`,
    `epochs`, `kept` and `copies` of the input are replaced. An empty table gives an empty result.
    """
    names = list(margins)
    key = {f"_m_{n}": F.coalesce(F.col(n).cast("string"), F.lit(NONE)) for n in names}
    marked = docs.drop("ratio", "probability", "epochs", "kept", "copies").withColumns(key)
    cells = marked.groupBy(*key).agg(F.sum(F.coalesce(F.col(tokens), F.lit(0)).cast("long")).alias("tokens"))
    fitted = stored(rake(cells, {f"_m_{n}": t for n, t in margins.items()}, rounds))
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    rates = fitted.select(*key, ratio.alias("ratio"), F.least(ratio, F.lit(1.0)).alias("probability"))
    u = F.coalesce(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0, F.lit(0.0))
    out = marked.join(rates, list(key)).drop(*key)
    return out.withColumns({"epochs": F.when(F.col("probability") > 0, F.col("ratio") / F.col("probability")).otherwise(0.0), "kept": u < F.col("probability"),
                            "copies": (F.floor("ratio") + (u < F.col("ratio") - F.floor("ratio")).cast("long")).cast("int")})


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of a mixture, each as often as its `copies` say."""
    return mixed.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_again")


def mix_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents mixed by source, language and topic: square roots of the sources' and languages' tokens, topics nearly as they are."""
    with_topic = docs.withColumns({"topic": surface_topic(text_col), "tokens": F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")})
    return mix(with_topic, {"source": 0.5, "lang": 0.5, "topic": 0.8}, **options)


def mixing_sql(rounds: int = 10) -> str:
    """The same as SQL over `documents`."""
    margins = {"source": 0.5, "lang": 0.5, "topic": 0.8}
    tables = [
        r"""marked AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
        CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) >= 6 THEN 'long' ELSE 'prose' END AS topic,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM marked GROUP BY ALL)",
        *(f"aim_{m} AS MATERIALIZED (SELECT {m}, CASE WHEN mass > 0 THEN pow(mass, {p}) ELSE 0 END / sum(CASE WHEN mass > 0 THEN pow(mass, {p}) ELSE 0 END) OVER () * sum(mass) OVER () AS aim_{m} FROM (SELECT {m}, sum(tokens) AS mass FROM cells GROUP BY {m}))" for m, p in margins.items()),
        "step0 AS (SELECT *, tokens AS weight FROM cells JOIN aim_source USING (source) JOIN aim_lang USING (lang) JOIN aim_topic USING (topic))"]
    n = 0
    for _ in range(rounds):
        for m in margins:
            n += 1
            tables.append(f"step{n} AS MATERIALIZED (SELECT * EXCLUDE (weight, s), CASE WHEN s > 0 THEN weight * aim_{m} / s ELSE 0 END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {m}) AS s FROM step{n - 1}))")
    return f"""WITH {', '.join(tables)},
    rates AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS ratio FROM step{n}),
    drawn AS (SELECT doc_id, marked.source, marked.lang, topic, tokens, ratio, least(ratio, 1) AS probability,
        CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM marked JOIN rates USING (source, lang, topic))
    SELECT doc_id, source, lang, topic, tokens, round(ratio, 6) AS ratio, round(probability, 6) AS probability,
        round(CASE WHEN probability > 0 THEN ratio / probability ELSE 0 END, 6) AS epochs, u < probability AS kept,
        CAST(floor(ratio) + CASE WHEN u < ratio - floor(ratio) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM drawn"""
