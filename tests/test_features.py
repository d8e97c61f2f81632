"""Gram features and what is made of them, against counting by hand."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.operators import features, models

TEXTS = ["Data  Team\n\nwork", "data work data", "", None, "大数据 平台", "a😀b a😀b", "abc", "work team"]


def grams_of(t, low, high):
    t = re.sub(r"\s\s+", " ", t or "").lower()
    return [t[i:i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1)]


def test_grams_as_counted_by_hand(spark):
    assert list(features.text_slices(TEXTS, 5)) == [(0, 1), (1, 2), (2, 5), (5, 6), (6, 8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, body string")
    prepare, names, idf = models.gram_stages(df, "body", 2, 4, 1000, 2)
    held = Counter(g for t in TEXTS for g in set(grams_of(t, 2, 4)))
    times = Counter(g for t in TEXTS for g in grams_of(t, 2, 4))
    assert sorted(names) == sorted(g for g in held if held[g] >= 2)
    assert [times[g] for g in names] == sorted((times[g] for g in names), reverse=True)
    assert list(idf) == pytest.approx([math.log((len(TEXTS) + 1) / (held[g] + 1)) + 1 for g in names])
    out = {r["id"]: r["features"] for r in prepare(df).collect()}
    for i, t in enumerate(TEXTS):
        n = Counter(grams_of(t, 2, 4))
        w = np.array([(1 + math.log(n[g])) * idf[k] if n[g] else 0.0 for k, g in enumerate(names)])
        assert out[i].toArray() == pytest.approx(w / (np.linalg.norm(w) or 1))
    assert models.gram_stages(df, "body", 2, 3, 3, 1)[1] == sorted((g for g in times if len(g) < 4), key=lambda g: (-times[g], [ord(c) for c in g]))[:3]


def test_scores_as_counted_by_hand(spark):
    terms = {"da": (1.5, 2.0), "at": (1.2, -2.5), "work": (2.0, 0.5), "wo": (1.0, -1.0), "平台": (3.0, 1.0)}
    rows = [(i, "t" if i != 1 else " ", t, "no" if i == 7 else t, 100) for i, t in enumerate(TEXTS)] + [(8, "t", "data", "data", 10), (None, "t", "data", "data", 100)]
    df = spark.createDataFrame(rows, "job_id long, job_name string, input_text string, input_body string, body_chars int")
    table = spark.createDataFrame([(t, *x) for t, x in terms.items()], "term string, idf double, coef double")
    out = {r["job_id"]: r for r in models.score_text_classifier(df, table, 0.25, 0.5, top=2).collect()}
    assert len(out) == 10 and all(out[i]["decision"] == "review" and out[i]["score"] is None and out[i]["top_features"] is None for i in (1, 2, 3, 5, 6, 7, 8, None))
    for i in (0, 4):
        n = Counter(grams_of(TEXTS[i], 2, 4))
        w = {g: (1 + math.log(n[g])) * terms[g][0] for g in terms if n[g]}
        c = {g: w[g] * terms[g][1] for g in w}
        logit = 0.25 + sum(c.values()) / math.sqrt(sum(x * x for x in w.values()))
        assert out[i]["score"] == pytest.approx(1 / (1 + math.exp(-logit))) and out[i]["matched_features"] == len(w)
        assert out[i]["top_features"] == sorted(c, key=lambda g: (-abs(c[g]), g))[:2]


def test_texts_are_read_without_row_functions(spark):
    df = spark.createDataFrame([(str(i), "job", f"word{i % 3} text {i % 2}", "c") for i in range(40)], "job_id string, job_name string, job_description string, company_name string")
    out, cards = models.discover_clusters(df, k=3)
    assert out.count() == 40 and sum(r["n"] for r in cards.collect()) == 40
    table = spark.createDataFrame([("wo", 1.0, 1.0)], "term string, idf double, coef double")
    scored = models.score_text_classifier(df.withColumns({"input_text": F.col("job_description"), "input_body": F.col("job_description"), "body_chars": F.lit(100)}), table, 0.0, 0.5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_distances_are_those_to_the_centres(spark):
    df = spark.createDataFrame([(str(i), "job", "alpha beta" if i % 2 else "gamma delta", "c") for i in range(20)], "job_id string, job_name string, job_description string, company_name string")
    out = models.discover_clusters(df, k=2)[0].collect()
    # Two kinds of texts, two clusters: every text is its own centre.
    assert len({r["cluster"] for r in out}) == 2 and all(r["distance"] < 1e-6 for r in out)


def test_latin_names_as_patterns_find_them(spark):
    from hirelens.operators import mining
    word = "[A-Za-z][A-Za-z0-9]*(?:[.+#/-][A-Za-z0-9]*)*"
    latin = lambda words: "|".join(w for w in words.split("|") if w.isascii())
    unfit = rf"(?i)(?<!\S)\S(?!\S)|{latin(mining.CLOUD_NOISE)}|(?<!\S)(?:{latin(mining.CLOUD_GENERIC)}|{latin(mining.CLOUD_FRAGMENT)})(?!\S)"
    names = F.concat(*[F.regexp_extract_all("t", F.lit(rf"(?<![A-Za-z0-9.+#/-])(?=({word}(?:\s+{word}){{{n}}})(?![A-Za-z0-9.+#/-]))"), 1) for n in range(3)])
    want = F.filter(F.array_distinct(names), lambda x: (F.length(x) <= 32) & ~x.rlike(unfit))
    texts = ["Spark SQL  on Kubernetes, c++ C# node.js a b 3d -x x- data Data team AI", "大数据Hive表 and\tFlink\nCDC　wide space", "9to5 to-9 e.g. strongly Experienced skill", "", None, "one two three, four averyveryverylongwordthatisover32characters x",
             "Ünï cödé naïve ſkill Kelvin", "x/y/z + - . p.q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.coalesce(want, F.array().cast("array<string>")).alias("want"), mining.latin_names(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r["t"]


def test_phrase_cloud_counts_terms_once(spark, monkeypatch):
    from hirelens.operators import mining
    calls, real = [], mining.tfidf_keywords
    monkeypatch.setattr(mining, "tfidf_keywords", lambda *a, **k: calls.append(1) or real(*a, **k))
    rows = [(i, f"岗位职责：alpha beta gamma{i} 大数据", "s") for i in range(6)] + [(9, "岗位职责：delta", "o")]
    df = spark.createDataFrame(rows, "seq long, job_description string, kind string")
    out = mining.phrase_cloud(df, F.col("kind") == "s", rounds=2).collect()
    assert len(calls) == 1 and "alphabeta" in {r["term"] for r in out}


def test_category_cloud_cuts_sections_once(spark):
    from hirelens.operators import mining
    rows = [(i, f"岗位职责：alphabet the gamma{i}", "s") for i in range(6)] + [(9, "岗位职责：the alphabet", "o")]
    df = spark.createDataFrame(rows, "seq long, job_description string, kind string")
    out = mining.category_cloud(df, F.col("kind") == "s", {"a": ["the"]}, tail=("b", "^[a-z]{7,}$"))
    assert "job_description" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["category"], r["term"], r["seed_df"], r["background_df"]) for r in out.collect()} == {("b", "alphabet", 6, 7), ("b", "alphabetthe", 6, 6)}
