"""Long texts take time in proportion to their length, and words do not move where their texts can."""

import time

from pyspark.sql import functions as F

from hirelens.functions.text import phrases, sections, tokens
from hirelens.operators import admit, mining


def seconds(df) -> tuple[float, list]:
    t = time.time()
    rows = df.collect()
    return time.time() - t, rows


def words(n: int) -> list[str]:
    return ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(n)]


def test_sections_of_a_long_text(spark):
    body = "岗位职责" + "\n".join(f"line {i}" for i in range(60_000))
    took, rows = seconds(spark.createDataFrame([(body,)], "t string").select(sections("t").alias("s")).select(F.size("s"), F.col("s")[59_999]["location"]))
    assert rows[0][0] == 60_000 and rows[0][1] == "duties" and took < 30


def test_phrases_of_a_long_text(spark):
    text = " ".join(words(60_000)) + ", xx"
    df = spark.createDataFrame([(text,), ("ab, cd ef",), (None,)], "t string").withColumn("w", tokens("t", "words"))
    took, rows = seconds(df.select(phrases("w", F.regexp_replace("t", " ", "")).alias("p")))
    # Three words of four letters have twelve; across the comma nothing stands in the text.
    assert [len(r["p"]) for r in rows] == [59_999 + 59_998, 1, 0] and rows[1]["p"] == ["cdef"] and took < 30


def test_phrases_across_marks_that_stand_elsewhere(spark):
    df = spark.createDataFrame([("ab, cd abcd 大数据",)], "t string").withColumn("w", tokens("t", "words"))
    few, many = (df.select(phrases("w", F.regexp_replace("t", " ", ""), few=n).alias("p")).first()["p"] for n in (200, 0))
    assert few == many and few == ["abcd", "cdabcd", "abcd大数", "大数据", "cdabcd大数", "abcd大数据"]


def test_pmi_of_a_long_sentence(spark):
    rows = [(i, " ".join(words(30_000)) if i == 0 else "aa bb cc dd") for i in range(6)]
    took, out = seconds(mining.pmi_phrases(spark.createDataFrame(rows, "job_id long, t string"), F.col("t"), least=5))
    assert {r["name"] for r in out} == {"aa bb cc", "bb cc dd"} and took < 60


def test_tags_move_once_by_posting(spark):
    tags = spark.createDataFrame([(1, "include", "skills", "k8s", "E1", "", 1), (1, "include", "skills", "sql", "E1", "", 2)], "key long, fit string, field string, name string, evidence_id string, category string, tag_no int")
    kept = admit.validate_tags(tags, spark.createDataFrame([(1, "E1", "k8s and c++")], "key long, evidence_id string, quote string"))[0]
    assert kept.count() == 1
    assert kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1


def test_strata_of_a_text_with_a_long_blank(spark):
    from hirelens.operators import sample
    terms = {"title": ["Ring"], "duty": ["bolt", "c++"], "adjacent": ["rod", "热轧"], "skill": ["blue"], "business": ["old"]}
    rows = [("a ring", "bolt" + " " * 300_000 + "x BLUE"), ("rings", "told ｏｌｄ c++"), ("rod", "rod_热轧x"), (None, None)]
    df = spark.createDataFrame(rows, "job_name string, job_description string")
    names = ["hit_title", "hit_duty", "adjacent_title", "adjacent", "hit_skill", "hit_business"]
    took, out = seconds(sample.retrieval_strata(df, terms).select(*names))
    assert [tuple(r) for r in out] == [(["Ring"], ["bolt"], [], [], ["blue"], []), ([], ["c++"], [], [], [], ["old"]), ([], [], ["rod"], ["rod", "热轧"], [], []), ([], [], [], [], [], [])]
    assert took < 30
    across = sample.retrieval_strata(spark.createDataFrame([("deep ", "\tlearning"), ("deep", "x learning")], "job_name string, job_description string"), {"adjacent": ["deep learning"]})
    assert [r["adjacent"] for r in across.collect()] == [["deep learning"], []]


def test_sample_keeps_texts_out_of_the_choice(spark):
    from hirelens.operators import sample
    df = spark.range(400).select("id", F.concat(F.lit("c"), (F.col("id") % 9).cast("string")).alias("company"), (F.col("id") % 4 == 0).alias("target"), (F.col("id") % 4 == 1).alias("related"), (F.col("id") % 5).cast("int").alias("score"),
                                F.array().cast("array<string>").alias("adjacent_title"), F.array(F.lit("r")).alias("adjacent"), F.repeat(F.lit("long text "), 9).alias("body"))
    out = sample.stratified_sample(df, 100)
    assert out.columns == [*df.columns, "stratum"] and out.count() == 100 and out.filter("body is null").count() == 0
    plan = out.select("id", "stratum")._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan and "repeat" not in plan


def test_group_stats_read_their_source_once(spark):
    from hirelens.functions.salary import with_salary
    from hirelens.operators import stats
    df = with_salary(spark.range(12).select((F.col("id") % 7).alias("g"), F.concat(F.col("id") + 3, F.lit("-"), F.col("id") + 5, F.lit("K")).alias("salary")))
    out = stats.salary_group_stats(df, ["g"], 2)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["g"]: (r["n"], r["median"], r["raw_quotes"]) for r in out.collect()} == {g: (2, 7500.0 + 1000 * g, None) if g < 5 else (1, 4000.0 + 1000 * g, f"{g + 3}-{g + 5}K") for g in range(7)}


def test_terms_of_a_long_text_with_every_word(spark):
    many = words(6000)
    body = "岗位职责" + "\n".join(f"{w} {w.upper()} 0{w}" for w in many)
    spans, at = [], 4
    for w in many:
        spans += [(1, "h", at, at + 4, w, 0.9), (1, "h", at + 5, at + 9, w.upper(), 0.9), (1, "h", at + 11, at + 15, w, 0.9)]
        at += 16
    hits = spark.createDataFrame(spans + [(1, "h", 0, 4, "aaaa", 0.9), (2, "h", 4, 8, "aaaa", 0.9)], "job_key long, content_hash string, start int, end int, text string, score double")
    took, rows = seconds(admit.validate_term_candidates(hits, spark.createDataFrame([(1, "h", body), (1, "old", "x"), (3, "h", None)], "job_key long, content_hash string, job_description string")))
    assert {(r["term"], r["start"], r["quote"]) for r in rows} == {(w, 4 + 16 * i, f"{w} {w.upper()} 0{w}") for i, w in enumerate(many)} and len(rows) == 6000
    assert {r["location"] for r in rows} == {"duties"} and took < 30


def test_query_of_terms_reads_whole_texts(spark, tmp_path):
    from hirelens.plans.q_admit import d12
    spark.createDataFrame([(1, "first WORDS, then 7later xlater_ words of later"), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["term"] for r in d12(spark, str(tmp_path)).collect()) == ["WORDS", "first", "later"]


def test_phrases_at_their_own_place_are_not_looked_for(spark):
    # As put together from the words, and as found anywhere in the text: words may be missing, or stand inside others before their own place.
    texts = ["ab, cd ef ab cd", "xab ab cd xabc d", "aa b aab aa", "ab", "", "é ab cd é, abé cd", "no marks here. at all no marks", "ab cd 大数 ab"]
    rows = [(t, [w for w in t.replace(",", " ").replace(".", " ").split() if len(w) > 1 and w != "ef"]) for t in texts] + [("ab cd", ["zz", "ab", "cd", "zz"]), (None, ["ab"]), ("ab", None)]
    got = spark.createDataFrame(rows, "t string, w array<string>").select("t", "w", phrases("w", F.regexp_replace("t", " ", "")).alias("p")).collect()
    for r in got:
        made = [p for n in (2, 3) for p in map("".join, zip(*[(r["w"] or [])[i:] for i in range(n)])) if len(p) <= 12]
        assert r["p"] == [p for p in made if p in (r["t"] or "").replace(" ", "")]
    many = [(" ".join(w + str(i % 7) for w in words(2000)), i) for i in range(60)]
    df = spark.createDataFrame(many, "t string, i int").withColumn("w", tokens("t", "words")).localCheckpoint()
    took, out = seconds(df.select(F.size(phrases("w", F.regexp_replace("t", " ", "")))))
    assert [r[0] for r in out] == [1999] * 60 and took < 30
