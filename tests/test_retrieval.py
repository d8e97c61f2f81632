"""Dense retrieval, nearest references, facets and keyword automata against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.operators import admit, mining, models, rank


@pytest.mark.parametrize("block", [2048, 3])
def test_dense_retrieval_equals_brute_force(spark, block):
    draw = np.random.default_rng(4)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    chunks = [(int(i % 60), unit(draw.normal(size=8))) for i in range(400)]
    # A third of all chunks are one vector, each of an owner of its own.
    chunks += [(1000 + i, unit(np.ones(8))) for i in range(200)] + [(None, unit(np.ones(8))), (5, None), (6, [1.0, None] + [0.0] * 6), (7, [1.0])]
    queries = [(q, unit(draw.normal(size=8))) for q in range(5) for _ in range(3)] + [(9, unit(np.ones(8))), (10, None)]
    out = rank.dense_retrieval(spark.createDataFrame(chunks, "owner long, vector array<double>").repartition(6), spark.createDataFrame(queries, "query_id long, vector array<double>"), 10, block=block)
    want = {}
    for q in {q for q, v in queries if v}:
        best = {}
        for o, v in chunks:
            if o is not None and v and len(v) == 8 and None not in v:
                best[o] = max(best.get(o, -2), *(float(np.dot(v, w)) for p, w in queries if p == q and w))
        want[q] = [o for o, _ in sorted(best.items(), key=lambda x: (-round(x[1], 8), x[0]))[:10]]
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["owner"])
    assert got == want
    empty = spark.createDataFrame([], "query_id long, vector array<double>")
    assert rank.dense_retrieval(spark.createDataFrame(chunks, "owner long, vector array<double>"), empty, 10).collect() == []


def test_dense_retrieval_shuffles_top_rows_only(spark):
    chunks = spark.range(20000).select(F.col("id").alias("owner"), F.array(F.sin("id"), F.cos("id")).alias("vector")).repartition(4)
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(3)], "query_id long, vector array<double>")
    some = queries.toArrow()
    rows = chunks.select(F.col("owner").alias("_o"), F.col("vector").alias("_v")).mapInArrow(rank._products(some, 5), "query_id long, owner long, _s double").count()
    assert rows <= 4 * 3 * 5


@pytest.mark.parametrize("most", [1000, 2])
def test_anchors_in_any_number(spark, most):
    anchors = spark.createDataFrame([(i, "target" if i % 2 else "other", [float(np.cos(i)), float(np.sin(i))]) for i in range(7)] + [(7, "other", [1.0, 0.0])], "anchor_id int, kind string, vector array<double>")
    rows = spark.createDataFrame([(i, [float(np.cos(i * 0.9)), float(np.sin(i * 0.9))]) for i in range(8)], "vec_id int, embedding array<double>")
    out = {r["vec_id"]: (r["winner"], r["decision"], round(r["other_score"], 9)) for r in models.nearest_reference(rows, anchors, most=most).collect()}
    for i in range(8):
        s = {a: np.cos(i * 0.9 - (a if a < 7 else 0)) for a in range(8)}
        best = min((a for a in s if s[a] >= max(s.values()) - 1e-7))
        tied = sum(x >= max(s.values()) - 1e-7 for x in s.values()) > 1
        assert out[i] == (best, "review" if tied else "include" if best < 7 and best % 2 else "exclude", round(max(s[a] for a in (0, 2, 4, 6, 7)), 9))


@pytest.mark.parametrize("block", [1 << 25, 4000])
def test_many_keywords_in_one_pass(spark, block):
    draw = random.Random(1)
    words = {"".join(draw.choice("abcd数据") for _ in range(draw.randint(2, 9))) for _ in range(3000)}
    texts = ["".join(draw.choice("abcd数据 ") for _ in range(draw.randint(0, 200))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, body string")
    got = {r["seq"]: r["keyword_hits"] for r in mining.match_keywords(df, spark.createDataFrame([(w,) for w in words] + [(" ",), (None,)], "term string"), 2, F.col("body"), block).collect()}
    for i, t in enumerate(texts):
        flat = (t or "").replace(" ", "")
        hits = [w for w in words if w in flat]
        assert got[i] == sorted(w for w in hits if not any(o != w and w in o for o in hits)), i


def test_facets_of_any_columns(spark):
    rows = [("A", "1-3年", "本科", "20-99人", "全职")] * 5 + [("B", "1-3年", "硕士", "20-99人", "实习"), ("B", "经验不限", "", "1万人以上", "")]
    df = spark.createDataFrame(rows, "province string, experience string, education string, company_size string, employment_type string")
    out = {(r["facet"], r["value"]): r["n"] for r in admit.facet_options(df, {"province": "A", "employment_type": "全职"}).collect()}
    assert out[("province", "A")] == 5 and out[("employment_type", "全职")] == 5 and ("employment_type", "实习") not in out and ("education", "硕士") not in out
    own = admit.facet_options(df.withColumnRenamed("province", "p"), {"x": "B"}, {"x": F.col("p"), "y": F.col("education")})
    assert {(r["facet"], r["value"], r["n"]) for r in own.collect()} == {("x", "A", 5), ("x", "B", 2), ("y", "硕士", 1), ("y", "", 1)}


@pytest.mark.parametrize("k", [1, 7, 500])
def test_best_fits_equal_all_pairs(spark, k):
    draw = random.Random(6)
    jobs = [(i if i % 41 else None, draw.choice(["AI应用开发", "资深大模型", "行政", "校招 后端", "算法实习", None]), draw.choice(["经验不限", "3-5年", "应届毕业生", None]), draw.choice(["大专", "硕士", "", None]),
             draw.choice(["全职", "实习", ""]), draw.choice(["面向2026届毕业生", "要求985高校本科", "RAG 平台", None]), draw.choice([["后端开发"], [], None])) for i in range(300)]
    postings = spark.createDataFrame(jobs, "seq long, job_name string, experience string, education string, employment_type string, job_description string, role_families array<string>")
    people = [("a", "本科", "实习", 2026, []), ("b", "硕士", "校招", 2026, ["智能体/大模型应用"]), ("c", "", "未明确", None, ["后端开发"]), ("d", "本科", "实习", 2026, []), ("e", None, None, None, [])]
    profiles = spark.createDataFrame(people, "pid string, profile_education string, profile_preference string, profile_graduation_year int, profile_roles array<string>")
    want = {}
    for r in admit.assess_fit(postings, profiles, block=2).filter("fit_eligible AND seq IS NOT NULL").collect():
        want.setdefault(r["pid"], []).append((r["fit_tier"], not r["target_match"], -r["target_priority"], r["seq"]))
    got = {}
    for r in admit.best_fits(postings, profiles, k).orderBy("pid", "rank").collect():
        got.setdefault(r["pid"], []).append((r["fit_tier"], not r["target_match"], -r["target_priority"], r["seq"]))
    assert got == {p: sorted(rows)[:k] for p, rows in want.items()} and len(got) == 5


@pytest.mark.parametrize("most", [200_000, 4])
def test_bm25_with_a_term_in_most_texts(spark, most):
    import math

    draw = random.Random(3)
    texts = [" ".join(["hot"] * (draw.random() < 0.8) + [draw.choice(["aa", "bb", "cc", "dd"]) for _ in range(draw.randint(0, 12))]) for _ in range(400)] + ["hot aa"] * 40 + [None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "hot aa")], "doc_id long, text string").repartition(5)
    asks = [(q, f, t) for q in range(6) for f, t in (("x", draw.choice(["hot aa", "bb cc", "hot"])), ("y", draw.choice(["dd zz", "aa", "zz"])))] + [(7, "x", None)]
    got = {}
    for r in rank.bm25(docs, spark.createDataFrame(asks, "query_id long, facet string, query_text string"), k=12, most=most).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    words = [(t or "").split() for t in texts]
    n, average = len(texts), sum(map(len, words)) / len(texts)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w in ("hot", "aa", "bb", "cc", "dd") for d in [sum(w in x for x in words)]}
    want = {}
    for q in {q for q, _, _ in asks}:
        scores = []
        for i, x in enumerate(words):
            per = [sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / average)) for w in set(t.split()) if w in x) for p, _, t in asks if p == q and t]
            if max(per, default=0) > 0:
                scores.append((-round(max(per), 8), i))
        if scores:
            want[q] = [i for _, i in sorted(scores)[:12]]
    assert got == want


def test_scans_shuffle_top_rows_only(spark, monkeypatch):
    from hirelens.operators import scans

    made = []
    plain = scans.scan
    monkeypatch.setattr(scans, "scan", lambda *a: made.append(plain(*a)) or made[-1])
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot w"), F.col("id").cast("string")).alias("text"), F.array(F.lit("s")).alias("skills"), F.lit("hot").alias("job_name")).repartition(4)
    asks = spark.createDataFrame([(q, "f", "hot", ["s"]) for q in range(3)], "query_id long, facet string, query_text string, query_skills array<string>")
    assert rank.bm25(docs, asks, k=5).count() == 15 and rank.lexical_rank(docs, asks, 5, ("job_name",), "doc_id").count() == 15
    assert len(made) == 2 and all(m.count() <= 4 * 3 * 5 for m in made)


def test_the_best_anchor_wins_a_near_tie(spark):
    anchors = spark.createDataFrame([(1, "other", [1.0 - 5e-8, 0.0]), (2, "target", [1.0, 0.0])], "anchor_id int, kind string, vector array<double>")
    rows = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id int, embedding array<double>")
    for tie, want in ((1e-7, (2, "review")), (0.0, (2, "include"))):
        assert [(r["winner"], r["decision"]) for r in models.nearest_reference(rows, anchors, tie=tie).collect()] == [want]


def test_cloud_threshold_is_three_seeds_and_a_share(spark):
    rows = [(i, str(i), "岗位职责：文本" + str(i) + ("有é" if i < 3 else "") + "。") for i in range(1000)]
    df = spark.createDataFrame(rows, "seq long, job_id string, job_description string")
    for rate, want in ((0.0, [("b", "é", 3)]), (0.005, [])):
        assert [(r["category"], r["term"], r["seed_df"]) for r in mining.category_cloud(df, F.lit(True), {"b": ["é"]}, rate=rate).collect()] == want
