"""Invariants: brute force on small data, order independence, idempotence, plan shape."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hirelens.core import hot_key_join, position_within
from hirelens.operators import clean, mining, models, near, salary_models, sample, stats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_merge_does_not_depend_on_partitioning(spark, parts):
    rows = [("p", "1", 1, "a", "long text here", "k1"), ("p", "1", 2, "", "short", "k2"), ("p", "1", 3, "c", "", ""), ("p", "2", 1, "x", "y", "k")]
    df = spark.createDataFrame(rows, "platform string, job_id string, seq long, city string, job_description string, query_keyword string").repartition(parts)
    got = {r["job_id"]: r for r in clean.merge_postings(None, df).collect()}
    assert got["1"]["city"] == "c" and got["1"]["job_description"] == "long text here" and got["1"]["query_keywords"] == ["k1", "k2"]
    again = clean.merge_postings(clean.merge_postings(None, df), df).collect()
    assert {tuple(r[c] for c in ("job_id", "city", "job_description")) for r in again} == {("1", "c", "long text here"), ("2", "x", "y")}


def test_late_rows_are_placed_by_their_own_seq(spark):
    schema = "platform string, job_id string, job_name string, city string, job_description string, seq long"
    rows = [("p", "1", "a", "old", "text", 1), ("p", "1", "b", "", "longer text", 5), ("p", "1", "c", "late", "even longer text", 3), ("p", "1", "d", "", "", 4)]
    some, rest, every = (spark.createDataFrame(r, schema) for r in (rows[:2], rows[2:], rows))
    first = clean.ingest_versions(None, None, None, some, "t")
    second = clean.ingest_versions(first["jobs"], first["new_versions"], first["new_memberships"], rest, "t")
    pick = lambda d: [tuple(r) for r in d.select("job_name", "city", "job_description", "seq", "content_hash").collect()]
    assert pick(second["jobs"]) == pick(clean.ingest_versions(None, None, None, every, "t")["jobs"])
    assert [tuple(r) for r in second["jobs"].select("job_name", "city").collect()] == [("b", "late")]
    assert [tuple(r) for r in second["change"].collect()] == [(0, 1, 0, 0)]


def test_positions_are_exact_under_skew(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"))
    got = position_within(df, [("v", False)], ["g"], rows_each=1250).toPandas()
    for _, part in got.groupby("g"):
        assert list(part.sort_values("v", ascending=False)["position"]) == list(range(1, len(part) + 1))


def test_quantiles_by_position_match_percentile(spark):
    rnd_ = random.Random(3)
    df = spark.createDataFrame([(rnd_.choice("ab"), round(rnd_.random() * 50, 2)) for _ in range(3000)], "g string, v double")
    a = stats.quantiles(df, "v", [0.25, 0.5, 0.9], ["g"]).orderBy("g").collect()
    b = stats.quantiles_by_position(df, "v", [0.25, 0.5, 0.9], ["g"]).orderBy("g").collect()
    assert a == b


def test_hot_key_join_equals_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert sorted(map(str, hot_key_join(big, small, "k", how).select("k", "id", "v").collect())) == sorted(map(str, big.join(small, "k", how).select("k", "id", "v").collect()))


def texts():
    rnd_ = random.Random(11)
    words = ["".join(rnd_.choice("abcdefg") for _ in range(rnd_.randint(2, 6))) for _ in range(60)]
    base = [" ".join(rnd_.choice(words) for _ in range(60)) for _ in range(14)]
    out = []
    for b in base:
        out.append(b)
        for changes in (1, 2, 4, 9, 25):
            w = b.split(" ")
            for _ in range(changes):
                w[rnd_.randrange(len(w))] = rnd_.choice(words)
            out.append(" ".join(w))
    return out


def brute_groups(docs, threshold, size=5):
    grams = [Counter(d[i:i + size] for i in range(len(d) - size + 1)) for d in docs]
    df = Counter(g for c in grams for g in c)
    n = len(docs)
    vec = []
    for c in grams:
        v = {g: f * (math.log((1 + n) / (1 + df[g])) + 1) for g, f in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec.append({g: x / norm for g, x in v.items()})
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(n):
        for j in range(i):
            if sum(x * vec[j].get(g, 0) for g, x in vec[i].items()) >= threshold:
                parent[find(i)] = find(j)
    return {frozenset(str(j) for j in range(n) if find(j) == find(i)) for i in range(n)}


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_near_duplicate_groups_equal_brute_force(spark, threshold):
    docs = list(dict.fromkeys(texts()))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(docs)], "job_id string, job_description string")
    got = {}
    for r in near.near_duplicate_groups(df, threshold=threshold).collect():
        got.setdefault(r["group"], set()).add(r["job_id"])
    assert {frozenset(v) for v in got.values()} == brute_groups(docs, threshold)


def test_overlap_filter_equals_brute_force(spark):
    docs = texts()
    rows, stop = docs[::2], docs[1::2]
    norm = lambda t: re.sub(r"[\W\d_]", "", t.lower())
    grams = lambda t: {norm(t)[i:i + 5] for i in range(len(norm(t)) - 4)}

    def near_(a, b):
        ga, gb = grams(a), grams(b)
        la, lb = len(norm(a)), len(norm(b))
        return min(la, lb) / max(la, lb) >= 0.75 and len(ga & gb) / len(ga | gb) >= 0.8
    want = {str(i) for i, a in enumerate(rows) if not any(near_(a, b) for b in stop)}
    make = lambda x: spark.createDataFrame([(str(i), t) for i, t in enumerate(x)], "job_id string, job_description string")
    assert {r["job_id"] for r in near.gram_overlap_filter(make(rows), make(stop)).collect()} == want


def test_splits_are_disjoint_and_stable(spark):
    df = spark.range(500).select(F.concat(F.lit("g"), (F.col("id") % 60).cast("string")).alias("group")).withColumn("split", sample.hash_split("group"))
    assert sample.split_leak_check(df).count() == 0
    assert {r[0] for r in df.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_stratified_sample_quotas(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("c"), (F.col("id") % 90).cast("string")).alias("company"), (F.col("id") < 60).alias("target"), F.col("id").between(60, 199).alias("related"),
                                  F.when(F.col("id") < 60, 8).otherwise(2).alias("score"), F.array().cast("array<string>").alias("adjacent_title"), F.array(F.lit("x")).alias("adjacent"))
    got = sample.stratified_sample(df, 100)
    counts = {r["stratum"]: r["count"] for r in got.groupBy("stratum").count().collect()}
    assert got.count() == 100 and got.select("id").distinct().count() == 100
    assert counts["random_source"] == 20 and counts["target_candidate"] == 58 and counts["related_candidate"] == 20


def test_ingest_rejects_other_tasks(spark):
    df = spark.createDataFrame([("p", "1", "n", "t2", 1)], "platform string, job_id string, job_name string, task_id string, seq long")
    with pytest.raises(Exception, match="another task"):
        clean.ingest_versions(None, None, None, df, "t1")["change"].collect()


def test_aliases_read_the_texts_once(spark):
    rows = [(i, f"k{i}", "a", "n", "c", "t e x t" if i % 3 == 0 else f"own {i}") for i in range(30)] + [(30, "k30", "a", "n", "c", None), (31, "k31", "a", "n", "c", " ")]
    df = spark.createDataFrame(rows, "seq long, job_id string, company_name string, job_name string, city string, job_description string")
    kept, aliases = clean.identity_dedupe(df)
    assert sorted((r["kept_key"], r["alias_key"]) for r in aliases.collect()) == sorted([("k0", f"k{i}") for i in range(3, 30, 3)] + [("k30", "k31")])
    assert kept.count() == 22
    assert "job_description" not in aliases._jdf.queryExecution().optimizedPlan().toString()


def test_changed_sources(spark):
    listing = spark.createDataFrame([("a", "1:1"), ("b", "2:2")], "path string, signature string")
    seen = spark.createDataFrame([("a", "1:1"), ("b", "2:1")], "path string, signature string")
    assert [r["path"] for r in clean.changed_sources(listing, seen).collect()] == ["b"]


def test_every_keyword_is_matched(spark):
    words = [f"w{i:04d}q" for i in range(2300)]
    df = spark.createDataFrame([(1, " ".join(words))], "seq long, body string")
    kw = spark.createDataFrame([(w,) for w in words], "term string")
    hits = mining.match_keywords(df, kw, 2, F.col("body")).first()["keyword_hits"]
    assert sorted(hits) == words


@pytest.mark.parametrize("each", [7, 1000])
def test_positions_at_any_number_of_ranges(spark, each):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 == 0, None).otherwise(F.lit("x")).alias("h"))
    out = position_within(df.repartition(5), [("id", False)], ["g", "h"], rows_each=each)
    seen = {}
    for r in sorted(out.collect(), key=lambda r: -r["id"]):
        seen[r["g"], r["h"]] = seen.get((r["g"], r["h"]), 0) + 1
        assert r["position"] == seen[r["g"], r["h"]]


def test_overlapping_pairs_and_phrases_in_the_text(spark):
    df = spark.createDataFrame([("大数据分析",), ("数据分析",), ("使用Java 和 Python做开发",)], "t string")
    rows = mining.term_documents(df, F.col("t"), stop=()).select("words", "terms").collect()
    assert set(rows[0]["words"]) >= {"大数", "数据", "据分", "分析"} and {"数据", "分析", "数据分"} <= set(rows[0]["terms"]) & set(rows[1]["terms"])
    assert "javapython" not in rows[2]["terms"] and "java" in rows[2]["terms"]
    assert "开发" not in mining.term_documents(df, F.col("t")).collect()[2]["words"]


def test_ridge_recovers_a_plain_effect(spark):
    rnd_ = random.Random(5)
    rows = []
    for i in range(600):
        skills = [s for s in ("x", "y") if rnd_.random() < 0.5]
        rows.append((math.exp(2 + 0.5 * ("x" in skills)), skills, "c", "e", "d", "s", "全职"))
    df = spark.createDataFrame(rows, "salary_midpoint_k double, skills array<string>, city string, experience string, education string, company_size string, employment_type string")
    spec = models.salary_feature_spec(df)
    beta = dict(zip(salary_models.feature_names(spec), salary_models.ridge_salary(df, spec, pairs=False)))
    assert abs(beta["skill:x"] - 0.5) < 0.05 and abs(beta["skill:y"]) < 0.05


PLAIN = ["B1_dedupe_first", "B3_merge_postings", "C1_parse_salary", "D4_facet_options", "E1_live_postings", "F4_salary_benchmark", "F6_cohort_salary", "F12_province_stats", "G4_bm25", "H3_reservoir"]


@pytest.mark.parametrize("name", PLAIN)
def test_plans_stay_on_the_engine(spark, name):
    import __spark_entry__ as entry
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
    assert not re.search(r"Exchange SinglePartition[\s\S]{0,400}Window", plan) or "WindowGroupLimit" in plan


def test_collection_funnel(spark):
    rows = [("p", "1", 1, None), ("p", "1", 2, "late"), ("p", "2", 3, "short"), ("p", "2", 4, None), ("q", "1", 5, ""), ("q", None, 6, None), ("", "3", 7, "x"), ("q", "4", 8, None)]
    df = spark.createDataFrame(rows, "platform string, job_id string, seq long, filter_reason string")
    steps = {r["step"]: r["n"] for r in stats.collection_funnel(df, target=2).collect()}
    assert steps == {"input_rows": 8, "missing_key_rows": 2, "duplicate_rows": 2, "unique_rows": 4, "excluded_rows": 1, "eligible_rows": 3, "trimmed_rows": 1, "output_rows": 2}
    assert [tuple(r) for r in stats.filter_reasons(df).collect()] == [("p", "short", 1)]
    assert all(r["n"] == 0 for r in stats.collection_funnel(df.limit(0)).collect())


def test_audit_examples(spark):
    df = spark.range(1, 31).select(F.col("id").alias("seq"), F.when(F.col("id") <= 25, "a").otherwise("b").alias("match_method"), F.when(F.col("id") != 30, F.col("id") != 28).alias("matched"))
    out = {}
    for r in stats.audit_examples(df, k=5).orderBy("audit_no").collect():
        out.setdefault(r["audit_group"], []).append(r["seq"])
    assert out == {"a": [1, 7, 13, 19, 25], "b": [26, 27, 29], "未匹配": [28, 30]}
    assert stats.audit_examples(df.limit(0)).count() == 0
