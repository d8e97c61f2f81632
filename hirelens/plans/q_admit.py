"""Queries for D."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from hirelens.core import first_per_key, rnd, shuffle_width
from hirelens.functions import groups
from hirelens.operators import admit, clean
from hirelens.plans.q_functions import SAL, SECTIONED, WORDS, sectioned
from hirelens.plans.registry import query
from hirelens.plans.views import DOCP, P_LEAN, P_WHOLE, SALARY, doc_postings, postings, table, whole_postings, with_

ADMIT = """adm AS MATERIALIZED (SELECT * REPLACE (CASE WHEN quoted THEN '9.9-9.9千/月' ELSE salary END AS salary, CASE WHEN quoted THEN 'month' ELSE period END AS period, CASE WHEN quoted THEN 9900.0 ELSE lo END AS lo, CASE WHEN quoted THEN 9900.0 ELSE mid END AS mid, CASE WHEN quoted THEN 9900.0 ELSE hi END AS hi), seq % 11 = 0 AS closed, CASE WHEN seq % 2 = 0 THEN 'include' ELSE 'review' END AS decision,
 quoted AND count(*) FILTER (quoted) OVER (PARTITION BY platform) >= 5 AS bad, education='' AS noedu FROM (SELECT *, seq % 13 = 0 AND platform <> '5-LOW' AS quoted FROM sal))"""


def admitted(spark, sf):
    p = whole_postings(spark, sf)
    s = F.col("seq")
    p = p.withColumns({"salary": F.when((s % 13 == 0) & (F.col("platform") != "5-LOW"), "9.9-9.9千/月").otherwise(F.col("salary")),
                       "closed": s % 11 == 0, "decision": F.when(s % 2 == 0, "include").otherwise("review")})
    return admit.admit_postings(p)


@query("D1_admit_postings", with_(P_WHOLE, SAL, ADMIT) + """SELECT platform, admit_retrieval, admit_salary, reasons, count(*) AS n FROM (SELECT platform, decision='include' AND NOT closed AS admit_retrieval, decision='include' AND NOT closed AND NOT bad AND salary<>'面议' AS admit_salary,
 array_to_string(list_filter([CASE WHEN salary='面议' AND NOT bad THEN 'salary_unparsed' END, CASE WHEN bad THEN 'repeated_9_9k_pending_verification' END, CASE WHEN noedu THEN 'education_unknown' END, CASE WHEN closed THEN 'explicitly_closed' END], lambda x: x IS NOT NULL),'|') AS reasons FROM adm) GROUP BY ALL""")
def d1(spark, sf):
    return admitted(spark, sf).groupBy("platform", "admit_retrieval", "admit_salary", F.array_join("reasons", "|").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("D2_admission_summary", with_(P_WHOLE, SAL, ADMIT) + """SELECT 'total' AS item, count(*) AS n FROM adm UNION ALL SELECT 'retrieval_admitted', count(*) FROM adm WHERE decision='include' AND NOT closed UNION ALL SELECT 'salary_admitted', count(*) FROM adm WHERE decision='include' AND NOT closed AND NOT bad AND salary<>'面议'
 UNION ALL SELECT 'salary_unparsed', count(*) FROM adm WHERE salary='面议' AND NOT bad HAVING count(*) > 0 UNION ALL SELECT 'repeated_9_9k_pending_verification', count(*) FROM adm WHERE bad HAVING count(*) > 0 UNION ALL SELECT 'education_unknown', count(*) FROM adm WHERE noedu HAVING count(*) > 0 UNION ALL SELECT 'explicitly_closed', count(*) FROM adm WHERE closed HAVING count(*) > 0""")
def d2(spark, sf):
    return admit.admission_summary(admitted(spark, sf))


@query("D3_filter_postings", with_(P_WHOLE, SAL) + """SELECT seq, salary FROM sal WHERE city IN ('NATION_1','NATION_2','NATION_3','NATION_4') AND city<>'NATION_4' AND education IN ('','大专','本科') AND employment_type<>'实习' AND (experience='经验不限' OR experience IN ('1-3年','3-5年')) AND month_k BETWEEN 5 AND 40""")
def d3(spark, sf):
    p = whole_postings(spark, sf)
    goal = {"cities": ["NATION_1", "NATION_2", "NATION_3", "NATION_4"], "exclude_cities": ["NATION_4"], "candidate_education": "本科", "career_stage": "formal", "years": 3, "salary_min_k": 5, "salary_max_k": 40}
    return admit.filter_postings(p, goal).select("seq", "salary")


FACET_SQL = {"province": "province", "experience": "CASE experience WHEN '应届毕业生' THEN '在校/应届' ELSE experience END", "education": "CASE education WHEN '' THEN '未明确' ELSE education END",
             "employment_type": "CASE employment_type WHEN '' THEN '未明确' ELSE employment_type END",
             "company_size": "CASE company_size WHEN '20-99人' THEN '100人以下' WHEN '150-500人' THEN '100-499人' WHEN '1万人以上' THEN '10000人及以上' ELSE company_size END"}
CHOSEN = {"province": "ASIA", "experience": "1-3年", "employment_type": "全职"}


@query("D4_facet_options", with_(P_LEAN) + " UNION ALL ".join(
    f"SELECT '{f}' AS facet, {e} AS value, count(*) AS n FROM postings WHERE " + " AND ".join(f"{FACET_SQL[g]} = '{v}'" for g, v in CHOSEN.items() if g != f) + " GROUP BY 2" for f, e in FACET_SQL.items()))
def d4(spark, sf):
    return admit.facet_options(postings(spark, sf, False), CHOSEN)


FIT = with_(P_WHOLE) + """, pr AS (SELECT * FROM (VALUES ('a','本科','实习',2026),('b','硕士','校招',NULL),('c','','未明确',NULL)) t(pid, e, pref, y)), x AS (SELECT *, CASE education WHEN '大专' THEN 1 WHEN '本科' THEN 2 WHEN '硕士' THEN 3 END AS need, CASE e WHEN '本科' THEN 2 WHEN '硕士' THEN 3 END AS own, employment_type='实习' AS intern,
 experience LIKE '%应届%' AS campus, experience IN ('1-3年','3-5年','5-10年') AS firm FROM postings, pr),
 z AS (SELECT *, (coalesce(need>own,false))::INT + (pref='校招' AND intern)::INT + ((pref='校招' OR (pref='实习' AND NOT intern)) AND firm)::INT AS rej FROM x)"""


@query("D5_assess_fit", FIT + """SELECT pid, rej=0 AS fit_eligible, CAST(CASE WHEN rej>0 THEN 3 WHEN pref='实习' THEN CASE WHEN intern THEN 0 WHEN campus THEN 1 ELSE 2 END ELSE 0 END AS INT) AS fit_tier,
 CAST((e<>'' AND need IS NULL)::INT + (y IS NOT NULL)::INT + (pref='实习')::INT AS INT) AS checks, count(*) AS n FROM z GROUP BY ALL""")
def d5(spark, sf):
    p, profiles = fit_tables(spark, sf)
    return admit.assess_fit(p, profiles).groupBy("pid", "fit_eligible", "fit_tier", F.size("fit_checks").alias("checks")).agg(F.count(F.lit(1)).alias("n"))


@query("D5_best_fits", FIT + """, t AS (SELECT pid, seq, CAST(CASE WHEN pref='实习' THEN CASE WHEN intern THEN 0 WHEN campus THEN 1 ELSE 2 END ELSE 0 END AS INT) AS fit_tier FROM z WHERE rej=0)
SELECT pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY fit_tier, seq) AS INT) AS rank, seq, fit_tier, true AS target_match, CAST(1 AS INT) AS target_priority FROM t QUALIFY rank <= 50""")
def d5b(spark, sf):
    return admit.best_fits(*fit_tables(spark, sf), 50)


def fit_tables(spark, sf):
    p = whole_postings(spark, sf).withColumns({"role_families": F.array(F.lit("x"))})
    rows = [("a", "本科", "实习", 2026, []), ("b", "硕士", "校招", None, []), ("c", "", "未明确", None, [])]
    return p, spark.createDataFrame(rows, "pid string, profile_education string, profile_preference string, profile_graduation_year int, profile_roles array<string>")


def label_tables(spark, sf):
    """Postings with identity and labels derived from them: two skills per posting, one of them unproven at times."""
    p = first_per_key(whole_postings(spark, sf, F.lit("正文")), ["platform", "job_id"], [F.col("seq")]).withColumn("row_no", F.col("seq"))
    p = p.withColumns({"job_key": clean.job_key(), "content_hash": F.sha2("job_name", 256)})
    first, second = F.split_part("skills", F.lit(" "), F.lit(1)), F.split_part("skills", F.lit(" "), F.lit(2))
    quote = F.when(F.col("seq") % 3 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("…"), second, F.lit("…")))
    item = lambda kind, label, q: F.struct(F.lit(kind).alias("label_type"), label.alias("label"), q.alias("quote"))
    labels = p.select(
        "job_key", "row_no", "job_id", "job_name", F.when(F.col("seq") % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("seq") % 2 == 0, "approved").otherwise("pending").alias("state"), F.array(first, second).alias("label_skills"), F.array(F.lit("t")).alias("label_tasks"),
        F.array().cast("array<string>").alias("label_domains"), F.array(item("skill", first, first), item("技能", second, quote)).alias("evidence"),
        F.col("job_key").alias("label_key"), F.when(F.col("seq") % 7 == 0, "非目标").otherwise("高").alias("relevance_grade"), F.lit("").alias("label_status"), "seq")
    return p, labels


L = """one AS MATERIALIZED (SELECT *, split_part(skills,' ',1) AS s1, split_part(skills,' ',2) AS s2, 'K' || substr(sha256('["' || platform || '","' || job_id || '"]'),1,24) AS job_key FROM postings QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq)=1)"""


@query("D6_approved_labels", with_(P_WHOLE, L) + "SELECT DISTINCT job_key, 'skills' AS kind, s AS name FROM (SELECT job_key, unnest(CASE WHEN seq % 3 = 0 THEN [s1] ELSE [s1,s2] END) AS s FROM one WHERE seq % 2 = 0 AND seq % 5 <> 0)")
def d6(spark, sf):
    p, labels = label_tables(spark, sf)
    return admit.approved_labels(labels, p).select("job_key", "kind", "name")


@query("D7_review_state", """SELECT user_id AS label_key, arg_max(event_id, event_id) AS seq, CASE WHEN max(event_id) % 2 = 0 THEN 'approved' END AS decision FROM events GROUP BY 1""")
def d7(spark, sf):
    e = table(spark, sf, "events")
    labels = e.select(F.col("user_id").alias("label_key"), F.sha2(F.col("event_id").cast("string"), 256).alias("label_digest"), F.col("event_id").alias("seq"))
    reviews = e.select(F.col("user_id").alias("label_key"), F.when(F.col("event_id") % 2 == 0, F.sha2(F.col("event_id").cast("string"), 256)).otherwise("old").alias("label_digest"), F.lit("approved").alias("decision"), F.col("event_id").alias("seq"))
    return admit.review_state(labels, reviews).select("label_key", "seq", "decision")


@query("D8_prelabels", with_(P_WHOLE, L) + """SELECT count(*) AS total, count(*) FILTER (seq % 4 = 0) AS rejected_identity, count(*) FILTER (seq % 4 <> 0 AND seq % 7 = 0) AS non_target, count(*) FILTER (seq % 4 <> 0 AND seq % 7 <> 0) AS matched,
 CAST(sum(CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END) FILTER (seq % 4 <> 0 AND seq % 7 <> 0) AS BIGINT) AS skills_with_evidence, CAST(0 AS BIGINT) AS tasks_with_evidence FROM one""")
def d8(spark, sf):
    p, labels = label_tables(spark, sf)
    labels = labels.withColumn("job_name", F.when(F.col("seq") % 4 == 0, "another").otherwise(F.col("job_name")))
    return admit.prelabels(labels, p, WORDS)[1]


@query("D9_consensus_labels", with_(P_WHOLE, L) + """SELECT seq AS row_no, s1 || CASE WHEN seq % 3 = 0 THEN '' ELSE '|' || s2 END AS skills FROM one WHERE seq % 7 <> 0 AND seq % 11 <> 0""")
def d9(spark, sf):
    p, a = label_tables(spark, sf)
    b = a.withColumn("relevance_grade", F.when(F.col("seq") % 11 == 0, "非目标").otherwise("高"))
    return admit.consensus_labels(a, b, p, WORDS)[0].select("row_no", F.array_join("skills", "|").alias("skills"))


LINES = r"""ln AS MATERIALIZED (SELECT doc_id, place, 'E' || place AS evidence_id, line FROM (SELECT doc_id, generate_subscripts(ls, 1) AS place, unnest(ls) AS line FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.\n]+'), lambda x: trim(x, E' \t\r') <> '') AS ls FROM documents)))"""


@query("D10_validate_tags", with_(LINES) + r""", w AS (SELECT doc_id, place, unnest(list_distinct(regexp_extract_all(lower(line), '[a-z]+'))) AS w, line FROM ln), f AS (SELECT doc_id, w, min(place) AS place, arg_min(line, place) AS line FROM w GROUP BY 1,2)
SELECT doc_id AS "key", w AS name, 'E' || place AS evidence_id FROM f WHERE length(w) <= 35 AND regexp_matches(lower(line), '(^|[^a-z0-9])' || w || '($|[^a-z0-9])') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, w) <= 30""")
def d10(spark, sf):
    """Every word of a text is a tag with its first line as evidence; words of the first line have a misspelt double and one whose evidence does not exist."""
    lines = F.filter(F.split("text", r"[.\n]+"), lambda x: F.trim(F.lit(" \t\r"), x) != "")
    texts = table(spark, sf, "documents")
    # Texts move, not their words.
    d = texts.select("doc_id", "text").repartition(shuffle_width(texts), "doc_id").select(F.col("doc_id").alias("key"), F.posexplode(lines).alias("place", "quote")).withColumn("evidence_id", F.concat(F.lit("E"), (F.col("place") + 1).cast("string")))
    words = d.select("key", "place", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("quote"), F.lit("([a-z]+)"), 1))).alias("w")).groupBy("key", "w").agg(F.min("place").alias("place"))
    words = words.withColumn("evidence_id", F.concat(F.lit("E"), (F.col("place") + 1).cast("string")))
    mention = lambda name, proof: F.struct(F.lit("skills").alias("field"), name.alias("name"), proof.alias("evidence_id"))
    real = F.array(mention(F.col("w"), F.col("evidence_id")))
    more = F.array(mention(F.concat("w", F.lit("0qzx")), F.col("evidence_id")), mention(F.col("w"), F.lit("none")))
    # Words of a line share its number, so that equal places are told apart by name.
    tags = words.select("key", F.lit("include").alias("fit"), F.explode(F.when(F.col("place") == 0, F.concat(real, more)).otherwise(real)).alias("t"), F.struct("place", "w").alias("tag_no")).select("key", "fit", "t.*", F.lit("").alias("category"), "tag_no")
    return admit.validate_tags(tags, d.select("key", "evidence_id", "quote"))[0].select("key", "name", "evidence_id")


@query("D11_validate_review_labels", with_(P_WHOLE) + """SELECT CASE WHEN province='ASIA' THEN 'unknown_source' WHEN seq % 5 = 0 THEN 'stale_hash' WHEN seq % 7 = 0 THEN 'unknown_role' WHEN length(job_name) < 12 THEN 'insufficient_target_evidence' END AS reason, count(*) AS n FROM postings WHERE province='ASIA' OR seq % 5 = 0 OR seq % 7 = 0 OR length(job_name) < 12 GROUP BY 1""")
def d11(spark, sf):
    p = whole_postings(spark, sf).withColumns({"key": F.col("seq"), "content_hash": F.lit("h"), "job_description": F.concat("job_name", F.lit("\n"), "job_description")})
    labels = p.select("key", F.when(F.col("seq") % 5 == 0, "old").otherwise("h").alias("content_hash"), F.when(F.col("seq") % 7 == 0, "z").otherwise("r").alias("role"), F.lit("target").alias("decision"), F.lit("job_description").alias("evidence_field"), F.col("job_name").alias("quote"))
    return admit.validate_review_labels(labels, p.filter("province <> 'ASIA'"), ["r"])[1]


# Every word of every text; a word is told by the marks before and after it, and a term counts once, as it is first written.
@query("D12_validate_terms", r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{5,}') AS ws, regexp_split_to_array(text, '[A-Za-z]{5,}') AS gaps FROM documents WHERE regexp_matches(text, '[A-Za-z]{5,}')),
 h AS (SELECT doc_id, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS ahead, unnest(gaps[2:len(ws) + 1]) AS behind, generate_subscripts(ws, 1) AS i FROM d)
SELECT doc_id AS job_key, w AS term FROM h WHERE length(w) <= 48 AND NOT regexp_matches(ahead, '[A-Za-z0-9_]$') AND NOT regexp_matches(behind, '^[A-Za-z0-9_]') QUALIFY row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) = 1""")
def d12(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("text").rlike("[A-Za-z]{5,}")).select(F.col("doc_id").alias("job_key"), F.xxhash64("text").cast("string").alias("content_hash"), "text")
    # Texts move, not their words.
    d = d.repartition(shuffle_width(d), "job_key", "content_hash")
    # One sentence per word, so that every span lies inside a short evidence sentence.
    body = F.concat(F.lit("岗位职责"), F.regexp_replace("text", "[ 。；;\n]", "\n"))
    words = F.arrays_zip(_word_starts("text").alias("at"), F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"), 1).alias("w"))
    start = F.col("x.at") + 4
    hits = d.select("job_key", "content_hash", F.explode(words).alias("x")).select("job_key", "content_hash", start.alias("start"), (start + F.length("x.w")).alias("end"), F.col("x.w").alias("text"), F.lit(0.9).alias("score"))
    return admit.validate_term_candidates(hits, d.select("job_key", "content_hash", body.alias("job_description"))).select("job_key", "term")


@F.pandas_udf(ArrayType(IntegerType()))
def _word_starts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [m.start() for m in re.finditer("[A-Za-z]{5,}", t)])


@query("D12_unscanned", with_(DOCP) + "SELECT job_id AS job_key FROM docp WHERE length(job_description) BETWEEN 16 AND 12000 AND city<>'city1' ORDER BY job_id LIMIT 50")
def d12u(spark, sf):
    p = doc_postings(spark, sf).withColumns({"job_key": F.col("job_id"), "content_hash": F.lit("h")})
    scans = p.filter("city = 'city1'").select("job_key", "content_hash", F.lit("v1").alias("pipeline"))
    return admit.unscanned(p, scans, "v1", 50).select("job_key")


@query("D13_title_candidates", with_(P_WHOLE, L) + """, h AS (SELECT *, CASE WHEN employment_type='实习' THEN 0 ELSE 1 END AS stage FROM one WHERE job_name LIKE '%ring%' OR job_name LIKE '%rod%'), p AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY stage ORDER BY job_key)<=80),
 q AS (SELECT *, 2*(CASE WHEN stage=0 THEN salary LIKE '%天' ELSE (salary LIKE '%K%' OR salary LIKE '%月') END)::INT + (job_name LIKE '%ring%')::INT AS score FROM p QUALIFY row_number() OVER (PARTITION BY company_name, city, job_name ORDER BY stage, job_key)=1),
 r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, job_key) AS place FROM q)
SELECT job_key, CAST(stage AS INT) AS stage, CAST(row_number() OVER (ORDER BY place, stage) AS INT) AS rank FROM r QUALIFY rank <= 24""")
def d13(spark, sf):
    p, _ = label_tables(spark, sf)
    return admit.title_candidates(p, ["ring", "rod"], roles=["ring"])[0].select("job_key", "stage", "rank")
