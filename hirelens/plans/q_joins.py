"""Queries for E."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.core import rnd
from hirelens.functions import salary
from hirelens.operators import clean, joins
from hirelens.plans.q_functions import SAL
from hirelens.plans.q_sources import KB, knowledge
from hirelens.plans.registry import query
from hirelens.plans.views import DOCP, P_LEAN, R, doc_postings, postings, table, with_


@query("E1_live_postings", KB + "SELECT job_key, seq FROM jobs WHERE job_key IN (SELECT job_key FROM members WHERE task_id <> '实习')")
def e1(spark, sf):
    jobs, tasks, members = knowledge(spark, sf)
    return joins.live_postings(jobs, members, tasks).select("job_key", "seq")


@query("E2_task_catalog", KB + "SELECT task_id, label, count(*) AS n FROM members JOIN tasks USING (task_id) WHERE NOT archived GROUP BY 1,2")
def e2(spark, sf):
    _, tasks, members = knowledge(spark, sf)
    return joins.task_catalog(members, tasks)


@query("E3_attach_labels", with_(DOCP) + """, lab AS (SELECT job_id AS label_id, CASE WHEN seq % 2 = 0 THEN 'K' || job_id ELSE '' END AS kk, CASE WHEN seq % 3 = 0 THEN 'other' ELSE job_name END AS name, job_id, substr(job_description,1,6000) AS body FROM docp)
SELECT label_id, 'K' || job_id AS job_key FROM lab WHERE name<>'other'""")
def e3(spark, sf):
    d = doc_postings(spark, sf)
    jobs = d.withColumns({"job_key": F.concat(F.lit("K"), "job_id"), "content_hash": F.lit("h")})
    labels = jobs.select(F.col("job_id").alias("label_id"), F.when(F.col("seq") % 2 == 0, F.col("job_key")).otherwise("").alias("knowledge_key"), F.lit("h").alias("knowledge_hash"), "job_id",
                         F.when(F.col("seq") % 3 == 0, "other").otherwise(F.col("job_name")).alias("job_name"), F.substring("job_description", 1, 6000).alias("job_description"))
    return joins.attach_labels(labels, jobs).select("label_id", "job_key")


@query("E4_enrich_by_version", KB + """SELECT job_key, CASE WHEN city='NATION_2' THEN '' WHEN seq % 3 = 0 THEN company_name || ' v' WHEN seq % 3 = 1 THEN company_name || ' j' ELSE '' END AS company_name, CASE WHEN seq % 3 = 2 OR city = 'NATION_2' THEN 'unset' ELSE province END AS province FROM jobs WHERE city<>'NATION_2'
 UNION ALL SELECT job_key, company_name, 'unset' FROM jobs WHERE city='NATION_2'""")
def e4(spark, sf):
    jobs, _, _ = knowledge(spark, sf)
    j = jobs.withColumn("content_hash", F.lit("h"))
    rows = j.select("job_key", "content_hash", F.when(F.col("city") == "NATION_2", F.col("company_name")).otherwise("").alias("company_name"), F.lit("unset").alias("province"))
    v = j.filter("seq % 3 = 0").select("job_key", "content_hash", F.concat("company_name", F.lit(" v")).alias("company_name"), "province")
    c = j.filter("seq % 3 < 2").select("job_key", "content_hash", F.concat("company_name", F.lit(" j")).alias("company_name"), "province")
    return joins.enrich_by_version(rows, v, c).select("job_key", "company_name", "province")


@query("E5_reuse_or_compute", KB + "SELECT job_key, CASE WHEN city='NATION_2' THEN 'cached' ELSE upper(job_name) END AS result, city='NATION_2' AS reused FROM jobs")
def e5(spark, sf):
    jobs, _, _ = knowledge(spark, sf)
    j = jobs.withColumn("content_hash", F.lit("h"))
    cache = j.filter("city in ('NATION_2', 'NATION_3')").select("job_key", "content_hash", F.lit("cached").alias("result"), F.when(F.col("city") == "NATION_2", "p2").otherwise("p1").alias("pipeline"))
    out = joins.reuse_or_compute(j, cache, lambda d: d.select("job_key", "content_hash", F.upper("job_name").alias("result")), "p2")
    return out.select("job_key", "result", "reused")


@query("E6_merge_tag_sets", """SELECT source AS "key", CASE WHEN source IN ('src1','src2') THEN 'old' ELSE 'new' END AS origin FROM (SELECT DISTINCT source FROM documents)""")
def e6(spark, sf):
    s = table(spark, sf, "documents").select(F.col("source").alias("key")).distinct()
    old = s.filter("key <> 'src5'").select("key", F.when(F.col("key").isin("src1", "src2"), "c2").otherwise("c1").alias("contract"), F.lit("old").alias("origin"))
    new = s.select("key", F.lit("c1").alias("contract"), F.lit("new").alias("origin"))
    return joins.merge_tag_sets(old, new, "c2").select("key", "origin")


@query("E7_pending_extraction", with_(DOCP) + """SELECT job_name AS "key", min(seq) AS seq FROM docp WHERE platform<>'de' AND job_name NOT IN (SELECT job_name FROM docp WHERE city='city1' AND platform='fr') GROUP BY 1""")
def e7(spark, sf):
    d = doc_postings(spark, sf).withColumns({"key": F.col("job_name"), "matched": F.col("platform") != "de"})
    tags = d.filter("city = 'city1'").select("key", F.lit("include").alias("fit"), F.when(F.col("platform") == "fr", "c2").otherwise("c1").alias("contract"))
    return joins.pending_extraction(d, tags, "c2").select("key", "seq")


@query("E8_first_accepted_observation", """WITH a AS (SELECT o_custkey AS aid, max(o_orderdate) AS created FROM orders GROUP BY 1 ORDER BY created DESC, aid LIMIT 20), o AS (SELECT o_custkey AS aid, o_orderpriority AS job_key, created FROM orders JOIN a ON aid=o_custkey)
SELECT job_key, arg_min(aid, (-epoch(created), aid)) AS analysis_id FROM o GROUP BY 1""")
def e8(spark, sf):
    o = table(spark, sf, "orders")
    a = o.groupBy(F.col("o_custkey").alias("analysis_id")).agg(F.max("o_orderdate").alias("created_at"), F.collect_list(F.struct(F.col("o_orderpriority").alias("job_key"), F.lit("h").alias("content_hash"))).alias("observations")).withColumn("role", F.lit("r"))
    return joins.first_accepted_observation(a).select("job_key", "analysis_id")


@query("E9_comparable_strata", with_(P_LEAN, SAL) + f""", g AS (SELECT platform, city, experience, education, employment_type, count(*) AS n, count(mk) AS valid_salary_rows, quantile_cont(mk, 0.5) AS med FROM sal WHERE education<>'' AND employment_type<>'' AND platform IN ('1-URGENT','5-LOW') GROUP BY ALL HAVING count(mk)>=5)
SELECT platform AS role, city, experience, education, employment_type, n, valid_salary_rows, {R('med', 4)} AS median_salary_k FROM g WHERE (city, experience, education, employment_type) IN (SELECT (city, experience, education, employment_type) FROM g GROUP BY city, experience, education, employment_type HAVING count(*)=2)""")
def e9(spark, sf):
    p = salary.with_salary(postings(spark, sf, False)).withColumn("role", F.col("platform"))
    return joins.comparable_strata(p, ["1-URGENT", "5-LOW"]).withColumn("median_salary_k", rnd("median_salary_k", 4))


@query("E10_reconcile_counts", """WITH c AS (SELECT event_type AS channel, count(*) AS a, count(DISTINCT user_id) AS b, CAST(sum(value) AS BIGINT) // 100 AS c FROM events GROUP BY 1), m AS (SELECT channel, greatest(a, b, c) AS rows FROM c)
SELECT channel, rows, (SELECT CAST(sum(rows) AS BIGINT) FROM m WHERE channel IN ('click','view')) AS public_rows, (SELECT CAST(sum(rows) AS BIGINT) FROM m WHERE channel IN ('click','view','error')) AS candidates FROM m WHERE channel IN ('click','view','error')""")
def e10(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("channel"))
    a, b = e.agg(F.count(F.lit(1)).alias("rows")), e.agg(F.count_distinct("user_id").alias("rows"))
    c = e.agg(F.floor(F.round(F.sum("value")) / 100).cast("long").alias("rows"))
    return joins.reconcile_counts([a, b, c], ["click", "view"], ["error"])


@query("E11_distinct_ids", """SELECT event_type AS channel, count(DISTINCT user_id) AS rows FROM events GROUP BY 1""")
def e11(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("channel"), F.col("user_id").cast("string").alias("job_id"), "value")
    return joins.distinct_ids_across_sources([e.filter("value < 50"), e.filter("value >= 20")])


@query("E11_detail_progress", """SELECT event_type AS channel, count(DISTINCT user_id) AS discovered, count(ok) AS processed, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN event_id % 3 = 0 END AS ok FROM events) GROUP BY 1""")
def e11p(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("channel"), F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 3 == 0).alias("ok"))
    return joins.detail_progress(e, ["channel"])


@query("E12_salary_gap", with_(P_LEAN, SAL) + f""", g AS (SELECT city, employment_type AS stage, period, platform AS role, count(*) AS n, quantile_cont(mid,0.5) AS med FROM sal WHERE period IS NOT NULL GROUP BY ALL)
SELECT a.city, a.stage, a.period, a.role, b.role AS base_role, {R('a.med-b.med',4)} AS difference, {R('(a.med-b.med)/b.med*100',4)} AS percent FROM g a JOIN g b ON a.city=b.city AND a.stage=b.stage AND a.period=b.period WHERE b.role='5-LOW' AND a.role<>'5-LOW' AND a.n>=5 AND b.n>=5""")
def e12(spark, sf):
    p = salary.parse_salary(postings(spark, sf, False)).filter("pay is not null")
    g = p.groupBy("city", F.col("employment_type").alias("stage"), F.col("pay.period").alias("period"), F.col("platform").alias("role")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("pay.midpoint", 0.5).alias("median")).withColumn("published", F.col("n") >= 5)
    return joins.salary_gap(g, ["5-LOW"]).select("city", "stage", "period", "role", "base_role", rnd("difference", 4).alias("difference"), rnd("percent", 4).alias("percent"))


@query("E13_union_sources", with_(P_LEAN) + "SELECT 'a' AS source_name, count(*) AS n FROM postings WHERE province='ASIA' UNION ALL SELECT 'b', count(*) FROM postings WHERE province<>'ASIA'")
def e13(spark, sf):
    p = postings(spark, sf, False)
    return joins.source_counts(joins.union_sources({"a": p.filter("province = 'ASIA'").drop("city"), "b": p.filter("province <> 'ASIA'").withColumn("task_id", F.lit("t"))}, "t"))
