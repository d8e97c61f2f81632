"""Queries for F over the postings with skills as words of the part name."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.core import first_per_key, rnd
from hirelens.functions import groups, labels, salary, text
from hirelens.operators import clean, stats
from hirelens.plans.q_admit import ADMIT, FACET_SQL, admitted
from hirelens.plans.q_functions import ASK, QX, SAL, asking
from hirelens.plans.registry import query
from hirelens.plans.views import CONV, P_LEAN, P_WHOLE, R, doc_postings, postings, table, with_

USABLE = "CASE WHEN mk<=200 AND (mk>=3 OR (period='day' AND mk>0)) THEN mk END"
U = f"u AS MATERIALIZED (SELECT *, {USABLE} AS v, str_split(skills,' ') AS sk FROM sal)"


def base(spark, sf):
    p = salary.with_salary(postings(spark, sf, False))
    return p.withColumns({"skills": F.split("skills", " "), "company_key": F.col("company_name"), "industry": F.col("experience")})


def q(x, p, d=2):
    return R(f"quantile_cont({x},{p})", d)


@query("F1_count_by", with_(P_LEAN) + "SELECT city AS name, count(*) AS n FROM postings GROUP BY 1")
def f1(spark, sf):
    return stats.count_by(postings(spark, sf, False), "city")


@query("F1_distribution", with_(P_LEAN) + """, c AS (SELECT city AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, city) AS r FROM postings GROUP BY 1)
SELECT name, n, CAST(r AS INT) AS rank FROM c WHERE r<=6 UNION ALL SELECT '其他（剩余类别）', CAST(sum(n) AS BIGINT), 7 FROM c WHERE r>6""")
def f1d(spark, sf):
    return stats.count_by(postings(spark, sf, False), "city", 6, "其他（剩余类别）")


@query("F2_quantiles", with_(P_LEAN, SAL) + f"SELECT city, count(mk) AS n, {q('mk',.25)} AS p25, {q('mk',.5)} AS p50, {q('mk',.75)} AS p75 FROM sal WHERE mk IS NOT NULL GROUP BY 1")
def f2(spark, sf):
    return stats.quantiles(base(spark, sf), "salary_midpoint_k", [0.25, 0.5, 0.75], ["city"])


@query("F2_quantiles_by_position", f"SELECT l_returnflag, count(*) AS n, {q('l_extendedprice',.25)} AS p25, {q('l_extendedprice',.5)} AS p50, {q('l_extendedprice',.9)} AS p90 FROM lineitem GROUP BY 1")
def f2p(spark, sf):
    return stats.quantiles_by_position(table(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.9], ["l_returnflag"])


@query("F3_salary_group_stats", with_(P_LEAN, SAL) + f"""SELECT company_name, city, platform, period, count(*) AS n, {R('quantile_cont(mid,0.5)',4)} AS median, min(lo) AS quote_min, max(hi) AS quote_max, count(*)>=5 AS published, CASE WHEN count(*)>=5 THEN {R('quantile_cont(mid,0.25)',4)} END AS p25, CASE WHEN count(*)>=5 THEN {R('quantile_cont(mid,0.75)',4)} END AS p75,
 CASE WHEN count(*)<5 THEN array_to_string(list_sort(list(salary)),'、') END AS raw_quotes FROM sal WHERE period IS NOT NULL GROUP BY 1,2,3,4""")
def f3(spark, sf):
    p = base(spark, sf).withColumn("period", F.col("pay.period"))
    g = stats.salary_group_stats(p, ["company_name", "city", "platform", "period"])
    return g.withColumns({c: rnd(c, 4) for c in ("median", "p25", "p75")}).drop("period_inferred_rows")


@query("F3_pay_months", with_(P_LEAN, SAL) + "SELECT city, CASE WHEN salary LIKE '%13薪' THEN '13薪' ELSE '未公开' END AS pay_months, count(*) AS n FROM sal WHERE period IS NOT NULL GROUP BY 1,2")
def f3m(spark, sf):
    return stats.pay_month_distribution(base(spark, sf), ["city"])


BENCH = f"b AS MATERIALIZED (SELECT *, decision='include' AND NOT closed AND NOT bad AND salary<>'面议' AS ok FROM adm)"


@query("F4_salary_benchmark", with_(P_WHOLE, SAL, ADMIT, BENCH) + f"""SELECT CASE grouping_id(city, platform) WHEN 3 THEN 'period' WHEN 1 THEN 'city' ELSE 'role' END AS level, period, city, platform AS role, count(*) AS n, {R('quantile_cont(mid,0.5)',4)} AS median, CASE WHEN count(*)>=5 THEN {R('quantile_cont(mid,0.25)',4)} END AS p25, min(lo) AS quote_min, max(hi) AS quote_max
 FROM b WHERE ok AND education IN ('大专','本科') GROUP BY GROUPING SETS ((period),(city,period),(city,platform,period))""")
def f4(spark, sf):
    p = admitted(spark, sf).withColumn("role_families", F.array("platform"))
    out = stats.salary_benchmark(p, {"education": "本科"})[0]
    return out.select("level", "period", "city", "role", "n", rnd("median", 4).alias("median"), rnd("p25", 4).alias("p25"), "quote_min", "quote_max")


@query("F4_benchmark_exclusions", with_(P_WHOLE, SAL, ADMIT, BENCH) + """SELECT count(*) AS matched_jobs, count(*) FILTER (ok AND education IN ('大专','本科')) AS benchmark_jobs, CAST(0 AS BIGINT) AS unknown_cohort_rows, count(*) FILTER (education NOT IN ('大专','本科')) AS education_excluded, count(*) FILTER (NOT ok) AS salary_quality_excluded FROM b""")
def f4x(spark, sf):
    p = admitted(spark, sf).withColumn("role_families", F.array("platform"))
    return stats.salary_benchmark(p, {"education": "本科"})[1]


@query("F5_benchmark_by_field", with_(P_LEAN, SAL) + f"SELECT company_name AS name, count(mk) AS salary_count, {q('mk',.25,1)} AS p25, {q('mk',.5,1)} AS median, {q('mk',.75,1)} AS p75 FROM sal GROUP BY 1 HAVING count(mk)>=5 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 12")
def f5(spark, sf):
    return stats.benchmark_by_field(base(spark, sf), "company_name")


COHORT = f"count(v) AS salary_count, count(*)-count(v) AS excluded, count(v) FILTER (period='day') AS converted_daily_count, {q('v',.5)} AS median, {q('v',.25)} AS p25, {q('v',.75)} AS p75, {R('avg(v)',4)} AS mean"


@query("F6_cohort_salary", with_(P_LEAN, SAL, U) + f"SELECT city, {COHORT} FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq)=1) GROUP BY 1")
def f6(spark, sf):
    p = salary.with_salary(clean.dedupe_first(postings(spark, sf, False).select("platform", "job_id", "seq", "city", "salary")))
    return stats.cohort_salary(p, [groups.city_name().alias("city")])


@query("F7_label_frequency", with_(P_LEAN, SAL, U) + f"""SELECT name, count(*) AS n, count(mk) AS salary_count, {q('mk',.5)} AS median_salary_k, {R('count(*)/(SELECT count(*) FROM u)',6)} AS rate, array_to_string(list(CAST(seq AS VARCHAR) ORDER BY seq)[1:3],'|') AS samples FROM (SELECT DISTINCT seq, mk, unnest(sk) AS name FROM u) GROUP BY 1""")
def f7(spark, sf):
    g = stats.label_frequency(base(spark, sf).withColumn("job_id", F.col("seq").cast("string")), "skills")
    return g.withColumns({"rate": rnd("rate", 6), "samples": F.array_join("samples", "|")})


@query("F8_summarize_cohort", with_(P_LEAN, SAL) + f"SELECT experience, count(*) AS n, count(mk) AS salary_count, {q('mk',.5)} AS median, {q('mk',.25)} AS p25, {q('mk',.75)} AS p75, count(DISTINCT company_name) AS company_count, count(DISTINCT CASE WHEN education<>'' THEN company_name END) AS industry_known_companies, {R(chr(99)+'ount(DISTINCT CASE WHEN education<>'+chr(39)*2+' THEN company_name END)/count(DISTINCT company_name)',6)} AS industry_coverage FROM sal GROUP BY 1")
def f8(spark, sf):
    return stats.summarize_cohort(base(spark, sf).withColumn("industry", F.col("education")), ["experience"]).withColumn("industry_coverage", rnd("industry_coverage", 6))


@query("F8_employment_mix", with_(P_LEAN) + "SELECT experience, employment_type, count(*) AS n FROM postings GROUP BY 1,2")
def f8m(spark, sf):
    return stats.employment_mix(base(spark, sf), ["experience"])


@query("F9_industry_shares", with_(P_LEAN) + f""", p AS (SELECT DISTINCT platform, company_name, experience FROM postings), k AS (SELECT *, 1.0/count(*) OVER (PARTITION BY platform, company_name) AS w FROM p)
SELECT platform, experience AS name, {R('sum(w)',2)} AS company_weight, {R('sum(w)/(SELECT count(DISTINCT company_name) FROM p p2 WHERE p2.platform=k.platform)',6)} AS share FROM k GROUP BY 1,2""")
def f9(spark, sf):
    return stats.industry_shares(base(spark, sf), ["platform"])


@query("F10_with_without", with_(P_LEAN, SAL, U) + f""", s AS (SELECT DISTINCT unnest(sk) AS name FROM u), x AS (SELECT name, list_contains(sk, name) AS has, v FROM u, s), g AS (SELECT name, count(*) FILTER (has) AS n, count(v) FILTER (has) AS with_count, count(v) FILTER (NOT has) AS without_count, {R('quantile_cont(v,0.5) FILTER (has)',2)} AS with_median, {R('quantile_cont(v,0.5) FILTER (NOT has)',2)} AS without_median FROM x GROUP BY 1)
SELECT *, {R('with_median-without_median',2)} AS difference FROM g""")
def f10(spark, sf):
    return stats.with_without_association(base(spark, sf))


@query("F11_salary_by_experience", with_(P_LEAN, SAL, U) + f"""SELECT CASE experience WHEN '应届毕业生' THEN '在校/应届' ELSE experience END AS name, CASE experience WHEN '应届毕业生' THEN 0 WHEN '1-3年' THEN 2 WHEN '3-5年' THEN 3 WHEN '5-10年' THEN 4 END AS "order", {COHORT} FROM u GROUP BY 1,2""")
def f11(spark, sf):
    return stats.salary_by_experience(base(spark, sf))


@query("F12_province_stats", with_(P_LEAN, SAL, U) + f""", e AS (SELECT province, CASE education WHEN '' THEN '未明确' ELSE education END AS edu, count(*) AS c FROM u GROUP BY 1,2)
SELECT province AS name, count(*) AS n, count(v) AS salary_count, count(v) FILTER (period='day') AS converted_daily_count, {R('avg(v)',4)} AS average_salary_k, {q('v',.25)} AS p25_salary_k, {q('v',.5)} AS median_salary_k, {q('v',.75)} AS p75_salary_k,
 (SELECT array_to_string(list_sort(list(edu)),'、') FROM e WHERE e.province=u.province AND c=(SELECT max(c) FROM e e2 WHERE e2.province=u.province)) AS top_education, (SELECT max(c) FROM e e2 WHERE e2.province=u.province) AS top_education_count FROM u GROUP BY 1""")
def f12(spark, sf):
    return stats.province_stats(base(spark, sf), "province")


@query("F13_company_ranking", with_(P_LEAN) + f""", o AS (SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq)=1), g AS (SELECT company_name AS name, count(*) AS n, array_to_string(list_sort(list(DISTINCT platform)),'|') AS platforms FROM o GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY n DESC, name) AS INT) AS rank, name, n, {R('n/(SELECT count(*) FROM o)',6)} AS share, platforms FROM g QUALIFY rank<=10""")
def f13(spark, sf):
    return stats.company_ranking(postings(spark, sf, False))


@query("F14_city_stats", with_(P_LEAN, SAL) + f"SELECT city AS name, count(*) AS n, count(mk) AS salary_count, {q('mk',.5,1)} AS median_salary_k, {R('count(*)/(SELECT count(*) FROM sal)',3)} AS rate, CASE WHEN city='NATION_1' THEN 116.4 END AS longitude, CASE WHEN city='NATION_1' THEN 39.9 END AS latitude FROM sal GROUP BY 1")
def f14(spark, sf):
    return stats.city_stats(base(spark, sf), [("NATION_1", 116.4, 39.9)])


@query("F15_skill_pairs", with_(P_LEAN, SAL, U) + f""", s AS (SELECT a, count(*) AS c FROM (SELECT unnest(sk) AS a FROM u) GROUP BY 1), p AS (SELECT least(sk[1],sk[2]) AS a, greatest(sk[1],sk[2]) AS b, count(*) AS n, count(mk) AS salary_count, {q('mk',.5,1)} AS median_salary_k FROM u GROUP BY 1,2),
 t AS (SELECT count(*) AS total FROM u), l AS (SELECT p.*, n*total/(x.c*y.c) AS lift, n/total AS support FROM p, t, s x, s y WHERE x.a=p.a AND y.a=p.b AND n>=greatest(3,ceil(total*0.015)))
SELECT a || ' + ' || b AS name, n, {R('support',3)} AS support, {R('lift',2)} AS lift, salary_count, median_salary_k FROM l ORDER BY n DESC, l.lift DESC, a, b LIMIT 15""")
def f15(spark, sf):
    return stats.skill_pairs(base(spark, sf))


TRI = f"tri AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_concat(str_split(skills,' '), [lower(split_part(job_name,' ',1)), city]))) AS ks FROM sal WHERE mk IS NOT NULL)"


@query("F16_frequent_sets", with_(P_LEAN, SAL, TRI) + f""", t AS (SELECT count(*) AS total FROM tri), s AS (SELECT a, count(*) AS c FROM (SELECT unnest(ks) AS a FROM tri) GROUP BY 1), top AS (SELECT a, c FROM s, t WHERE c>=greatest(6,ceil(total*0.03)) ORDER BY c DESC, a LIMIT 26), f AS (SELECT mk, list_filter(ks, lambda k: k IN (SELECT a FROM top)) AS ks FROM tri),
 e AS (SELECT seq, mk, a FROM (SELECT seq, mk, unnest(ks) AS a FROM tri) SEMI JOIN top USING (a)), r AS (SELECT [x.a,y.a] AS items, x.mk FROM e x JOIN e y ON x.seq=y.seq AND x.a<y.a UNION ALL SELECT [x.a,y.a,z.a], x.mk FROM e x JOIN e y ON x.seq=y.seq AND x.a<y.a JOIN e z ON z.seq=y.seq AND y.a<z.a UNION ALL
 SELECT [x.a,y.a,z.a,w.a], x.mk FROM e x JOIN e y ON x.seq=y.seq AND x.a<y.a JOIN e z ON z.seq=y.seq AND y.a<z.a JOIN e w ON w.seq=z.seq AND z.a<w.a),
 g AS (SELECT items, len(items) AS size, count(*) AS n, {q('mk',.5,1)} AS raw_median_salary_k FROM r GROUP BY 1), h AS (SELECT g.*, total, n/total AS support FROM g, t WHERE n>=greatest(5,ceil(total*0.03))),
 x AS (SELECT items, size, n, support, raw_median_salary_k, total, product(c/total) AS expected FROM (SELECT *, unnest(items) AS a FROM h) JOIN s USING (a) GROUP BY ALL), y AS (SELECT *, support/greatest(expected, 1/total) AS lift FROM x)
SELECT array_to_string(items,' + ') AS name, CAST(size AS INT) AS size, n, {R('support',3)} AS support, {R('lift',2)} AS lift, raw_median_salary_k, CASE WHEN n>=20 THEN '中等' WHEN n>=10 THEN '谨慎参考' ELSE '低' END AS reliability FROM y QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, y.lift DESC, items)<=12""".replace(", f AS (SELECT mk, list_filter(ks, lambda k: k IN (SELECT a FROM top)) AS ks FROM tri)", ""))
def f16(spark, sf):
    p = base(spark, sf)
    p = p.withColumn("skills", F.concat("skills", F.array(F.lower(F.split_part("job_name", F.lit(" "), F.lit(1))), F.col("city"))))
    return stats.frequent_sets(p)


@query("F17_channel_completeness", with_(P_LEAN) + "SELECT platform AS channel, count(*) AS rows, count(*) FILTER (education<>'') AS complete_rows, count(*) FILTER (education='') AS incomplete_rows FROM postings GROUP BY 1")
def f17(spark, sf):
    p = postings(spark, sf, False).withColumn("job_description", F.when(F.col("education") == "", "short").otherwise("A description of the duties of this posting"))
    return stats.channel_completeness(p)


@query("F18_quality_report", with_(P_LEAN) + f"""SELECT 'rows' AS section, 'output_rows' AS item, count(*) AS n, CAST(NULL AS DOUBLE) AS rate FROM postings UNION ALL SELECT 'rows','invalid_job_url', 0, NULL UNION ALL SELECT 'completeness', 'education', count(*) FILTER (education<>''), {R("count(*) FILTER (education<>'')/count(*)",4)} FROM postings
 UNION ALL SELECT 'completeness','employment_type', count(*) FILTER (employment_type<>''), {R("count(*) FILTER (employment_type<>'')/count(*)",4)} FROM postings UNION ALL SELECT 'platform', platform, count(*), NULL FROM postings GROUP BY platform""")
def f18(spark, sf):
    return stats.quality_report(postings(spark, sf, False), ["education", "employment_type"])


@query("F19_coverage_report", with_(P_LEAN) + f"""SELECT 'field' AS section, 'education' AS item, count(*) FILTER (education<>'') AS n, {R("count(*) FILTER (education<>'')/count(*)",3)} AS rate FROM postings UNION ALL SELECT 'match_method', platform, count(*), NULL FROM postings GROUP BY platform""")
def f19(spark, sf):
    return stats.coverage_report(postings(spark, sf, False).withColumn("match_method", F.col("platform")), ["education"])


# Some rows without a key, keys of several rows, and two reasons against a row.
FUNNEL = """f AS MATERIALIZED (SELECT platform, CASE WHEN seq % 11 = 0 THEN '' ELSE job_id END AS job_id, seq, CASE WHEN education='' THEN 'no education' WHEN employment_type='' THEN 'no type' END AS reason FROM postings),
 k AS MATERIALIZED (SELECT platform, job_id, count(*) AS c, min_by(coalesce(reason,''), seq) AS reason FROM f WHERE job_id<>'' AND platform<>'' GROUP BY 1,2),
 z AS (SELECT (SELECT count(*) FROM f) AS i, (SELECT count(*) FROM f WHERE job_id='' OR platform='') AS m, (SELECT CAST(coalesce(sum(c-1),0) AS BIGINT) FROM k) AS d, (SELECT count(*) FROM k) AS u, (SELECT count(*) FROM k WHERE reason<>'') AS x)"""


def filtered(spark, sf):
    p = postings(spark, sf, False)
    return p.withColumns({"job_id": F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("job_id")), "filter_reason": F.when(F.col("education") == "", "no education").when(F.col("employment_type") == "", "no type")})


@query("F18_collection_funnel", with_(P_LEAN, FUNNEL) + """SELECT 'input_rows' AS step, i AS n FROM z UNION ALL SELECT 'missing_key_rows', m FROM z UNION ALL SELECT 'duplicate_rows', d FROM z UNION ALL SELECT 'unique_rows', u FROM z UNION ALL SELECT 'excluded_rows', x FROM z
 UNION ALL SELECT 'eligible_rows', u-x FROM z UNION ALL SELECT 'trimmed_rows', greatest(u-x-1000,0) FROM z UNION ALL SELECT 'output_rows', least(u-x,1000) FROM z""")
def f18f(spark, sf):
    return stats.collection_funnel(filtered(spark, sf), target=1000)


@query("F18_filter_reasons", with_(P_LEAN, FUNNEL) + "SELECT platform AS source, reason, count(*) AS n FROM k WHERE reason<>'' GROUP BY 1,2")
def f18r(spark, sf):
    return stats.filter_reasons(filtered(spark, sf))


# Texts matched by one of two words, the language as the role.
AUDIT = """a AS MATERIALIZED (SELECT doc_id, lang, CASE WHEN contains(text,'ung') THEN 'ung' WHEN contains(text,'tion') THEN 'tion' END AS method FROM documents)"""


def audited(spark, sf):
    d = table(spark, sf, "documents")
    method = F.when(F.col("text").contains("ung"), "ung").when(F.col("text").contains("tion"), "tion")
    return d.select("doc_id", F.col("lang").alias("role_family"), method.alias("match_method"), method.isNotNull().alias("matched"))


@query("F19_role_segments", with_(AUDIT) + f"""SELECT 'field' AS section, 'match_method' AS item, count(method) AS n, {R('count(method)/count(*)',3)} AS rate FROM a UNION ALL SELECT 'match_method', method, count(*), NULL FROM a WHERE method IS NOT NULL GROUP BY method
 UNION ALL SELECT 'input_role', lang, count(*), NULL FROM a WHERE lang<>'' GROUP BY lang UNION ALL SELECT 'role', lang, count(method), NULL FROM a WHERE lang<>'' GROUP BY lang HAVING count(method)>0""")
def f19r(spark, sf):
    return stats.coverage_report(audited(spark, sf), ["match_method"])


@query("F19_audit_examples", with_(AUDIT) + """, b AS (SELECT *, coalesce(method,'未匹配') AS audit_group FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY audit_group ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY audit_group) AS n FROM b),
 w AS (SELECT DISTINCT audit_group, CASE WHEN n<=12 THEN i ELSE i*(n-1)//11 END AS p, i FROM (SELECT DISTINCT audit_group, n FROM r), range(12) t(i) WHERE i<n)
SELECT audit_group, CAST(i+1 AS INT) AS audit_no, doc_id FROM w JOIN r USING (audit_group, p)""")
def f19a(spark, sf):
    return stats.audit_examples(audited(spark, sf), "doc_id").select("audit_group", "audit_no", "doc_id")


@query("F20_compare_roles", with_(P_LEAN, SAL, U) + f"SELECT city AS role, count(*) AS matched_jobs, count(v) AS valid_salary_rows, {q('v',.5)} AS median_salary_k, {q('v',.25)} AS p25_salary_k, {q('v',.75)} AS p75_salary_k, array_to_string(list_sort(list(DISTINCT platform)),'|') AS platforms FROM u WHERE city IN ('NATION_1','NATION_2') GROUP BY 1")
def f20(spark, sf):
    return stats.compare_roles(base(spark, sf).withColumn("role_families", F.array("city", "province")), ["NATION_1", "NATION_2"])[0]


@query("F20_role_skills", with_(P_LEAN, SAL, U) + "SELECT city AS role, name, count(*) AS n, CAST(row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, name) AS INT) AS rank FROM (SELECT city, unnest(sk) AS name FROM u WHERE city IN ('NATION_1','NATION_2')) GROUP BY 1,2 QUALIFY rank<=10")
def f20s(spark, sf):
    return stats.compare_roles(base(spark, sf).withColumn("role_families", F.array("city", "province")), ["NATION_1", "NATION_2"])[1]


@query("F21_question_frequency", with_(CONV) + r"""SELECT min(w) AS question, count(DISTINCT id) AS post_count FROM (SELECT id, unnest(str_split(content,' ')) AS w FROM conv) WHERE length(regexp_replace(regexp_replace(lower(regexp_replace(w,'[\s\x{3000}\x{00a0}]','','g')), '^([0-9]{1,3}[.、)）]|[-*•]|问[:：])+', ''), '[，。？?！!、:：；;“”"''()（）]', '', 'g'))>=4
 GROUP BY regexp_replace(regexp_replace(lower(regexp_replace(w,'[\s\x{3000}\x{00a0}]','','g')), '^([0-9]{1,3}[.、)）]|[-*•]|问[:：])+', ''), '[，。？?！!、:：；;“”"''()（）]', '', 'g') HAVING count(DISTINCT id)>=2 ORDER BY 2 DESC, 1 LIMIT 8""")
def f21(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.split("text", " ").alias("questions"))
    return stats.question_frequency(c)


@query("F21_topic_mentions", with_(CONV, ASK, QX) + "SELECT 'the' AS topic, count(*) FILTER (len(list_filter(qs, lambda q: regexp_matches(q,'the')))>0) AS post_count FROM qx UNION ALL SELECT 'ung', count(*) FILTER (len(list_filter(qs, lambda q: regexp_matches(q,'ung')))>0) FROM qx")
def f21t(spark, sf):
    return stats.topic_mentions(asking(spark, sf).withColumn("questions", text.question_excerpts()), [("the", "the"), ("ung", "ung")])


@query("F22_classification_metrics", f"""WITH t AS (SELECT lang, CASE quality WHEN 1 THEN 'include' ELSE 'exclude' END AS g, CASE WHEN n_chars>1200 THEN 'include' ELSE 'exclude' END AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) AS n, count(*) FILTER (g='include' AND p='include') AS tp, count(*) FILTER (g='exclude' AND p='exclude') AS tn, count(*) FILTER (g='exclude' AND p='include') AS fp, count(*) FILTER (g='include' AND p='exclude') AS fn FROM t GROUP BY 1)
SELECT lang, n, tp, tn, fp, fn, {R('(tp+tn)/n',6)} AS accuracy, {R('tp/(tp+fp)',6)} AS "precision", {R('tp/(tp+fn)',6)} AS recall, {R('2*tp/(2*tp+fp+fn)',6)} AS f1 FROM c""")
def f22(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("gold"), F.when(F.col("n_chars") > 1200, "include").otherwise("exclude").alias("prediction"))
    m = stats.classification_metrics(d, ["lang"])
    return m.select("lang", "n", "tp", "tn", "fp", "fn", *[rnd(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


# Two thirds of the labelled documents validate, one third tests.
RELEASE = """t AS (SELECT lang, doc_id % 3 = 0 AS test, quality=1 AS g, n_chars>1200 AS p FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT lang, test, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND NOT p) AS tn, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM t GROUP BY 1,2),
 l AS (SELECT *, least(tp+fn, tn+fp) AS least_class, coalesce(tp/nullif(tp+fp,0)>=0.9 AND tp/nullif(tp+fn,0)>=0.85 AND 2*tp/nullif(2*tp+fp+fn,0)>=0.87, false) AS good,
  CASE WHEN tp+fp>0 THEN (tp/(tp+fp)+z2/(2*(tp+fp))-sqrt(z2)*sqrt(tp/(tp+fp)*(1-tp/(tp+fp))/(tp+fp)+z2/(4*(tp+fp)*(tp+fp))))/(1+z2/(tp+fp)) ELSE 0 END AS plow,
  CASE WHEN tp+fn>0 THEN (tp/(tp+fn)+z2/(2*(tp+fn))-sqrt(z2)*sqrt(tp/(tp+fn)*(1-tp/(tp+fn))/(tp+fn)+z2/(4*(tp+fn)*(tp+fn))))/(1+z2/(tp+fn)) ELSE 0 END AS rlow FROM c, (SELECT 1.959963984540054*1.959963984540054::DOUBLE AS z2))"""


@query("F22_release_reasons", with_(RELEASE) + """SELECT t.lang, array_to_string(list_filter([CASE WHEN t.n<30 THEN '独立测试不足30篇' END, CASE WHEN t.least_class<10 THEN '独立测试每类不足10篇' END, CASE WHEN v.least_class<5 THEN '验证集每类不足5篇' END, CASE WHEN NOT v.good THEN '验证指标未达到精确率90%、召回率85%、F1 87%' END,
 CASE WHEN NOT t.good THEN '测试指标未达到精确率90%、召回率85%、F1 87%' END, CASE WHEN t.plow<0.7 THEN '测试精确率95%置信区间下界不足70%' END, CASE WHEN t.rlow<0.7 THEN '测试召回率95%置信区间下界不足70%' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM l AS t JOIN l AS v ON t.lang=v.lang AND t.test AND NOT v.test""")
def f22r(spark, sf):
    side = lambda c: F.when(c, "include").otherwise("exclude")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", (F.col("doc_id") % 3 == 0).alias("test"), side(F.col("quality") == 1).alias("gold"), side(F.col("n_chars") > 1200).alias("prediction"))
    m = stats.classification_metrics(d, ["lang", "test"])
    part = lambda of, name: m.filter(of).select("lang", F.struct("*").alias(name))
    both = part(F.col("test"), "t").join(part(~F.col("test"), "v"), "lang")
    return both.select("lang", F.array_join(stats.release_reasons(), "|").alias("reasons"))


@query("F23_requirement_coverage", """WITH i AS (SELECT l_orderkey AS k, count(*) AS items, count(DISTINCT l_linenumber) AS ids, count(*) FILTER (l_returnflag<>'R') AS total, count(*) FILTER (l_returnflag='A') AS matched FROM lineitem GROUP BY 1),
 p AS (SELECT o_orderkey AS k, CASE WHEN items=ids AND total>0 THEN 100.0*matched/total END AS pct FROM orders LEFT JOIN i ON k=o_orderkey)
SELECT k AS "key", CAST(round(CAST(pct AS DECIMAL(28,10)),4) AS DOUBLE) AS percentage, row_number() OVER (ORDER BY (pct IS NULL)::INT, -coalesce(pct,0), k) AS place FROM p""")
def f23(spark, sf):
    li = table(spark, sf, "lineitem")
    items = li.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("item_id"), (F.col("l_returnflag") == "R").alias("optional"), F.when(F.col("l_returnflag") == "A", "met").otherwise("not_evidenced").alias("status"), F.lit("x").alias("jd_evidence"), F.lit("y").alias("resume_evidence"))
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("rank"))
    out = stats.requirement_coverage(items, jobs)
    return out.select("key", rnd("percentage", 4).alias("percentage"), F.col("place").cast("long").alias("place"))


@query("F24_labelling_report")
def f24(spark, sf):
    return stats.labelling_report(labels.rule_label(doc_postings(spark, sf)))


@query("F25_label_readiness", """SELECT count(*) FILTER (quality=1 AND toxic=0) AS positive, count(*) FILTER (quality=0) AS negative, count(*) FILTER (quality=1 AND toxic=1) AS review, greatest(0, 24-count(*) FILTER (quality=1 AND toxic=0)) AS deficit_positive, greatest(0,24-count(*) FILTER (quality=0)) AS deficit_negative,
 greatest(0, 60-count(*) FILTER (quality=0 OR toxic=0)) AS deficit_total, greatest(0, 24-count(*) FILTER (quality=1 AND toxic=0))+greatest(0,24-count(*) FILTER (quality=0))+greatest(0, 60-count(*) FILTER (quality=0 OR toxic=0))=0 AS ready FROM labels""")
def f25(spark, sf):
    lab = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "include").when(F.col("quality") == 0, "exclude").otherwise("review")
    return stats.label_readiness(table(spark, sf, "labels").select(lab.alias("label")))


@query("F26_cluster_suggestions", """SELECT arg_min(p_name, p_partkey) AS name, CAST(sum(p_size) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT p_type)),'|') AS keywords FROM part WHERE p_type<>'PROMO' GROUP BY p_name""")
def f26(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("cluster_id"), F.col("p_name").alias("name"), F.when(F.col("p_type") == "PROMO", "mixed").otherwise("coherent").alias("status"), F.col("p_size").alias("n"), F.lit(0.1).alias("share"), F.array("p_type").alias("keywords"))
    return stats.cluster_suggestions(c).select("name", "n", F.array_join("keywords", "|").alias("keywords"))


@query("F27_cloud_terms", """SELECT p_name AS name, max(CASE WHEN p_size>25 THEN CAST(p_size AS DOUBLE) WHEN p_partkey>0 THEN CAST(p_partkey % 7 + 1 AS DOUBLE) ELSE 1 END) AS weight FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def f27(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("score"), F.when(F.col("p_partkey") > 0, F.col("p_partkey") % 7 + 1).alias("n"))
    return stats.cloud_terms(t, 20)


FAM = [("ring", "(?i)ring", "(?i)SMALL", "(?i)red"), ("rod", "(?i)rod", "(?i)LARGE", "(?i)blue"), ("bolt", "(?i)bolt", "(?i)ECONOMY", "(?i)hot")]


@query("F28_infer_dataset_role", with_(P_LEAN) + ", v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(sum(s) AS BIGINT) AS score, count(*) FILTER (s>=4) AS matching_rows, count(*) FILTER (qq) AS query_rows FROM (SELECT 5*regexp_matches(job_name,'{t}')::INT + 2*qq::INT + 3*regexp_matches(skills,'{c}')::INT AS s, qq FROM (SELECT *, regexp_matches(split_part(job_name,' ',1),'{k}') AS qq FROM postings))" for n, t, k, c in FAM) + ") SELECT CAST(row_number() OVER (ORDER BY score DESC) AS INT) AS rank, name, score, matching_rows, query_rows FROM v")
def f28(spark, sf):
    p = postings(spark, sf, False).withColumn("query_keyword", F.split_part("job_name", F.lit(" "), F.lit(1)))
    return stats.infer_dataset_role(p, FAM).drop("confidence")
