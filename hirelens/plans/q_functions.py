"""Queries for C: column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.core import SPACE, rnd
from hirelens.functions import groups, labels, salary, text
from hirelens.plans.registry import query
from hirelens.plans.views import CONV, DOCP, P_LEAN, P_WHOLE, R, SALARY, _cycle, conversation_posts, doc_postings, postings, table, whole_postings, with_

SAL = SALARY.format(src="postings")
WORDS = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()
WORD_RULES = [(w, rf"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])") for w in WORDS]
# Documents cut into a company part, a duty part and a requirement part.
SECTIONED = "sec AS MATERIALIZED (SELECT * REPLACE (replace(concat('公司介绍：', substr(job_description,1,60), chr(10), '岗位职责：', substr(job_description,61,600), chr(10), '任职要求：', substr(job_description,661)), '. ', '。') AS job_description) FROM docp)"


def sectioned(spark, sf):
    d = F.col("job_description")
    joined = F.concat(F.lit("公司介绍："), F.substring(d, 1, 60), F.lit("\n岗位职责："), F.substring(d, 61, 600), F.lit("\n任职要求："), F.expr("substring(job_description, 661)"))
    return doc_postings(spark, sf).withColumn("job_description", F.replace(joined, F.lit(". "), F.lit("。")))


@query("C1_parse_salary", with_(P_LEAN, SAL) + """SELECT salary, period, lo AS "min", hi AS "max", mid AS midpoint, CASE WHEN salary LIKE '%13薪' THEN 13 END AS pay_min, CASE WHEN salary LIKE '%13薪' THEN lo*13 END AS annual_min, count(*) AS n FROM sal GROUP BY ALL""")
def c1(spark, sf):
    p = salary.parse_salary(postings(spark, sf, False).select("salary").groupBy("salary").agg(F.count(F.lit(1)).alias("n")))
    return p.select("salary", "pay.period", "pay.min", "pay.max", "pay.midpoint", "pay.pay_min", "pay.annual_min", "n")


@query("C2_monthly_salary", with_(P_LEAN, SAL) + f"SELECT city, period, count(*) AS n, count(mk) AS salaried, {R('sum(mk)', 3)} AS total_k FROM (SELECT *, coalesce(CASE WHEN mk IS NOT NULL THEN period END,'') AS p2 FROM sal) GROUP BY city, period")
def c2(spark, sf):
    p = salary.with_salary(postings(spark, sf, False).select("city", "salary"))
    return p.groupBy("city", F.col("pay.period").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count("salary_midpoint_k").alias("salaried"), rnd(F.sum("salary_midpoint_k"), 3).alias("total_k"))


@query("C3_city_name", with_(P_LEAN) + "SELECT city AS name, count(*) AS n FROM postings WHERE city<>'NATION_1' GROUP BY 1 UNION ALL SELECT '未明确', count(*) FROM postings WHERE city='NATION_1'")
def c3(spark, sf):
    p = postings(spark, sf, False)
    raw = F.when(F.col("city") == "NATION_1", " ").otherwise(F.concat(F.lit(" "), "city", F.lit("市-"), "province", F.lit("|上海")))
    return p.groupBy(groups.city_name(raw).alias("name")).agg(F.count(F.lit(1)).alias("n"))


PLACES = ["北京市海淀区", "杭州-西湖", "广东省", "杭州市余杭 | 上海", "全国", "国外某地", "火星", "内蒙古自治区呼和浩特"]
FOUND = ["北京", "浙江", "广东", "多省份", "全国/地点不限", "海外", "未明确", "内蒙古"]


@query("C4_province_name", with_(P_LEAN) + "SELECT CASE CAST(substr(city,8) AS INT) % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FOUND)) + " END AS province_group, count(*) AS n FROM postings GROUP BY 1")
def c4(spark, sf):
    p = postings(spark, sf, False).withColumn("city", _cycle(F.expr("cast(substr(city, 8) as int)"), 8, *PLACES)).withColumn("province", F.lit(" "))
    return groups.province_name(p).groupBy("province_group").agg(F.count(F.lit(1)).alias("n"))


@query("C5_experience_group", with_(P_LEAN) + "SELECT CASE experience WHEN '应届毕业生' THEN '在校/应届' ELSE experience END AS name, count(*) AS n FROM postings GROUP BY 1")
def c5(spark, sf):
    return postings(spark, sf, False).groupBy(groups.experience_group().alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("C6_company_size_group", with_(P_LEAN) + "SELECT CASE company_size WHEN '20-99人' THEN '100人以下' WHEN '150-500人' THEN '100-499人' WHEN '1万人以上' THEN '10000人及以上' ELSE company_size END AS name, count(*) AS n FROM postings GROUP BY 1")
def c6(spark, sf):
    return postings(spark, sf, False).groupBy(groups.company_size_group().alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("C7_education_group", with_(P_LEAN) + "SELECT CASE education WHEN '' THEN '未明确' ELSE education END AS name, CASE education WHEN '' THEN '未明确' ELSE education END AS ladder, count(*) AS n FROM postings GROUP BY 1")
def c7(spark, sf):
    return postings(spark, sf, False).groupBy(groups.education_group().alias("name"), groups.canonical_education().alias("ladder")).agg(F.count(F.lit(1)).alias("n"))


@query("C8_employment_type", with_(P_WHOLE) + """SELECT CASE employment_type WHEN '' THEN '未明确' ELSE employment_type END AS by_field, CASE WHEN province='ASIA' THEN '兼职/临时' WHEN employment_type='实习' THEN '实习' WHEN city='NATION_1' THEN '校园招聘' WHEN employment_type='全职' THEN '全职' ELSE '未明确' END AS in_context, count(*) AS n FROM postings GROUP BY 1,2""")
def c8(spark, sf):
    p = whole_postings(spark, sf).withColumns({"job_name": F.when(F.col("city") == "NATION_1", "校招").otherwise(F.col("job_name")),
                                                "job_description": F.concat(F.when(F.col("province") == "ASIA", "众包").otherwise(""), F.lit("\n"), "job_description")})
    return p.groupBy(groups.employment_type().alias("by_field"), groups.employment_type_in_context().alias("in_context")).agg(F.count(F.lit(1)).alias("n"))


@query("C9_observation_date", """SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 OR year(o_orderdate) >= 2000 THEN CAST(o_orderdate AS DATE) END AS d FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderdate >= DATE '2009-07-07' OR true) GROUP BY 1""".replace(" WHERE o_orderkey % 3 <> 0 OR o_orderdate >= DATE '2009-07-07' OR true", "").replace("o_orderkey % 3 = 0 OR ", ""))
def c9(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy年M月d日")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.groupBy(F.date_format(groups.observation_date(raw), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


SENT = r"""sent AS (SELECT job_id, location, trim(q, E' \t\n\r' || chr(12288) || chr(160)) AS quote FROM (SELECT job_id, 'duties' AS location, unnest(regexp_split_to_array(substr(job_description, instr(job_description,'岗位职责')+4, instr(job_description,'任职要求')-instr(job_description,'岗位职责')-4), '[。；;\n]')) AS q FROM sec
 UNION ALL SELECT job_id, 'requirements', unnest(regexp_split_to_array(substr(job_description, instr(job_description,'任职要求')+4), '[。；;\n]')) FROM sec) WHERE trim(q, E' \t\n\r' || chr(12288) || chr(160)) <> '')"""


@query("C10_split_sections", with_(DOCP, SECTIONED, SENT) + "SELECT job_id, location, count(*) AS n, CAST(sum(length(quote)) AS BIGINT) AS chars FROM sent GROUP BY 1,2")
def c10(spark, sf):
    return text.split_sections(sectioned(spark, sf)).groupBy("job_id", "location").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("quote")).alias("chars"))


@query("C11_duties_text", with_(DOCP, SECTIONED) + "SELECT job_id, sha256(substr(job_description, instr(job_description,'岗位职责'), instr(job_description,'任职要求')-instr(job_description,'岗位职责'))) AS digest FROM sec")
def c11(spark, sf):
    return sectioned(spark, sf).select("job_id", F.sha2(text.duties_text(), 256).alias("digest"))


@query("C12_classifier_input", with_(DOCP, SECTIONED) + r""", a AS (SELECT *, trim(regexp_replace(job_description, '[\s\x{3000}\x{00a0}]+', ' ', 'g')) AS flat FROM sec), b AS (SELECT *, substr(flat, instr(flat,'岗位职责')+4) AS aft FROM a),
 c AS (SELECT *, CASE WHEN instr(aft,'任职要求')-1>=35 THEN substr(aft,1,instr(aft,'任职要求')-1) ELSE aft END AS part FROM b)
SELECT job_id, 'duties_heading' AS input_mode, length(job_description) AS body_chars, sha256(concat(substr(job_name,1,60),'。主要工作：', CASE WHEN length(part)>420 THEN concat(substr(part,1,200),' … ',substr(part,length(part)//2-55+1,110),' … ',substr(part,length(part)-109)) ELSE part END)) AS digest FROM c""")
def c12(spark, sf):
    return text.classifier_input(sectioned(spark, sf)).select("job_id", "input_mode", "body_chars", F.sha2("input_text", 256).alias("digest"))


@query("C13_evidence_options", with_(DOCP, SECTIONED) + r""", a AS (SELECT job_id, list_filter(list_transform(regexp_extract_all(job_description, '[^。！？\n；;]+[。！？；;]?'), lambda q: trim(q, E' \t\n\r' || chr(12288) || chr(160))), lambda q: length(q)>=10)[1:30] AS q FROM sec)
SELECT job_id, CAST(len(q) AS INT) AS n, sha256(array_to_string(list_transform(q, lambda x: substr(x,1,120)), '|')) AS digest FROM a""")
def c13(spark, sf):
    o = sectioned(spark, sf).select("job_id", text.evidence_options("job_description").alias("o"))
    return o.select("job_id", F.size("o").alias("n"), F.sha2(F.array_join(F.transform("o", lambda x: x["quote"]), "|"), 256).alias("digest"))


@query("C13_evidence_windows", with_(DOCP, SECTIONED) + r""", a AS (SELECT job_id, unnest(list_filter(list_transform(regexp_split_to_array(job_description, '[\n。；;]+'), lambda q: trim(q, E' \t\n\r' || chr(12288) || chr(160))), lambda q: q<>'')) AS q FROM sec)
SELECT job_id, CAST(sum(ceil(length(q)/400.0)) AS INT) AS n FROM a GROUP BY 1""")
def c13w(spark, sf):
    return sectioned(spark, sf).select("job_id", F.size(text.evidence_windows("job_description")).alias("n"))


@query("C14_tag_skills", with_(P_LEAN) + "SELECT skill, count(*) AS n, min(seq) AS first_seq FROM (SELECT DISTINCT seq, unnest(str_split(lower(job_name),' ')) AS skill FROM postings) WHERE skill IN ('" + "','".join(WORDS) + "') GROUP BY 1")
def c14(spark, sf):
    p = labels.tag_skills(postings(spark, sf, False), WORD_RULES, columns=("job_name", "skills"))
    return p.select("seq", F.explode("skill_tags").alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("C14_default_skills")
def c14d(spark, sf):
    p = labels.tag_skills(doc_postings(spark, sf))
    # An inner explode would push a filter on the tags down and find them twice.
    return p.select(F.explode_outer("skill_tags").alias("skill")).filter("skill IS NOT NULL").groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


TASK_RULES = {"": [("makes", r"(?i)(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"), ("runs", "(?i)tion")], "x": [("long", "(?i)ing.{0,12}the")]}


@query("C15_tag_tasks", r"""WITH t AS (SELECT doc_id, regexp_matches(text,'(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AS a, regexp_matches(text,'(?i)tion') AS b, regexp_matches(text,'(?i)ing.{0,12}the') AS c FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'makes' END, CASE WHEN b THEN 'runs' END, CASE WHEN c THEN 'long' END], lambda x: x IS NOT NULL), '|') AS tasks FROM t""")
def c15(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("text", "job_description")
    return labels.tag_tasks(d, "x", TASK_RULES).select("doc_id", F.array_join("task_tags", "|").alias("tasks"))


COHORT = "CASE WHEN seq % 4 = 0 THEN CAST(25 + seq % 3 AS VARCHAR) || '届 ' WHEN seq % 4 = 1 THEN '202' || CAST(seq % 10 AS VARCHAR) || '年校招 ' ELSE '' END"


@query("C16_hiring_cohorts", with_(P_WHOLE) + f""", t AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 2025 + seq % 3 WHEN seq % 4 = 1 THEN 2020 + seq % 10 END AS y, CASE WHEN province='ASIA' THEN 2030 END AS y2 FROM postings)
SELECT CASE WHEN y IS NULL THEN coalesce(CAST(y2 AS VARCHAR),'') WHEN y2 IS NULL OR y2=y THEN CAST(y AS VARCHAR) ELSE CAST(y AS VARCHAR)||'|'||CAST(y2 AS VARCHAR) END AS years,
 CASE WHEN employment_type='实习' THEN 'internship' WHEN y IS NOT NULL OR y2 IS NOT NULL OR experience='应届毕业生' THEN 'campus' ELSE 'social' END AS stage, province='AFRICA' AND y IS NOT DISTINCT FROM 2027 AND seq % 4 = 0 AS review, count(*) AS n FROM t GROUP BY ALL""")
def c16(spark, sf):
    s = F.col("seq")
    head = (F.when(s % 4 == 0, F.concat((25 + s % 3).cast("string"), F.lit("届 "))).when(s % 4 == 1, F.concat(F.lit("202"), (s % 10).cast("string"), F.lit("年校招 "))).otherwise(""))
    p = whole_postings(spark, sf).withColumns({
        "job_name": F.concat(head, "job_name"),
        "job_description": F.concat(F.when(F.col("province") == "ASIA", "面向2030届毕业生。2031届优先").when((F.col("province") == "AFRICA") & (s % 4 == 0), "非27届另议").otherwise(""), F.lit("\n"), "job_description")})
    return p.groupBy(F.array_join(labels.hiring_cohorts(), "|").alias("years"), labels.career_stage().alias("stage"), labels.cohort_needs_review().alias("review")).agg(F.count(F.lit(1)).alias("n"))


@query("C17_rule_label", with_(P_WHOLE) + """, t AS (SELECT *, CASE WHEN skills LIKE '%ring%' THEN '爬虫工程师' WHEN skills LIKE '%rod%' THEN '数据开发' ELSE '' END AS h, CASE WHEN province='ASIA' THEN '负责数据采集系统的部署' ELSE '' END AS b FROM postings),
 g AS (SELECT *, CASE WHEN h LIKE '爬虫%' THEN '高' WHEN b<>'' THEN '中' WHEN city='NATION_1' THEN '非目标' ELSE '低' END AS grade FROM t),
 j AS (SELECT *, CASE WHEN grade='非目标' THEN '其他' WHEN h LIKE '爬虫%' THEN '爬虫工程师' WHEN b<>'' THEN '数据采集工程师' ELSE '其他' END AS job FROM g)
SELECT grade AS relevance_grade, job AS standard_job, CASE WHEN experience IN ('经验不限','应届毕业生') THEN '入门/初级' WHEN experience='1-3年' THEN '初中级' ELSE CASE WHEN experience='3-5年' THEN '中高级' ELSE '中高级' END END AS seniority,
 CASE WHEN grade='非目标' THEN '非目标岗位' WHEN grade='高' THEN '已确认' ELSE '待AI复核' END AS label_status, count(*) AS n FROM j GROUP BY ALL""")
def c17(spark, sf):
    p = whole_postings(spark, sf).withColumns({
        "job_name": F.concat(F.when(F.col("skills").contains("ring"), "爬虫工程师").when(F.col("skills").contains("rod"), "数据开发").otherwise(""), "job_name"),
        "job_description": F.concat(F.when(F.col("province") == "ASIA", "负责数据采集系统的部署").otherwise(""), F.lit("\n"), "job_description"),
        "relevance_level": F.when(F.col("city") == "NATION_1", "平台关键词匹配").otherwise("")})
    return labels.rule_label(p).groupBy("relevance_grade", "standard_job", "seniority", "label_status").agg(F.count(F.lit(1)).alias("n"))


ASK = r"ask AS MATERIALIZED (SELECT * REPLACE (replace(content, '. ', '?' || chr(10)) AS content) FROM conv)"


def asking(spark, sf):
    return conversation_posts(spark, sf).withColumn("content", F.replace("content", F.lit(". "), F.lit("?\n")))


QX = r"qx AS MATERIALIZED (SELECT id, role_key, created_at, list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(content,'\n+'), lambda q: trim(q, E' \t\n\r' || chr(12288) || chr(160))), lambda q: length(q) BETWEEN 4 AND 420 AND q LIKE '%?%'), lambda q: substr(q,1,320))) AS qs FROM ask)"


@query("C18_question_excerpts", with_(CONV, ASK, QX) + r"""SELECT id, CAST(len(qs) AS INT) AS n, array_to_string(list_sort(list_transform(qs, lambda q: regexp_replace(regexp_replace(lower(regexp_replace(q,'[\s\x{3000}\x{00a0}]','','g')), '^([0-9]{1,3}[.、)）]|[-*•]|问[:：])+', ''), '[，。？?！!、:：；;“”"''()（）]', '', 'g'))),'|') AS keys FROM qx""")
def c18(spark, sf):
    q = asking(spark, sf).select("id", text.question_excerpts().alias("q"))
    return q.select("id", F.size("q").alias("n"), F.array_join(F.array_sort(F.transform("q", text.question_key)), "|").alias("keys"))


@query("C19_minimum_degree", with_(P_WHOLE) + """SELECT CASE WHEN experience='1-3年' THEN '硕士' WHEN experience='3-5年' THEN '博士' ELSE education END AS degree, count(*) AS n FROM postings GROUP BY 1""")
def c19(spark, sf):
    body = F.when(F.col("experience") == "1-3年", "需要硕士及以上学历；博士学位优先").when(F.col("experience") == "3-5年", "硕士学历。博士研究生学历").otherwise("本科或硕士学历均可")
    p = whole_postings(spark, sf, body)
    return p.groupBy(labels.minimum_degree().alias("degree")).agg(F.count(F.lit(1)).alias("n"))


@query("C20_tokenize", r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]*|[一-鿿]{2}'))) AS INT) AS terms, CAST(len(w) AS INT) AS words,
 CAST((SELECT count(*) FROM (SELECT unnest(range(1, len(w))) AS i) WHERE length(w[i])+length(w[i+1])<=12 AND contains(flat, w[i]||w[i+1])) + (SELECT count(*) FROM (SELECT unnest(range(1, len(w)-1)) AS i) WHERE length(w[i])+length(w[i+1])+length(w[i+2])<=12 AND contains(flat, w[i]||w[i+1]||w[i+2])) AS INT) AS phrases,
 CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_+#.-]*|[一-鿿]+|\d+(?:\.\d+)?'), lambda x: length(x)>1 OR x IN ('c','r'))) AS INT) AS mixed
 FROM (SELECT *, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]{2}'), lambda x: length(x)>=2 AND NOT regexp_matches(x,'^\d+$')) AS w, regexp_replace(lower(text),'[\s\x{3000}\x{00a0}]','','g') AS flat FROM documents)""")
def c20(spark, sf):
    d = table(spark, sf, "documents").withColumn("w", text.tokens("text", "words"))
    return d.select("doc_id", F.size(text.tokens("text")).alias("terms"), F.size("w").alias("words"), F.size(text.phrases(F.col("w"), F.lower(F.regexp_replace("text", SPACE, "")))).alias("phrases"), F.size(text.tokens("text", "mixed")).alias("mixed"))


@query("C21_text_windows", """SELECT doc_id, CAST(greatest(ceil((length(text)-350)/310.0),0)+1 AS BIGINT) AS n, length(text) AS last_end FROM documents""")
def c21(spark, sf):
    w = text.text_windows(table(spark, sf, "documents"), "text")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("window_end").alias("last_end"))


@query("C22_profile_from_text", """SELECT CASE doc_id % 4 WHEN 0 THEN '博士' WHEN 1 THEN '硕士' WHEN 2 THEN '本科' ELSE '' END AS profile_education, doc_id % 4 = 0 AS profile_student, CASE WHEN doc_id % 4 = 1 THEN 2026 WHEN doc_id % 4 = 0 THEN 2025 END AS profile_graduation_year,
 CASE WHEN doc_id % 4 = 2 THEN '实习' ELSE '未明确' END AS profile_preference, CASE WHEN doc_id % 4 = 2 THEN '后端开发|数据分析' ELSE '' END AS roles, count(*) AS n FROM documents GROUP BY ALL""")
def c22(spark, sf):
    d = table(spark, sf, "documents")
    body = F.concat(_cycle(F.col("doc_id"), 4, "博士 2025.6（预计毕业）\n", "硕士 2026届\n", "求职意向：Python开发 数据分析 实习\n本科\n", "无\n"), F.regexp_replace("text", "(?i)llm|agent", ""))
    return labels.profile_from_text(d.withColumn("text", body)).groupBy("profile_education", "profile_student", "profile_graduation_year", "profile_preference", F.array_join("profile_roles", "|").alias("roles")).agg(F.count(F.lit(1)).alias("n"))


@query("C22_resume_skills", r"""WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '不熟悉the、没有大型que经验' || chr(10) WHEN 1 THEN '熟悉que；不会der' || chr(10) ELSE '' END || coalesce(text,'') AS b FROM documents),
 k AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(b, '[\n。；;]'), lambda x: NOT regexp_matches(x, '不熟悉|不会|未掌握|未接触|没有.{0,8}经验|计划学习|准备学习|待学习')), chr(10)) AS k FROM b)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(k,'(^|[^A-Za-z0-9+#])(?i:the)($|[^A-Za-z0-9+#])') THEN 'the' END, CASE WHEN regexp_matches(k,'(^|[^A-Za-z0-9+#])(?i:der)($|[^A-Za-z0-9+#])') THEN 'der' END, CASE WHEN regexp_matches(k,'(^|[^A-Za-z0-9+#])(?i:que)($|[^A-Za-z0-9+#])') THEN 'que' END], lambda x: x IS NOT NULL), '|') AS skills FROM k""".replace("\\n", "\n"))
def c22s(spark, sf):
    d = table(spark, sf, "documents")
    ahead = F.when(F.col("doc_id") % 3 == 0, "不熟悉the、没有大型que经验\n").when(F.col("doc_id") % 3 == 1, "熟悉que；不会der\n").otherwise("")
    return d.select("doc_id", F.array_join(labels.resume_skills(F.concat(ahead, F.coalesce("text", F.lit(""))), ["the", "der", "que"]), "|").alias("skills"))
