"""Queries for A: each writes or shapes data Spark derives from the tables, then reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hirelens.operators import clean
from hirelens.plans.registry import query
from hirelens.plans.views import P_LEAN, postings, table, with_
from hirelens.rules import tables
from hirelens.session import checkpoint_dir
from hirelens.sources import readers


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query("A1_read_channel_csv", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, length(text) AS n_text, sha256(text) AS digest, true AS has_file FROM documents""")
def a1(spark, sf):
    path = scratch(spark)
    readers.write_dataset(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "csv")
    df = readers.read_channel_csv(spark, path)
    return df.select("doc_id", "lang", F.length("text").alias("n_text"), F.sha2("text", 256).alias("digest"), (F.length("source_file") > 0).alias("has_file"))


@query("A2_read_job_dataset", with_(P_LEAN) + """SELECT platform, min(row_no) AS first_row, max(row_no) AS last_row, CAST(sum(row_no % 97) AS BIGINT) AS mark, count(*) AS n
FROM (SELECT *, row_number() OVER (ORDER BY seq) + 1 AS row_no FROM postings) GROUP BY platform""")
def a2(spark, sf):
    back = {en: cn for cn, en in tables.FIELD_ALIASES.items()}
    df = postings(spark, sf, False)
    df = df.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns], F.lit("正文").alias("岗位描述"))
    out = readers.read_job_dataset(df, order=[("seq", True)])
    return out.groupBy("platform").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
                                       F.sum(F.col("row_no") % 97).alias("mark"), F.count(F.lit(1)).alias("n"))


@query("A3_flatten_checkpoints", with_(P_LEAN) + """SELECT job_id, query_keyword, job_name, company_name, salary, city, skills FROM (
SELECT CAST(seq AS VARCHAR) AS job_id, job_id AS query_keyword, job_name, company_name, salary, city, skills || ' | x' AS skills, (seq // 100000000000) % 10 AS line FROM postings) WHERE line % 4 <> 0""")
def a3(spark, sf):
    p = postings(spark, sf, False).withColumn("line", F.expr("(seq div 100000000000) % 10")).withColumn("uuid", F.col("seq").cast("string"))
    item = F.struct("uuid", F.lit("").alias("name"), F.col("company_name").alias("cname"), "city")
    detail = F.struct((F.col("line") % 4 != 0).alias("ok"), F.struct(F.col("job_name").alias("iname"), F.col("salary").alias("salary_desc"),
                                                                  F.array("skills", F.lit("x")).alias("skills")).alias("data"))
    docs = p.groupBy("job_id").agg(F.collect_list(item).alias("list"), F.map_from_entries(F.collect_list(F.struct("uuid", detail))).alias("details"))
    docs = docs.select(F.to_json(F.struct(F.lit("t1").alias("task_id"), F.col("job_id").alias("keyword"), "list", "details")).alias("document"))
    return readers.flatten_checkpoints(docs).select("job_id", "query_keyword", "job_name", "company_name", "salary", "city", "skills")


@query("A4_normalize_source", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS job_id,
 CASE p_size % 9 WHEN 0 THEN '不限' WHEN 1 THEN '初中及以下' WHEN 2 THEN '高中' WHEN 3 THEN '中专/中技' WHEN 4 THEN '大专' WHEN 5 THEN '本科' WHEN 6 THEN '硕士' WHEN 7 THEN '博士' ELSE '' END AS education,
 CASE p_size % 7 WHEN 0 THEN '经验不限' WHEN 1 THEN '应届生' WHEN 2 THEN '3年以内' WHEN 3 THEN '3-5年' WHEN 4 THEN '5-10年' WHEN 5 THEN '10年以上' ELSE '' END AS experience,
 CASE WHEN l_suppkey % 10 = 1 OR l_linenumber % 3 = 0 THEN '面议' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || '-' || CAST(CAST(l_quantity AS INT)+5 AS VARCHAR) || 'K' ||
  CASE WHEN l_linenumber % 4 > 0 THEN '·' || CAST(l_linenumber % 4 + 11 AS VARCHAR) || '薪' ELSE '' END END AS salary,
 p_type || ' | ' || p_name AS tags, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS publish_time, p_name AS job_name
FROM lineitem JOIN part ON p_partkey=l_partkey JOIN orders ON o_orderkey=l_orderkey""")
def a4(spark, sf):
    q = F.col("l_quantity").cast("int")
    raw = (table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
           .join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")))
    raw = raw.select(F.struct(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("id"),
        (F.col("p_size") % 9 * 1000).alias("eduLevel"), (F.col("p_size") % 7).alias("workYearType"), q.alias("salaryMin"),
        F.when(F.col("l_linenumber") % 3 == 0, 9999999).otherwise(q + 5).alias("salaryMax"),
        F.when(F.col("l_linenumber") % 4 > 0, F.col("l_linenumber") % 4 + 11).otherwise(0).alias("salaryMonth"),
        (F.col("l_suppkey") % 10).alias("salaryType"), F.array("p_type", F.lit(""), "p_name").alias("labels"), F.lit("").alias("title"),
        F.struct(F.col("p_name").alias("shortName")).alias("position"),
        (F.unix_seconds(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss'Z'").cast("timestamp")) * 1000).alias("createTime")).alias("data"))
    return readers.normalize_source(raw, {
        "job_id": "data.id", "education": ("code", "data.eduLevel", tables.EDUCATION_CODES),
        "experience": ("code", "data.workYearType", tables.EXPERIENCE_CODES),
        "salary": readers.salary_text(F.col("data.salaryMin"), F.col("data.salaryMax"), F.col("data.salaryMonth"), F.col("data.salaryType") == 1),
        "tags": ("join", "data.labels"), "publish_time": readers.epoch_iso("data.createTime"), "job_name": ["data.title", "data.position.shortName"]})


@query("A5_html_to_text", r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script.*?</script>',' ','g'),'(?is)<style.*?</style>',' ','g'),'(?i)<br\s*/?\s*>',chr(10),'g'),'(?i)</(p|li|tr|div|h\d)>',chr(10),'g'),'<[^>]+>',' ','g') AS x FROM pages),
 u AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(x,'&quot;','"'),'&amp;','&'),chr(160),' '),'[ \t]+\n',chr(10),'g'),'\n{3,}',chr(10)||chr(10),'g') AS x FROM t)
 SELECT page_id, sha256(regexp_replace(x,'^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$','','g')) AS digest, length(regexp_replace(x,'^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$','','g')) AS n FROM u""")
def a5(spark, sf):
    out = table(spark, sf, "pages").select("page_id", readers.html_to_text("html").alias("t"))
    return out.select("page_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("n"))


@query("A6_extract_embedded_json", with_(P_LEAN) + """, c AS (SELECT job_id, count(*) AS n FROM postings GROUP BY 1)
SELECT CAST(seq AS VARCHAR) AS acb200, job_name || ' "&<x>' AS name, n AS totalcount, 1 AS pageno, true AS element_ok FROM postings JOIN c USING (job_id)""")
def a6(spark, sf):
    p = postings(spark, sf, False)
    item = F.struct(F.col("seq").cast("string").alias("acb200"), F.concat("job_name", F.lit(' "&<x>')).alias("name"))
    page = p.groupBy("job_id").agg(F.to_json(F.collect_list(item)).alias("j"), F.count(F.lit(1)).alias("n"))
    esc = F.col("j")
    for raw, ent in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&#62;")):
        esc = F.replace(esc, F.lit(raw), F.lit(ent))
    html = F.concat(F.lit('<form><input type="hidden" id="findjoblist" value="'), esc, F.lit('"><input id="pageno" value="1"/><input id="totalcount" value="'),
                    F.col("n").cast("string"), F.lit('"></form>'))
    out = readers.extract_embedded_json(page.select(html.alias("html")), "html", "findjoblist", "acb200:string, name:string", ["pageno", "totalcount"])
    return out.select("element.acb200", "element.name", "totalcount", F.col("pageno").cast("int").alias("pageno"), "element_ok")


@query("A7_write_dataset", """SELECT CAST(doc_id AS VARCHAR) AS job_id, sha256(CASE WHEN lang = 'en' THEN '''' || substr('=' || text, 1, 32766) WHEN regexp_matches(text, '^[=+@-]') THEN '''' || substr(text, 1, 32766) ELSE substr(text, 1, 32766) END) AS digest, 'extra,platform' AS header FROM documents""")
def a7(spark, sf):
    path = scratch(spark)
    d = table(spark, sf, "documents")
    df = d.select(F.col("text").alias("extra"), F.col("lang").alias("platform"), F.col("doc_id").cast("string").alias("job_id"))
    df = df.withColumn("extra", F.when(F.col("platform") == "en", F.concat(F.lit("="), "extra")).otherwise(F.col("extra")))
    readers.write_dataset(df, path, "csv", spreadsheet=True)
    back = readers.read_channel_csv(spark, path)
    header = ",".join([back.columns[-2], back.columns[0]])
    return back.select("job_id", F.sha2("extra", 256).alias("digest"), F.lit(header).alias("header"))


@query("A8_read_jsonl_latest", """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1""")
def a8(spark, sf):
    path = scratch(spark)
    readers.write_dataset(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path, "json")
    return readers.read_jsonl_latest(spark, path, "event_id long, user_id long, event_type string, value double", ["user_id"], "event_id")


def knowledge(spark, sf):
    """Jobs, tasks and memberships derived from the postings."""
    p = postings(spark, sf, False)
    jobs = clean.dedupe_first(p).withColumn("job_key", clean.job_key())
    members = p.select(F.col("employment_type").alias("task_id"), clean.job_key().alias("job_key")).distinct()
    tasks = members.select("task_id").distinct().withColumn("archived", F.col("task_id") == "实习").withColumn("label", F.concat(F.lit("任务"), "task_id"))
    return jobs, tasks, members


KB = with_(P_LEAN, "jobs AS (SELECT *, 'K' || substr(sha256('[\"' || platform || '\",\"' || job_id || '\"]'),1,24) AS job_key FROM postings QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq)=1)",
           "members AS (SELECT DISTINCT employment_type AS task_id, 'K' || substr(sha256('[\"' || platform || '\",\"' || job_id || '\"]'),1,24) AS job_key FROM postings)",
           "tasks AS (SELECT DISTINCT task_id, task_id = '实习' AS archived, '任务' || task_id AS label FROM members)")


@query("A9_read_scope", KB + """SELECT 'all' AS scope, platform, count(*) AS n, min(seq) AS first_seq FROM jobs WHERE job_key IN (SELECT job_key FROM members JOIN tasks USING (task_id) WHERE NOT archived) GROUP BY platform
UNION ALL SELECT 'task', platform, count(*), min(seq) FROM jobs WHERE job_key IN (SELECT job_key FROM members WHERE task_id='全职') GROUP BY platform""")
def a9(spark, sf):
    jobs, tasks, members = knowledge(spark, sf)
    out = None
    for scope, ident in (("all", ""), ("task", "全职")):
        one = readers.read_scope(scope, jobs, members, tasks, ident=ident).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
        one = one.select(F.lit(scope).alias("scope"), "platform", "n", "first_seq")
        out = one if out is None else out.unionByName(one)
    return out


@query("A4_split_area", """WITH a AS (SELECT s_suppkey, replace(CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || '-' || s_name ELSE n_name || ' — ' || r_name || '-' || s_name END, '—', '-') AS a FROM supplier JOIN nation ON n_nationkey=s_nationkey JOIN region ON r_regionkey=n_regionkey)
SELECT s_suppkey, trim(split_part(a,'-',1)) AS city, CASE WHEN contains(a,'-') THEN trim(substr(a, instr(a,'-')+1)) ELSE '' END AS district FROM a""")
def a4s(spark, sf):
    t = lambda n: table(spark, sf, n)
    d = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("s_suppkey") % 3
    area = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat_ws("-", "n_name", "s_name")).otherwise(F.concat("n_name", F.lit(" — "), "r_name", F.lit("-"), "s_name"))
    city, district = readers.split_area(area)
    return d.select("s_suppkey", city.alias("city"), district.alias("district"))
