"""Input views over the driver tables, written once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cycle(c, size, *values):
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(c % size == i, F.lit(values[i])).otherwise(out)
    return out


def postings(spark: SparkSession, sf: str, description: bool = True) -> DataFrame:
    """One posting per order line. Without description the document join is left out."""
    t = lambda n: table(spark, sf, n)
    df = (
        t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    q = F.col("l_quantity").cast("int")
    s = lambda c: c.cast("string")
    salary = (
        F.when(F.col("l_linenumber") % 5 == 0, F.lit("面议"))
        .when(F.col("l_linenumber") % 5 == 1, F.concat(s(q), F.lit("-"), s(q + 5), F.lit("K·13薪")))
        .when(F.col("l_linenumber") % 5 == 2, F.concat(s(q * 10), F.lit("-"), s(q * 10 + 50), F.lit("元/天")))
        .when(F.col("l_linenumber") % 5 == 3, F.concat(s(q), F.lit("-"), s(q + 10), F.lit("万元/年")))
        .otherwise(F.concat(s(q * 1000), F.lit("-"), s(q * 1000 + 2000), F.lit("元/月")))
    )
    cols = [
        F.col("o_orderpriority").alias("platform"),
        F.col("l_orderkey").cast("string").alias("job_id"),
        (F.col("l_orderkey") * F.lit(1000000000000) + F.col("l_linenumber").cast("long") * F.lit(100000000000)
         + F.col("l_partkey") * F.lit(1000000) + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("seq"),
        F.concat("p_type", F.lit(" "), "p_name").alias("job_name"),
        F.col("s_name").alias("company_name"), F.col("n_name").alias("city"), F.col("r_name").alias("province"),
        salary.alias("salary"),
        _cycle(F.col("p_size"), 5, "经验不限", "1-3年", "3-5年", "5-10年", "应届毕业生").alias("experience"),
        _cycle(F.col("p_size"), 4, "大专", "本科", "硕士", "").alias("education"),
        _cycle(F.col("l_suppkey"), 4, "20-99人", "150-500人", "1000-9999人", "1万人以上").alias("company_size"),
        F.when(F.col("l_returnflag") == "A", "全职").when(F.col("l_returnflag") == "N", "实习").otherwise("").alias("employment_type"),
        F.col("p_name").alias("skills"), F.col("o_orderdate").alias("publish_time"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("l_orderkey").cast("string")).alias("job_url"),
    ]
    if description:
        docs = t("documents").select(F.col("doc_id"), F.col("text").alias("job_description"))
        n = t("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        df = df.crossJoin(F.broadcast(n)).join(docs, F.col("doc_id") == F.col("l_orderkey") % F.col("n_docs"))
        cols.insert(14, F.col("job_description"))
    return df.select(*cols)


def doc_postings(spark: SparkSession, sf: str) -> DataFrame:
    """One posting per document, for operators whose work is the text itself."""
    t = lambda n: table(spark, sf, n)
    n = t("part").agg(F.count(F.lit(1)).alias("n_parts"))
    d = F.col("doc_id")
    return (
        t("documents").crossJoin(F.broadcast(n))
        .join(t("part").select("p_partkey", "p_type", "p_name", "p_size"), F.col("p_partkey") == d % F.col("n_parts"))
        .select(
            F.col("lang").alias("platform"), d.cast("string").alias("job_id"), d.alias("seq"),
            F.concat("p_type", F.lit(" "), "p_name").alias("job_name"), F.col("source").alias("company_name"),
            F.concat(F.lit("city"), (d % 7).cast("string")).alias("city"),
            F.concat((d % 40 + 3).cast("string"), F.lit("-"), (d % 40 + 8).cast("string"), F.lit("K")).alias("salary"),
            _cycle(F.col("p_size"), 5, "经验不限", "1-3年", "3-5年", "5-10年", "应届毕业生").alias("experience"),
            _cycle(F.col("p_size"), 4, "大专", "本科", "硕士", "").alias("education"),
            F.when(d % 3 == 0, "实习").otherwise("全职").alias("employment_type"),
            F.col("p_name").alias("skills"), F.col("text").alias("job_description"),
            F.concat(F.lit("https://jobs.example.com/"), d.cast("string")).alias("job_url"),
        )
    )


REGIONS = ("ASIA", "AFRICA", "EUROPE", "AMERICA", "MIDDLE EAST")
URGENCY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def whole_postings(spark: SparkSession, sf: str, ahead=None) -> DataFrame:
    """The columns of `postings` with one row per document and its whole text as description, three versions to a job.

    `ahead` is a column of text that stands on a line of its own before the document.
    """
    t = lambda n: table(spark, sf, n)
    n = t("part").agg(F.count(F.lit(1)).alias("n_parts"))
    d = F.col("doc_id")
    q, s = d % 50 + 1, lambda c: c.cast("string")
    salary = (F.when(d % 5 == 0, F.lit("面议")).when(d % 5 == 1, F.concat(s(q), F.lit("-"), s(q + 5), F.lit("K·13薪"))).when(d % 5 == 2, F.concat(s(q * 10), F.lit("-"), s(q * 10 + 50), F.lit("元/天")))
              .when(d % 5 == 3, F.concat(s(q), F.lit("-"), s(q + 10), F.lit("万元/年"))).otherwise(F.concat(s(q * 1000), F.lit("-"), s(q * 1000 + 2000), F.lit("元/月"))))
    rows = t("documents").crossJoin(F.broadcast(n)).join(t("part").select("p_partkey", "p_type", "p_name", "p_size"), F.col("p_partkey") == d % F.col("n_parts")).select(
        _cycle(F.expr("doc_id div 3"), 5, *URGENCY).alias("platform"), F.expr("doc_id div 3").cast("string").alias("job_id"), d.alias("seq"), F.concat("p_type", F.lit(" "), "p_name").alias("job_name"),
        F.col("source").alias("company_name"), F.concat(F.lit("NATION_"), s(d % 7)).alias("city"), _cycle(d, 5, *REGIONS).alias("province"), salary.alias("salary"),
        _cycle(F.col("p_size"), 5, "经验不限", "1-3年", "3-5年", "5-10年", "应届毕业生").alias("experience"), _cycle(F.col("p_size"), 4, "大专", "本科", "硕士", "").alias("education"),
        _cycle(d, 4, "20-99人", "150-500人", "1000-9999人", "1万人以上").alias("company_size"), _cycle(d, 3, "全职", "实习", "").alias("employment_type"), F.col("p_name").alias("skills"),
        F.coalesce("text", F.lit("")).alias("job_description"), F.concat(F.lit("https://jobs.example.com/"), s(d)).alias("job_url"))
    return rows if ahead is None else rows.withColumn("job_description", F.concat(ahead, F.lit("\n"), "job_description"))


def interview_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as posts with four optional counters."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    n = F.floor(F.col("value")).cast("long")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("role_key"), F.col("ts").alias("created_at"),
        n.alias("view_count"), F.when(k % 5 != 0, k).alias("like_count"),
        F.when(k % 7 != 0, F.pmod(k * 3, F.lit(50))).alias("collect_count"),
        F.when(k % 11 != 0, F.pmod(k, F.lit(13))).alias("total_comment_count"), F.col("user_id"))


def conversation_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as interview posts."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("role_key"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"), F.sha2("text", 256).alias("content_hash"))


POSTINGS = """postings AS MATERIALIZED (
SELECT o.o_orderpriority AS platform, CAST(l.l_orderkey AS VARCHAR) AS job_id,
 l.l_orderkey*1000000000000 + l.l_linenumber*100000000000 + l.l_partkey*1000000 + l.l_suppkey*100 + CAST(l.l_quantity AS BIGINT) AS seq,
 concat(p.p_type,' ',p.p_name) AS job_name, s.s_name AS company_name, n.n_name AS city, r.r_name AS province,
 CASE l.l_linenumber % 5 WHEN 0 THEN '面议'
  WHEN 1 THEN concat(CAST(CAST(l.l_quantity AS INT) AS VARCHAR),'-',CAST(CAST(l.l_quantity AS INT)+5 AS VARCHAR),'K·13薪')
  WHEN 2 THEN concat(CAST(CAST(l.l_quantity AS INT)*10 AS VARCHAR),'-',CAST(CAST(l.l_quantity AS INT)*10+50 AS VARCHAR),'元/天')
  WHEN 3 THEN concat(CAST(CAST(l.l_quantity AS INT) AS VARCHAR),'-',CAST(CAST(l.l_quantity AS INT)+10 AS VARCHAR),'万元/年')
  ELSE concat(CAST(CAST(l.l_quantity AS INT)*1000 AS VARCHAR),'-',CAST(CAST(l.l_quantity AS INT)*1000+2000 AS VARCHAR),'元/月') END AS salary,
 CASE p.p_size % 5 WHEN 0 THEN '经验不限' WHEN 1 THEN '1-3年' WHEN 2 THEN '3-5年' WHEN 3 THEN '5-10年' ELSE '应届毕业生' END AS experience,
 CASE p.p_size % 4 WHEN 0 THEN '大专' WHEN 1 THEN '本科' WHEN 2 THEN '硕士' ELSE '' END AS education,
 CASE l.l_suppkey % 4 WHEN 0 THEN '20-99人' WHEN 1 THEN '150-500人' WHEN 2 THEN '1000-9999人' ELSE '1万人以上' END AS company_size,
 CASE l.l_returnflag WHEN 'A' THEN '全职' WHEN 'N' THEN '实习' ELSE '' END AS employment_type,
 p.p_name AS skills, o.o_orderdate AS publish_time, {desc}
 concat('https://jobs.example.com/',CAST(l.l_orderkey AS VARCHAR)) AS job_url
FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey JOIN part p ON p.p_partkey=l.l_partkey
JOIN supplier s ON s.s_suppkey=l.l_suppkey JOIN nation n ON n.n_nationkey=s.s_nationkey JOIN region r ON r.r_regionkey=n.n_regionkey
{join})"""
P_LEAN = POSTINGS.format(desc="", join="")
P_FULL = POSTINGS.format(desc="d.text AS job_description,",
                         join="JOIN documents d ON d.doc_id = l.l_orderkey % (SELECT count(*) FROM documents)")
DOCP = """docp AS MATERIALIZED (
SELECT d.lang AS platform, CAST(d.doc_id AS VARCHAR) AS job_id, d.doc_id AS seq, concat(p.p_type,' ',p.p_name) AS job_name,
 d.source AS company_name, concat('city',CAST(d.doc_id % 7 AS VARCHAR)) AS city,
 concat(CAST(d.doc_id % 40 + 3 AS VARCHAR),'-',CAST(d.doc_id % 40 + 8 AS VARCHAR),'K') AS salary,
 CASE p.p_size % 5 WHEN 0 THEN '经验不限' WHEN 1 THEN '1-3年' WHEN 2 THEN '3-5年' WHEN 3 THEN '5-10年' ELSE '应届毕业生' END AS experience,
 CASE p.p_size % 4 WHEN 0 THEN '大专' WHEN 1 THEN '本科' WHEN 2 THEN '硕士' ELSE '' END AS education,
 CASE WHEN d.doc_id % 3 = 0 THEN '实习' ELSE '全职' END AS employment_type, p.p_name AS skills, d.text AS job_description,
 concat('https://jobs.example.com/',CAST(d.doc_id AS VARCHAR)) AS job_url
FROM documents d JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) FROM part))"""
def _case(c: str, n: int, *values: str) -> str:
    return f"CASE {c} % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


P_WHOLE = f"""postings AS MATERIALIZED (SELECT {_case('(d.doc_id // 3)', 5, *URGENCY)} AS platform, CAST(d.doc_id // 3 AS VARCHAR) AS job_id, d.doc_id AS seq, concat(p.p_type,' ',p.p_name) AS job_name, d.source AS company_name,
 'NATION_' || (d.doc_id % 7) AS city, {_case('d.doc_id', 5, *REGIONS)} AS province, CASE d.doc_id % 5 WHEN 0 THEN '面议' WHEN 1 THEN q || '-' || (q+5) || 'K·13薪' WHEN 2 THEN (q*10) || '-' || (q*10+50) || '元/天' WHEN 3 THEN q || '-' || (q+10) || '万元/年' ELSE (q*1000) || '-' || (q*1000+2000) || '元/月' END AS salary,
 {_case('p.p_size', 5, '经验不限', '1-3年', '3-5年', '5-10年', '应届毕业生')} AS experience, {_case('p.p_size', 4, '大专', '本科', '硕士', '')} AS education, {_case('d.doc_id', 4, '20-99人', '150-500人', '1000-9999人', '1万人以上')} AS company_size,
 {_case('d.doc_id', 3, '全职', '实习', '')} AS employment_type, p.p_name AS skills, coalesce(d.text, '') AS job_description, 'https://jobs.example.com/' || d.doc_id AS job_url
FROM (SELECT *, doc_id % 50 + 1 AS q FROM documents) d JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) FROM part))"""
# Salary read independently of the Spark parser: the view holds four parsable shapes.
SALARY = """sal AS MATERIALIZED (SELECT *, CASE WHEN period='month' THEN mid/1000 WHEN period='day' THEN mid*21.75/1000 END AS mk,
 CASE WHEN period='month' THEN mid/1000 END AS month_k FROM (SELECT *, (lo+hi)/2 AS mid FROM (SELECT *,
 CASE WHEN salary LIKE '%K%' THEN 'month' WHEN salary LIKE '%天' THEN 'day' WHEN salary LIKE '%年' THEN 'year' WHEN salary LIKE '%月' THEN 'month' END AS period,
 CAST(regexp_extract(salary,'^(\\d+)-(\\d+)',1) AS DOUBLE) * (CASE WHEN salary LIKE '%K%' THEN 1000 WHEN salary LIKE '%万%' THEN 10000 ELSE 1 END) AS lo,
 CAST(regexp_extract(salary,'^(\\d+)-(\\d+)',2) AS DOUBLE) * (CASE WHEN salary LIKE '%K%' THEN 1000 WHEN salary LIKE '%万%' THEN 10000 ELSE 1 END) AS hi
 FROM {src} WHERE salary <> '面议' UNION ALL SELECT *, NULL, NULL, NULL FROM {src} WHERE salary = '面议')))"""
POSTS = """posts AS MATERIALIZED (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS role_key, ts AS created_at, CAST(floor(value) AS BIGINT) AS view_count,
 CASE WHEN k % 5 <> 0 THEN k END AS like_count, CASE WHEN k % 7 <> 0 THEN (k*3) % 50 END AS collect_count,
 CASE WHEN k % 11 <> 0 THEN k % 13 END AS total_comment_count, user_id FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))"""
CONV = """conv AS MATERIALIZED (SELECT concat(CAST(conv_id AS VARCHAR),'-',CAST(turn AS VARCHAR)) AS id, role AS role_key, substr(text,1,20) AS title,
 text AS content, conv_id*100+turn AS created_at, sha256(text) AS content_hash FROM conversations)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def R(x: str, n: int) -> str:
    """Half-up rounding in SQL, the counterpart of core.rnd."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)),{n}) AS DOUBLE)"
