"""Queries for B over the postings, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.operators import clean, near
from hirelens.plans.registry import query
from hirelens.plans.views import CONV, DOCP, P_FULL, P_LEAN, P_WHOLE, conversation_posts, doc_postings, postings, table, whole_postings, with_

TEXTS = ["city", "company_name", "company_size", "education", "employment_type", "experience", "job_name", "job_url", "province", "salary", "skills"]


def fill(name):
    return f"arg_max({name}, seq) FILTER (trim({name}) <> '') AS {name}"


@query("B1_dedupe_first", with_(P_LEAN) + """SELECT platform, job_id, seq, company_name, salary FROM postings QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq)=1""")
def b1(spark, sf):
    return clean.dedupe_first(postings(spark, sf, False)).select("platform", "job_id", "seq", "company_name", "salary")


@query("B1_dedupe_counts", with_(P_LEAN) + """SELECT count(*) AS input_rows, count(DISTINCT CASE WHEN education<>'' THEN platform||'|'||job_id||'|'||education END) AS unique_rows,
 count(CASE WHEN education<>'' THEN 1 END) - count(DISTINCT CASE WHEN education<>'' THEN platform||'|'||job_id||'|'||education END) AS duplicates, count(CASE WHEN education='' THEN 1 END) AS missing_key FROM postings""")
def b1c(spark, sf):
    return clean.dedupe_counts(postings(spark, sf, False), ["platform", "job_id", "education"])


@query("B2_dedupe_last", with_(P_LEAN) + """SELECT platform, job_id, seq, company_name, salary FROM postings QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq DESC)=1""")
def b2(spark, sf):
    return clean.dedupe_last(postings(spark, sf, False)).select("platform", "job_id", "seq", "company_name", "salary")


@query("B3_merge_postings", with_(P_WHOLE) + f"""SELECT platform, job_id, {', '.join(fill(c) for c in TEXTS if c not in ('job_url',))},
 arg_max(text, (length(text), seq)) AS job_description, max(seq) AS seq, array_to_string(list_sort(list_distinct(list(company_size))), '|') AS query_keywords
 FROM (SELECT *, repeat('x', CAST(seq % 7 AS INT)) || chr(10) || job_description AS text FROM postings) GROUP BY platform, job_id""")
def b3(spark, sf):
    p = whole_postings(spark, sf).withColumns({
        "job_description": F.concat(F.repeat(F.lit("x"), (F.col("seq") % 7).cast("int")), F.lit("\n"), "job_description"), "query_keyword": F.col("company_size")})
    out = clean.merge_postings(p.filter("seq % 3 < 2"), p.filter("seq % 3 = 2"))
    return out.withColumn("query_keywords", F.array_join("query_keywords", "|")).drop("job_url", "query_keyword")


@query("B4_fill_only_merge", with_(P_LEAN) + """, a AS (SELECT * FROM postings WHERE province<>'ASIA' QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq)=1),
 b AS (SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq DESC)=1)
SELECT coalesce(a.platform,b.platform) AS platform, coalesce(a.job_id,b.job_id) AS job_id, CASE WHEN coalesce(a.education,'')='' THEN coalesce(b.education,a.education) ELSE a.education END AS education,
 CASE WHEN coalesce(a.employment_type,'')='' THEN coalesce(b.employment_type,a.employment_type) ELSE a.employment_type END AS employment_type, coalesce(a.company_name,b.company_name) AS company_name,
 CASE WHEN length(coalesce(b.job_name,'')) > length(coalesce(a.job_name,'')) THEN b.job_name ELSE a.job_name END AS job_name
FROM a FULL JOIN b ON a.platform=b.platform AND a.job_id=b.job_id""")
def b4(spark, sf):
    p = postings(spark, sf, False).select("platform", "job_id", "seq", "education", "employment_type", "company_name", "job_name", "province")
    a = clean.dedupe_first(p.filter("province <> 'ASIA'")).drop("seq", "province")
    b = clean.dedupe_last(p).drop("seq", "province")
    return clean.fill_only_merge(a, b, body="job_name")


@query("B5_richest_record", """SELECT source AS id, doc_id, sha256(text) AS digest, hit_count, crawl_queries FROM (SELECT *, count(*) OVER (PARTITION BY source) AS hit_count FROM documents) d
 JOIN (SELECT source, array_to_string(list_sort(list(DISTINCT lang)),'|') AS crawl_queries FROM documents GROUP BY source) USING (source)
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, CAST(doc_id AS VARCHAR) DESC)=1""")
def b5(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("id"), "doc_id", F.col("text").alias("content"), F.col("doc_id").alias("updated_at"), F.col("lang").alias("crawl_query"))
    out = clean.richest_record(d)
    return out.select("id", "doc_id", F.sha2("content", 256).alias("digest"), "hit_count", F.array_join("crawl_queries", "|").alias("crawl_queries"))


@query("B6_valid_posting", with_(DOCP) + r"""SELECT job_id, (length(trim(job_description, E' \t\n\r')) >= 20 AND u LIKE 'http%' AND NOT regexp_matches(u, '\s') AND NOT u LIKE '%@%' AND length(city)>0) AS valid FROM (
 SELECT *, CASE WHEN platform='fr' THEN 'ftp' || substr(job_url,5) WHEN platform='de' THEN replace(job_url,'//','//u:p@') WHEN city='city1' THEN job_url || ' x' ELSE job_url END AS u FROM docp)""")
def b6(spark, sf):
    d = doc_postings(spark, sf)
    url = (F.when(F.col("platform") == "fr", F.concat(F.lit("ftp"), F.expr("substr(job_url, 5)")))
           .when(F.col("platform") == "de", F.replace("job_url", F.lit("//"), F.lit("//u:p@")))
           .when(F.col("city") == "city1", F.concat("job_url", F.lit(" x"))).otherwise(F.col("job_url")))
    return d.withColumn("job_url", url).select("job_id", clean.is_valid_posting().alias("valid"))


PROFILE = clean.standard_profile("(?i)ring|rod", "(?i)anvil", "(?i)PROMO", "(?i)small|large|hot", "(?i)ECONOMY", ["L1", "L2", "L3", "L4"], ["t", "d", "s", "p"])
LEVELS = """lev AS (SELECT *, CASE WHEN regexp_matches(job_name,'(?i)ECONOMY') THEN '低相关待排除' WHEN regexp_matches(job_name,'(?i)ring|rod') THEN 'L1'
 WHEN regexp_matches(job_name||' '||skills,'(?i)anvil') AND regexp_matches(job_name,'(?i)small|large|hot') THEN 'L2' WHEN regexp_matches(job_name||' '||skills,'(?i)PROMO') AND regexp_matches(job_name,'(?i)small|large|hot') THEN 'L3'
 WHEN regexp_matches(job_name,'(?i)small|large|hot') THEN 'L4' ELSE '低相关待排除' END AS relevance_level FROM postings)"""


@query("B7_relevance_level", with_(P_LEAN, LEVELS) + "SELECT platform, relevance_level, count(*) AS n, min(seq) AS first_seq FROM lev GROUP BY 1,2")
def b7(spark, sf):
    return clean.relevance_level(postings(spark, sf, False), PROFILE).groupBy("platform", "relevance_level").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("B8_top_by_level", with_(P_LEAN, LEVELS) + """SELECT CAST(row_number() OVER (ORDER BY relevance_level, seq) AS INT) AS record_no, relevance_level, seq, job_name FROM lev WHERE relevance_level IN ('L4','L1') QUALIFY record_no <= 500""")
def b8(spark, sf):
    df = clean.relevance_level(postings(spark, sf, False), PROFILE)
    return clean.top_by_level(df, ["L1", "L4"], 500).select("record_no", "relevance_level", "seq", "job_name")


@query("B9_number_rows", with_(P_LEAN) + "SELECT seq, row_number() OVER (ORDER BY city, seq DESC) AS record_no FROM postings")
def b9(spark, sf):
    p = postings(spark, sf, False).select("city", "seq")
    return clean.number_rows(p, [("city", True), ("seq", False)]).select("seq", F.col("record_no").cast("long").alias("record_no"))


@query("B10_canonicalize", with_(P_LEAN) + """SELECT CASE platform WHEN '5-LOW' THEN '智联招聘' ELSE platform END AS platform, job_id, job_name, CASE WHEN education='' THEN province ELSE education END AS education FROM postings WHERE company_size <> '20-99人'""")
def b10(spark, sf):
    p = postings(spark, sf, False)
    df = p.select(F.when(F.col("platform") == "5-LOW", "zhaopin").otherwise(F.concat(F.lit(" "), "platform", F.lit(" "))).alias("platform"), F.concat("job_id", F.lit(" ")).alias("job_id"),
                  F.when(F.col("company_size") == "20-99人", " ").otherwise(F.col("job_name")).alias("job_name"), "education", F.col("province").alias("学历要求"), F.lit("t").alias("task_id"))
    return clean.canonicalize(df)


@query("B11_content_identity", with_(P_LEAN) + """SELECT 'K' || substr(sha256('["' || platform || '","' || job_id || '"]'),1,24) AS job_key, sha256('{"city":"' || city || '","company_name":"' || company_name || '","job_id":"' || job_id || '","job_name":"' || job_name || '","platform":"' || platform || '","salary":"' || salary || '"}') AS content_hash, seq FROM postings""")
def b11(spark, sf):
    p = postings(spark, sf, False).select("platform", "job_id", "job_name", "company_name", "city", "salary", "seq", F.lit("t").alias("task_id"))
    return clean.content_identity(p, ignore=["seq"]).select("job_key", "content_hash", "seq")


MERGED = ", ".join(f"arg_max({c}, seq) FILTER ({c}<>'' AND {{w}}) AS {{p}}{c}" for c in TEXTS)
DIFFERS = " OR ".join(f"a_{c} IS DISTINCT FROM b_{c}" for c in TEXTS)


@query("B12_ingest_versions", with_(P_LEAN) + f""", m AS (SELECT platform, job_id, count(*) FILTER (line<=3) AS old_rows, count(*) FILTER (line>3) AS new_rows,
 {MERGED.format(w="line<=3", p="a_")}, {MERGED.format(w="true", p="b_")} FROM (SELECT *, (seq // 100000000000) % 10 AS line FROM postings) GROUP BY 1,2)
SELECT count(*) FILTER (old_rows=0) AS inserted, count(*) FILTER (old_rows>0 AND ({DIFFERS})) AS updated, count(*) FILTER (old_rows>0 AND NOT ({DIFFERS})) AS unchanged, count(*) AS joined FROM m WHERE new_rows>0""")
def b12(spark, sf):
    p = postings(spark, sf, False).drop("publish_time")
    line = F.expr("(seq div 100000000000) % 10")
    first = clean.ingest_versions(None, None, None, p.filter(line <= 3), "t1")
    second = clean.ingest_versions(first["jobs"], first["new_versions"], first["new_memberships"], p.filter(line > 3), "t2")
    return second["change"]


@query("B13_changed_sources", "SELECT url AS path, sha256(html) AS signature FROM pages WHERE url LIKE 'http://%'")
def b13(spark, sf):
    # Pages as sources: those at plain http addresses were seen with other contents.
    listing = table(spark, sf, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("signature"))
    seen = listing.withColumn("signature", F.when(F.col("path").startswith("http://"), F.sha2("path", 256)).otherwise(F.col("signature")))
    return clean.changed_sources(listing, seen)


@query("B14_meaningful_change", with_(P_LEAN) + f""", a AS (SELECT * FROM postings WHERE province<>'ASIA' QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq)=1),
 b AS (SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY seq DESC)=1)
SELECT b.platform, count(*) FILTER (a.platform IS NULL) AS inserted, count(*) FILTER (a.platform IS NOT NULL AND ({' OR '.join(f'a.{c}<>b.{c}' for c in TEXTS)})) AS updated,
 count(*) FILTER (a.platform IS NOT NULL AND NOT ({' OR '.join(f'a.{c}<>b.{c}' for c in TEXTS)})) AS unchanged FROM b LEFT JOIN a ON a.platform=b.platform AND a.job_id=b.job_id GROUP BY 1""")
def b14(spark, sf):
    p = postings(spark, sf, False).drop("publish_time")
    return clean.meaningful_change(clean.dedupe_first(p.filter("province <> 'ASIA'")), clean.dedupe_last(p), ignore=["seq"])


REDACT = r"""regexp_replace(regexp_replace(regexp_replace({x}, '(?i)https?://\S+', '[链接已移除]', 'g'), '(?i)[\w.+-]+@[\w.-]+\.[a-z]{{2,}}', '[邮箱已移除]', 'g'), '(^|[^0-9])(\+?86[- ]?)?1[3-9][0-9]{{9}}($|[^0-9])', '\1[电话已移除]\3', 'g')"""


@query("B15_redact", f"SELECT doc_id, sha256({REDACT.format(x='text')}) AS digest FROM documents")
def b15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(clean.redact("text"), 256).alias("digest"))


@query("B16_match_key", r"""SELECT doc_id, sha256(regexp_replace(lower(text), '[\s\x{3000}\x{00a0}]', '', 'g')) AS key, sha256(regexp_replace(lower(text), '[\s\x{3000}\x{00a0}]|\p{P}|\p{S}', '', 'g')) AS bare FROM documents""")
def b16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(clean.match_key("text"), 256).alias("key"), F.sha2(clean.match_key("text", True), 256).alias("bare"))


@query("B17_modelling_candidates", with_(DOCP) + f"""SELECT job_id, sha256('["' || job_name || '",' || CAST(to_json(body) AS VARCHAR) || ']') IS NOT NULL AS has_id, length(body) AS body_chars FROM (SELECT *, {REDACT.format(x='job_description')} AS body FROM docp)
 WHERE length(body) BETWEEN 80 AND 9000 QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(body, '[\\s\\x{{3000}}\\x{{00a0}}]', '', 'g')) ORDER BY seq)=1""")
def b17(spark, sf):
    return clean.modelling_candidates(doc_postings(spark, sf)).select("job_id", F.col("id").isNotNull().alias("has_id"), "body_chars")


@query("B18_identity_dedupe", with_(P_FULL) + r""", t AS (SELECT *, sha256(company_name||'|'||job_name||'|'||city||'|'||regexp_replace(job_description,'[\s\x{3000}\x{00a0}]','','g')) AS ident FROM postings)
SELECT CAST(kept AS VARCHAR) AS kept_key, CAST(seq AS VARCHAR) AS alias_key FROM (SELECT seq, min(seq) OVER (PARTITION BY ident) AS kept FROM t) WHERE seq<>kept""")
def b18(spark, sf):
    p = postings(spark, sf).withColumn("ref", F.col("seq").cast("string"))
    return clean.identity_dedupe(p, [F.col("seq")], "ref")[1]


@query("B19_posting_fallback_key", with_(P_FULL) + r""", t AS (SELECT seq, CASE WHEN city<>'NATION_3' AND city<>'NATION_4' THEN 'id:'||platform||':'||job_id
 WHEN city='NATION_3' AND length(d)>=30 THEN 'content:'||company_name||':'||job_name||':'||city||':'||d ELSE 'row:'||CAST(seq AS VARCHAR) END AS k FROM (SELECT *, substr(regexp_replace(trim(job_description, E' \t\n\r'),'[\s\x{3000}\x{00a0}]','','g'),1,160) AS d FROM postings))
SELECT split_part(k,':',1) AS kind, count(*) AS n, sum(first % 1000)::BIGINT AS mark FROM (SELECT k, min(seq) AS first FROM t GROUP BY k) GROUP BY 1""")
def b19(spark, sf):
    p = postings(spark, sf)
    p = p.withColumns({"platform": F.when(F.col("city").isin("NATION_3", "NATION_4"), "").otherwise(F.col("platform")),
                       "company_name": F.when(F.col("city") == "NATION_4", "").otherwise(F.col("company_name"))})
    out = clean.dedupe_postings(p, "seq")
    return out.groupBy(F.split_part("posting_key", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seq") % 1000).alias("mark"))


# Documents as posts: their exact copies are the duplicates.
POSTS = """posts AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS role_key, split_part(text, chr(10), 1) AS title, text AS content, doc_id AS created_at FROM documents),
 t AS (SELECT id, created_at, CASE WHEN role_key<>'de' AND length(content)>=80 THEN role_key||chr(1)||title||chr(1)||content ELSE 'id:'||id END AS k FROM posts)"""


def document_posts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("role_key"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"),
                    F.col("doc_id").alias("created_at"), F.when(F.col("lang") != "de", "detail").otherwise("list").alias("content_status"))


@query("B20_dedupe_interviews", with_(POSTS) + "SELECT id, count(*) OVER (PARTITION BY k) - 1 AS duplicate_count FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at, id)=1")
def b20(spark, sf):
    return clean.dedupe_interviews(document_posts(spark, sf))[0].select("id", "duplicate_count")


@query("B20_interview_duplicates", with_(POSTS) + "SELECT kept_id, id AS duplicate_id FROM (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY created_at, id) AS kept_id FROM t) WHERE id<>kept_id")
def b20d(spark, sf):
    return clean.dedupe_interviews(document_posts(spark, sf))[1]


@query("B20_interview_sources", with_(CONV) + r""", t AS (SELECT *, regexp_extract(id,'^\d+',0) AS url, regexp_replace(lower(content),'[\s\x{3000}\x{00a0}]','','g') AS norm FROM conv QUALIFY row_number() OVER (PARTITION BY regexp_extract(id,'^\d+',0) ORDER BY CAST(created_at AS VARCHAR) DESC, id)=1),
 k AS (SELECT *, CASE WHEN length(norm)>=120 THEN norm ELSE 'url:'||url END AS key FROM t) SELECT id, url, count(*) OVER (PARTITION BY key) - 1 AS duplicate_count FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at, url)=1""")
def b20s(spark, sf):
    c = conversation_posts(spark, sf).withColumns({"content_status": F.lit("detail"), "url": F.regexp_extract("id", r"^\d+", 0), "collected_at": F.col("created_at")})
    return clean.dedupe_interview_sources(c).select("id", "url", "duplicate_count")


@query("B21_question_set_dedupe", r"""WITH q AS (SELECT doc_id, list_sort(list_distinct(list_transform(str_split(text, chr(10)), lambda l: regexp_replace(regexp_replace(lower(regexp_replace(l,'[\s\x{3000}\x{00a0}]','','g')), '^(?:\d{1,3}[.、)）]|[-*•]|问[:：])+', ''), '[，。？?！!、:：；;“”"''()（）]', '', 'g')))) AS ks FROM documents),
 k AS (SELECT doc_id, CASE WHEN len(ks)>=5 THEN array_to_string(ks, chr(10)) ELSE 'post:'||doc_id END AS g FROM q) SELECT CAST(doc_id AS VARCHAR) AS id FROM k QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id)=1""")
def b21(spark, sf):
    return clean.question_set_dedupe(document_posts(spark, sf).withColumn("questions", F.split("content", "\n"))).select("id")


@query("B22_near_duplicate_groups")
def b22(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("job_description"))
    out = near.near_duplicate_groups(d)
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")


@query("B22_key_groups", r"""WITH RECURSIVE d AS (SELECT doc_id, sha256(lower(regexp_replace(text,'[\s\x{3000}\x{00a0}]','','g'))) AS body, CASE WHEN length(regexp_replace(text,'[\s\x{3000}\x{00a0}]','','g'))>160 THEN substr(lower(regexp_replace(text,'[\s\x{3000}\x{00a0}]','','g')),1,160) END AS pre FROM documents)
SELECT CAST(g AS VARCHAR) AS "group", count(*) AS members FROM (SELECT doc_id, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY coalesce(pre, body)) AS g FROM d) GROUP BY 1 HAVING count(*)>1""")
def b22k(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("job_description"))
    flat = clean.compact("job_description")
    pre = F.when(F.length(flat) > 160, F.sha2(F.substring(flat, 1, 160), 256))
    out = near.near_duplicate_groups(d, keys=[pre], threshold=None)
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")


# Grams of five letters without white space, marks and digits; every pair of texts of a like length that shares one is counted.
@query("B23_gram_overlap_filter", with_(DOCP) + r"""t AS (SELECT job_id, company_name='src0' AS stop, regexp_replace(lower(job_description), '[\p{P}\p{S}\d\s\x{3000}\x{00a0}]', '', 'g') AS x FROM docp WHERE company_name IS NOT NULL),
 g AS MATERIALIZED (SELECT DISTINCT job_id, stop, length(x) AS n, hash(substr(x, i, 5)) AS h FROM (SELECT *, unnest(range(1, length(x) - 3)) AS i FROM t WHERE length(x) >= 5)),
 m AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS m FROM g),
 p AS (SELECT a.job_id, count(*) AS c, any_value(a.m) AS ma, any_value(b.m) AS mb FROM m AS a JOIN m AS b ON a.h = b.h AND a.m * 0.8 <= b.m AND b.m * 0.8 <= a.m AND least(a.n, b.n) / greatest(a.n, b.n) >= 0.75 WHERE NOT a.stop AND b.stop GROUP BY a.job_id, b.job_id)
SELECT job_id FROM docp WHERE company_name <> 'src0' AND job_id NOT IN (SELECT job_id FROM p WHERE c / (ma + mb - c) >= 0.8)""".replace("t AS (", ", t AS (", 1))
def b23(spark, sf):
    d = doc_postings(spark, sf)
    return near.gram_overlap_filter(d.filter("company_name <> 'src0'"), d.filter("company_name = 'src0'")).select("job_id")


@query("B24_remove_conflicting_labels", r"""WITH t AS (SELECT doc_id, lang, CASE WHEN quality=1 AND toxic=0 THEN 'include' ELSE 'exclude' END AS label, lower(regexp_replace(text,'[\s\x{3000}\x{00a0}]','','g')) AS b FROM documents JOIN labels USING (doc_id))
SELECT doc_id, lang, label FROM t WHERE (lang,b) IN (SELECT lang,b FROM t GROUP BY lang,b HAVING count(DISTINCT label)=1) QUALIFY row_number() OVER (PARTITION BY lang,b ORDER BY doc_id)=1""")
def b24(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.withColumns({"label": F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "include").otherwise("exclude"), "body": F.col("text")})
    return clean.remove_conflicting_labels(d, group=["lang"], order="doc_id").select("doc_id", "lang", "label")
