"""Queries for G and H."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.core import rnd
from hirelens.functions import text
from hirelens.operators import rank, sample
from hirelens.plans.q_functions import SECTIONED, SENT, WORDS, sectioned
from hirelens.plans.q_stats import base
from hirelens.plans.registry import query
from hirelens.plans.views import CONV, DOCP, POSTS, P_LEAN, P_WHOLE, R, conversation_posts, doc_postings, interview_posts, postings, table, whole_postings, with_

NOW = "2024-02-01 00:00:00"
INFL = f"""lg AS (SELECT *, ln(1+view_count) AS m0, ln(1+like_count) AS m1, ln(1+collect_count) AS m2, ln(1+total_comment_count) AS m3, 0.15 + (like_count IS NOT NULL)::INT*0.2 + (collect_count IS NOT NULL)::INT*0.4 + (total_comment_count IS NOT NULL)::INT*0.25 AS cov, (epoch(TIMESTAMP '{NOW}')-epoch(created_at))/86400.0 AS age FROM posts),
 sc AS (SELECT role_key, greatest(ln(1001), quantile_cont(m0,0.5)) AS s0, greatest(ln(21), quantile_cont(m1,0.5)) AS s1, greatest(ln(21), quantile_cont(m2,0.5)) AS s2, greatest(ln(11), quantile_cont(m3,0.5)) AS s3 FROM lg GROUP BY 1),
 inf AS MATERIALIZED (SELECT id, role_key, 100*(0.15*(1-exp(-least(m0/s0,3))) + 0.2*(CASE WHEN m1 IS NULL THEN 0 ELSE 1-exp(-least(m1/s1,3)) END) + 0.4*(CASE WHEN m2 IS NULL THEN 0 ELSE 1-exp(-least(m2/s2,3)) END) + 0.25*(CASE WHEN m3 IS NULL THEN 0 ELSE 1-exp(-least(m3/s3,3)) END))/cov*sqrt(cov)*pow(2.0,-age/180) AS score FROM lg JOIN sc USING (role_key))"""


@query("G1_influence_rank", with_(POSTS, INFL) + f"SELECT id, role_key, {R('score',6)} AS score, row_number() OVER (PARTITION BY role_key ORDER BY inf.score DESC, id) AS rank, {R('score/sum(score) OVER (PARTITION BY role_key)',8)} AS relative_weight FROM inf")
def g1(spark, sf):
    out = rank.influence_rank(interview_posts(spark, sf), NOW)
    return out.select("id", "role_key", rnd("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), rnd("relative_weight", 8).alias("relative_weight"))


ROLES = [("the", "(?i)^the", "(?i)zzz", "(?i)zzz")]
FAMS = ROLES + [("der", "(?i)^der", "(?i)zzz", "(?i)zzz")]


@query("G2_interview_retrieval", with_(CONV) + """SELECT id, CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rank, CAST(s AS DOUBLE) AS retrieval_score FROM (SELECT id, 20 + CASE WHEN lower(title) LIKE '%inthe%' THEN 3 WHEN lower(content) LIKE '%inthe%' THEN 1 ELSE 0 END + CASE WHEN lower(title) LIKE '%er%' THEN 3 WHEN lower(content) LIKE '%er%' THEN 1 ELSE 0 END + CASE WHEN role_key='user' THEN 2 ELSE 0 END AS s FROM conv WHERE regexp_matches(title,'(?i)^th')) QUALIFY rank<=8""")
def g2(spark, sf):
    c = conversation_posts(spark, sf).withColumn("content_status", F.when(F.col("role_key") == "user", "detail").otherwise("list"))
    roles = [("th", "(?i)^th", "(?i)zzzz", "(?i)zzzz")]
    return rank.interview_retrieval(c, "er inthe", roles, roles).select("id", "rank", F.col("retrieval_score").cast("double").alias("retrieval_score"))


QUERIES_SQL = "bq AS (SELECT item_id AS query_id, text FROM benchmark)"


@query("G3_lexical_rank", with_(P_LEAN) + f""", t AS MATERIALIZED (SELECT DISTINCT seq, unnest(regexp_extract_all(lower(job_name || ' ' || skills), '[a-z][a-z0-9+#.-]*|[一-鿿]{{2}}')) AS term FROM postings), qs AS (SELECT DISTINCT p_type AS query_id, p_type FROM part), qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query_id || ' red ring'), '[a-z][a-z0-9+#.-]*')) AS term FROM qs),
 d AS (SELECT term, ln(1+((SELECT count(*) FROM postings)-count(*)+0.5)/(count(*)+0.5)) AS idf FROM t GROUP BY 1), l AS (SELECT query_id, seq, sum(idf) AS lexical FROM t JOIN qt USING (term) JOIN d USING (term) GROUP BY 1,2),
 o AS (SELECT seq, len(list_intersect(str_split(skills,' '), ['red','ring'])) AS overlap FROM postings), z AS (SELECT query_id, seq, overlap, 2.0*overlap/4 AS matching, coalesce(lexical,0) AS lexical FROM (SELECT query_id, seq FROM l UNION SELECT query_id, seq FROM qs, o WHERE overlap>0) JOIN o USING (seq) LEFT JOIN l USING (query_id, seq))
SELECT query_id, seq, matching, {R('lexical',5)} AS lexical, CAST(row_number() OVER (PARTITION BY query_id ORDER BY matching DESC, overlap DESC, {R('z.lexical',8)} DESC, seq) AS INT) AS rank FROM z QUALIFY rank<=20""")
def g3(spark, sf):
    p = base(spark, sf).withColumn("skills_text", F.array_join("skills", " "))
    qs = table(spark, sf, "part").select(F.col("p_type").alias("query_id")).distinct().select("query_id", F.concat("query_id", F.lit(" red ring")).alias("query_text"), F.array(F.lit("red"), F.lit("ring")).alias("query_skills"))
    out = rank.lexical_rank(p, qs, 20, ("job_name", "skills_text"), "seq")
    return out.select("query_id", "seq", "matching", rnd("lexical", 5).alias("lexical"), "rank")


@query("G4_bm25", f"""WITH tk AS MATERIALIZED (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_+#.-]*|[一-鿿]+|\\d+(?:\\.\\d+)?'), lambda x: length(x)>1 OR x IN ('c','r')) AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM tk),
 qt AS MATERIALIZED (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_+#.-]*|[一-鿿]+|\\d+(?:\\.\\d+)?'), lambda x: length(x)>1 OR x IN ('c','r'))) AS term FROM benchmark), f AS MATERIALIZED (SELECT doc_id, len, term, count(*) AS f FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 d AS (SELECT term, ln(1+((SELECT n FROM st)-count(*)+0.5)/(count(*)+0.5)) AS idf FROM f GROUP BY 1), s AS (SELECT item_id AS query_id, doc_id, sum(idf*f*2.5/(f+1.5*(0.25+0.75*len/av))) AS score FROM f JOIN d USING (term) JOIN qt USING (term), st GROUP BY 1,2)
SELECT query_id, doc_id, {R('score',5)} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {R('s.score',8)} DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank<=250""")
def g4(spark, sf):
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("facet"), F.col("text").alias("query_text"))
    return rank.bm25(table(spark, sf, "documents"), qs).select("query_id", "doc_id", rnd("score", 5).alias("score"), "rank")


def centroids(spark, sf):
    """One mean vector per label."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


CENT = "cent AS MATERIALIZED (SELECT label, list(x ORDER BY i) AS vector FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY 1,2) GROUP BY 1)"
DOT = "list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), vector), lambda z: z[1]*z[2]))"


@query("G5_dense_retrieval", with_(CENT) + f"""SELECT c.label AS query_id, vec_id AS owner, {R(DOT,5)} AS score, CAST(row_number() OVER (PARTITION BY c.label ORDER BY {R(DOT,8)} DESC, vec_id) AS INT) AS rank FROM embeddings e, cent c QUALIFY rank<=100""")
def g5(spark, sf):
    chunks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("owner"), F.col("embedding").alias("vector"))
    qs = centroids(spark, sf).select(F.col("label").alias("query_id"), "vector")
    return rank.dense_retrieval(chunks, qs, 100).select("query_id", "owner", rnd("score", 5).alias("score"), "rank")


LISTS = """a AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(text), doc_id) AS rank FROM documents),
 fused AS (SELECT query_id, doc_id, sum(1.0/(60+rank)) AS rrf_score FROM (SELECT * FROM a WHERE rank<=100 UNION ALL SELECT * FROM b WHERE rank<=100) GROUP BY 1,2)"""


def fused(spark, sf):
    from hirelens.core import first_per_key
    d = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    a = first_per_key(d, ["query_id"], [F.col("n_chars").desc(), F.col("doc_id")], 100, "rank")
    b = first_per_key(d, ["query_id"], [F.col("h"), F.col("doc_id")], 100, "rank")
    return rank.rrf([a, b], "doc_id")


@query("G6_rrf", with_(LISTS) + f"SELECT query_id, doc_id, {R('rrf_score',8)} AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {R('fused.rrf_score',10)} DESC, doc_id) AS INT) AS rank FROM fused")
def g6(spark, sf):
    return fused(spark, sf).withColumn("rrf_score", rnd("rrf_score", 8))


@query("G7_rerank", with_(LISTS) + f"""SELECT query_id, doc_id, CAST(n_chars % 50 AS DOUBLE) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n_chars % 50 DESC, {R('rrf_score',10)} DESC, doc_id) AS INT) AS rank FROM fused JOIN documents USING (doc_id)""")
def g7(spark, sf):
    d = table(spark, sf, "documents")
    w = d.select(F.col("lang").alias("query_id"), "doc_id", F.explode(F.array((F.col("n_chars") % 50).cast("double"), F.lit(-1.0))).alias("window_score"))
    return rank.rerank(fused(spark, sf), w, "doc_id").select("query_id", "doc_id", "rerank_score", "rank")


@query("G8_cluster_representatives", """WITH p AS (SELECT city AS cluster, seq AS id, company_name AS company, seq % 1000003 AS distance FROM (SELECT n_name AS city, l_orderkey*1000000000000 + l_linenumber*100000000000 + l_partkey*1000000 + l_suppkey*100 + CAST(l_quantity AS BIGINT) AS seq, s_name AS company_name FROM lineitem JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey)),
 n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY distance, id)<=24), c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cluster, company ORDER BY distance, id)=1), r AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY distance, id) AS place FROM c QUALIFY place<=5),
 b AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY distance DESC, id) AS place FROM p ANTI JOIN r USING (cluster, id) QUALIFY place<=2), u AS (SELECT cluster,id FROM r UNION ALL SELECT cluster,id FROM b),
 h AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY sha256('sample42:'||CAST(id AS VARCHAR))) AS place FROM p ANTI JOIN u USING (cluster,id) QUALIFY place<=4)
SELECT cluster, id, CAST(place AS INT) AS place, 'center' AS kind FROM r UNION ALL SELECT cluster, id, CAST(place AS INT), 'boundary' FROM b UNION ALL SELECT cluster, id, CAST(CASE WHEN place>2 THEN place-2 ELSE place END AS INT), CASE WHEN place>2 THEN 'audit' ELSE 'random' END FROM h""")
def g8(spark, sf):
    p = postings(spark, sf, False).select(F.col("city").alias("cluster"), F.col("seq").alias("id"), F.col("company_name").alias("company"), (F.col("seq") % 1000003).alias("distance"))
    return rank.cluster_representatives(p)


@query("G9_round_robin_audit", with_(P_LEAN) + """, t AS (SELECT seq, CASE WHEN employment_type='' THEN '未明确' ELSE employment_type END || ':' || CASE WHEN seq % 10 < 6 THEN '低置信' ELSE '高置信' END AS audit_group, CASE WHEN seq % 7 < 3 THEN 0 ELSE 1 END AS low FROM postings), s AS (SELECT *, count(*) OVER (PARTITION BY audit_group) AS size, row_number() OVER (PARTITION BY audit_group ORDER BY low, seq) AS turn FROM t)
SELECT seq, audit_group, CAST(row_number() OVER (ORDER BY turn, size, audit_group) AS INT) AS place FROM s QUALIFY place<=40""")
def g9(spark, sf):
    p = postings(spark, sf, False).withColumns({"confidence": F.when(F.col("seq") % 10 < 6, 0.5).otherwise(0.9), "evidence_coverage": F.when(F.col("seq") % 7 < 3, 0.1).otherwise(0.9), "row_no": F.col("seq")})
    return rank.round_robin_audit(p, 40).select("seq", "audit_group", "place")


@query("G10_company_diverse_order", with_(P_LEAN) + """, t AS (SELECT seq, min(seq) OVER (PARTITION BY lower(company_name)) AS first, row_number() OVER (PARTITION BY lower(company_name) ORDER BY seq) AS turn FROM postings)
SELECT seq, row_number() OVER (ORDER BY turn, first) AS place FROM t""")
def g10(spark, sf):
    p = postings(spark, sf, False).select("seq", F.col("company_name").alias("company"), F.col("seq").alias("id"))
    return rank.company_diverse_order(p, "seq").select("seq", F.col("place").cast("long").alias("place"))


@query("G11_latest_per_context", "SELECT o_custkey AS context_key, o_orderkey AS snapshot_key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)=1")
def g11(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("context_key"), F.col("o_orderkey").alias("snapshot_key"), F.col("o_orderdate").alias("generated_at"))
    return rank.latest_per_context(o).select("context_key", "snapshot_key")


@query("G12_evidence_snippet", with_(DOCP, SECTIONED) + r""", cut AS (SELECT job_id, job_description AS d, instr(job_description, '岗位职责') AS i, instr(job_description, '任职要求') AS j FROM sec),
 sn AS MATERIALIZED (SELECT job_id, regexp_split_to_array(substr(d, i + 4, j - i - 4), '[。；;\n]') AS du, regexp_split_to_array(substr(d, j + 4), '[。；;\n]') AS rq FROM cut),
 sp AS (SELECT job_id, generate_subscripts(du, 1) AS pos, unnest(du) AS q FROM sn UNION ALL SELECT job_id, 100000 + generate_subscripts(rq, 1), unnest(rq) FROM sn),
 sent AS MATERIALIZED (SELECT job_id, pos, trim(q, E' \t\n\r' || chr(12288) || chr(160)) AS quote FROM sp),
 h AS (SELECT job_id, pos, quote, contains(lower(regexp_replace(quote, '\s', '', 'g')), 'there')::INT + contains(lower(regexp_replace(quote, '\s', '', 'g')), 'ing')::INT AS hits FROM sent WHERE length(quote) >= 16),
 b AS (SELECT job_id, arg_max(struct_pack(hits, quote), (hits, -pos)) AS x FROM h GROUP BY job_id)
SELECT d.job_id, coalesce(CAST(x.hits AS INT), 0) AS snippet_hits, sha256(coalesce(substr(x.quote, 1, 650), '未提供可引用原文')) AS digest FROM docp d LEFT JOIN b ON b.job_id = d.job_id""")
def g12(spark, sf):
    return rank.evidence_snippet(sectioned(spark, sf), "ing there").select("job_id", "snippet_hits", F.sha2("snippet", 256).alias("digest"))


@query("H1_even_sample", with_(P_LEAN) + ", n AS (SELECT seq, row_number() OVER (ORDER BY seq)-1 AS i, count(*) OVER () AS t FROM postings) SELECT seq FROM n WHERE i IN (SELECT CAST(floor(k*(SELECT count(*)-1 FROM postings)/299.0) AS BIGINT) FROM range(300) r(k))")
def h1(spark, sf):
    return sample.even_sample(postings(spark, sf, False).select("seq"), [("seq", True)], 300)


TERMS = {"title": ["ring"], "duty": ["bolt", "red"], "adjacent": ["rod", "hot"], "skill": ["blue"], "business": ["old"]}


def stratified_source(spark, sf):
    p = whole_postings(spark, sf, F.col("skills"))
    return sample.retrieval_strata(p, TERMS).withColumns({"id": F.col("seq"), "company": F.col("company_name")})


@query("H2_stratified_sample")
def h2(spark, sf):
    return sample.stratified_sample(stratified_source(spark, sf), 300).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


STRATA = """hs AS MATERIALIZED (SELECT *, regexp_matches(ttl,'(^|[^a-z0-9_])ring($|[^a-z0-9_])')::INT AS t, regexp_matches(body,'(^|[^a-z0-9_])bolt($|[^a-z0-9_])')::INT + regexp_matches(body,'(^|[^a-z0-9_])red($|[^a-z0-9_])')::INT AS d, regexp_matches(ttl||' '||body,'(^|[^a-z0-9_])rod($|[^a-z0-9_])')::INT + regexp_matches(ttl||' '||body,'(^|[^a-z0-9_])hot($|[^a-z0-9_])')::INT AS a, regexp_matches(body,'(^|[^a-z0-9_])blue($|[^a-z0-9_])')::INT AS s, regexp_matches(body,'(^|[^a-z0-9_])old($|[^a-z0-9_])')::INT AS b FROM (SELECT *, lower(job_name) AS ttl, lower(skills||chr(10)||job_description) AS body FROM postings)),
 st AS MATERIALIZED (SELECT *, t>0 OR d>=2 OR (s>=2 AND (d>0 OR b>0)) AS target, least(4,t)*4+least(5,d)*2+least(3,s)+least(2,b) AS sc FROM hs)"""


@query("H2_target_order", with_(P_WHOLE, STRATA) + """, e AS (SELECT seq, row_number() OVER (ORDER BY seq)-1 AS i FROM postings), r AS (SELECT seq FROM e WHERE i IN (SELECT CAST(floor(k*(SELECT count(*) FROM postings)/60.0) AS BIGINT) FROM range(60) r(k)))
SELECT seq FROM r UNION ALL SELECT seq FROM (SELECT seq, row_number() OVER w AS turn, first_value(-sc) OVER w AS l1, first_value(seq) OVER w AS l2 FROM st WHERE target AND seq NOT IN (SELECT seq FROM r) WINDOW w AS (PARTITION BY company_name ORDER BY sc DESC, seq) ORDER BY turn, l1, l2 LIMIT 180)""")
def h2t(spark, sf):
    return sample.stratified_sample(stratified_source(spark, sf), 300).filter("stratum in ('random_source', 'target_candidate')").select("seq")


@query("H3_reservoir", with_(P_LEAN) + "SELECT platform, seq FROM postings QUALIFY row_number() OVER (PARTITION BY platform ORDER BY sha256('173:'||CAST(seq AS VARCHAR)))<=50")
def h3(spark, sf):
    p = postings(spark, sf, False).select("platform", "seq", F.col("seq").alias("id"))
    return sample.reservoir(p, 50, pool="platform").select("platform", "seq")


@query("H4_capped_hash_sample", with_(DOCP) + r""", h AS (SELECT job_id, company_name, sha256('pilot:'||job_id) AS h, lower(regexp_replace(job_description,'[\s\x{3000}\x{00a0}]','','g')) AS b FROM docp), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY b ORDER BY h)=1), c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY h)<=5)
SELECT job_id, CAST(row_number() OVER (ORDER BY h) AS INT) AS place FROM c QUALIFY place<=60""")
def h4(spark, sf):
    return sample.capped_hash_sample(doc_postings(spark, sf), 5, 60).select("job_id", "place")


@query("H5_strata_review_sample", with_(P_LEAN) + """, t AS (SELECT platform AS role, province AS split, company_name, seq, CASE WHEN skills LIKE '%ring%' THEN 'a' ELSE 'b' END AS stratum, sha256('weighted-review'||CAST(seq AS VARCHAR)) AS h FROM postings),
 a AS (SELECT * FROM (SELECT * FROM t WHERE stratum='a' QUALIFY row_number() OVER (PARTITION BY role, split, company_name ORDER BY h)=1) QUALIFY row_number() OVER (PARTITION BY role, split ORDER BY h)<=8),
 b AS (SELECT * FROM (SELECT * FROM t ANTI JOIN a USING (role, split, company_name) WHERE stratum='b' QUALIFY row_number() OVER (PARTITION BY role, split, company_name ORDER BY h)=1) QUALIFY row_number() OVER (PARTITION BY role, split ORDER BY h)<=6)
SELECT seq, stratum FROM a UNION ALL SELECT seq, stratum FROM b""")
def h5(spark, sf):
    p = postings(spark, sf, False).select(F.col("platform").alias("role"), F.col("province").alias("split"), F.col("company_name").alias("company"), "seq", F.col("seq").alias("id"), F.when(F.col("skills").contains("ring"), "a").otherwise("b").alias("stratum"))
    return sample.strata_review_sample(p, [("a", 8), ("b", 6)]).select("seq", "stratum")


@query("H6_hash_split", with_(P_LEAN) + """SELECT split, count(*) AS n, count(DISTINCT company_name) AS companies FROM (SELECT company_name, CASE WHEN b<6 THEN 'train' WHEN b<8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT company_name, CAST('0x'||substr(sha256(company_name),1,8) AS BIGINT) % 10 AS b FROM postings)) GROUP BY 1""")
def h6(spark, sf):
    return postings(spark, sf, False).select("company_name", sample.hash_split("company_name").alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company_name").alias("companies"))


@query("H6_fnv_fold", """SELECT s_name, CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(str_split(s_name,''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda a, c: (xor(CAST(a AS UBIGINT), CAST(c AS UBIGINT))::HUGEINT * 16777619) % 4294967296) % 3 AS INT) AS fold FROM supplier""")
def h6f(spark, sf):
    return table(spark, sf, "supplier").select("s_name", sample.fnv_fold("s_name", 3).alias("fold"))


@query("H7_split_leak_check", with_(P_LEAN) + """SELECT company_name AS "group", min(platform) AS lowest, max(platform) AS highest, count(*) AS rows FROM postings GROUP BY 1 HAVING min(platform)<>max(platform)""")
def h7(spark, sf):
    return sample.split_leak_check(postings(spark, sf, False).select(F.col("company_name").alias("group"), F.col("platform").alias("split")))


@query("H8_time_holdout", with_(P_LEAN) + """, d AS (SELECT *, CAST(publish_time AS DATE) AS day, row_number() OVER (ORDER BY CAST(publish_time AS DATE)) AS r, count(*) OVER () AS t FROM postings) SELECT part, count(*) AS n, min(strftime(day,'%Y-%m-%d')) AS first_day FROM (SELECT day, CASE WHEN day < (SELECT day FROM d WHERE r=floor(t*0.8)+1) THEN 'train' ELSE 'holdout' END AS part FROM d) GROUP BY 1""")
def h8(spark, sf):
    p = postings(spark, sf, False).select(F.col("publish_time").cast("date").alias("day"))
    return sample.time_holdout(p).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"))


@query("H9_retrieval_strata", with_(P_WHOLE, STRATA) + """SELECT target, NOT target AND (d>0 OR a>0 OR s>0 OR b>0) AS related, CAST(sc AS INT) AS score, count(*) AS n FROM st GROUP BY ALL""")
def h9(spark, sf):
    return stratified_source(spark, sf).groupBy("target", "related", "score").agg(F.count(F.lit(1)).alias("n"))
