"""Queries for K: streams run over files Spark writes from the tables, then the state is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.operators import clean
from hirelens.plans.q_sources import KB, knowledge, scratch
from hirelens.plans.registry import query
from hirelens.plans.views import P_LEAN, postings, table, with_
from hirelens.streaming import operators as st


def drained(spark, changes, mode):
    """Run a stream over what is there and read its output back from files."""
    path = scratch(spark)

    def each(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    changes.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(path)


def as_stream(spark, df, files=3):
    path = scratch(spark)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("K1_pin_snapshot", with_(P_LEAN) + "SELECT platform, count(*) AS n, min(seq) AS first_seq, 's1' AS snapshot_id, 7 AS revision FROM postings GROUP BY 1")
def k1(spark, sf):
    snap = st.pin_snapshot(postings(spark, sf, False), scratch(spark), "s1", 7)
    return snap.groupBy("platform", "snapshot_id", "revision").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("K2_reusable_report", """WITH s AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(floor(o_totalprice/1000) AS BIGINT) AS b FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)=1)
SELECT c_custkey AS context_key, CASE WHEN b IS NULL THEN 'no_snapshot' WHEN 200<b THEN 'data_decreased' WHEN 200>=CASE WHEN b>0 THEN b+ceil(b*20/100.0) ELSE 1 END THEN 'growth_threshold' ELSE 'unchanged_or_below_threshold' END AS reason FROM customer LEFT JOIN s ON c=c_custkey""")
def k2(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("context_key"), F.col("o_orderkey").alias("snapshot_key"), F.col("o_orderdate").alias("generated_at"), F.floor(F.col("o_totalprice") / 1000).alias("baseline_rows"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("context_key"), F.lit(200).alias("current_rows"))
    return st.reusable_report(o, c).select("context_key", "reason")


@query("K3_publish_if_changed", "SELECT 'first' AS step, true AS published UNION ALL SELECT 'same', false UNION ALL SELECT 'grown', count(*) > 0 FROM documents WHERE lang='de'")
def k3(spark, sf):
    path, d = scratch(spark), table(spark, sf, "documents").select("doc_id", "lang", "source")
    part = d.filter("lang <> 'de'")
    steps = [("first", st.publish_if_changed(part, path, "t", 1)), ("same", st.publish_if_changed(part.repartition(5), path, "t", 2)), ("grown", st.publish_if_changed(d, path, "t", 3))]
    return spark.createDataFrame(steps, "step string, published boolean")


@query("K4_stream_ingest", with_(P_LEAN) + "SELECT platform, job_id, arg_max(company_name, seq) AS company_name, arg_max(education, seq) FILTER (education<>'') AS education, max(seq) AS seq FROM postings GROUP BY 1,2")
def k4(spark, sf):
    p = postings(spark, sf, False).select("platform", "job_id", "seq", "company_name", "education", "salary")
    target, path, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    line = F.expr("(seq div 100000000000) % 10")
    # Rows arrive in three lots, each of as many files as it needs; a start of the stream takes what is new as one batch.
    for part in (line <= 2, (line > 2) & (line <= 4), line > 4):
        p.filter(part).write.mode("append").parquet(path)
        st.stream_ingest(spark.readStream.schema(p.schema).parquet(path), target, checkpoint).awaitTermination()
    return st.ingested(spark, target).select("platform", "job_id", "company_name", "education", "seq")


@query("K5_channel_ingestion", "SELECT event_type AS platform, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ingested_at, CAST(sum(user_id) AS BIGINT) AS inserted_rows, count(*) AS updated_rows FROM events GROUP BY 1")
def k5(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("platform"), F.col("ts").alias("ingested_at"), F.col("user_id").alias("inserted"), F.lit(1).alias("updated"))
    return drained(spark, st.channel_ingestion(as_stream(spark, e)), "complete").withColumn("last_ingested_at", F.date_format("last_ingested_at", "yyyy-MM-dd HH:mm:ss"))


@query("K6_channel_health", "SELECT CAST(user_id AS VARCHAR) AS platform, CASE WHEN user_id % 5 = 0 THEN 'blocked' WHEN user_id % 5 = 1 THEN 'completed' WHEN epoch(TIMESTAMP '2024-01-30 23:57:00')-epoch(max(ts)) >= 600 THEN 'lost' WHEN epoch(TIMESTAMP '2024-01-30 23:57:00')-epoch(max(ts)) >= 120 THEN 'delayed' ELSE 'healthy' END AS health FROM events GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-01-30 23:57:30'")
def k6(spark, sf):
    e = table(spark, sf, "events")
    g = e.groupBy(F.col("user_id").cast("string").alias("platform"), "user_id").agg(F.max("ts").alias("last_ingested_at"), F.min("ts").alias("started_at"))
    u = F.col("user_id") % 5
    activity = g.select("platform", F.when(u == 1, "completed").otherwise("running").alias("state"), "started_at", F.col("started_at").alias("updated_at"), F.when(u == 0, "manual").otherwise("").alias("diagnostic"))
    out = st.channel_health(activity, g.select("platform", "last_ingested_at"), "2024-01-30 23:57:00")
    return out.filter(F.col("last_ingested_at") <= F.lit("2024-01-30 23:57:30").cast("timestamp_ntz")).select("platform", "health")


@query("K6_health_stream")
def k6s(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("platform"), F.col("ts").cast("timestamp").alias("ts"))
    return drained(spark, st.channel_health_stream(as_stream(spark, e)), "append").groupBy("platform").agg(F.max_by("health", "at").alias("health"))


PAGES = "pg AS MATERIALIZED (SELECT event_type AS channel, event_id // 40 AS page_at, list(CAST(user_id AS VARCHAR)) AS ids FROM events GROUP BY 1,2)"


def pages(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("channel"), F.expr("event_id div 40").alias("page_at")).agg(F.collect_list(F.col("user_id").cast("string")).alias("ids"))


YIELD = with_(PAGES) + """, f AS (SELECT channel, page_at, count(*) AS added FROM (SELECT channel, id, min(page_at) AS page_at FROM (SELECT channel, page_at, unnest(ids) AS id FROM pg) GROUP BY 1,2) GROUP BY 1,2), b AS (SELECT pg.channel, pg.page_at, len(ids) AS records, coalesce(added,0) AS added FROM pg LEFT JOIN f USING (channel, page_at)),
 w AS (SELECT channel, page_at, CAST(sum(records) OVER x AS BIGINT) AS window_records, CAST(sum(added) OVER x AS BIGINT) AS window_new, count(*) OVER x AS n FROM b WINDOW x AS (PARTITION BY channel ORDER BY page_at ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT channel, page_at, window_records, window_new, n>=5 AND window_records>=100 AND window_new<=0 AS defer FROM w"""


@query("K7_low_yield_window", YIELD)
def k7(spark, sf):
    return st.low_yield_window(pages(spark, sf)).select("channel", "page_at", "window_records", "window_new", "defer")


@query("K7_low_yield_stream", YIELD)
def k7s(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path, rows = scratch(spark), pages(spark, sf)
    # Three files in the order of the pages, one for each batch.
    ends = rows.agg(F.expr("percentile_disc(0.33) WITHIN GROUP (ORDER BY page_at)").alias("a"), F.expr("percentile_disc(0.66) WITHIN GROUP (ORDER BY page_at)").alias("b")).first()
    at = F.col("page_at")
    for part in (at <= ends["a"], (at > ends["a"]) & (at <= ends["b"]), at > ends["b"]):
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return drained(spark, st.low_yield_stream(stream), "append").select("channel", "page_at", "window_records", "window_new", "defer")


@query("K8_repeated_page", """WITH p AS (SELECT o_custkey AS condition, year(o_orderdate) AS scan, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS page, o_orderstatus AS sig FROM orders)
SELECT condition, scan, page, min(page) OVER (PARTITION BY condition, scan, sig) < page AS repeated, page=1 AND coalesce(sig = (SELECT q.sig FROM p q WHERE q.condition=p.condition AND q.scan=p.scan-1 AND q.page=1), false) AS unchanged FROM p""")
def k8(spark, sf):
    from pyspark.sql import Window as W
    o = table(spark, sf, "orders").withColumn("scan", F.year("o_orderdate"))
    p = o.select(F.col("o_custkey").alias("condition"), "scan", F.row_number().over(W.partitionBy("o_custkey", "scan").orderBy("o_orderkey")).alias("page"), F.array("o_orderstatus").alias("ids"))
    return st.repeated_page(p).select("condition", F.col("scan").cast("long").alias("scan"), F.col("page").cast("long").alias("page"), "repeated", "unchanged")


@query("K9_incremental_classify", KB + "SELECT job_key, upper(job_name) AS decision FROM jobs")
def k9(spark, sf):
    jobs, _, _ = knowledge(spark, sf)
    j = jobs.select("job_key", F.sha2("job_name", 256).alias("content_hash"), "job_name", "seq")
    cache = scratch(spark)
    st.incremental_classify(as_stream(spark, j), cache, lambda d: d.select("job_key", "content_hash", F.upper("job_name").alias("decision")), "p1", scratch(spark)).awaitTermination()
    return st.classified(spark, cache).select("job_key", "decision")


@query("K10_admit_owner", with_(P_LEAN) + "SELECT CASE WHEN employment_type IN ('','全职') THEN 'good' ELSE 'quarantine' END AS part, count(*) AS n FROM postings GROUP BY 1")
def k10(spark, sf):
    good, bad = st.admit_owner(postings(spark, sf, False).withColumn("task_id", F.col("employment_type")), "全职")
    n = F.count(F.lit(1)).alias("n")
    return good.agg(n).select(F.lit("good").alias("part"), "n").unionByName(bad.agg(n).select(F.lit("quarantine").alias("part"), "n"))
