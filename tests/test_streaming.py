"""Streams against batches: restart, repeated batches and streams that run at once."""

import random

from pyspark.sql import functions as F

from hirelens.operators import clean
from hirelens.streaming import operators as st
from hirelens.streaming.batches import read_batches, stream_name, write_batch

POSTINGS = "platform string, job_id string, seq long, city string, query_keyword string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_ingest_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("p", str(i % 20), i, f"c{i}" if i % 3 else "", "k") for i in range(60)] + [("", "1", 1, "x", ""), ("p", None, 1, "x", "")], POSTINGS)
    for lo in (0, 20, 40):
        df.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, check, changes = (str(tmp_path / x) for x in ("t", "c", "changes"))

    def run():
        st.stream_ingest(source(spark, tmp_path / "in", df.schema), path, check, changes).awaitTermination()
        return {tuple(r) for r in st.ingested(spark, path).select("platform", "job_id", "city", "seq").collect()}
    first = run()
    assert first == {tuple(r) for r in clean.merge_postings(None, df).select("platform", "job_id", "city", "seq").collect()} and len(first) == 20
    assert run() == first
    told = spark.read.parquet(changes).groupBy("batch").agg(F.sum("inserted"), F.sum("updated"), F.sum("unchanged")).orderBy("batch").collect()
    assert [tuple(r)[1:] for r in told] == [(20, 0, 0), (0, 13, 7), (0, 14, 6)]
    # A batch that runs again overwrites its folder, and some keys can be read alone.
    write_batch(df.filter("seq < 20 AND platform = 'p' AND job_id IS NOT NULL"), path, st.POSTING, stream_name(check), 0)
    assert {tuple(r) for r in st.ingested(spark, path).select("platform", "job_id", "city", "seq").collect()} == first
    some = st.ingested(spark, path, df.filter("job_id IN ('3', '7')")).collect()
    assert {r["job_id"] for r in some} == {"3", "7"}
    assert st.ingested(spark, str(tmp_path / "none")) is None


def test_streams_at_once_lose_nothing(spark, tmp_path):
    df = spark.createDataFrame([("p", str(i), i, f"c{i}", "") for i in range(60)], POSTINGS)
    running = []
    for n, name in enumerate("abc"):
        df.filter(F.col("seq") % 3 == n).repartition(2).write.parquet(str(tmp_path / name))
        running.append(st.stream_ingest(source(spark, tmp_path / name, df.schema), str(tmp_path / "t"), str(tmp_path / f"check-{name}")))
    for query in running:
        query.awaitTermination()
    assert {r["job_id"] for r in st.ingested(spark, str(tmp_path / "t")).collect()} == {str(i) for i in range(60)}


def test_only_changed_rows_are_scored(spark, tmp_path):
    schema = "job_key string, content_hash string, seq long"
    steps = [[("a", "1", 1), ("b", "1", 2)], [("a", "1", 3), ("b", "2", 4), ("c", "1", 5)], [("b", "1", 6), ("c", "1", 7), ("c", "2", 6)]]
    seen = []
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def classify(d):
            seen.append(sorted(r["job_key"] + r["content_hash"] for r in d.collect()))
            return d.select("job_key", "content_hash", F.concat("job_key", F.lit("!"), "content_hash").alias("decision"))
        st.incremental_classify(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), classify, "p1", str(tmp_path / "c")).awaitTermination()
    assert seen == [["a1", "b1"], ["b2", "c1"], ["b1"]]
    assert {r["job_key"]: r["decision"] for r in st.classified(spark, str(tmp_path / "t")).collect()} == {"a": "a!1", "b": "b!1", "c": "c!1"}
    st.incremental_classify(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), classify, "p2", str(tmp_path / "c2")).awaitTermination()
    assert seen[-1] == ["a1", "b1", "c1"] and read_batches(spark, str(tmp_path / "t")).filter("pipeline = 'p2'").count() == 3


def test_low_yield_stream_equals_the_batch_under_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        draw = random.Random(2)
        rows = [(channel, page, [draw.choice(["", None, *map(str, range(60 if channel == "a" else 4000))]) for _ in range(draw.randint(0, 60))]) for channel in "ab" for page in range(24)]
        pages = spark.createDataFrame(rows, "channel string, page_at long, ids array<string>")
        want = {tuple(r) for r in st.low_yield_window(pages).select("channel", "page_at", "window_records", "window_new", "defer").collect()}
        assert {r[4] for r in want} == {True, False}
        for lo in (0, 7, 16):
            pages.filter(F.col("page_at").between(lo, {0: 6, 7: 15, 16: 99}[lo])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            # A new start for each file: the state comes from the checkpoint.
            out = st.low_yield_stream(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))).select("channel", "page_at", "window_records", "window_new", "defer")
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_ingest_query_writes_and_reads_with_many_tasks(spark, tmp_path, monkeypatch):
    from hirelens.plans import q_streaming
    from tests.oracle import compare, connect
    sf, made, whole = "/root/testdata/sf0.001", [], q_streaming.postings

    def scratch(_):
        made.append(tmp_path / f"s{len(made)}")
        return str(made[-1])
    monkeypatch.setattr(q_streaming, "scratch", scratch)
    monkeypatch.setattr(q_streaming, "postings", lambda *a: whole(*a).repartition(4))
    assert compare(spark, connect(sf), q_streaming.k4, q_streaming.query.__globals__["SQL"]["K4_stream_ingest"], sf) is None
    # Three lots of four files each, taken as three batches.
    assert len(list(made[1].glob("*.parquet"))) == 12 and len(list(made[0].glob("stream=*/batch=*"))) == 3
