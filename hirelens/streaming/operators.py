"""K: snapshots, publication and incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, Row, StringType, StructField, StructType

from hirelens.core import filled, first_per_key, position_within, text
from hirelens.operators.clean import TIMES, meaningful_change, merge_postings
from hirelens.streaming.batches import PARTS, exists, read_batches, stream_name, write_batch


def pin_snapshot(df: DataFrame, path: str, snapshot_id: str, revision: int) -> DataFrame:
    """K1: immutable copy in its own partition; pinning an id twice fails."""
    df.withColumn("revision", F.lit(revision)).write.mode("errorifexists").parquet(f"{path}/snapshot_id={snapshot_id}")
    return df.sparkSession.read.parquet(f"{path}/snapshot_id={snapshot_id}").withColumn("snapshot_id", F.lit(snapshot_id))


def context_key(columns: Sequence[str]) -> Column:
    """K2: key over the columns that make a report comparable."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def reusable_report(snapshots: DataFrame, contexts: DataFrame, growth: int = 20) -> DataFrame:
    """K2: newest snapshot per context with its verdict: reusable unless rows grew by `growth` percent (rounded up) or shrank.

    snapshots: context_key, snapshot_key, generated_at, baseline_rows. contexts: context_key, current_rows.
    """
    newest = first_per_key(snapshots, ["context_key"], [F.col("generated_at").desc(), F.col("snapshot_key")])
    df = contexts.join(newest, "context_key", "left")
    base, now = F.col("baseline_rows"), F.col("current_rows")
    trigger = F.when(base > 0, base + F.ceil(base * growth / 100)).otherwise(1)
    reason = F.when(base.isNull(), "no_snapshot").when(now < base, "data_decreased").when(now >= trigger, "growth_threshold").otherwise("unchanged_or_below_threshold")
    return df.withColumns({"next_trigger_rows": trigger, "reason": reason, "reusable": reason == "unchanged_or_below_threshold"})


def dataset_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """K3: one row (rows, hash) that does not depend on row order or partitioning."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(columns or df.columns)])
    total = F.sum(h.cast("decimal(20,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"), total.cast("string")).alias("hash"))


def publish_if_changed(df: DataFrame, path: str, task_id: str, version: int) -> bool:
    """K3: write a new version and its manifest row unless the content equals the published one."""
    spark = df.sparkSession
    now = dataset_hash(df).collect()[0]
    last = spark.read.json(f"{path}/manifest").orderBy(F.col("version").desc()).limit(1).collect() if exists(spark, f"{path}/manifest") else []
    if last and last[0]["task_id"] != task_id:
        raise ValueError("manifest belongs to another task")
    if last and last[0]["hash"] == now["hash"]:
        return False
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    spark.createDataFrame([(task_id, version, now["rows"], now["hash"])], "task_id string, version long, rows long, hash string").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return True


POSTING = ("platform", "job_id")


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, changes: str | None = None, task_id: str | None = None, buckets: int = 32):
    """K4: keep the rows of every batch; `ingested` merges them by B3. A repeated batch writes the same folder again.

    Per-platform change counts (B14) of each batch go to `changes`; they read the earlier rows
    of the keys in the batch only. Any number of streams may write to one path at once. Returns
    the started query, which processes what is available and ends.
    """
    name = stream_name(checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(filled("platform") & filled("job_id"))
        if task_id is not None:
            rows = admit_owner(rows, task_id)[0]
        if not changes:
            write_batch(rows, path, POSTING, name, batch_id, buckets)
            return
        rows = rows.persist()
        try:
            old = read_batches(rows.sparkSession, path, rows, POSTING, buckets, but=(name, batch_id))
            before = merge_postings(None, old.drop(*PARTS), times=TIMES) if old is not None else None
            after = merge_postings(before, rows, times=TIMES)
            before = before if before is not None else after.limit(0)
            meaningful_change(before, after, ignore=["seq", TIMES]).write.mode("overwrite").parquet(f"{changes}/stream={name}/batch={batch_id}")
            write_batch(rows, path, POSTING, name, batch_id, buckets)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str, keys: DataFrame | None = None, buckets: int = 32) -> DataFrame | None:
    """K4: the state of all postings, or of some keys: one aggregate over the rows of all batches."""
    rows = read_batches(spark, path, keys, POSTING, buckets)
    return None if rows is None else merge_postings(None, rows.drop(*PARTS))


def channel_ingestion(stream: DataFrame, at: str = "ingested_at") -> DataFrame:
    """K5: last ingestion time and added counts per platform; update mode on a stream, plain on a table."""
    return stream.filter(F.col("inserted") + F.col("updated") > 0).groupBy("platform").agg(
        F.max(at).alias("last_ingested_at"), F.sum("inserted").alias("inserted_rows"), F.sum("updated").alias("updated_rows"))


def channel_health(activity: DataFrame, ingestion: DataFrame, now: str, task_status: str = "running", run_started: str | None = None, stale: int = 120, lost: int = 600) -> DataFrame:
    """K6: state of each channel by precedence; stamps over 30 s in the future are ignored.

    activity: platform, state, started_at, updated_at, diagnostic. ingestion: K5.
    """
    if not 0 < stale < lost:
        raise ValueError("thresholds")
    clock = F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("double")
    stamp = lambda c: F.when(F.col(c).cast("timestamp").cast("double") <= clock + 30, F.col(c).cast("timestamp").cast("double"))
    run = F.lit(run_started).cast("timestamp_ntz").cast("timestamp").cast("double") if run_started else F.lit(None).cast("double")
    df = activity.join(ingestion, "platform", "full_outer").withColumns({"_last": stamp("last_ingested_at"), "_start": stamp("started_at"), "_upd": stamp("updated_at")})
    current = run.isNull() | (F.col("_upd") >= run)
    state = F.when(current, F.col("state"))
    fresh = F.col("_last").isNotNull() & (run.isNull() | (F.col("_last") >= run))
    started = F.coalesce(F.when(current, F.col("_start")), run)
    reference = F.when(fresh, F.greatest(F.col("_last"), F.coalesce(started, F.col("_last")))).otherwise(started)
    gone = F.greatest(F.lit(0.0), clock - reference)
    diag = F.coalesce("diagnostic", F.lit(""))
    out = (F.when(diag == "paused", "paused").when(diag.isin("manual", "failed"), "blocked").when(F.lit(task_status) == "ready", "pending")
           .when(state.isin("empty", "completed") | diag.isin("empty", "completed"), "completed").when(F.lit(task_status).isin("paused", "stopping"), "paused")
           .when(F.lit(task_status) != "running", "unknown").when(state == "paused", "paused")
           .when(~F.coalesce(state == "running", F.lit(False)) & (diag != "running") & ~F.coalesce(fresh & (clock - F.col("_last") < stale), F.lit(False)), "waiting")
           .when(reference.isNull(), "waiting").when(gone >= lost, "lost").when(gone >= stale, "delayed").when(fresh, "healthy").otherwise("waiting"))
    return df.withColumns({"health": out, "seconds_since": gone}).drop("_last", "_start", "_upd")


HEALTH = "platform string, health string, at double"


def channel_health_stream(events: DataFrame, stale: int = 120, lost: int = 600, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """K6 on a stream: a row whenever a channel turns healthy, delayed or lost, by event time.

    State is one time per platform. The watermark is ours: it moves the timers and bounds
    late rows.
    """
    def step(key, batches, state: GroupState):
        name = key[0]
        if state.hasTimedOut:
            last, level = state.get
            if level == 0:
                state.update((last, 1))
                state.setTimeoutTimestamp(max(int((last + lost) * 1000), state.getCurrentWatermarkMs() + 1))
                yield pd.DataFrame([(name, "delayed", last + stale)], columns=["platform", "health", "at"])
            else:
                state.remove()
                yield pd.DataFrame([(name, "lost", last + lost)], columns=["platform", "health", "at"])
            return
        newest = max(float(b["_sec"].max()) for b in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last, 0))
        state.setTimeoutTimestamp(max(int((last + stale) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(name, "healthy", last)], columns=["platform", "health", "at"])

    timed = events.withWatermark(at, late).select("platform", F.col(at), F.col(at).cast("double").alias("_sec"))
    return timed.groupBy("platform").applyInPandasWithState(step, HEALTH, "last double, level int", "append", GroupStateTimeout.EventTimeTimeout)


def low_yield_window(pages: DataFrame, window: int = 5, least_records: int = 100, most_new: int = 0) -> DataFrame:
    """K7: per page the records and first-seen ids of the last `window` pages and whether to defer.

    pages: channel, page_at (order), ids array. First sight is a minimum per id; window
    sums are page contributions added at the following positions, so no channel is
    walked by one task.
    """
    ids = pages.select("channel", "page_at", F.explode(F.filter("ids", lambda i: i.isNotNull() & (i != ""))).alias("id"))
    first = ids.groupBy("channel", "id").agg(F.min("page_at").alias("page_at")).groupBy("channel", "page_at").agg(F.count(F.lit(1)).alias("added"))
    base = pages.select("channel", "page_at", F.size(F.filter("ids", lambda i: i.isNotNull() & (i != ""))).alias("records"))
    base = base.join(first, ["channel", "page_at"], "left").na.fill(0, ["added"])
    placed = position_within(base, [("page_at", True)], ["channel"], "page_no")
    spread = placed.select("channel", F.explode(F.sequence(F.col("page_no"), F.col("page_no") + window - 1)).alias("page_no"), "records", "added")
    sums = spread.groupBy("channel", "page_no").agg(F.sum("records").alias("window_records"), F.sum("added").alias("window_new"), F.count(F.lit(1)).alias("_pages"))
    out = placed.join(sums, ["channel", "page_no"])
    return out.withColumns({
        "duplicate_rate": F.coalesce(1 - F.try_divide("window_new", "window_records"), F.lit(0.0)),
        "defer": (F.col("_pages") >= window) & (F.col("window_records") >= least_records) & (F.col("window_new") <= most_new)}).drop("_pages")


class _Yield(StatefulProcessor):
    """State of a channel: the ids seen so far and (records, added) of its last pages."""

    def __init__(self, window: int, least_records: int, most_new: int, ttl_ms: int | None):
        self.window, self.least, self.most, self.ttl = window, least_records, most_new, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        text_type = StructType([StructField("id", StringType())])
        self.seen = handle.getMapState("seen", text_type, StructType([StructField("page_at", LongType())]), self.ttl)
        self.last = handle.getListState("last", StructType([StructField("records", LongType()), StructField("added", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = list(self.last.get()) if self.last.exists() else []
        for page in sorted(rows, key=lambda r: r["page_at"]):
            ids = [i for i in page["ids"] or [] if i is not None and i != ""]
            added = 0
            for i in dict.fromkeys(ids):
                if not self.seen.containsKey((i,)):
                    self.seen.updateValue((i,), (page["page_at"],))
                    added += 1
            last = [*last, (len(ids), added)][-self.window:]
            records, new = sum(r for r, _ in last), sum(a for _, a in last)
            yield Row(channel=key[0], page_at=page["page_at"], window_records=records, window_new=new, duplicate_rate=1 - new / records if records else 0.0,
                      defer=len(last) >= self.window and records >= self.least and new <= self.most)
        self.last.put(last)

    def close(self) -> None:
        pass


def low_yield_stream(pages: DataFrame, window: int = 5, least_records: int = 100, most_new: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """K7 on a stream: the same rows as `low_yield_window` for pages that arrive in order within their channel.

    Ids seen are a map in the state store, so a channel's history is not held in memory and may
    expire after `ttl_ms`; the last pages are a list of at most `window` entries. Pages of one
    batch are put in order. The session needs the RocksDB state store.
    """
    schema = "channel string, page_at long, window_records long, window_new long, duplicate_rate double, defer boolean"
    rows = pages.select("channel", F.col("page_at").cast("long").alias("page_at"), "ids")
    processor = _Yield(window, least_records, most_new, ttl_ms)
    return rows.groupBy("channel").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


def repeated_page(pages: DataFrame) -> DataFrame:
    """K8: page signature; `repeated` if an earlier page of the scan has it, `unchanged` if a first page equals the one of the scan before.

    pages: condition, scan, page, ids array.
    """
    sig = F.sha2(F.array_join(F.array_sort(F.array_distinct("ids")), "|"), 256)
    p = pages.select("condition", "scan", "page", F.size("ids").alias("records"), sig.alias("signature"))
    first = p.filter("records > 0").groupBy("condition", "scan", "signature").agg(F.min("page").alias("_first"))
    heads = p.filter("page = 1")
    before = heads.select("condition", (F.col("scan") + 1).alias("scan"), F.lit(1).alias("page"), F.col("signature").alias("_before"))
    out = p.join(first, ["condition", "scan", "signature"], "left").join(before, ["condition", "scan", "page"], "left")
    return out.withColumns({"repeated": (F.col("records") > 0) & (F.col("_first") < F.col("page")), "unchanged": F.coalesce((F.col("records") > 0) & (F.col("_before") == F.col("signature")), F.lit(False))}).drop("_first", "_before")


def incremental_classify(stream: DataFrame, path: str, classify: Callable[[DataFrame], DataFrame], pipeline: str, checkpoint: str, buckets: int = 32):
    """K9: score only rows whose content hash or pipeline differs from the newest result of their key.

    `classify` keeps job_key and content_hash. Results of every batch are kept with the seq of
    their row; `classified` reads the newest of each key.
    """
    name = stream_name(checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = first_per_key(batch, ["job_key"], [F.col("seq").desc()]).persist()
        try:
            done = read_batches(rows.sparkSession, path, rows, ["job_key"], buckets, but=(name, batch_id))
            todo = rows
            if done is not None:
                known = _newest(done).filter(F.col("pipeline") == pipeline).select("job_key", "content_hash")
                todo = rows.join(known, ["job_key", "content_hash"], "left_anti")
            scored = classify(todo).withColumn("pipeline", F.lit(pipeline)).join(todo.select("job_key", "seq"), "job_key")
            write_batch(scored, path, ["job_key"], name, batch_id, buckets)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(results: DataFrame) -> DataFrame:
    rest = [c for c in results.columns if c not in ("job_key", *PARTS)]
    return results.groupBy("job_key").agg(F.max_by(F.struct(*rest), F.struct("seq", "pipeline", "batch")).alias("_r")).select("job_key", "_r.*")


def classified(spark: SparkSession, path: str) -> DataFrame | None:
    """K9: the newest result of each key."""
    rows = read_batches(spark, path)
    return None if rows is None else _newest(rows)


def admit_owner(df: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows of this task (or none named), and the rows to quarantine."""
    own = (text("task_id") == "") | (text("task_id") == task_id) if "task_id" in df.columns else F.lit(True)
    return df.filter(own), df.filter(~own)
