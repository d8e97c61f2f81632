"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelens.llm.common import stored
from hirelens.llm.crc_sql import CRC_TABLE, crc32_sql

#: Points of the ring. Texts and virtual nodes are hashed to points; the table of points bounds what is broadcast.
POINTS = 1 << 14
#: Rows of a range in which loads are summed one by one.
RANGE_ROWS = 250_000


def point(mark: Column) -> Column:
    """The ring point of an MD5 sum: its first 32 bits, so that any engine finds the same one."""
    return F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % POINTS


def ring(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """(point, walk): the distinct shards in the order in which a walk clockwise from the point meets their virtual nodes."""
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    nodes = nodes.select("shard", point(F.md5(F.concat_ws("-", F.lit("node"), "shard", "copy"))).alias("point")).distinct().withColumn("node", F.col("point"))
    places = spark.range(POINTS).select(F.col("id").alias("point"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    ahead = F.last("node", ignorenulls=True).over(W.partitionBy("shard").orderBy(F.desc("point")).rowsBetween(W.unboundedPreceding, 0))
    around = F.min("node").over(W.partitionBy("shard")) + POINTS
    met = places.join(nodes, ["point", "shard"], "left").select("point", "shard", (F.coalesce(ahead, around) - F.col("point")).alias("way"))
    return met.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("way", "shard"))).alias("met")).select("point", F.col("met.shard").alias("walk"))


def _before(rows: DataFrame, group: str, amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` over the rows of the same group that come earlier in the order of the ranges."""
    here = F.sum(amount).over(W.partitionBy("_range", group).orderBy(*_order()).rowsBetween(W.unboundedPreceding, -1))
    totals = rows.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.sum(amount).alias("_sum"))
    offsets = totals.select("_r", "_g", F.coalesce(F.sum("_sum").over(W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    joined = rows.withColumn("_here", F.coalesce(here, F.lit(0))).join(offsets, (F.col("_range") == F.col("_r")) & (F.col(group) == F.col("_g")))
    return joined.withColumn(name, F.col("_here") + F.col("_offset")).drop("_r", "_g", "_here", "_offset")


def _order() -> list[Column]:
    """Long texts first, so that the rows at the edge of a full shard are short; equal texts stand together."""
    return [F.col("size").desc(), F.col("point"), F.col("mark"), F.col("doc").asc_nulls_first(), F.col("tie")]


def shard_documents(docs: DataFrame, shards: int = 8, virtual: int = 64, slack: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; sizes of shards are near equal.

    A text goes to the shard of the first virtual node clockwise from its point on the ring. A
    shard takes rows until it holds ceil((1 + slack) * bytes / shards) bytes, long texts first;
    what comes after that walks on to the next shard clockwise. A shard exceeds this load by
    less than one row, and as the loads of all shards cannot reach it while a row is left, every
    row finds a place within one walk. Equal texts share a point and stand together in a shard;
    a group of copies is parted only where a shard is full. One more shard moves what lies
    before its virtual nodes and what the lower loads push on, the rest stays.

    Texts are read once. Loads are summed in ranges of rows and over the table of ranges, so no
    shard, point or group of copies is gathered in one task. `slot` numbers the rows of a shard
    from 0 without gaps. Size is the bytes of the text in UTF-8 plus 1; null is a text without
    bytes, at a point of its own. Null ids and repeated rows are placed like others. Other
    columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    if shards < 1 or virtual < 1 or slack < 0:
        raise ValueError("shards and virtual nodes are at least 1, slack at least 0")
    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.md5(F.coalesce(text, F.lit("\u0000null"))).alias("mark"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), F.monotonically_increasing_id().alias("tie"))
    narrow = stored(read.select("doc", (F.col("bytes") + 1).alias("size"), "mark", point(F.col("mark")).alias("point"), "crc", "tie"))
    count, total = narrow.agg(F.count(F.lit(1)), F.sum("size")).first()
    load = math.ceil((total or 0) * (1 + slack) / shards)
    ranged = narrow.repartitionByRange(-(-count // RANGE_ROWS) or 1, *_order()).withColumn("_range", F.spark_partition_id())
    left = stored(ranged.join(F.broadcast(ring(spark, shards, virtual)), "point"))
    held, placed = dict.fromkeys(range(shards), 0), []
    for step in range(shards):
        asked = left.withColumn("shard", F.element_at("walk", step + 1))
        free = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, load - held[s])])[F.col("shard")]
        tried = stored(_before(asked, "shard", F.col("size"), "before").withColumn("fits", F.col("before") < free).drop("before"))
        placed.append(tried.filter("fits").drop("walk", "fits"))
        left = tried.filter("NOT fits").drop("shard", "fits")
        sums = tried.groupBy("shard").agg(F.sum(F.when(F.col("fits"), F.col("size"))).alias("taken"), F.count_if(~F.col("fits")).alias("left")).collect()
        for row in sums:
            held[row["shard"]] += row["taken"] or 0
        if not any(row["left"] for row in sums):
            break
    whole = placed[0]
    for part in placed[1:]:
        whole = whole.unionByName(part)
    slots = _before(whole, "shard", F.lit(1), "slot")
    return slots.select(F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharding_sql(shards: int = 8, virtual: int = 64, slack: float = 0.002) -> str:
    """The same result over `documents` in SQL: the ring as a table, then one pair of tables for each step of the walk."""
    hashed = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT % {POINTS}"
    order = "size DESC, point, mark, doc_id NULLS FIRST, tie"
    parts = [CRC_TABLE, f"""nodes AS (SELECT DISTINCT i % {shards} AS shard, {hashed(f"'node-' || i % {shards} || '-' || i // {shards}")} AS node FROM range({shards * virtual}) r(i)),
ways AS (SELECT p.point, n.shard, min((n.node - p.point + {POINTS}) % {POINTS}) AS way FROM range({POINTS}) p(point), nodes n GROUP BY ALL),
ring AS (SELECT point, list(shard ORDER BY way, shard) AS walk FROM ways GROUP BY point),
sized AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, md5(coalesce(text, chr(0) || 'null')) AS mark, {crc32_sql("coalesce(text, '')")} AS crc,
 row_number() OVER () AS tie FROM documents, crc_table),
narrow AS MATERIALIZED (SELECT *, ('0x' || substr(mark, 1, 8))::BIGINT % {POINTS} AS point FROM sized),
left0 AS (SELECT narrow.*, walk FROM narrow JOIN ring USING (point)),
load AS (SELECT ceil(sum(size) * (1 + {slack}) / {shards})::BIGINT AS most FROM narrow)"""]
    for step in range(shards):
        before = " + ".join(["0"] + [f"coalesce((SELECT sum(size) FROM tried{i} WHERE fits AND shard = x.shard), 0)" for i in range(step)])
        parts.append(f"""asked{step} AS (SELECT *, walk[{step + 1}] AS shard FROM left{step}),
tried{step} AS MATERIALIZED (SELECT *, coalesce(sum(size) OVER (PARTITION BY shard ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {before} < most AS fits FROM asked{step} x, load),
left{step + 1} AS (SELECT * EXCLUDE (shard, most, fits) FROM tried{step} WHERE NOT fits)""")
    union = " UNION ALL ".join(f"SELECT doc_id, size, crc, shard, point, mark, tie FROM tried{i} WHERE fits" for i in range(shards))
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY {order}) - 1 AS slot, NULL::INTEGER AS grown_shard FROM ({union})"""
