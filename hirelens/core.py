"""Column helpers and skew-safe relational building blocks shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UNKNOWN = "未明确"
# Java's \s leaves out these two, which the source texts use as spaces.
SPACE = r"[\s　 ]"
_VISIBLE = r"[^\s　 ]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word(pattern: str) -> str:
    """ASCII word boundaries around a pattern (Java's own would not fire next to CJK)."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def text(c: str | Column) -> Column:
    """Trimmed text, never NULL."""
    return F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def filled(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string").rlike(_VISIBLE), F.lit(False))


def value(c: str | Column) -> Column:
    """Trimmed text with blanks as NULL, ready for coalesce."""
    return F.nullif(text(c), F.lit(""))


def halfwidth(c: str | Column) -> Column:
    """Full-width ASCII and the ideographic space to half width (the NFKC part these texts use)."""
    t = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(t.rlike("[！-～　]"), F.translate(t, _WIDE, _ASCII)).otherwise(t)


def rnd(c: str | Column, digits: int) -> Column:
    """Half-up rounding on the decimal image, so sums in another order round alike."""
    return F.round(col(c).try_cast("decimal(28,10)"), digits).cast("double")


def let(bound: Column, use) -> Column:
    """Evaluate `bound` once and hand it to `use`.

    Plain column reuse repeats the whole expression wherever a filter is pushed down;
    binding it as a lambda variable keeps nested steps linear in size.
    """
    return F.transform(F.array(bound), use)[0]


def number_in(c: Column, pattern: str = r"\d+(?:\.\d+)?", group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("double")


def sha(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def compact(c: str | Column) -> Column:
    """Whitespace-free lower-case text."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE, ""))


def values_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter table; its size is the size of the Python list it comes from."""
    return spark.createDataFrame(list(rows), schema)


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter table to broadcast: the row count is known and checked here."""
    if len(rows) > 100_000:
        raise ValueError("parameter table too large to broadcast")
    return F.broadcast(values_table(spark, rows, schema))


def shuffle_width(df: DataFrame) -> int:
    """Partition count for shuffles whose rows grow a lot afterwards.

    Adaptive execution would merge such partitions by their small input size.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1,
                  rank: str | None = None) -> DataFrame:
    """The first n rows of every key.

    The rank filter lets Spark keep n rows per key on each input partition before the
    shuffle, so a key holding a third of the table still sends n rows per task.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def hot_key_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """Join a skewed side to a side holding each key once, both read by column `key`.

    Keys with over 1/share of the big side are at most `share` many: that bound is what
    allows broadcasting them. Their matches, and all other keys, take the join that the
    planner picks by size.
    """
    counts = big.groupBy(key).count()
    total = big.agg(F.count(F.lit(1)).alias("_total"))
    hot = (
        counts.crossJoin(F.broadcast(total)).filter(F.col("count") * share > F.col("_total"))
        .select(key).limit(share)
    )
    hot = F.broadcast(hot)
    lone = small.join(hot, key, "left_semi")
    return big.join(hot, key, "left_semi").join(lone, key, how).unionByName(
        big.join(hot, key, "left_anti").join(small.join(hot, key, "left_anti"), key, how))


def position_within(df: DataFrame, order: Sequence[tuple[str, bool]], group: Sequence[str] = (),
                    name: str = "position", rows_each: int = 250_000, start: int = 1) -> DataFrame:
    """Exact row numbers inside each group without putting a whole group in one task.

    `order` lists (column, ascending) pairs over non-NULL columns forming a total order. The
    rows are dealt into ranges of about `rows_each` rows, as many as the table needs, and
    stored with the number of their range, so every later read agrees on it. A position is
    the rank inside the range plus the group's rows in the ranges before.
    """
    from hirelens.session import cut_lineage

    group = list(group)
    sort = [F.col(g) for g in group] + [F.col(k).asc() if asc else F.col(k).desc() for k, asc in order]
    ranges = -(-df.count() // rows_each) or 1
    tagged = cut_lineage(df.repartitionByRange(ranges, *sort).withColumn("_range", F.spark_partition_id()))
    inner = [F.col(k).asc() if asc else F.col(k).desc() for k, asc in order]
    local = tagged.withColumn("_local", F.row_number().over(W.partitionBy(*group, "_range").orderBy(*inner)))
    counts = tagged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    gone = W.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_range_no"), F.coalesce(F.sum("_n").over(gone), F.lit(0)).alias("_offset"))
    same = F.col("_range") == F.col("_range_no")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        local.join(offsets, same)
        .withColumn(name, F.col("_local") + F.col("_offset") + F.lit(start - 1))
        .drop("_range", "_local", "_offset", "_range_no", *[f"_g_{g}" for g in group])
    )


def top_rows(df: DataFrame, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The k first rows overall; each task keeps k rows, so only k rows per task move."""
    out = df.orderBy(*order).limit(k)
    if rank:
        out = out.withColumn(rank, (F.monotonically_increasing_id() + 1).cast("int"))
    return out
