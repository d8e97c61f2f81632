"""Reading exports, payloads and scopes, and writing datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.core import SPACE, filled, first_per_key, let, lookup, position_within, text, value
from hirelens.rules import tables


def read_channel_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A1: quoted CSV with a header; every column a string, absent values blank, source file kept.

    Multi-line quoting means one file is one task, so exports should be many files.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\u0000")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("enforceSchema", False)
    raw = reader.csv(paths)
    named = raw.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in raw.columns]
                       + [F.col("_metadata.file_path").alias("source_file")])
    return named


def read_job_dataset(df: DataFrame, aliases: dict[str, str] | None = None, required: Sequence[str] = ("job_name", "job_description"),
                     order: Sequence[tuple[str, bool]] | None = None) -> DataFrame:
    """A2: canonical column names, required columns, blank rows dropped, rows numbered from 2."""
    aliases = tables.FIELD_ALIASES if aliases is None else aliases
    names = [aliases.get(c.strip(), c.strip()) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("two columns map to one name")
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    df = df.toDF(*names)
    numbering = [c for c, _ in order] if order else []
    some = None
    for c in names:
        if c not in numbering:
            some = filled(c) if some is None else some | filled(c)
    df = df.filter(some)
    return position_within(df, order, name="row_no", start=2) if order else df


def flatten_checkpoints(df: DataFrame, doc: str = "document") -> DataFrame:
    """A3: list × details of a crawl checkpoint to postings; only entries whose detail is ok."""
    entry = ("uuid string, name string, cname string, c_uuid string, city string, degree string, ftype string, scale string, industry string, "
             "minsalary string, maxsalary string, refresh string")
    detail = ("iname string, cuuid string, cname string, salary_desc string, city string, degree string, ftype string, scale string, "
              "industry string, skills array<string>, attraction array<string>, info string, address string, endtime string, url string, refresh string")
    schema = (f"task_id string, keyword string, city struct<name:string>, list array<struct<{_fields(entry)}>>, "
              f"details map<string, struct<ok:boolean, data:struct<{_fields(detail)}>>>")
    rows = (df.select(F.from_json(doc, schema).alias("d"))
            .select("d.task_id", "d.keyword", F.col("d.city.name").alias("query_city"), "d.details", F.explode("d.list").alias("e"))
            .withColumn("t", F.col("details")[F.col("e.uuid")]).filter("t.ok"))
    either = lambda a, b: F.coalesce(value(f"t.data.{a}"), value(f"e.{b}"), F.lit(""))
    return rows.select(
        "task_id", F.lit("实习僧").alias("platform"), F.col("e.uuid").alias("job_id"), F.col("keyword").alias("query_keyword"), "query_city",
        either("iname", "name").alias("job_name"), either("cuuid", "c_uuid").alias("company_id"), either("cname", "cname").alias("company_name"),
        F.coalesce(value("t.data.salary_desc"), F.concat(text("e.minsalary"), F.lit("-"), text("e.maxsalary"))).alias("salary"),
        either("city", "city").alias("city"), either("degree", "degree").alias("education"), either("ftype", "ftype").alias("employment_type"),
        either("scale", "scale").alias("company_size"), either("industry", "industry").alias("industry"),
        F.array_join(F.coalesce("t.data.attraction", F.array().cast("array<string>")), " | ").alias("tags"),
        F.array_join(F.coalesce("t.data.skills", F.array().cast("array<string>")), " | ").alias("skills"),
        html_to_text("t.data.info").alias("job_description"), either("url", "uuid").alias("job_url"))


def _fields(ddl: str) -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in ddl.split(", "))


def salary_text(low: Column, high: Column, months: Column, negotiable: Column, sentinel: int = 9_999_999) -> Column:
    """A4: quote text from numeric fields in thousands a month."""
    span = F.when(low == high, F.concat(low.cast("string"), F.lit("K"))).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit("K")))
    return (F.when(negotiable, "面议").when(low.isNull() | high.isNull(), "")
            .when((low >= sentinel) | (high >= sentinel) | ((low <= 0) & (high <= 0)), "面议")
            .when(months > 0, F.concat(span, F.lit("·"), months.cast("string"), F.lit("薪"))).otherwise(span))


def epoch_iso(c: str | Column) -> Column:
    """A4: epoch milliseconds to ISO text, blank unless positive."""
    ms = F.col(c) if isinstance(c, str) else c
    stamp = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(ms > 0, stamp).otherwise("")


def normalize_source(df: DataFrame, mapping: dict[str, object], keep: Column | None = None, unique: str | None = None,
                     order: Sequence[Column] = ()) -> DataFrame:
    """A4: one projection from a source payload to canonical columns.

    A mapping value is a list of paths (first non-blank wins), ("join", path) for an
    array, ("code", path, table) for a code table, or a Column.
    """
    if keep is not None:
        df = df.filter(keep)
    out = []
    for name, spec in mapping.items():
        if isinstance(spec, Column):
            c = spec
        elif isinstance(spec, tuple) and spec[0] == "join":
            c = F.array_join(F.filter(spec[1], lambda x: x != ""), " | ")
        elif isinstance(spec, tuple) and spec[0] == "code":
            c = F.lit("")
            for code, label in reversed(spec[2]):
                c = F.when(F.col(spec[1]) == code, label).otherwise(c)
        else:
            paths = [spec] if isinstance(spec, str) else list(spec)
            c = F.coalesce(*[value(p) for p in paths], F.lit(""))
        out.append(c.alias(name))
    df = df.select(*out, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    if unique:
        df = first_per_key(df.filter(filled(unique)), [unique], [F.col(f"_o{i}") for i in range(len(order))] or [F.col(unique)])
    return df.drop(*[f"_o{i}" for i in range(len(order))])


def split_area(c: str | Column) -> tuple[Column, Column]:
    """A4: 'city-district' text to its two parts."""
    flat = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("—"), F.lit("-"))
    return F.trim(F.regexp_extract(flat, "^([^-]*)", 1)), F.trim(F.regexp_extract(flat, "^[^-]*-(.*)$", 1))


# Named entities that are decoded, longest effect last so that &amp; cannot create new ones.
ENTITIES = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")]


def decode_entities(c: Column) -> Column:
    """Numeric and named entities to characters, each entity decoded once."""
    # The name is cut out once for each piece; patterns are tried on numeric entities only.
    name = lambda p: F.when(F.instr(F.substring(p, 1, 10), ";") > 0, F.lower(F.substring_index(p, ";", 1)))

    def point(x: Column) -> Column:
        piece, head = x["piece"], x["head"]
        dec = F.regexp_extract(piece, r"^#(\d{1,7});", 1)
        hexa = F.regexp_extract(piece, r"(?i)^#x([0-9a-f]{1,6});", 1)
        code = F.coalesce(dec.try_cast("long"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("long"))
        rest = F.substring(piece, F.length(head) + 2, F.length(piece))
        char = let(code, lambda n: F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        asis = F.concat(F.lit("&"), piece)
        out = F.when(head.isNull(), asis)
        for known, sign in reversed(ENTITIES):
            out = out.when(head == known, F.concat(F.lit(sign), rest))
        return out.when(head.startswith("#"), F.coalesce(F.concat(char, rest), asis)).otherwise(asis)

    def decoded(t: Column) -> Column:
        pieces = F.transform(F.split(t, "&"), lambda p: F.struct(p.alias("piece"), name(p).alias("head")))
        return F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x["piece"]).otherwise(point(x))), "")

    return let(c, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def html_to_text(c: str | Column) -> Column:
    """A5: markup to text: scripts and styles gone, block ends as line breaks, tags gone, entities decoded."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for pattern, sign in [(r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?i)<br\s*/?\s*>", "\n"),
                          (r"(?i)</(p|li|tr|div|h\d)>", "\n"), (r"<[^>]+>", " ")]:
        t = F.regexp_replace(t, pattern, sign)
    t = decode_entities(t)
    for pattern, sign in [(" ", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (rf"^{SPACE}+|{SPACE}+$", "")]:
        t = F.regexp_replace(t, pattern, sign)
    return t


def input_value(html: str | Column, field: str) -> Column:
    """Decoded value of the <input> with the given id, NULL if absent."""
    t = F.col(html) if isinstance(html, str) else html
    tag = F.regexp_extract(t, rf"""(?i)(<input\b[^>]*\bid\s*=\s*["']{field}["'][^>]*>)""", 1)
    raw = lambda x: F.regexp_extract(x, r"""(?i)\bvalue\s*=\s*"([^"]*)\"""", 1)
    return let(tag, lambda x: F.when(x != "", decode_entities(raw(x))))


def extract_embedded_json(df: DataFrame, col: str, field: str, schema: str, counters: Sequence[str] = ()) -> DataFrame:
    """JSON array held in an input field, one row per element, with numeric page fields.

    A page lacking the field or holding invalid JSON gives one row with element_ok false.
    """
    element = f"array<struct<{schema}>>"
    df = df.withColumn("_json", input_value(col, field)).withColumn("_list", F.from_json("_json", element))
    for name in counters:
        df = df.withColumn(name, input_value(col, name).try_cast("long"))
    df = df.withColumn("element_ok", F.col("_list").isNotNull())
    return df.select("*", F.explode_outer("_list").alias("element")).drop("_json", "_list")


def order_columns(df: DataFrame, preferred: Sequence[str] = tuple(tables.PREFERRED_COLUMNS)) -> DataFrame:
    """Preferred columns first, the others by name."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *sorted(set(df.columns) - set(first)))


def sheet_safe(c: str | Column) -> Column:
    """Control characters out, cell length limit, no leading formula sign."""
    t = F.regexp_replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")),
                         "[\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f\\ufffe\\uffff]", "")
    t = F.substring(t, 1, 32766)
    return F.when(t.rlike("^[=+@-]"), F.concat(F.lit("'"), t)).otherwise(t)


def flat_text(df: DataFrame) -> DataFrame:
    """Every column as text; arrays joined."""
    out = []
    for f in df.schema.fields:
        c = F.array_join(F.col(f.name).cast("array<string>"), " | ") if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*out)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", spreadsheet: bool = False) -> None:
    """Write in stable column order, one file per partition."""
    df = order_columns(df)
    if fmt == "csv":
        df = flat_text(df)
        if spreadsheet:
            df = df.select([sheet_safe(c).alias(c) for c in df.columns])
        # Spark's CSV writer trims every value unless it is told not to.
        whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="", **whole).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_jsonl_latest(spark: SparkSession, path: str, schema: str, key: Sequence[str], seq: str) -> DataFrame:
    """JSON lines; the last record of a key wins, malformed lines fail the read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return first_per_key(df, key, [F.col(seq).desc()])


def read_scope(scope: str, jobs: DataFrame, memberships: DataFrame | None = None, tasks: DataFrame | None = None,
               snapshots: DataFrame | None = None, ident: str = "") -> DataFrame:
    """Postings of any live task, of one task, or of a pinned snapshot."""
    if scope == "snapshot":
        if not ident:
            raise ValueError("a snapshot scope names its snapshot")
        return snapshots.filter(F.col("snapshot_id") == ident)
    live = tasks.filter(~F.col("archived")).select("task_id")
    if scope == "task":
        if not ident:
            raise ValueError("a task scope names its task")
        live = live.filter(F.col("task_id") == ident)
    elif scope != "all":
        raise ValueError(f"unknown scope {scope}")
    return jobs.join(memberships.join(live, "task_id").select("job_key"), "job_key", "left_semi")
