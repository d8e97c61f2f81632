"""B: cleaning, identity, deduplication and merging of postings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.core import SPACE, col, compact, filled, first_per_key, halfwidth, hot_key_join, position_within, sha, text, top_rows, value
from hirelens.functions.text import classifier_input, question_key
from hirelens.rules import tables
from hirelens.session import cut_lineage

KEY = ("platform", "job_id")
TIMES = "_times"
# What marks a description as a challenge page.
CHALLENGE = r"(?i)^\s*(?:<!doctype|<html|<textarea)|aliyun_waf|请按住滑块|拖动到最右边|Protected by Tencent Cloud EdgeOne"
REQUIRED = ("platform", "job_id", "job_name", "company_name", "city", "job_url", "job_description")


def dedupe_first(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[Column] = ()) -> DataFrame:
    """B1: first row of each key in source order; rows lacking a key part are left out."""
    order = list(order) or [F.col("seq").asc()]
    whole = None
    for k in keys:
        whole = filled(k) if whole is None else whole & filled(k)
    return first_per_key(df.filter(whole), [text(k) for k in keys], order)


def dedupe_counts(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """B1: input rows, kept rows, duplicates and rows lacking a key part, in one pass over keys."""
    whole = None
    for k in keys:
        whole = filled(k) if whole is None else whole & filled(k)
    per_key = df.select(whole.alias("_whole"), *[text(k).alias(k) for k in keys]).groupBy("_whole", *keys).count()
    return per_key.agg(
        F.sum("count").alias("input_rows"), F.sum(F.when(F.col("_whole"), 1).otherwise(0)).alias("unique_rows"),
        F.sum(F.when(F.col("_whole"), F.col("count") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(F.col("_whole"), 0).otherwise(F.col("count"))).alias("missing_key"))


def dedupe_last(df: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """B2: last row of each key."""
    return first_per_key(df, list(keys), [F.col(seq).desc()])


def merge_postings(current: DataFrame | None, incoming: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq",
                   body: str = "job_description", keyword: str = "query_keyword", times: str | None = None) -> DataFrame:
    """Upsert. The newest non-blank value of each field, the longest description, all keywords.

    Taking one row after the other gives the newest non-blank value of each field, so an
    aggregate over non-blank values ordered by seq needs one shuffle and combines early.
    `times` names a column that keeps the seq of every value taken: merged rows that carry
    it can be merged again with rows that come late and give the same as all rows at once.
    """
    if times and current is not None and times not in current.columns:
        current = current.withColumn(times, F.lit(None).cast(f"map<string,{incoming.schema[seq].dataType.simpleString()}>"))
    rows = incoming if current is None else current.unionByName(incoming, allowMissingColumns=True)
    rows = rows.filter(filled(keys[0]) & filled(keys[1]))
    at = lambda c: F.coalesce(F.try_element_at(times, F.lit(c)), F.col(seq)) if times and times in rows.columns else F.col(seq)
    aggs, taken = [], []

    def newest(c: str, rank: Column, seen: Column) -> None:
        aggs.append(F.max_by(F.col(c), F.when(filled(c), rank)).alias(c))
        if times:
            taken.append((c, F.max_by(seen, F.when(filled(c), rank))))

    for c in rows.columns:
        if c in keys or c in (seq, body, "query_keywords", keyword, times):
            continue
        newest(c, at(c), at(c))
    if body in rows.columns:
        newest(body, F.struct(F.length(body), at(body)), at(body))
    if keyword in rows.columns:
        newest(keyword, at(keyword), at(keyword))
        one = F.array(value(keyword))
        every = F.concat(F.coalesce(F.col("query_keywords"), F.array().cast("array<string>")), one) if "query_keywords" in rows.columns else one
        aggs.append(F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set(F.array_compact(every)))))).alias("query_keywords"))
    aggs.append(F.max(seq).alias(seq))
    if taken:
        aggs.append(F.map_from_arrays(F.array(*[F.lit(c) for c, _ in taken]), F.array(*[t for _, t in taken])).alias(times))
    return rows.groupBy(*keys).agg(*aggs)


def fill_only_merge(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEY, body: str = "job_description") -> DataFrame:
    """The primary row wins, the secondary fills its blanks; a longer secondary description replaces."""
    columns = list(dict.fromkeys(primary.columns + secondary.columns))
    p = primary.select([F.col(c).alias(f"p_{c}") for c in primary.columns])
    s = secondary.select([F.col(c).alias(f"s_{c}") for c in secondary.columns])
    on = [F.col(f"p_{k}") == F.col(f"s_{k}") for k in keys]
    out = []
    for c in columns:
        a = F.col(f"p_{c}") if c in primary.columns else F.lit(None)
        b = F.col(f"s_{c}") if c in secondary.columns else F.lit(None)
        if c == body and c in primary.columns and c in secondary.columns:
            longer = F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit("")))
            out.append(F.when(longer, b).otherwise(a).alias(c))
        elif c in primary.columns and c in secondary.columns:
            empty = a.isNull() | (a.cast("string") == "")
            out.append(F.when(empty, F.coalesce(b, a)).otherwise(a).alias(c))
        else:
            out.append((a if c in primary.columns else b).alias(c))
    return p.join(s, on, "full_outer").select(*out)


def richest_record(df: DataFrame, key: str = "id", content: str = "content", updated: str = "updated_at", query: str = "crawl_query") -> DataFrame:
    """The fullest, then newest row of each key with its hit count and the queries that found it; the last in text order of equals."""
    rest = [c for c in df.columns if c not in (key, query)]
    best = F.max_by(F.struct(*rest), F.struct(F.length(F.coalesce(content, F.lit(""))), F.coalesce(F.col(updated).cast("string"), F.lit("")), F.to_json(F.struct(*rest))))
    out = df.groupBy(key).agg(best.alias("_best"), F.count(F.lit(1)).alias("hit_count"), F.array_sort(F.collect_set(query)).alias("crawl_queries"))
    return out.select(key, "_best.*", "hit_count", "crawl_queries")


def is_valid_posting(required: Sequence[str] = REQUIRED) -> Column:
    """Required fields filled, a real description, a plain http(s) address."""
    ok = None
    for c in required:
        ok = filled(c) if ok is None else ok & filled(c)
    body, url = text("job_description"), F.col("job_url")
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(
        ok & (F.length(body) >= 20) & ~body.rlike(CHALLENGE) & ~url.rlike(SPACE) & F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
        & (F.length(host) > 0) & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False))


def literal_pattern(terms: Sequence[str]) -> str:
    """Pattern matching any of the literal terms, inner spaces optional."""
    cleaned = [t.strip() for t in terms if t and t.strip()]
    return "(?i)" + "|".join(re.escape(t).replace(r"\ ", r"\s*") for t in cleaned) if cleaned else "(?!)"


LOW = "低相关待排除"


def relevance_level(df: DataFrame, profile: dict) -> DataFrame:
    """Ordered cascade over title and text.

    `profile["rules"]` lists (level, evidence, {title|text|not_title: [patterns]}) in
    order; the first rule whose patterns all hold decides. `profile["exclude"]` is a
    title pattern tested first. Rows no rule takes get the low level.
    """
    columns = profile.get("text", ("job_name", "job_description", "skills", "tags"))
    df = df.withColumn("_search", F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns if c in df.columns]))
    title = F.coalesce(F.col("job_name"), F.lit(""))
    level = F.when(title.rlike(profile["exclude"]), LOW) if profile.get("exclude") else F.when(F.lit(False), LOW)
    proof = F.when(title.rlike(profile["exclude"]), "岗位标题属于非工程开发方向") if profile.get("exclude") else F.when(F.lit(False), "")
    for name, why, tests in profile["rules"]:
        hold = F.lit(True)
        for where, patterns in tests.items():
            source = F.col("_search") if where == "text" else title
            for p in patterns:
                hold = hold & (~source.rlike(p) if where == "not_title" else source.rlike(p))
        level, proof = level.when(hold, name), proof.when(hold, why)
    return df.withColumns({"relevance_level": level.otherwise(LOW), "relevance_evidence": proof.otherwise("仅由平台拆词返回，未发现目标岗位或技术证据")}).drop("_search")


def standard_profile(title: str, direct: str, skill: str, role: str, exclude: str, levels: Sequence[str], evidence: Sequence[str]) -> dict:
    """The usual title → text → skill → platform cascade."""
    return {"exclude": exclude, "rules": [
        (levels[0], evidence[0], {"title": [title]}), (levels[1], evidence[1], {"text": [direct], "title": [role]}),
        (levels[2], evidence[2], {"text": [skill], "title": [role]}), (levels[3], evidence[3], {"title": [role]})]}


class TooFewRows(RuntimeError):
    def __init__(self, wanted: int, counts: dict):
        super().__init__(f"{sum(counts.values())} eligible rows, {wanted} wanted: {counts}")
        self.counts = counts


def top_by_level(df: DataFrame, levels: Sequence[str], n: int, seq: str = "seq", strict: bool = False) -> DataFrame:
    """N rows by level rank, then source order, numbered from 1."""
    eligible = df.filter(F.col("relevance_level").isin(*levels))
    if strict:
        counts = {r[0]: r[1] for r in eligible.groupBy("relevance_level").count().collect()}
        if sum(counts.values()) < n:
            raise TooFewRows(n, counts)
    rank = F.lit(len(levels))
    for i, name in reversed(list(enumerate(levels))):
        rank = F.when(F.col("relevance_level") == name, i).otherwise(rank)
    ranked = eligible.withColumn("_level", rank)
    if n <= 100_000:
        return top_rows(ranked, [F.col("_level"), F.col(seq)], n, "record_no").drop("_level")
    return position_within(ranked, [("_level", True), (seq, True)], name="record_no").filter(F.col("record_no") <= n).drop("_level")


def number_rows(df: DataFrame, order: Sequence[tuple[str, bool]], start: int = 1) -> DataFrame:
    """Consecutive record numbers in the given order."""
    return position_within(df, order, name="record_no", start=start)


def canonicalize(df: DataFrame) -> DataFrame:
    """Chinese field names fill blank English ones, platform aliases resolved, transport columns gone."""
    for cn, en in tables.FIELD_ALIASES.items():
        if cn in df.columns:
            df = df.withColumn(en, F.coalesce(value(en), F.col(cn)) if en in df.columns else F.col(cn)).drop(cn)
    platform = text("platform")
    for alias, name in tables.PLATFORM_ALIASES.items():
        platform = F.when(F.col("platform") == alias, name).otherwise(platform)
    df = df.withColumns({"platform": platform, "job_id": text("job_id")})
    return df.filter(filled("platform") & filled("job_id") & filled("job_name")).drop(*tables.TRANSPORT_COLUMNS)


def job_key(platform: str | Column = "platform", job_id: str | Column = "job_id") -> Column:
    """Identity key of a posting."""
    return F.concat(F.lit("K"), F.substring(F.sha2(F.to_json(F.array(col(platform), col(job_id))), 256), 1, 24))


def content_hash(columns: Sequence[str]) -> Column:
    """Hash over the named columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def content_identity(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Add job_key and content_hash; transport columns and `ignore` do not enter the hash."""
    content = [c for c in df.columns if c not in tables.TRANSPORT_COLUMNS and c not in ignore]
    return df.withColumns({"job_key": job_key(), "content_hash": content_hash(content)})


def ingest_versions(jobs: DataFrame | None, versions: DataFrame | None, memberships: DataFrame | None, incoming: DataFrame, task_id: str,
                    seq: str = "seq") -> dict[str, DataFrame]:
    """New state of jobs, versions and memberships after one batch.

    Returns DataFrames: jobs, new_versions, new_memberships and change (one row:
    inserted, updated, unchanged, joined). Rows of another task make the batch fail.
    Several rows of one posting inside a batch give one version, their merged state; the
    seq of its values stays in column `_times`, so rows that come late are placed by their own.
    """
    if "task_id" in incoming.columns:
        wrong = F.when(filled("task_id") & (text("task_id") != task_id), F.raise_error(F.lit("row of another task"))).otherwise(F.lit(True))
        incoming = incoming.filter(wrong.cast("boolean"))
    rows = canonicalize(incoming)
    old = None
    if jobs is not None:
        old = jobs.drop("job_key", "content_hash")
        touched = old.join(rows.select(*KEY).distinct(), list(KEY), "left_semi")
        merged = merge_postings(touched, rows, seq=seq, times=TIMES)
    else:
        merged = merge_postings(None, rows, seq=seq, times=TIMES)
    merged = content_identity(merged, ignore=[seq, TIMES])
    keys = merged.select("job_key", "content_hash")
    before = jobs.select("job_key", F.col("content_hash").alias("old_hash")) if jobs is not None else keys.select("job_key", F.lit("").alias("old_hash")).limit(0)
    state = keys.join(before, "job_key", "left")
    member = merged.select("job_key").withColumn("task_id", F.lit(task_id))
    new_members = member if memberships is None else member.join(memberships, ["job_key", "task_id"], "left_anti")
    new_versions = merged if versions is None else merged.join(versions.select("job_key", "content_hash"), ["job_key", "content_hash"], "left_anti")
    kept = merged if jobs is None else jobs.join(keys.select("job_key"), "job_key", "left_anti").unionByName(merged, allowMissingColumns=True)
    change = state.agg(
        F.sum(F.when(F.col("old_hash").isNull(), 1).otherwise(0)).alias("inserted"),
        F.sum(F.when(F.col("old_hash") != F.col("content_hash"), 1).otherwise(0)).alias("updated"),
        F.sum(F.when(F.col("old_hash") == F.col("content_hash"), 1).otherwise(0)).alias("unchanged")
    ).crossJoin(F.broadcast(new_members.agg(F.count(F.lit(1)).alias("joined"))))
    return {"jobs": kept, "new_versions": new_versions, "new_memberships": new_members, "change": change}


def source_listing(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files with size and time signature; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", F.concat_ws(":", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string")).alias("signature"))


def changed_sources(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new or whose signature differs."""
    return listing.join(seen.select("path", "signature"), ["path", "signature"], "left_anti")


def meaningful_change(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEY, ignore: Sequence[str] = ()) -> DataFrame:
    """Inserted, updated, unchanged per platform; volatile and query columns do not count."""
    def content(df: DataFrame) -> list[str]:
        return sorted(c for c in df.columns if c not in tables.VOLATILE_COLUMNS and c not in ignore and not c.startswith("query_"))

    names = sorted(set(content(old)) | set(content(new)))
    digest = lambda df: F.sha2(F.to_json(F.struct(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names])), 256)
    a = old.select(*keys, digest(old).alias("_old"))
    b = new.select(*keys, digest(new).alias("_new"))
    return b.join(a, list(keys), "left").groupBy("platform").agg(
        F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old") != F.col("_new")).alias("updated"),
        F.count_if(F.col("_old") == F.col("_new")).alias("unchanged"))


# Patterns and marks of personal data, in the order they are replaced.
URL = (r"(?i)https?://\S+", "[链接已移除]")
EMAIL = (r"(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}", "[邮箱已移除]")
MOBILE = (r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", "[电话已移除]")
LANDLINE = (r"(?<!\d)0\d{2,3}[-－]\d{7,8}(?!\d)", "[电话已移除]")
IDENTITY = (r"(?<!\d)\d{17}[\dXx](?!\d)", "[证件号已移除]")
PERSONAL_LINE = r"(?:性别|婚育|民族|宗教|身份证|出生日期|政治面貌)\s*[:：]"


def redact(c: str | Column, resume: bool = False) -> Column:
    """Addresses, mail and phone numbers replaced; a résumé also loses names, identity numbers, personal lines."""
    t = F.coalesce(col(c), F.lit(""))
    steps = [URL, EMAIL, MOBILE]
    if resume:
        t = F.trim(F.regexp_replace(t, "\r\n?", "\n"))
        for pattern in (r"(?:^|\n)姓名\s*[:：]\s*([一-鿿]{2,4})(?=\s|$)", r"^([一-鿿]{2,4})\s+(?=[A-Za-z])"):
            name = F.regexp_extract(t, pattern, 1)
            t = F.when(name != "", F.replace(t, name, F.lit("[候选人]"))).otherwise(t)
        steps = [URL, EMAIL, MOBILE, LANDLINE, IDENTITY]
    for pattern, mark in steps:
        t = F.regexp_replace(t, pattern, mark)
    if resume:
        t = F.array_join(F.filter(F.split(t, "\n"), lambda line: ~line.rlike(PERSONAL_LINE)), "\n")
    return t


def match_key(c: str | Column, punctuation: bool = False) -> Column:
    """Half-width lower-case text without whitespace, on demand without punctuation too."""
    drop = rf"{SPACE}|\p{{P}}|\p{{S}}" if punctuation else SPACE
    return F.regexp_replace(F.lower(halfwidth(c)), drop, "")


def modelling_candidates(df: DataFrame, title: str = "job_name", body: str = "job_description") -> DataFrame:
    """Redacted title and body fit for training, one row per normalised body."""
    out = df.withColumns({"title": redact(title), "body": redact(body)})
    out = classifier_input(out, "title", "body").filter((F.length("title") > 0) & F.col("body_chars").between(80, 9000))
    out = out.withColumns({"id": F.sha2(F.to_json(F.array("title", "body")), 256), "_body": F.sha2(compact("body"), 256)})
    order = [F.col("seq")] if "seq" in df.columns else []
    return first_per_key(out, ["_body"], order + [F.col("id")]).drop("_body")


def identity_dedupe(df: DataFrame, order: Sequence[Column] = (), key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """One row per (company, title, city, whitespace-free body) and a table alias → kept key.

    Aliases are rows, not lists, because one identity may cover a large share of postings.
    """
    identity = F.sha2(F.to_json(F.array(
        text("company_name"), text("job_name"), text("city"), F.regexp_replace(F.coalesce("job_description", F.lit("")), SPACE, ""))), 256)
    order = list(order) or [F.col("seq")]
    kept = first_per_key(df.withColumn("_identity", identity), ["_identity"], order)
    # The texts are read once for the aliases: what is kept of them are the 32 bytes of the identity.
    pairs = cut_lineage(df.select(F.unhex(identity).alias("_identity"), F.col(key).alias("alias_key"), F.struct(*order).alias("_at")))
    owner = pairs.groupBy("_identity").agg(F.min(F.struct("_at", "alias_key")).alias("_kept"), F.count(F.lit(1)).alias("_copies"))
    # An identity of one row has no alias and need not be joined.
    owner = owner.filter("_copies > 1").select("_identity", F.col("_kept.alias_key").alias("kept_key"), F.col("_kept._at").alias("_kept_at"))
    aliases = hot_key_join(pairs, owner, "_identity").filter(F.col("_at") != F.col("_kept_at")).select("kept_key", "alias_key")
    return kept.drop("_identity"), aliases


def posting_fallback_key(row_no: str = "row_no") -> Column:
    """Id key, else content key, else the row itself."""
    body = F.substring(F.regexp_replace(text("job_description"), SPACE, ""), 1, 160)
    company = value("company_name")
    return F.coalesce(
        F.when(filled("platform") & filled("job_id"), F.concat_ws(":", F.lit("id"), text("platform"), text("job_id"))),
        F.when(company.isNotNull() & filled("job_name") & (F.length(body) >= 30), F.concat_ws(":", F.lit("content"), company, text("job_name"), text("city"), body)),
        F.concat(F.lit("row:"), F.col(row_no).cast("string")))


def dedupe_postings(df: DataFrame, order: str = "row_no") -> DataFrame:
    """First row per fallback key."""
    return first_per_key(df.withColumn("posting_key", posting_fallback_key(order)), ["posting_key"], [F.col(order)])


def interview_key() -> Column:
    """Posts with a full text share a key when role, title and text agree."""
    full = (F.col("content_status") == "detail") & (F.length("content") >= 80)
    return F.when(full, sha("role_key", "title", "content_hash")).otherwise(F.concat(F.lit("id:"), F.col("id")))


def dedupe_interviews(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earliest post per interview key with its duplicate count, and a table duplicate → kept id."""
    tagged = df.withColumns({"_key": interview_key(), "_when": F.coalesce(F.col("created_at").cast("long"), F.lit(2**62))})
    kept = first_per_key(tagged, ["_key"], [F.col("_when"), F.col("id")])
    counts = tagged.groupBy("_key").agg((F.count(F.lit(1)) - 1).alias("duplicate_count"))
    pairs = hot_key_join(tagged.select("_key", F.col("id").alias("duplicate_id")), kept.select("_key", F.col("id").alias("kept_id")), "_key")
    return (kept.join(counts, "_key").drop("_key", "_when"), pairs.filter("duplicate_id <> kept_id").select("kept_id", "duplicate_id"))


def dedupe_interview_sources(df: DataFrame) -> DataFrame:
    """Newest post per address, then earliest per normalised text of 120 characters and more."""
    newest = first_per_key(df, ["url"], [F.coalesce(F.col("collected_at").cast("string"), F.lit("")).desc(), F.col("id")])
    norm = compact(halfwidth("content"))
    key = F.when((F.col("content_status") == "detail") & (F.length(norm) >= 120), F.sha2(norm, 256)).otherwise(F.concat(F.lit("url:"), F.col("url")))
    tagged = newest.withColumns({"_key": key, "_when": F.coalesce(F.col("created_at").cast("long"), F.lit(2**62))})
    counts = tagged.groupBy("_key").agg((F.count(F.lit(1)) - 1).alias("duplicate_count"))
    return first_per_key(tagged, ["_key"], [F.col("_when"), F.col("url")]).join(counts, "_key").drop("_key", "_when")


def question_set_dedupe(df: DataFrame, questions: str = "questions", key: str = "id", created: str = "created_at") -> DataFrame:
    """Posts with the same set of five or more question keys collapse to the earliest."""
    keys = F.array_sort(F.array_distinct(F.transform(questions, question_key)))
    group = F.when(F.size(keys) >= 5, F.sha2(F.array_join(keys, "\n"), 256)).otherwise(F.concat(F.lit("post:"), F.col(key)))
    return first_per_key(df.withColumn("_set", group), ["_set"], [F.coalesce(F.col(created).cast("long"), F.lit(2**62)), F.col(key)]).drop("_set")


def remove_conflicting_labels(df: DataFrame, body: str = "body", label: str = "label", group: Sequence[str] = ("family",), order: str = "seq") -> DataFrame:
    """Per group, drop bodies carrying both labels and keep one row of each other body."""
    tagged = df.filter(F.col(label).isin("include", "exclude")).withColumn("_body", F.sha2(compact(body), 256))
    spread = tagged.groupBy(*group, "_body").agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).filter("_lo = _hi").select(*group, "_body")
    return first_per_key(tagged, [*group, "_body"], [F.col(order)]).join(spread, [*group, "_body"], "left_semi").drop("_body")
