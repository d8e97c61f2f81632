"""E: joins, reconciliation and set operations between tables of the knowledge base."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.core import UNKNOWN, filled, first_per_key, text, value


def live_postings(jobs: DataFrame, memberships: DataFrame, tasks: DataFrame) -> DataFrame:
    """Postings of any task that is not archived; membership never multiplies rows."""
    live = memberships.join(tasks.filter(~F.col("archived")).select("task_id"), "task_id", "left_semi")
    return jobs.join(live.select("job_key"), "job_key", "left_semi")


def task_catalog(memberships: DataFrame, tasks: DataFrame) -> DataFrame:
    """Posting count of each live task. Counted per task before the join."""
    counts = memberships.groupBy("task_id").agg(F.count("job_key").alias("n"))
    return tasks.filter(~F.col("archived")).join(counts, "task_id").select("task_id", "label", "n")


def attach_labels(labels: DataFrame, jobs: DataFrame, prefix: int = 6000) -> DataFrame:
    """Label to the one posting that agrees on title and opening text; none or several attach nothing.

    labels: label_id, knowledge_key, knowledge_hash, job_id, job_name, job_description.
    """
    j = jobs.select("job_key", "content_hash", F.col("job_id").alias("_id"), F.col("job_name").alias("_name"), F.sha2(F.substring("job_description", 1, prefix), 256).alias("_open"))
    lab = labels.withColumn("_label_open", F.sha2("job_description", 256))
    agrees = (F.col("_name") == F.col("job_name")) & (F.col("_open") == F.col("_label_open"))
    keyed = lab.filter(filled("knowledge_key")).join(j, (F.col("knowledge_key") == F.col("job_key")) & (F.col("knowledge_hash") == F.col("content_hash")) & agrees)
    loose = lab.filter(~filled("knowledge_key")).join(j, (F.col("job_id") == F.col("_id")) & agrees)
    both = keyed.unionByName(loose)
    one = both.groupBy("label_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("job_key", "content_hash")).alias("_job"))
    return one.filter("_n = 1").select("label_id", "_job.*")


def enrich_by_version(rows: DataFrame, versions: DataFrame, jobs: DataFrame, columns: Sequence[str] = ("company_name", "company_id", "province")) -> DataFrame:
    """Blank company fields filled from the exact content version, else the current row of that version."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("job_key", "content_hash", *[F.col(c).alias(f"{p}{c}") for c in columns if c in df.columns], F.lit(True).alias(f"{p}hit"))

    out = rows.join(side(versions, "v_"), ["job_key", "content_hash"], "left").join(side(jobs, "j_"), ["job_key", "content_hash"], "left")
    blank = ~filled("company_name")
    picked = {}
    for c in columns:
        v = F.col(f"v_{c}") if c in versions.columns else F.lit(None)
        j = F.col(f"j_{c}") if c in jobs.columns else F.lit(None)
        own = F.col(c) if c in rows.columns else F.lit(None).cast("string")
        source = F.when(F.col("v_hit"), v).otherwise(j)
        picked[c] = F.when(blank & (F.col("v_hit") | F.col("j_hit")), F.coalesce(source, own)).otherwise(own)
    return out.withColumns(picked).select(*rows.columns, *[c for c in columns if c not in rows.columns])


def reuse_or_compute(df: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], pipeline: str,
                     keys: Sequence[str] = ("job_key", "content_hash")) -> DataFrame:
    """E5: cached rows of this version and pipeline as they are, the others computed; `reused` tells which."""
    ready = cache.filter(F.col("pipeline") == pipeline).drop("pipeline")
    kept = ready.join(df.select(*keys), list(keys), "left_semi").withColumn("reused", F.lit(True))
    todo = df.join(ready.select(*keys), list(keys), "left_anti")
    return kept.unionByName(compute(todo).select(*[c for c in kept.columns if c != "reused"]).withColumn("reused", F.lit(False)))


def merge_tag_sets(old: DataFrame, new: DataFrame, current: str, key: str = "key") -> DataFrame:
    """The new set replaces the old one unless only the old one follows the current contract."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    keep_old = (F.col("contract") == current).cast("int")
    return first_per_key(both, [key], [keep_old.desc(), F.col("_new").desc()]).drop("_new")


def pending_extraction(df: DataFrame, tags: DataFrame, current: str, key: str = "key") -> DataFrame:
    """One row per accepted content key that has no include tag set of the current contract."""
    done = tags.filter((F.col("fit") == "include") & (F.col("contract") == current))
    return first_per_key(df.filter("matched"), [key], [F.col("seq")]).join(done.select(key), key, "left_anti")


def first_accepted_observation(analyses: DataFrame, newest: int = 20) -> DataFrame:
    """Observations of the newest analyses; the newest one wins per posting version.

    analyses: analysis_id, role, created_at, observations array<struct<job_key, content_hash, ...>>.
    The observation lists are exploded only for the few newest analyses.
    """
    ids = analyses.select("analysis_id", "created_at").orderBy(F.col("created_at").desc(), "analysis_id").limit(newest)
    rows = analyses.join(F.broadcast(ids.select("analysis_id")), "analysis_id", "left_semi")
    flat = rows.select("role", "created_at", "analysis_id", F.posexplode("observations").alias("_at", "o")).select("role", "created_at", "analysis_id", "_at", "o.*")
    return first_per_key(flat, ["job_key", "content_hash"], [F.col("created_at").desc(), F.col("analysis_id"), F.col("_at")]).drop("_at")


def comparable_strata(df: DataFrame, roles: Sequence[str], least: int = 5, strata: Sequence[str] = ("city", "experience", "education", "employment_type"),
                      salary: str = "salary_midpoint_k", role: str = "role") -> DataFrame:
    """Strata with enough salaries in every role compared, with each role's statistics."""
    known = F.lit(True)
    for s in strata:
        known = known & filled(s) & ~F.col(s).contains(UNKNOWN)
    per = df.filter(known & F.col(role).isin(*roles)).groupBy(role, *strata).agg(
        F.count(F.lit(1)).alias("n"), F.count(salary).alias("valid_salary_rows"), F.percentile(salary, 0.5).alias("median_salary_k"))
    enough = per.filter(F.col("valid_salary_rows") >= least)
    everywhere = enough.groupBy(*strata).agg(F.count(F.lit(1)).alias("_roles")).filter(F.col("_roles") == len(roles))
    return enough.join(everywhere.drop("_roles"), list(strata), "left_semi")


def reconcile_counts(sources: Sequence[DataFrame], public: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Per channel the greatest of several counts (channel, rows), with public and overall totals."""
    each = None
    for s in sources:
        one = s.select("channel", F.greatest(F.coalesce(F.col("rows").try_cast("long"), F.lit(0)), F.lit(0)).alias("rows"))
        each = one if each is None else each.unionByName(one)
    best = each.filter(F.col("channel").isin(*public, *extra)).groupBy("channel").agg(F.max("rows").alias("rows"))
    totals = best.agg(F.coalesce(F.sum(F.when(F.col("channel").isin(*public), F.col("rows"))), F.lit(0)).alias("public_rows"), F.coalesce(F.sum("rows"), F.lit(0)).alias("candidates"))
    return best.crossJoin(F.broadcast(totals))


def distinct_ids_across_sources(sources: Sequence[DataFrame], channel: str = "channel", ident: str = "job_id") -> DataFrame:
    """Distinct ids per channel over checkpoints and exports."""
    ids = None
    for s in sources:
        one = s.select(channel, text(ident).alias(ident)).filter(filled(ident))
        ids = one if ids is None else ids.unionByName(one)
    return ids.distinct().groupBy(channel).agg(F.count(F.lit(1)).alias("rows"))


def detail_progress(entries: DataFrame, by: Sequence[str] = ("channel", "keyword")) -> DataFrame:
    """Discovered ids and processed, successful, failed details per crawl."""
    per = entries.groupBy(*by, "job_id").agg(F.count("ok").alias("_seen"), F.count_if(F.col("ok")).alias("_ok"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("discovered"), F.sum("_seen").alias("processed"), F.sum("_ok").alias("successful"), F.sum(F.col("_seen") - F.col("_ok")).alias("failed"))


def salary_gap(benchmarks: DataFrame, base_roles: Sequence[str]) -> DataFrame:
    """Published role medians against base roles of the same city, stage and period.

    One row per published group; pairs arise only between base and other roles of a cell.
    """
    ok = benchmarks.filter(F.col("published") & F.col("median").isNotNull())
    cell = ["city", "stage", "period"]
    base = ok.filter(F.col("role").isin(*base_roles) & (F.col("median") > 0)).select(*cell, F.col("role").alias("base_role"), F.col("median").alias("base_median"), F.col("n").alias("base_n"))
    other = ok.filter(~F.col("role").isin(*base_roles)).select(*cell, "role", "median", "n")
    gap = F.col("median") - F.col("base_median")
    return other.join(base, cell).withColumns({"difference": gap, "percent": gap / F.col("base_median") * 100})


def union_sources(sources: dict[str, DataFrame], task_id: str | None = None) -> DataFrame:
    """Concatenation over all columns seen, with the source name; rows of another task fail the job."""
    out = None
    for name, s in sources.items():
        one = s.withColumn("source_name", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if task_id is not None:
        own = F.coalesce(value("task_id"), F.lit(task_id)) if "task_id" in out.columns else F.lit(task_id)
        out = out.withColumn("task_id", F.when(own == task_id, own).otherwise(F.raise_error(F.lit("row of another task")).cast("string")))
    return out


def source_counts(df: DataFrame) -> DataFrame:
    """Rows per source."""
    return df.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
