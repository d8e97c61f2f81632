"""F: counts, quantiles, cohort and label statistics, metrics and reports.

Quantiles use `percentile`, exact and linearly interpolated. Its state is one counter
per distinct value and combines before the shuffle; salary midpoints are a bounded set
of quotes, so a hot group stays small. `quantiles_by_position` serves columns whose
distinct values are unbounded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelens.core import SPACE, UNKNOWN, filled, first_per_key, halfwidth, lookup, position_within, rnd, text, top_rows, value
from hirelens.functions import groups
from hirelens.session import cut_lineage

K = "salary_midpoint_k"


def count_by(df: DataFrame, c: str | Column, k: int | None = None, other: str | None = None) -> DataFrame:
    """(name, n) by count then name; with k and `other` the tail is folded into one row."""
    name = F.col(c) if isinstance(c, str) else c
    counts = df.select(text(name).alias("name")).filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return counts
    top = top_rows(counts, [F.col("n").desc(), F.col("name")], k, "rank")
    if other is None:
        return top
    rest = counts.join(F.broadcast(top.select("name")), "name", "left_anti").agg(F.sum("n").alias("n")).filter("n > 0")
    return top.unionByName(rest.select(F.lit(other).alias("name"), "n", F.lit(k + 1).alias("rank")))


def quartile(c: str | Column, p: float) -> Column:
    """One of the three quartiles; all that ask for one of a column share a single buffer of its values."""
    points = (0.25, 0.5, 0.75)
    return F.get(F.percentile(c, F.array(*map(F.lit, points))), F.lit(points.index(p)))


def quantiles(df: DataFrame, c: str, ps: Sequence[float], by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """exact interpolated quantiles of the finite values per group."""
    # Finite values are picked inside the aggregate: a filter would be pushed down to the scan and compute the value again for every row there.
    v = F.col(c).cast("double")
    fine = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    out = df.groupBy(*by).agg(F.count(fine).alias("n"), F.percentile(fine, F.array(*[F.lit(float(p)) for p in ps])).alias("_ps")).filter("n > 0")
    return out.select(*by, "n", *[rnd(F.get("_ps", F.lit(i)), digits).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)])


def quantiles_by_position(df: DataFrame, c: str, ps: Sequence[float], by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """F2 for any column: the same values read off exact positions, no group in one task."""
    fine = df.select(*by, F.col(c).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    runs = fine.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = position_within(runs, [("_v", True)], by, "_run")
    return _quantiles_of_runs(placed, ps, by, digits)


def order_statistics(df: DataFrame, c: str, ranks: DataFrame, by: Sequence[str] = (), copies: str | None = None, buckets: int = 1024) -> DataFrame:
    """(by, rank, value): the values at the given ranks from 0 of each group, exactly, for values that hardly repeat.

    Each pass counts a group's values in equal buckets between the two bounds of every rank
    and narrows them to the least and the largest value of the bucket that holds the rank, until both
    are one. Only counts are shuffled, no group of values is gathered, and a few passes do for any
    number of rows. `copies` names a column with the number of times that a row counts. Null and NaN
    are left out; a rank beyond a group gives no row.
    """
    by = list(by)
    v = F.col(c).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("_n"))
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    targets = ranks.select(*by, F.col("rank").cast("long").alias("rank"))
    targets = targets.join(ends, by) if by else targets.crossJoin(F.broadcast(ends))
    targets = cut_lineage(targets.filter((F.col("rank") >= 0) & (F.col("rank") < F.col("_all"))).distinct().select(*by, "rank", "_lo", "_hi", F.lit(0).cast("long").alias("_before")))
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * buckets))
    while not (live := targets.filter("_lo < _hi")).isEmpty():
        held = rows.join(live, by) if by else rows.crossJoin(F.broadcast(live))
        counts = held.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*by, "rank", "_before", bucket.alias("_b")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        until = F.sum("_n").over(W.partitionBy(*by, "rank").orderBy("_b")) + F.col("_before")
        found = counts.withColumn("_until", until).filter((F.col("_until") > F.col("rank")) & (F.col("_until") - F.col("_n") <= F.col("rank")))
        targets = cut_lineage(targets.filter("_lo = _hi").unionByName(found.select(*by, "rank", "_lo", "_hi", (F.col("_until") - F.col("_n")).alias("_before"))))
    return targets.select(*by, "rank", F.col("_lo").alias("value"))


def narrowed_quantile(df: DataFrame, c: str, p: float, by: Sequence[str] = (), copies: str | None = None) -> DataFrame:
    """(by, n, value): the interpolated quantile of each group by `order_statistics`."""
    by = list(by)
    v = F.col(c).cast("double")
    n = F.sum(F.when(v.isNotNull() & ~F.isnan(v), F.col(copies) if copies else F.lit(1)))
    sizes = cut_lineage(df.groupBy(*by).agg(n.alias("n")).filter("n > 0").withColumn("_at", (F.col("n") - 1) * F.lit(float(p))))
    ranks = sizes.select(*by, F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("rank"))
    found = order_statistics(df, c, ranks, by, copies)
    both = found.join(sizes, by) if by else found.crossJoin(F.broadcast(sizes))
    low, high = F.min("value"), F.max("value")
    return both.groupBy(*by).agg(F.max("n").alias("n"), (low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias("value")).filter("n > 0")


def _quantiles_of_runs(runs: DataFrame, ps: Sequence[float], by: Sequence[str], digits: int) -> DataFrame:
    """Weighted positions: run r of value v covers positions (before, before + n]."""
    buckets = runs.withColumn("_b", F.floor((F.col("_run") - 1) / 4096))
    part = buckets.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"))
    gone = W.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = part.select(*by, "_b", F.coalesce(F.sum("_bn").over(gone), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*by, "_b").orderBy("_run").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = buckets.withColumn("_in", F.sum("_n").over(inside)).join(offsets, [*by, "_b"]).withColumn("_end", F.col("_off") + F.col("_in"))
    totals = part.groupBy(*by).agg(F.sum("_bn").alias("n"))
    rows = ends.join(totals, list(by)) if by else ends.crossJoin(F.broadcast(totals))
    out = []
    for p in ps:
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, frac = F.floor(at), at - F.floor(at)
        start = F.col("_end") - F.col("_n")
        low = F.max(F.when((lo >= start) & (lo < F.col("_end")), F.col("_v")))
        nxt = F.least(lo + 1, F.col("n") - 1)
        high = F.max(F.when((nxt >= start) & (nxt < F.col("_end")), F.col("_v")))
        out.append(rnd(low + (high - low) * F.max(frac), digits).alias(f"p{round(p * 100)}"))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *out)


def salary_group_stats(df: DataFrame, by: Sequence[str], small: int = 5) -> DataFrame:
    """statistics of original quotes per group; quartiles only from `small` quotes on, raw quotes only below.

    Needs the parsed `pay` column. Raw quotes are collected only for groups whose count
    is known to be small.
    """
    p = lambda q: quartile("pay.midpoint", q)
    pay = ("midpoint", "min", "max", "period_inferred", "raw")
    # Written once for both passes, with what they read only.
    rows = cut_lineage(df.filter("pay is not null").select(*by, F.struct(*[F.col("pay")[c].alias(c) for c in pay]).alias("pay")))
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), p(0.5).alias("median"), F.min("pay.min").alias("quote_min"), F.max("pay.max").alias("quote_max"),
        p(0.25).alias("p25"), p(0.75).alias("p75"), F.count_if("pay.period_inferred").alias("period_inferred_rows"))
    agg = agg.withColumns({"published": F.col("n") >= small, "p25": F.when(F.col("n") >= small, F.col("p25")), "p75": F.when(F.col("n") >= small, F.col("p75"))})
    few = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < small).select(*by)
    raw = rows.join(few, list(by), "left_semi").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("pay.raw")), "、").alias("raw_quotes"))
    return agg.join(raw, list(by), "left")


def pay_month_distribution(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows per pay-month label."""
    a, b = F.col("pay.pay_min"), F.col("pay.pay_max")
    label = F.when(a.isNull(), "未公开").otherwise(F.concat(a.cast("string"), F.when(a != b, F.concat(F.lit("-"), b.cast("string"))).otherwise(""), F.lit("薪")))
    return df.filter("pay is not null").groupBy(*by, label.alias("pay_months")).agg(F.count(F.lit(1)).alias("n"))


def salary_benchmark(df: DataFrame, goal: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """quote statistics by period, by city and period, and by city, role and period, and exclusion counts.

    Reads the admitted postings (D1) with city and role_families. A posting counts in
    each of its roles. Levels are separate groupings of one aggregate.
    """
    from hirelens.functions.labels import hiring_cohorts
    from hirelens.operators.admit import education_admits
    goal = goal or {}
    years = hiring_cohorts()
    asked = goal.get("stage") == "campus" and goal.get("graduation_year")
    in_year = F.array_contains(years, int(goal["graduation_year"])) if asked else F.lit(True)
    df = df.withColumns({"_year": in_year, "_none": (F.size(years) == 0) if asked else F.lit(False), "_edu": education_admits(goal.get("education"), strict=True)})
    counts = df.agg(
        F.count(F.lit(1)).alias("matched_jobs"), F.count_if(F.col("_year") & F.col("_edu") & F.col("admit_salary")).alias("benchmark_jobs"),
        F.count_if("_none").alias("unknown_cohort_rows"), F.count_if(F.col("_year") & ~F.col("_edu")).alias("education_excluded"),
        F.count_if(F.col("_year") & ~F.col("admit_salary")).alias("salary_quality_excluded"))
    rows = df.filter(F.col("_year") & F.col("_edu") & F.col("admit_salary") & F.col("pay").isNotNull())
    rows = rows.select(F.coalesce(value("city"), F.lit(UNKNOWN)).alias("city"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "role_families")).alias("role"), F.col("pay.period").alias("period"),
                       F.col("pay.midpoint").alias("mid"), F.col("pay.min").alias("lo"), F.col("pay.max").alias("hi"))
    # The NULL role row carries the posting once for the levels above role.
    def level(x: DataFrame, name: str, keys: list[str]) -> DataFrame:
        g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), quartile("mid", 0.5).alias("median"), quartile("mid", 0.25).alias("p25"),
                                 quartile("mid", 0.75).alias("p75"), F.min("lo").alias("quote_min"), F.max("hi").alias("quote_max"))
        extra = [F.lit(None).cast("string").alias(c) for c in ("city", "role") if c not in keys]
        return g.select(F.lit(name).alias("level"), "period", *[c for c in keys if c != "period"], *extra, "n", "median", "p25", "p75", "quote_min", "quote_max")

    once, roles = rows.filter("role is null").drop("role"), rows.filter("role is not null")
    out = level(once, "period", ["period"]).unionByName(level(once, "city", ["city", "period"])).unionByName(level(roles, "role", ["city", "role", "period"]))
    show = F.col("n") >= 5
    return out.withColumns({"published": show, "p25": F.when(show, F.col("p25")), "p75": F.when(show, F.col("p75"))}), counts


def benchmark_by_field(df: DataFrame, field: str, least: int = 5, k: int = 12) -> DataFrame:
    """quartiles per category with enough salaries, the k largest."""
    g = df.groupBy(F.coalesce(value(field), F.lit(UNKNOWN)).alias("name")).agg(
        F.count(K).alias("salary_count"), *[rnd(quartile(K, p), 1).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])
    return top_rows(g.filter(F.col("salary_count") >= least), [F.col("salary_count").desc(), F.col("median").desc(), F.col("name")], k)


def usable_salary() -> Column:
    """3 to 200 thousand a month, or any positive amount up to that if converted from days."""
    return (F.col(K) <= 200) & ((F.col(K) >= 3) | ((F.col("salary_period") == "day") & (F.col(K) > 0)))


def _cohort_columns() -> list[Column]:
    v = F.when(usable_salary(), F.col(K))
    return [F.count(v).alias("salary_count"), (F.count(F.lit(1)) - F.count(v)).alias("excluded"),
            F.count_if(usable_salary() & (F.col("salary_period") == "day")).alias("converted_daily_count"),
            rnd(quartile(v, 0.5), 2).alias("median"), rnd(quartile(v, 0.25), 2).alias("p25"), rnd(quartile(v, 0.75), 2).alias("p75"), rnd(F.avg(v), 4).alias("mean")]


def cohort_salary(df: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """salary statistics per cohort."""
    return df.groupBy(*by).agg(*_cohort_columns())


def label_frequency(df: DataFrame, field: str, key: str = "job_id", samples: int = 3) -> DataFrame:
    """per distinct label of a row: count, rate, salaries, median, and the first samples."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    seen = df.select(key, K, F.col("seq"), F.explode(F.array_distinct(field)).alias("name")).filter("name <> ''")
    g = seen.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count(K).alias("salary_count"), rnd(F.percentile(K, 0.5), 2).alias("median_salary_k"))
    # The rank limit keeps at most `samples` rows per label and task before the shuffle.
    few = first_per_key(seen, ["name"], [F.col("seq")], samples, "_no").groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_no", key))), lambda s: s[key]).alias("samples"))
    return g.join(few, "name").crossJoin(F.broadcast(total)).withColumn("rate", F.col("n") / F.col("_total")).drop("_total")


def summarize_cohort(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """F8: counts, quartiles, company coverage per cohort; label tables come from F7 on the same rows."""
    company = F.when(filled("company_key"), F.col("company_key"))
    known = F.when(filled("company_key") & filled("industry") & ~F.col("industry").rlike("^(未明确|其他|不限|未知)$"), F.col("company_key"))
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(K).alias("salary_count"), *[rnd(quartile(K, p), 2).alias(n) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))],
        F.count_distinct(company).alias("company_count"), F.count_distinct(known).alias("industry_known_companies"))
    return g.withColumn("industry_coverage", F.coalesce(F.try_divide("industry_known_companies", "company_count"), F.lit(0.0)))


def employment_mix(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """F8: rows per employment type of each cohort."""
    return df.groupBy(*by, "employment_type").agg(F.count(F.lit(1)).alias("n"))


def industry_shares(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """company-level shares; a company counts 1/k for each of its k industries."""
    pairs = df.filter(filled("company_key") & filled("industry") & ~F.col("industry").rlike("^(未明确|其他|不限|未知)$")).select(*by, "company_key", "industry").distinct()
    per = pairs.groupBy(*by, "company_key").agg(F.count(F.lit(1)).alias("_k"))
    totals = per.groupBy(*by).agg(F.count(F.lit(1)).alias("_companies"))
    w = pairs.join(per, [*by, "company_key"]).groupBy(*by, "industry").agg(F.sum(1 / F.col("_k")).alias("_w"))
    w = w.join(totals, list(by)) if by else w.crossJoin(F.broadcast(totals))
    return w.select(*by, F.col("industry").alias("name"), rnd("_w", 2).alias("company_weight"), rnd(F.col("_w") / F.col("_companies"), 6).alias("share"))


def with_without_association(df: DataFrame, field: str = "skills", limit: int = 200) -> DataFrame:
    """salary median of rows with and without each label, and the difference if both have five.

    Rows without a label are never listed. Value counts of all rows minus value counts of
    rows with the label give them; both are small next to the postings. Labels beyond
    `limit` are refused, not dropped.
    """
    usable = df.filter(usable_salary()).withColumn("_v", F.col(K))
    labels = df.select(F.explode(F.array_distinct(field)).alias("name")).filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    if labels.limit(limit + 1).count() > limit:
        raise ValueError("name the labels to compare")
    everyone = usable.groupBy("_v").agg(F.count(F.lit(1)).alias("_all"))
    having = usable.select("_v", F.explode(F.array_distinct(field)).alias("name")).groupBy("name", "_v").agg(F.count(F.lit(1)).alias("_with"))
    grid = everyone.crossJoin(F.broadcast(labels.select("name").limit(limit)))
    cells = grid.join(having, ["name", "_v"], "left").select("name", "_v", F.coalesce("_with", F.lit(0)).alias("a"), (F.col("_all") - F.coalesce("_with", F.lit(0))).alias("b"))
    stats = cells.groupBy("name").agg(F.sum("a").alias("with_count"), F.sum("b").alias("without_count"),
                                      F.percentile(F.when(F.col("a") > 0, F.col("_v")), 0.5, F.col("a")).alias("m1"), F.percentile(F.when(F.col("b") > 0, F.col("_v")), 0.5, F.col("b")).alias("m2"))
    both = (F.col("with_count") >= 5) & (F.col("without_count") >= 5)
    return labels.join(stats, "name", "left").select(
        "name", "n", F.coalesce("with_count", F.lit(0)).alias("with_count"), F.coalesce("without_count", F.lit(0)).alias("without_count"), rnd("m1", 2).alias("with_median"), rnd("m2", 2).alias("without_median"),
        F.when(both, rnd(rnd("m1", 2) - rnd("m2", 2), 2)).alias("difference"))


def salary_by_experience(df: DataFrame) -> DataFrame:
    """cohort statistics per experience bucket with its place in the order."""
    g = cohort_salary(df, [groups.experience_group().alias("name")])
    order = F.lit(None).cast("int")
    for i, name in enumerate(groups.EXPERIENCE_GROUPS[:6]):
        order = F.when(F.col("name") == name, i).otherwise(order)
    return g.withColumn("order", order)


def province_stats(df: DataFrame, province: str = "province_group") -> DataFrame:
    """counts, mean, gated quartiles and the most frequent education (ties listed) per province."""
    g = df.groupBy(F.col(province).alias("name")).agg(F.count(F.lit(1)).alias("n"), *_cohort_columns())
    edu = df.groupBy(F.col(province).alias("name"), groups.education_group().alias("education")).agg(F.count(F.lit(1)).alias("_n"))
    most = edu.groupBy("name").agg(F.max("_n").alias("top_education_count"))
    tied = edu.join(most, "name").filter("_n = top_education_count").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("education")), "、").alias("top_education"), F.max("top_education_count").alias("top_education_count"))
    gate = lambda c: F.when(F.col("salary_count") >= 5, F.col(c)).alias(f"{c}_salary_k")
    return g.join(tied, "name").select("name", "n", "salary_count", "converted_daily_count", F.col("mean").alias("average_salary_k"), gate("p25"), gate("median"), gate("p75"), "top_education", "top_education_count")


def company_ranking(df: DataFrame, k: int = 10) -> DataFrame:
    """distinct postings per normalised company with rank, share of known postings and platforms."""
    name = F.trim(halfwidth("company_name"))
    rows = df.withColumn("_name", name).filter((F.col("_name") != "") & ~F.col("_name").isin("未明确", "未知", "保密", "公司保密", "匿名公司", "--", "-"))
    rows = rows.withColumn("_company", F.lower(F.regexp_replace("_name", SPACE, "")))
    job = F.when(filled("platform") & filled("job_id"), F.concat_ws(":", "platform", "job_id")).otherwise(
        F.to_json(F.array("_company", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("job_name", "city", "experience", "salary")])))
    once = first_per_key(rows.withColumn("_job", job).select("_job", "_company", "_name", "platform", "seq"), ["_job"], [F.col("seq")])
    total = once.agg(F.count(F.lit(1)).alias("_known"))
    g = once.groupBy("_company").agg(F.count(F.lit(1)).alias("n"), F.min_by("_name", "seq").alias("name"), F.array_join(F.array_sort(F.collect_set("platform")), "|").alias("platforms"))
    top = top_rows(g, [F.col("n").desc(), F.col("name")], k, "rank")
    return top.crossJoin(F.broadcast(total)).select("rank", "name", "n", rnd(F.col("n") / F.col("_known"), 6).alias("share"), "platforms")


def city_stats(df: DataFrame, coordinates: Sequence[tuple[str, float, float]] = ()) -> DataFrame:
    """rows, rate, median salary and coordinates per city."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    g = df.filter(filled("city")).groupBy(text("city").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count(K).alias("salary_count"), rnd(F.percentile(K, 0.5), 1).alias("median_salary_k"))
    g = g.crossJoin(F.broadcast(total)).withColumn("rate", rnd(F.col("n") / F.col("_total"), 3)).drop("_total")
    places = lookup(df.sparkSession, list(coordinates) or [("", 0.0, 0.0)], "name string, longitude double, latitude double")
    return g.join(places, "name", "left")


def label_sets(df: DataFrame, field: str = "skills") -> DataFrame:
    """Distinct sorted label sets with row counts, counted before any pairing.

    Rows sharing one set are one row here, so pairing work grows with distinct sets.
    """
    return df.select(F.array_sort(F.array_distinct(F.filter(field, lambda s: s != ""))).alias("_set"), F.col(K).alias("_k")).groupBy("_set", "_k").agg(F.count(F.lit(1)).alias("_n"))


def _weighted_median(c: str = "_k", n: str = "_n", digits: int = 1) -> Column:
    return rnd(F.percentile(F.col(c), 0.5, F.col(n)), digits)


def skill_pairs(df: DataFrame, field: str = "skills", k: int = 15, least: int = 3, rate: float = 0.015) -> DataFrame:
    """label pairs of a row: count, support, lift, median salary; the k most frequent."""
    sets = label_sets(df, field)
    total = sets.agg(F.sum("_n").alias("_total"))
    single = sets.select(F.explode("_set").alias("name"), "_n").groupBy("name").agg(F.sum("_n").alias("c"))
    combos = F.flatten(F.transform("_set", lambda a, i: F.transform(F.slice("_set", i + 2, F.size("_set")), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    pairs = sets.select(F.explode(combos).alias("p"), "_k", "_n").groupBy("p.first", "p.second").agg(
        F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_k").isNotNull(), F.col("_n"))), F.lit(0)).alias("salary_count"), _weighted_median().alias("median_salary_k"))
    pairs = pairs.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("_total") * rate)))
    side = lambda key, c: single.select(F.col("name").alias(key), F.col("c").alias(c))
    pairs = pairs.join(side("first", "ca"), "first").join(side("second", "cb"), "second")
    pairs = pairs.withColumns({"support": F.col("n") / F.col("_total"), "lift": F.col("n") * F.col("_total") / (F.col("ca") * F.col("cb"))})
    top = top_rows(pairs, [F.col("n").desc(), F.col("lift").desc(), F.col("first"), F.col("second")], k)
    return top.select(F.concat_ws(" + ", "first", "second").alias("name"), "n", rnd("support", 3).alias("support"), rnd("lift", 2).alias("lift"), "salary_count", "median_salary_k")


def frequent_sets(df: DataFrame, field: str = "skills", top_skills: int = 26, sizes: Sequence[int] = (2, 3, 4), least: int = 5, rate: float = 0.03, k: int = 12) -> DataFrame:
    """F16: label sets of two to four among the most frequent labels, the k most frequent per size.

    Frequent sets are found by parallel FP-growth: conditional trees by groups of labels, so rows are not
    written out by set. Medians are taken for the sets that are kept, at most k for each size.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = df.filter(F.col(K).isNotNull())
    sets = cut_lineage(label_sets(rows, field))
    total = sets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    single = sets.select(F.explode("_set").alias("name"), "_n").groupBy("name").agg(F.sum("_n").alias("c"))
    spec = top_rows(single.filter(F.col("c") >= max(6, math.ceil(total * 0.03))), [F.col("c").desc(), F.col("name")], top_skills).collect()
    counts = F.create_map(*[F.lit(x) for r in spec for x in (r["name"], float(r["c"]))]) if spec else F.create_map().cast("map<string,double>")
    known = F.array(*[F.lit(r["name"]) for r in spec]).cast("array<string>")
    floor = max(least, math.ceil(total * rate))
    # Equal sets are one row with a number; the trees take them one by one again.
    tx = sets.select(F.array_intersect("_set", known).alias("items"), F.explode(F.expr("sequence(1L, _n)")).alias("_copy")).select("items")
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (floor - 0.5) / max(1, total)))).fit(tx).freqItemsets
    found = found.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("n")).filter(F.col("size").isin(*sizes) & (F.col("n") >= floor))
    support = F.col("n") / F.lit(max(1, total))
    expected = F.aggregate("items", F.lit(1.0), lambda t, i: t * (counts[i] / max(1, total)))
    scored = found.withColumns({"support": support, "lift": support / F.greatest(expected, F.lit(1 / max(1, total)))})
    kept = cut_lineage(first_per_key(scored, ["size"], [F.col("n").desc(), F.col("lift").desc(), F.col("items")], k))
    names = F.array(*[F.array(*[F.lit(x) for x in r["items"]]) for r in kept.select("items").collect()]).cast("array<array<string>>")
    inside = sets.select(F.explode(F.filter(names, lambda x: F.size(F.array_except(x, "_set")) == 0)).alias("items"), "_k", "_n")
    medians = inside.groupBy("items").agg(_weighted_median().alias("raw_median_salary_k"))
    return kept.join(medians, "items").select(
        F.array_join("items", " + ").alias("name"), "size", "n", rnd("support", 3).alias("support"), rnd("lift", 2).alias("lift"), "raw_median_salary_k",
        F.when(F.col("n") >= 20, "中等").when(F.col("n") >= 10, "谨慎参考").otherwise("低").alias("reliability"))


def channel_completeness(df: DataFrame) -> DataFrame:
    """rows, complete and incomplete rows per channel."""
    from hirelens.operators.clean import is_valid_posting
    ok = is_valid_posting()
    return df.groupBy(F.coalesce(value("platform"), F.lit("unknown")).alias("channel")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("complete_rows"), F.count_if(~ok).alias("incomplete_rows"))


def quality_report(df: DataFrame, fields: Sequence[str] = ("job_id", "job_name", "company_name", "city", "job_url"), counts: Sequence[str] = ("platform",)) -> DataFrame:
    """(section, item, n, rate): rows, field completeness, invalid addresses, counts per column."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(filled("job_url") & ~F.col("job_url").rlike("(?i)^https?://")).alias("_bad"), *[F.count_if(filled(f)).alias(f) for f in fields])
    items = [F.struct(F.lit("rows").alias("section"), F.lit("output_rows").alias("item"), F.col("_rows").alias("n"), F.lit(None).cast("double").alias("rate")),
             F.struct(F.lit("rows").alias("section"), F.lit("invalid_job_url").alias("item"), F.col("_bad").alias("n"), F.lit(None).cast("double").alias("rate"))]
    items += [F.struct(F.lit("completeness").alias("section"), F.lit(f).alias("item"), F.col(f).alias("n"), rnd(F.try_divide(f, "_rows"), 4).alias("rate")) for f in fields]
    out = wide.select(F.inline(F.array(*items)))
    for c in counts:
        out = out.unionByName(df.groupBy(F.coalesce(F.col(c), F.lit("")).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("section"), "item", "n", F.lit(None).cast("double").alias("rate")))
    return out


def collection_funnel(df: DataFrame, reason: str = "filter_reason", key: Sequence[str] = ("platform", "job_id"), order: str = "seq", target: int | None = None) -> DataFrame:
    """(step, n) from the rows read to the rows written.

    Rows without a key and repeated keys go first, then keys whose first row by `order` (a
    number) has a reason against it, then those beyond `target`. Rows without a key are one
    group that is counted in each task before it moves. An empty table gives zeros.
    """
    known = reduce(lambda a, b: a & b, [filled(c) for c in key])
    per = df.groupBy(*[F.when(known, F.col(c)).alias(f"_k{i}") for i, c in enumerate(key)]).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(filled(reason).cast("int"), F.col(order)).alias("_bad"))
    has = F.col("_k0").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = per.agg(total(F.col("_n")).alias("input_rows"), total(F.when(~has, F.col("_n"))).alias("missing_key_rows"), total(F.when(has, F.col("_n") - 1)).alias("duplicate_rows"),
                  F.count_if(has).alias("unique_rows"), F.count_if(has & (F.col("_bad") == 1)).alias("excluded_rows"))
    one = one.withColumn("eligible_rows", F.col("unique_rows") - F.col("excluded_rows"))
    one = one.withColumn("trimmed_rows", F.greatest(F.col("eligible_rows") - F.lit(target), F.lit(0)) if target is not None else F.lit(0)).withColumn("output_rows", F.col("eligible_rows") - F.col("trimmed_rows"))
    steps = ("input_rows", "missing_key_rows", "duplicate_rows", "unique_rows", "excluded_rows", "eligible_rows", "trimmed_rows", "output_rows")
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("step"), F.col(c).cast("long").alias("n")) for c in steps])))


def filter_reasons(df: DataFrame, reason: str = "filter_reason", key: Sequence[str] = ("platform", "job_id"), order: str = "seq", source: str = "platform") -> DataFrame:
    """(source, reason, n) of the keys that the funnel excludes; only key, order, reason and source move."""
    known = reduce(lambda a, b: a & b, [filled(c) for c in key])
    narrow = df.filter(known).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(order).alias("_o"), F.col(reason).alias("reason"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    first = first_per_key(narrow, [f"_k{i}" for i in range(len(key))], [F.col("_o")])
    return first.filter(filled("reason")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def coverage_report(df: DataFrame, fields: Sequence[str], methods: Sequence[str] = ("match_method", "confidence_band"), role: str = "role_family", matched: str = "matched") -> DataFrame:
    """rate of filled fields, counts per match method and confidence band, and role segments.

    Where `role` is a column, `input_role` counts all rows of a role and `role` the matched
    ones (all if there is no column `matched`). Audit rows come from `audit_examples`.
    """
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(filled(f)).alias(f) for f in fields])
    out = wide.select(F.inline(F.array(*[F.struct(F.lit("field").alias("section"), F.lit(f).alias("item"), F.col(f).alias("n"), rnd(F.try_divide(f, "_rows"), 3).alias("rate")) for f in fields])))
    no_rate = F.lit(None).cast("double").alias("rate")
    for c in methods:
        if c in df.columns:
            one = df.filter(filled(c)).groupBy(F.col(c).alias("item")).agg(F.count(F.lit(1)).alias("n"))
            out = out.unionByName(one.select(F.lit(c).alias("section"), "item", "n", no_rate))
    if role in df.columns:
        hit = F.coalesce(F.col(matched), F.lit(False)) if matched in df.columns else F.lit(True)
        one = df.filter(filled(role)).groupBy(F.col(role).alias("item")).agg(F.count(F.lit(1)).alias("input_role"), F.count_if(hit).alias("role"))
        rows = one.select("item", F.inline(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("n")) for c in ("input_role", "role")])))
        out = out.unionByName(rows.filter("n > 0").select("section", "item", "n", no_rate))
    return out


#: What rows that match nothing are called in the audit.
UNMATCHED = "未匹配"


def audit_examples(df: DataFrame, order: str = "seq", method: str = "match_method", matched: str = "matched", k: int = 12) -> DataFrame:
    """up to `k` rows of each match method at even distances in the order, first and last included, and as many unmatched ones.

    Columns of df with `audit_group` and `audit_no`. Positions are numbered without gathering a group.
    """
    group = F.when(F.coalesce(F.col(matched), F.lit(False)), F.coalesce(F.col(method).cast("string"), F.lit(""))).otherwise(UNMATCHED)
    tagged = df.withColumn("audit_group", group)
    placed = position_within(tagged, [(order, True)], group=["audit_group"], name="_at")
    sizes = tagged.groupBy("audit_group").agg(F.count(F.lit(1)).alias("_n"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, k - 1)) + 1)
    at = F.when(F.col("_n") <= k, F.sequence(F.lit(1).cast("long"), F.col("_n"))).otherwise(F.array_distinct(spaced))
    wanted = sizes.select("audit_group", F.posexplode(at).alias("audit_no", "_at")).withColumns({"audit_no": F.col("audit_no") + 1, "_at": F.col("_at").cast("long")})
    return placed.withColumn("_at", F.col("_at").cast("long")).join(wanted, ["audit_group", "_at"]).drop("_at")


def compare_roles(df: DataFrame, roles: Sequence[str], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """statistics per role and its k most frequent skills; a posting counts in each of its roles."""
    rows = df.withColumn("role", F.explode("role_families")).filter(F.col("role").isin(*roles))
    usable = F.when(usable_salary(), F.col(K))
    stats = rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("matched_jobs"), F.count(usable).alias("valid_salary_rows"), *[rnd(quartile(usable, p), 2).alias(n) for n, p in (("median_salary_k", 0.5), ("p25_salary_k", 0.25), ("p75_salary_k", 0.75))],
        F.array_join(F.array_sort(F.collect_set("platform")), "|").alias("platforms"))
    skills = rows.select("role", F.explode(F.array_distinct("skills")).alias("name")).groupBy("role", "name").agg(F.count(F.lit(1)).alias("n"))
    return stats, first_per_key(skills, ["role"], [F.col("n").desc(), F.col("name")], k, "rank")


def question_frequency(df: DataFrame, questions: str = "questions", post: str = "id", k: int = 8) -> DataFrame:
    """questions asked in two and more posts, with a representative wording."""
    from hirelens.functions.text import question_key
    q = df.select(F.col(post).alias("_post"), F.explode(questions).alias("question")).withColumn("_key", question_key(F.col("question"))).filter(F.length("_key") >= 4)
    g = q.groupBy("_key").agg(F.count_distinct("_post").alias("post_count"), F.min("question").alias("question")).filter("post_count >= 2")
    return top_rows(g, [F.col("post_count").desc(), F.col("question")], k).select("question", "post_count")


def topic_mentions(df: DataFrame, topics: Sequence[tuple[str, str]], questions: str = "questions") -> DataFrame:
    """posts with a question on each topic."""
    wide = df.agg(*[F.count_if(F.exists(questions, _likes(p))).alias(f"t{i}") for i, (_, p) in enumerate(topics)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("topic"), F.col(f"t{i}").alias("post_count")) for i, (n, _) in enumerate(topics)]))).filter("post_count > 0")


def _likes(pattern: str):
    return lambda q: q.rlike(pattern)


Z95 = 1.959963984540054


def wilson_lower(hit: Column, n: Column) -> Column:
    p = hit / n
    z2 = Z95 * Z95
    return F.when(n > 0, (p + z2 / (2 * n) - Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)).otherwise(0.0)


def classification_metrics(df: DataFrame, by: Sequence[str] = (), gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """confusion counts and the metrics derived from them, review rows left out of the counts."""
    g, p = F.col(gold), F.col(prediction)
    c = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((g == "include") & (p == "include")).alias("tp"), F.count_if((g == "exclude") & (p == "exclude")).alias("tn"),
        F.count_if((g == "exclude") & (p == "include")).alias("fp"), F.count_if((g == "include") & (p == "exclude")).alias("fn"))
    return add_metrics(c)


def add_metrics(c: DataFrame) -> DataFrame:
    tp, tn, fp, fn, n = (F.col(x) for x in ("tp", "tn", "fp", "fn", "n"))
    c = c.withColumns({"positive": tp + fn, "negative": tn + fp, "accuracy": F.try_divide(tp + tn, n), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
                       "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})
    pr, rc = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return c.withColumns({"f05": F.coalesce(F.try_divide(1.25 * pr * rc, 0.25 * pr + rc), F.lit(0.0)), "precision_lower95": wilson_lower(tp, tp + fp), "recall_lower95": wilson_lower(tp, tp + fn)})


def release_reasons(validation: str = "v", test: str = "t") -> Column:
    """reasons against releasing a classifier, from validation and test metric structs."""
    v, t = F.col(validation), F.col(test)
    weak = lambda m: ~F.coalesce((m["precision"] >= 0.9) & (m["recall"] >= 0.85) & (m["f1"] >= 0.87), F.lit(False))
    return F.array_compact(F.array(
        F.when(t["n"] < 30, "独立测试不足30篇"), F.when(F.least(t["positive"], t["negative"]) < 10, "独立测试每类不足10篇"), F.when(F.least(v["positive"], v["negative"]) < 5, "验证集每类不足5篇"),
        F.when(weak(v), "验证指标未达到精确率90%、召回率85%、F1 87%"), F.when(weak(t), "测试指标未达到精确率90%、召回率85%、F1 87%"),
        F.when(t["precision_lower95"] < 0.7, "测试精确率95%置信区间下界不足70%"), F.when(t["recall_lower95"] < 0.7, "测试召回率95%置信区间下界不足70%")))


def requirement_coverage(items: DataFrame, jobs: DataFrame, order: str = "rank") -> DataFrame:
    """share of met requirements per posting, NULL if an item is malformed; assessed postings first.

    items: key, item_id, optional, status, jd_evidence, resume_evidence. The final
    order is a number computed without gathering the postings.
    """
    good = filled("item_id") & F.col("optional").isNotNull() & F.col("status").isin("met", "partial", "not_evidenced") & filled("jd_evidence") & (filled("resume_evidence") | (F.col("status") == "not_evidenced"))
    per = items.groupBy("key", "item_id").agg(F.count(F.lit(1)).alias("_times"), F.min(F.coalesce(good, F.lit(False))).alias("_good"), F.first("optional").alias("optional"), F.first("status").alias("status"))
    g = per.groupBy("key").agg(
        F.max("_times").alias("_times"), F.min("_good").alias("_good"), F.count_if(~F.col("optional")).alias("total"), F.count_if(~F.col("optional") & (F.col("status") == "met")).alias("matched"),
        F.count_if(~F.col("optional") & (F.col("status") == "partial")).alias("partial"), F.count_if(F.col("optional")).alias("optional"))
    valid = (F.col("_times") == 1) & F.col("_good")
    g = g.select("key", *[F.when(valid, F.col(c)).alias(c) for c in ("total", "matched", "partial", "optional")], F.when(valid, F.try_divide(100 * F.col("matched"), F.col("total"))).alias("percentage"))
    out = jobs.join(g, "key", "left").withColumns({"_none": F.col("percentage").isNull().cast("int"), "_p": -F.coalesce("percentage", F.lit(0.0))})
    return position_within(out, [("_none", True), ("_p", True), (order, True), ("key", True)], name="place").drop("_none", "_p")


def labelling_report(df: DataFrame) -> DataFrame:
    """one row of coverage rates and audit counts over rule labels (C17)."""
    n = F.count(F.lit(1))
    rate = lambda c: rnd(F.avg(c.cast("double")), 3)
    return df.agg(
        n.alias("completed_rows"), rnd(F.avg("confidence"), 3).alias("average_confidence"), F.count_if(F.size("risk_signals") > 0).alias("risk_signal_rows"), rate(F.size("label_skills") > 0).alias("skills_coverage_rate"),
        rate(F.size("label_tasks") > 0).alias("tasks_coverage_rate"), rate(F.size("evidence") > 0).alias("evidence_coverage_rate"), rnd(F.avg("evidence_coverage"), 3).alias("average_evidence_coverage"), rate(F.col("evidence_coverage") >= 1).alias("full_evidence_coverage_rate"),
        F.count_if((F.col("label_status") == "已确认") & (F.size("evidence") == 0)).alias("confirmed_without_evidence_rows"),
        F.count_if((F.col("standard_job") != "其他") & (F.size("label_skills") == 0) & (F.size("label_tasks") == 0) & (F.size("evidence") == 0)).alias("forced_labels_without_signals"), F.count_distinct("confidence").alias("distinct_confidence_values"))


def label_readiness(df: DataFrame, label: str = "label", minima: tuple[int, int, int] = (24, 24, 60)) -> DataFrame:
    """class counts against the minima for training, with deficits."""
    g = df.agg(F.count_if(F.col(label) == "include").alias("positive"), F.count_if(F.col(label) == "exclude").alias("negative"), F.count(F.lit(1)).alias("_n"))
    short = lambda need, have: F.greatest(F.lit(0), F.lit(need) - have)
    g = g.withColumns({"review": F.col("_n") - F.col("positive") - F.col("negative"), "deficit_positive": short(minima[0], F.col("positive")), "deficit_negative": short(minima[1], F.col("negative")),
                       "deficit_total": short(minima[2], F.col("positive") + F.col("negative"))})
    return g.withColumn("ready", (F.col("deficit_positive") + F.col("deficit_negative") + F.col("deficit_total")) == 0).drop("_n")


def cluster_suggestions(clusters: DataFrame) -> DataFrame:
    """coherent clusters merged by normalised name: (cluster_id, name, status, n, share, keywords)."""
    key = F.lower(F.regexp_replace(halfwidth("name"), SPACE, ""))
    return clusters.filter("status = 'coherent'").withColumn("_key", key).groupBy("_key").agg(
        F.min_by("name", "cluster_id").alias("name"), F.sum("n").alias("n"), F.sum("share").alias("share"), F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords")).drop("_key")


def cloud_terms(df: DataFrame, k: int = 100, score: str = "score", count: str = "n") -> DataFrame:
    """greatest weight per term (score, else count, else one), the k heaviest."""
    w = F.when(F.col(score) > 0, F.col(score).cast("double")).when(F.col(count) > 0, F.col(count).cast("double")).otherwise(1.0)
    g = df.select(text("name").alias("name"), w.alias("weight")).filter("name <> ''").groupBy("name").agg(F.max("weight").alias("weight"))
    return top_rows(g, [F.col("weight").desc(), F.col("name")], k)


def infer_dataset_role(df: DataFrame, families: Sequence[tuple[str, str, str, str]] | None = None, title: str = "job_name", query: str = "query_keyword", skills: str = "skills", body: str = "job_description") -> DataFrame:
    """votes per occupation from weighted evidence, one pass; confidence of the leader against the second."""
    from hirelens.rules import tables
    families = families if families is not None else tables.FAMILIES
    f = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    score = [F.when(f(title).rlike(t), 5).otherwise(0) + F.when(f(query).rlike(q), 2).otherwise(0) + F.when(f(skills).rlike(c), 3).otherwise(0) + F.when(f(body).rlike(c), 2).otherwise(0) for _, t, q, c in families]
    df = df.select(*[s.alias(f"s{i}") for i, s in enumerate(score)], *[f(query).rlike(x[2]).alias(f"q{i}") for i, x in enumerate(families)])
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(families))], *[F.count_if(F.col(f"s{i}") >= 4).alias(f"m{i}") for i in range(len(families))],
                  *[F.count_if(F.col(f"q{i}")).alias(f"q{i}") for i in range(len(families))])
    votes = F.array_sort(F.array(*[F.struct((-F.col(f"s{i}")).alias("neg"), F.lit(i).alias("at"), F.lit(x[0]).alias("name"), F.col(f"m{i}").alias("matching_rows"), F.col(f"q{i}").alias("query_rows")) for i, x in enumerate(families)]))
    wide = wide.select("_rows", F.posexplode(votes).alias("_at", "v"), F.get(votes, F.lit(0))["neg"].alias("_lead"), F.get(votes, F.lit(1))["neg"].alias("_second"))
    margin = F.greatest(F.lit(0.0), (F.col("_second") - F.col("_lead")) / F.greatest(F.lit(1), -F.col("_lead")))
    conf = F.least(F.lit(0.99), 0.4 + F.col("v.query_rows") / F.greatest(F.lit(1), F.col("_rows")) * 0.2 + F.col("v.matching_rows") / F.greatest(F.lit(1), F.col("_rows")) * 0.1 + margin * 0.1)
    return wide.select((F.col("_at") + 1).alias("rank"), "v.name", (-F.col("v.neg")).alias("score"), "v.matching_rows", "v.query_rows", F.when(F.col("_at") == 0, rnd(conf, 3)).alias("confidence"))
