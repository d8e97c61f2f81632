"""Salary text to numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.core import SPACE, halfwidth, let

# Units, period words, upper limits and pay-month forms of the quote formats.
NUMBER = r"(\d+(?:\.\d+)?)(万|千|[kK]|元)?"
DASH = r"[-~～–—至到]"
NO_QUOTE = r"(?i)面议|保密|negotiable"
HOUR = r"(?i)小时|/时|时薪|/h(?![A-Za-z0-9_])"
DAY = r"(?i)天|/日|日薪|/day"
YEAR = r"年薪|年包|总包|/年|每年|万元?年薪"
MONTH = r"(?i)月|薪|千|k"
PAY_MONTHS = rf"[^\d](\d{{2}})(?:{DASH}(\d{{2}}))?薪"
LIMITS = {"hour": 10_000, "day": 100_000, "month": 1_000_000, "year": 10_000_000}
DAYS_PER_MONTH = 21.75


def _scale(unit):
    return F.when(unit == "万", 10000.0).when(unit.rlike("(?i)千|k"), 1000.0).otherwise(1.0)


def salary_struct(col: str = "salary") -> Column:
    """The parsed quote as one column; NULL for a text that holds no usable quote."""
    both = f"{NUMBER}{DASH}{NUMBER}"
    flat = F.regexp_replace(halfwidth(col), rf"[,，]|{SPACE}", "")

    def parts(t: Column) -> Column:
        group = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
        return F.struct(
            t.alias("t"), group(both, 1).alias("r1"), group(both, 2).alias("u1"), group(both, 3).alias("r2"), group(both, 4).alias("u2"),
            group(NUMBER, 1).alias("s1"), group(NUMBER, 2).alias("su"), group(PAY_MONTHS, 1).alias("m1"), group(PAY_MONTHS, 2).alias("m2"))

    def bounds(p: Column) -> Column:
        unit = F.coalesce(p["u2"], p["u1"], p["su"])
        low = F.coalesce(p["r1"].try_cast("double") * _scale(F.coalesce(p["u1"], unit)), p["s1"].try_cast("double") * _scale(unit))
        high = F.coalesce(p["r2"].try_cast("double") * _scale(unit), low)
        return F.struct(p["t"].alias("t"), low.alias("lo"), high.alias("hi"), (p["r1"].isNotNull() & F.coalesce(unit == "万", F.lit(False))).alias("wide"),
                        p["m1"].try_cast("int").alias("m1"), F.coalesce(p["m2"], p["m1"]).try_cast("int").alias("m2"))

    def period(v: Column) -> Column:
        t = v["t"]
        said = t.rlike(MONTH)
        name = (F.when(t.rlike(HOUR), "hour").when(t.rlike(DAY), "day").when(t.rlike(YEAR), "year").when(said, "month")
                .when((t.contains("元") & (v["lo"] >= 1000)) | v["wide"], "month"))
        return F.struct(v.alias("v"), name.alias("name"), (~said).alias("unsaid"))

    def value(q: Column) -> Column:
        v, name = q["v"], q["name"]
        limit = F.lit(None).cast("double")
        for known, top in LIMITS.items():
            limit = F.when(name == known, float(top)).otherwise(limit)
        usable = (v["lo"] > 0) & (v["hi"] >= v["lo"]) & (v["hi"] <= limit) & ~v["t"].rlike(NO_QUOTE) & ~v["t"].rlike(r"^\d+薪$")
        months = (name == "month") & (v["m1"] >= 12) & (v["m2"] <= 24)
        return F.when(usable, F.struct(
            F.col(col).alias("raw"), name.alias("period"), v["lo"].alias("min"), v["hi"].alias("max"), ((v["lo"] + v["hi"]) / 2).alias("midpoint"),
            F.when(months, v["m1"]).alias("pay_min"), F.when(months, v["m2"]).alias("pay_max"), ((name == "month") & q["unsaid"]).alias("period_inferred"),
            F.when(months, v["lo"] * v["m1"]).alias("annual_min"), F.when(months, v["hi"] * v["m2"]).alias("annual_max")))

    return let(flat, lambda t: let(parts(t), lambda p: let(bounds(p), lambda v: let(period(v), value))))


def parse_salary(df: DataFrame, col: str = "salary", out: str = "pay") -> DataFrame:
    """Add the parsed quote (raw, period, min, max, midpoint, pay months, inferred flag, nominal annual).

    Quotes repeat, so every distinct text is parsed once and joined back: a small table
    becomes a broadcast at run time, a large one a shuffled join whose hot texts adaptive
    execution splits.
    """
    quote = F.coalesce(F.col(col), F.lit("")).alias("_quote")
    parsed = df.select(quote).distinct().select("_quote", salary_struct("_quote").alias(out))
    return df.select("*", quote).join(parsed, "_quote", "left").drop("_quote")


def monthly_salary(df: DataFrame, pay: str = "pay") -> DataFrame:
    """Monthly midpoint in thousands; a day counts 21.75 per month, other periods have none."""
    p = F.col(f"{pay}.period")
    factor = F.when(p == "month", 1.0).when(p == "day", DAYS_PER_MONTH)
    return df.withColumns({
        "salary_midpoint_k": F.col(f"{pay}.midpoint") * factor / 1000,
        "salary_period": F.when(factor.isNotNull(), p).otherwise(""),
        "salary_basis": F.when(p == "month", "招聘月薪区间中点").when(p == "day", "日薪区间中点 × 21.75天/月（折算）").otherwise("无有效月薪"),
    })


def with_salary(df: DataFrame, col: str = "salary") -> DataFrame:
    return monthly_salary(parse_salary(df, col))
