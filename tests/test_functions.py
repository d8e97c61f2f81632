"""Function tables on small hand-made inputs."""

import re

import pytest
from pyspark.sql import functions as F

from hirelens.core import rnd
from hirelens.functions import groups, labels, salary, text
from hirelens.operators import clean
from hirelens.sources import readers


@pytest.mark.parametrize("raw,period,low,high,pay", [
    ("15-25K·13薪", "month", 15000, 25000, 13), ("150-200元/天", "day", 150, 200, None), ("20-30万元/年", "year", 200000, 300000, None),
    ("1.5-2万", "month", 15000, 20000, None), ("8000-12000元", "month", 8000, 12000, None), ("30元/小时", "hour", 30, 30, None),
    ("2-3万·14-16薪", "month", 20000, 30000, 14), ("１５－２５Ｋ", "month", 15000, 25000, None), ("面议", None, None, None, None), ("35万", None, None, None, None), ("13薪", None, None, None, None)])
def test_salary(spark, raw, period, low, high, pay):
    r = salary.with_salary(spark.createDataFrame([(raw,)], "salary string")).select("pay.*").collect()[0]
    assert (r["period"], r["min"], r["max"], r["pay_min"]) == (period, low, high, pay)


def test_groups(spark):
    df = spark.createDataFrame([("应届生", "1万人以上", "研究生"), ("3年以上", "少于50人", "不限"), ("无经验", "", "中专"), ("6个月以内1年以下", "500人", "")], "e string, s string, d string")
    got = df.select(groups.experience_group("e"), groups.company_size_group("s"), groups.education_group("d")).collect()
    assert [tuple(r) for r in got] == [("在校/应届", "10000人及以上", "硕士"), ("3-5年", "100人以下", "学历不限"), ("经验不限", "未明确", "中专/中技"), ("未明确", "500-999人", "未明确")]


def test_provinces(spark):
    rows = [("", "北京市海淀区"), ("浙江", "x"), ("", "杭州-西湖"), ("", "杭州市余杭 | 上海"), ("", "全国"), ("", "火星"), ("", "内蒙古自治区呼和浩特")]
    df = spark.createDataFrame(rows, "province string, city string")
    assert {r["city"]: r["province_group"] for r in groups.province_name(df).collect()} == {
        "北京市海淀区": "北京", "x": "浙江", "杭州-西湖": "浙江", "杭州市余杭 | 上海": "多省份", "全国": "全国/地点不限", "火星": "未明确", "内蒙古自治区呼和浩特": "内蒙古"}


def test_skill_boundaries_next_to_cjk(spark):
    df = spark.createDataFrame([("写Python代码", "", "精通JavaScript和java")], "job_name string, skills string, job_description string")
    assert set(labels.tag_skills(df).collect()[0]["skill_tags"]) == {"Python", "JavaScript", "Java"}


def test_sections(spark):
    df = spark.createDataFrame([("公司简介我们很好。岗位职责：负责开发；写代码。任职要求：本科。懂SQL\n福利待遇：五险",)], "job_description string")
    got = [(r["location"], r["quote"]) for r in text.split_sections(df).collect()]
    assert got == [("duties", "：负责开发"), ("duties", "写代码"), ("requirements", "：本科"), ("requirements", "懂SQL")]


def test_windows_cover_the_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(1000))
    got = text.text_windows(spark.createDataFrame([(body,)], "job_description string"), size=350, overlap=40).orderBy("window_no").collect()
    assert got[0]["window_start"] == 0 and got[-1]["window_end"] == 1000
    assert all(a["window_end"] - b["window_start"] == 40 for a, b in zip(got, got[1:])) or got[-1]["window_end"] - got[-1]["window_start"] <= 350
    assert all(r["window_text"] == body[r["window_start"]:r["window_end"]] for r in got)


def test_cohorts(spark):
    df = spark.createDataFrame([("26届校招", "面向2027届毕业生。2028届优先")], "job_name string, job_description string")
    assert df.select(labels.hiring_cohorts().alias("y")).collect()[0]["y"] == [2026, 2027]


def test_redaction(spark):
    df = spark.createDataFrame([("联系 a.b@c.com 或 13812345678，见 https://x.cn/1 谢谢",)], "t string")
    got = df.select(clean.redact("t").alias("t")).collect()[0]["t"]
    assert got == "联系 [邮箱已移除] 或 [电话已移除]，见 [链接已移除] 谢谢"


def test_valid_posting(spark):
    ok = ("p", "1", "n", "c", "x", "d" * 30)
    rows = [ok + (u,) for u in ("https://a.cn/1", "ftp://a.cn", "https://u:p@a.cn", "https://a.cn/ b", "")]
    df = spark.createDataFrame(rows, "platform string, job_id string, job_name string, company_name string, city string, job_description string, job_url string")
    assert [r[0] for r in df.select(clean.is_valid_posting()).collect()] == [True, False, False, False, False]


def test_rounding_is_half_up(spark):
    assert spark.createDataFrame([(3.805,), (2.675,), (float("nan"),)], "x double").select(rnd("x", 2)).collect()[:2] == [(3.81,), (2.68,)]


def test_written_csv_keeps_white_space_at_the_ends(spark, tmp_path):
    rows = [("1", " both "), ("2", "cut after a word "), ("3", "\tin\n"), ("4", ""), ("5", " ")]
    readers.write_dataset(spark.createDataFrame(rows, "job_id string, extra string"), str(tmp_path / "out"), "csv", spreadsheet=True)
    assert sorted((r["job_id"], r["extra"]) for r in readers.read_channel_csv(spark, str(tmp_path / "out")).collect()) == rows


def test_entities_are_decoded_once_and_cut_out_once(spark):
    rows = ["&amp;lt;", "&AMP;x", "&#62;&#x3E;", "&#0;z", "&#xD800;", "& lt;", "&unknown;z", "&&amp;&", "a;b&gt;c;d", "&#x1F600;ok", "plain"]
    column = readers.decode_entities(F.col("t"))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(column).collect()]
    assert got == ["&lt;", "&x", ">>", "&#0;z", "&#xD800;", "& lt;", "&unknown;z", "&&&", "a;b>c;d", "😀ok", "plain"]
    # Each piece used to meet fourteen patterns, whatever stood in it; only numbers need any.
    plan = spark.createDataFrame([("x",)], "t string").select(column)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"(?i)regexp_\w+\(|rlike\(| rlike ", plan)) <= 6
