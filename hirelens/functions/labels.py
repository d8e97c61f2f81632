"""Labels read from posting and résumé text by rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.core import SPACE, UNKNOWN, col, filled, let, rnd, text, value, word
from hirelens.functions.groups import employment_type_in_context
from hirelens.rules import tables

Rules = Sequence[tuple[str, str]]


def hits(source: Column, rules: Rules, lowered: Column | None = None) -> Column:
    """Names of the rules whose pattern occurs in the text, in rule order.

    With the text in lower case too, a pattern runs only on texts that hold letters which each of its matches has.
    """
    def found(p: str) -> Column:
        cues = letters_of(p) if lowered is not None else []
        return reduce(or_, [lowered.contains(c) for c in cues]) & source.rlike(p) if cues else source.rlike(p)
    return F.array_compact(F.array(*[F.when(found(p), F.lit(name)) for name, p in rules]))


def letters_of(pattern: str) -> list[str]:
    """Lower-case letters of which every match of the pattern holds some; none if that can't be told.

    Only forms that Java and Python read alike are looked into: top-level alternatives, each
    one run of plain characters between boundaries, as `word` makes it, or beside other parts.
    """
    out = []
    for part in _alternatives(re.sub(r"^\(\?i\)", "", pattern)):
        part = re.sub(r"\(\?<?[!=](?:\[[^\]\\]*\]|[^()\[\]\\])*\)", "\0", part)
        while re.fullmatch(r"\0?\(\?:[^()]*\)\0?", part):
            inner = part.strip("\0")[3:-1]
            if "|" in inner:
                return []
            part = inner
        if re.search(r"[(){}|]|\[|\\[^.+]", part.replace("\\s*", "")):
            return []
        # A character before ? or * may be absent; it, escapes of classes and lone dots end a run.
        runs = re.split(r"\\s\*|(?:\\.|[^\\])[?*]|(?<!\\)[.+^$]|\0", part)
        best = max((r.replace("\\", "") for r in runs), key=len)
        if len(best) < 2 or any(c.lower() != c.upper() and not c.isascii() for c in best):
            return []
        out.append(best.lower())
    return out


def _alternatives(pattern: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for m in re.finditer(r"\\.|\[[^\]]*\]|[()|]", pattern):
        depth += {"(": 1, ")": -1}.get(m.group(), 0)
        if m.group() == "|" and depth == 0:
            parts.append(pattern[at:m.start()])
            at = m.end()
    return [*parts, pattern[at:]]


def named(source: Column, lowered: Column, names: Sequence[str]) -> Column:
    """Names standing in the text. Only texts that hold the letters of a name are searched by its pattern."""
    return F.array_compact(F.array(*[F.when(lowered.contains(n.lower()) & source.rlike(_skill_pattern(n)), F.lit(n)) for n in names]))


def tag_skills(df: DataFrame, rules: Rules | None = None, columns: Sequence[str] = ("job_name", "skills", "job_description"),
               out: str = "skill_tags") -> DataFrame:
    """C14: distinct skill names found in title, skills and body."""
    rules = rules if rules is not None else tables.SKILLS
    every = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    # Bound, so that a filter pushed down does not put text and lower case into every rule.
    return df.withColumn(out, let(every, lambda t: let(F.lower(t), lambda low: hits(t, rules, low))))


def tag_tasks(df: DataFrame, family: str = "", rules: dict[str, Rules] | None = None, body: str = "job_description",
              out: str = "task_tags") -> DataFrame:
    """General duties and the duties of one occupation."""
    rules = rules if rules is not None else tables.TASKS
    own = list(rules.get("", [])) + (list(rules.get(family, [])) if family else [])
    return df.withColumn(out, hits(F.coalesce(F.col(body), F.lit("")), own))


def _years(found: Column) -> Column:
    return F.transform(found, lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).try_cast("int"))


def hiring_cohorts(title: str | Column = "job_name", body: str | Column = "job_description") -> Column:
    """Graduation years a posting is open to, from its title and firm clauses of its body."""
    t, b = F.coalesce(col(title), F.lit("")), F.coalesce(col(body), F.lit(""))
    short = F.lit(r"(?<!\d)((?:20)?\d{2})\s*届")
    clauses = F.filter(F.split(b, r"[\n。；;]"), lambda s: ~s.rlike("优先|加分") & s.rlike(
        "(?:届.{0,15}(?:毕业|应届|在校|本科|硕士)|(?:面向|仅限|要求|招收|招募).{0,20}届)"))
    return F.array_distinct(F.concat(
        _years(F.regexp_extract_all(t, short, 1)),
        _years(F.regexp_extract_all(t, F.lit(r"(?<!\d)(20\d{2})\s*年?\s*应届(?:毕业)?生"), 1)),
        _years(F.regexp_extract_all(t, F.lit(r"(?<!\d)(20\d{2})\s*(?:年)?(?:校招|校园招聘|秋招|春招)"), 1)),
        _years(F.flatten(F.transform(clauses, lambda s: F.regexp_extract_all(s, short, 1))))))


def cohort_needs_review(title: str | Column = "job_name", body: str | Column = "job_description") -> Column:
    """Body excludes a year the title names, without saying so plainly."""
    own = hiring_cohorts(title, F.lit(""))
    found = F.regexp_extract_all(F.coalesce(col(body), F.lit("")), F.lit(r"非\s*((?:20)?\d{2}\s*届[^\n。；;]{0,30})"), 1)
    plain = "勿投|不投|不要投|不接受|不考虑|不符合|谢绝"
    return F.exists(found, lambda s: F.array_contains(own, F.element_at(_years(F.array(F.regexp_extract(s, r"^(\d+)", 1))), 1)) & ~s.rlike(plain))


def career_stage(title: str = "job_name", body: str = "job_description", employment: str = "employment_type",
                 experience: str = "experience") -> Column:
    """Internship, campus or social hiring."""
    head = F.concat_ws(" ", text(title), text(experience))
    campus = (head.rlike(r"校招|校园招聘|应届|毕业生|\d{2}届") | (F.size(hiring_cohorts(title, body)) > 0)
              | text(body).rlike("(?:面向|招收|招募).{0,15}(?:应届|毕业生)"))
    return F.when(text(title).contains("实习") | (text(employment) == "实习"), "internship").when(campus, "campus").otherwise("social")


# Vocabulary of the crawling occupation the rule labels grade.
LABEL_SKILLS = [
    "Python", "Java", "JavaScript", "TypeScript", "Go", "C++", "SQL", "Linux", "Git", "Docker", "Kubernetes", "Scrapy", "Requests",
    "BeautifulSoup", "Selenium", "Playwright", "Pyppeteer", "Puppeteer", "Appium", "MySQL", "PostgreSQL", "MongoDB", "Redis",
    "Elasticsearch", "Kafka", "RabbitMQ", "Hadoop", "Spark", "HTTP", "HTTPS", "TCP/IP", "XPath", "正则表达式", "数据清洗", "数据采集",
    "分布式爬虫", "反爬虫"]
LABEL_TASKS = tables.ignoring_case([
    ("数据采集系统开发", "爬虫|数据采集系统|信息抽取|网页采集|采集程序|数据抓取|抓取数据|爬取数据"),
    ("数据清洗与入库", "数据清洗|清洗数据|清洗、|清洗，|入库|ETL|结构化处理|数据处理与存储"),
    ("分布式任务调度", "分布式|任务调度|调度系统|消息队列|去重"),
    ("采集稳定性与合规处理", "反爬|验证码|限流|封禁|风控|合规|稳定性"),
    ("数据接口与服务开发", "(?:接口|API|服务化).{0,18}(?:开发|设计|研发|构建|维护)|(?:开发|设计|研发|构建|维护).{0,18}(?:接口|API|服务化)"),
    ("采集系统运维", "(?:爬虫|采集)(?:系统|平台|程序|任务).{0,22}(?:维护|监控|告警|运维|部署)|(?:维护|监控|告警|运维|部署).{0,22}(?:爬虫|采集)(?:系统|平台|程序|任务)"),
])
OTHER_COLLECTION = "用电信息采集|信号采集|图像采集|音视频采集|采集卡|数据采集器|硬件采集|医学采集|样本采集|地质采集"
TITLE_CUE = "(?i)爬虫|反爬|网页抓取|数据抓取|采集开发|采集工程师.*爬虫|爬虫.*采集工程师"
WEB_CUE = "(?i)爬虫|反爬|网页抓取|数据抓取|网络抓取|scrapy|requests|beautifulsoup|selenium|playwright|puppeteer|xpath"
COLLECTION_CUE = "数据采集系统|信息抽取|网页采集|采集程序|抓取数据|爬取数据|爬虫"
CRAWLER, COLLECTOR, DATA_ENGINEER, OTHER = "爬虫工程师", "数据采集工程师", "数据开发工程师", "其他"
OFF_TARGET = "非目标"


def _skill_pattern(name: str) -> str:
    if re.fullmatch(r"[A-Za-z0-9+#/.]+", name):
        return rf"(?i)(?<![A-Za-z0-9+#]){re.escape(name)}(?![A-Za-z0-9+#])"
    return "(?i)" + re.escape(name)


def context_quote(source: Column, pattern: str, before: int = 35, after: int = 65, longest: int = 120) -> Column:
    """The first match with its surroundings, NULL without a match."""
    flat = F.trim(F.regexp_replace(F.coalesce(source, F.lit("")), rf"{SPACE}+", " "))
    at = F.regexp_instr(flat, F.lit(pattern))
    size = F.length(F.regexp_substr(flat, F.lit(pattern)))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + size + after - 1, F.length(flat))
    quote = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substring(flat, start, end - start + 1)),
                     F.when(end < F.length(flat), "…").otherwise(""))
    return F.when(at > 0, F.substring(quote, 1, longest))


def rule_label(df: DataFrame, skills: Sequence[str] = tuple(LABEL_SKILLS), tasks: Rules = tuple(LABEL_TASKS)) -> DataFrame:
    """C17: grade a posting for the data-collection occupation.

    Reads job_name, tags, skills, job_description, experience, employment_type,
    platform, relevance_level, relevance_evidence. Adds grade, standard job, seniority,
    skill and task lists, risks, evidence items, coverage and confidence.
    """
    for c in ("tags", "skills", "experience", "employment_type", "relevance_level", "relevance_evidence", "platform"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    title, body, skill_text, tags = text("job_name"), text("job_description"), text("skills"), text("tags")
    df = df.withColumn("_full", F.concat_ws("\n", title, tags, skill_text, body))
    full = F.col("_full")
    df = df.withColumn("_lower", F.lower(full))
    df = df.withColumns({
        "_title": ~title.rlike(OTHER_COLLECTION) & title.rlike(TITLE_CUE), "_web": F.concat_ws("\n", skill_text, body).rlike(WEB_CUE),
        "_coll": full.rlike(COLLECTION_CUE), "label_skills": named(full, F.col("_lower"), skills)})
    no_cue = ~F.col("_title") & ~F.col("_web") & ~F.col("_coll")
    df = df.withColumn("relevance_grade", F.when((F.col("relevance_level") == "平台关键词匹配") & no_cue, OFF_TARGET)
                       .when(F.col("_title") | F.col("_web") | (F.col("relevance_level") == "职责直接匹配"), "高")
                       .when((F.col("relevance_level") == "采集技术匹配") | F.col("_coll"), "中").otherwise("低"))
    on = F.col("relevance_grade") != OFF_TARGET
    df = df.withColumn("label_tasks", F.when(on, hits(full, tasks)).otherwise(F.array().cast("array<string>")))
    df = df.withColumns({
        "seniority": F.when(F.concat_ws(" ", title, text("experience")).rlike("实习|应届|经验不限|1年以下"), "入门/初级")
        .when(text("experience").rlike("1-3年|2年|3年"), "初中级")
        .when(F.concat_ws(" ", title, text("experience")).rlike("3-5年|5-10年|高级|专家|架构"), "中高级").otherwise(UNKNOWN),
        "standard_job": F.when(~on, OTHER).when(F.concat_ws("\n", title, body).rlike("爬虫|反爬"), CRAWLER)
        .when(F.col("_coll") | title.rlike("数据采集|信息抽取|抓取"), COLLECTOR)
        .when(title.rlike("数据开发|数据工程|ETL|数仓") & (F.col("relevance_grade") != "低"), DATA_ENGINEER).otherwise(OTHER),
        "label_employment": employment_type_in_context()})
    df = df.withColumn("label_status", F.when(~on, "非目标岗位").when(
        (F.col("relevance_grade") == "高") & (F.col("standard_job") != OTHER) & (F.size("label_skills") + F.size("label_tasks") > 0), "已确认")
        .otherwise("待AI复核"))
    df = df.withColumn("risk_signals", F.array_compact(F.array(
        F.when(full.rlike("兼职|接单|在家|多劳多得|日结"), "兼职或众包描述"),
        F.when(full.rlike("培训机构|课程招生|收费培训|缴纳学费|保证就业|付费学习"), "培训招生信号"),
        F.when(F.length(body) < 80, "岗位描述过短"), F.when(~on, "岗位相关性弱"))))

    def item(kind: str, label: Column, picks: Sequence[tuple[str, Column]]) -> Column:
        made = [F.when(q.isNotNull(), F.struct(F.lit(kind).alias("label_type"), label.alias("label"), F.lit(f).alias("source_field"), q.alias("quote")))
                for f, q in picks]
        return F.coalesce(*made)

    job_patterns = [(CRAWLER, "爬虫|反爬"), (COLLECTOR, "数据采集|信息抽取|抓取"), (DATA_ENGINEER, "数据开发|数据工程|ETL|数仓")]
    items = [F.when(F.col("standard_job") == name, item("standard_job", F.lit(name), [("岗位名称", context_quote(title, p)), ("岗位描述", context_quote(body, p))]))
             for name, p in job_patterns]
    items.append(F.when(F.col("standard_job") == OTHER, item("standard_job", F.lit(OTHER), [
        ("相关度依据", F.substring(value("relevance_evidence"), 1, 120)), ("岗位名称", F.substring(value("job_name"), 1, 120))])))
    for s in skills:
        p = _skill_pattern(s)
        items.append(F.when(F.array_contains("label_skills", s), item("skill", F.lit(s), [("技能", context_quote(skill_text, p)), ("岗位描述", context_quote(body, p))])))
    for name, p in tasks:
        items.append(F.when(F.array_contains("label_tasks", name), item("task", F.lit(name), [
            ("岗位描述", context_quote(body, p)), ("技能", context_quote(skill_text, p)), ("福利/标签", context_quote(tags, p)), ("岗位名称", context_quote(title, p))])))
    items.append(F.when(F.col("seniority") != UNKNOWN, item("seniority", F.col("seniority"), [("经验要求", context_quote(value("experience"), ".+"))])))
    items.append(F.when(F.col("label_employment") != UNKNOWN, item("employment_type", F.col("label_employment"), [
        ("用工类型", F.substring(value("employment_type"), 1, 120)), ("岗位名称", F.substring(value("job_name"), 1, 120))])))
    df = df.withColumn("evidence", F.array_compact(F.array(*items)))
    labelled = F.size("label_skills") + F.size("label_tasks") + 1
    covered = F.size(F.filter("evidence", lambda e: e["label_type"].isin("standard_job", "skill", "task")))
    complete = (filled("job_name").cast("int") + filled("job_description").cast("int") + filled("skills").cast("int")
                + filled("experience").cast("int") + (F.col("label_employment") != UNKNOWN).cast("int")) / 5
    df = df.withColumn("_cov", F.least(F.lit(1.0), covered / labelled))
    grade = F.when(F.col("relevance_grade") == "高", 0.25).when(F.col("relevance_grade") == "中", 0.15).when(F.col("relevance_grade") == "低", 0.06).otherwise(0.12)
    score = (F.lit(0.3) + grade + F.least(F.lit(0.1), F.size("label_skills") * 0.02) + F.least(F.lit(0.1), F.size("label_tasks") * 0.03)
             + F.col("_cov") * 0.12 + complete * 0.08)
    score = (F.when(F.col("label_status") == "非目标岗位", F.when(F.col("_web") | F.col("_title"), 0.62).otherwise(0.82))
             .when(F.col("label_status") == "待AI复核", F.least(score, F.lit(0.74))).otherwise(score))
    score = F.when(F.size("evidence") == 0, F.least(score, F.lit(0.5))).otherwise(score)
    return df.withColumns({"evidence_coverage": rnd("_cov", 3), "confidence": rnd(F.greatest(F.lit(0.0), F.least(F.lit(0.95), score)), 3)}
                          ).drop("_full", "_lower", "_title", "_web", "_coll", "_cov")


def minimum_degree(body: str | Column = "job_description", education: str | Column = "education") -> Column:
    """Strictest degree the body asks for; a clause naming a lower one too does not count."""
    firm = F.filter(F.split(F.coalesce(col(body), F.lit("")), r"[\n。；;]"), lambda s: ~s.rlike("优先|加分") & ~s.rlike("本科|大专"))
    asks = lambda d: F.exists(firm, lambda s: s.rlike(f"{d}(?:研究生)?(?:及以上|以上|学历|在读|学位)"))
    return F.when(asks("博士"), "博士").when(asks("硕士"), "硕士").otherwise(F.coalesce(col(education), F.lit("")))


def profile_from_text(df: DataFrame, body: str = "text", role_rules: Rules | None = None) -> DataFrame:
    """Education, student flag, graduation year, preference and target roles of a résumé text."""
    if role_rules is None:
        role_rules = tables.ignoring_case([
            ("智能体/大模型应用", "智能体|" + word("agent") + "|LLM|大模型应用"),
            ("后端开发", r"后端|Python\s*开发"),
            ("数据分析", "数据分析"),
            ("嵌入式开发", "嵌入式"),
        ])
    raw = F.coalesce(F.col(body), F.lit(""))
    head = F.array_join(F.slice(F.split(raw, "\n"), 1, 7), " ")
    intent = F.coalesce(F.nullif(F.regexp_extract(raw, r"求职意向[^\n]{0,100}", 0), F.lit("")), head)
    year = F.coalesce(F.nullif(F.regexp_extract(raw, r"(20\d{2})\s*届", 1), F.lit("")),
                      F.nullif(F.regexp_extract(raw, r"(20\d{2})[.年/-]\s*\d{1,2}\s*[（(]?预计", 1), F.lit("")))
    return df.withColumns({
        "profile_education": F.when(head.contains("博士"), "博士").when(head.rlike("硕士|研究生"), "硕士").when(raw.contains("本科"), "本科")
        .when(raw.contains("大专"), "大专").otherwise(""),
        "profile_student": raw.rlike(r"在校|在读|本科生|预计.{0,8}毕业|毕业.{0,8}预计|\d{4}[.年/-]\d{1,2}\s*[（(]预计"),
        "profile_graduation_year": year.try_cast("int"),
        "profile_preference": F.when(intent.rlike(r"(?i)实习生|求职意向[^\n]{0,60}实习|意向[^\n]{0,30}intern"), "实习").otherwise(UNKNOWN),
        "profile_roles": hits(intent, role_rules)})


def resume_skills(body: str | Column, names: Sequence[str]) -> Column:
    """Named skills in the lines of a résumé that do not disclaim them."""
    lines = F.filter(F.split(F.coalesce(col(body), F.lit("")), r"[\n。；;]"),
                     lambda s: ~s.rlike("不熟悉|不会|未掌握|未接触|没有.{0,8}经验|计划学习|准备学习|待学习"))
    kept = F.array_join(lines, "\n")
    return hits(kept, [(n, _skill_pattern(n)) for n in names])
