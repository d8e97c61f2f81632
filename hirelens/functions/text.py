"""Cutting posting text into sections, sentences, windows and tokens.

Everything here returns columns (arrays where a text has many pieces), so a whole text
is processed in place with no shuffle; callers explode only when rows are wanted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.core import SPACE, col, halfwidth, let, rnd, text

# Section headings, sentence marks and boilerplate openings of posting texts.
HEADINGS = ("岗位职责|工作职责|主要职责|工作内容|岗位定位|职位描述|任职要求|职位要求|岗位要求|任职资格|招聘要求|加分项|优先条件|"
            "公司介绍|公司简介|关于我们|企业介绍|福利待遇|岗位福利|薪酬福利")
ENGLISH_HEADINGS = "Responsibilities|Requirements|Qualifications|About us|Benefits"
EXCLUDED_HEADING = "(?i)公司|企业|关于我们|福利|about us|benefits"
REQUIREMENT_HEADING = "(?i)要求|资格|加分|优先|requirements|qualifications"
SENTENCE_END = r"[。；;\n]"
BOILERPLATE = "^(?:公司|我们)(?:是|成立|致力于)|^(?:薪资|待遇|福利|五险|招聘人数)"
DUTY_START = "岗位职责|工作职责|主要职责|主要工作职责|工作内容|工作任务|你会参与的工作|你将参与|你要做的|你将参与的工作"
DUTY_END = ("任职要求|职位要求|岗位要求|任职资格|岗位任职|我们希望你|我们希望找到|我们需要你|招聘要求|基础要求|岗位福利|福利待遇")
INPUT_START = ("(?i)岗位职责|工作职责|工作内容|岗位内容|职责描述|岗位描述|职位描述|我们需要你|(?:job\\s+)?responsibilities|main\\s+tasks|"
               "job\\s+description")
INPUT_END = ("(?i)任职要求|任职资格|岗位要求|职位要求|招聘条件|我们期望你|教育背景|福利待遇|薪酬福利|(?:key\\s+)?qualifications|"
             "requirements|educational\\s+background|benefits")
FOOTER = "福利待遇|薪酬福利|公司简介|关于我们|联系方式|投递方式"
QUESTION_HINT = "[？?]|如何|怎么|为什么|区别|原理|介绍|讲解|考察|手撕|实现|设计|优化|选型"
QUESTION_MARK = r"^(?:\d{1,3}[.、)）]|[-*•]|问[:：])"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def sections(c: str | Column = "job_description", english: bool = False, keep_excluded: bool = False) -> Column:
    """Array of (location, quote) sentences; company and benefit parts are left out."""
    heading = f"(?i)({HEADINGS}|{ENGLISH_HEADINGS})" if english else f"({HEADINGS})"
    marked = F.regexp_replace(F.coalesce(col(c), F.lit("")), heading, "\u0001$1\u0002")

    def one(part: Column) -> Column:
        # The place of a part is bound: inside the lambda of its sentences it would be looked for in the whole part for each of them.
        head = F.regexp_extract(part, "^([^\u0002]*)\u0002", 1)
        body = F.regexp_replace(part, "^[^\u0002]*\u0002", "")
        place = (F.when(head == "", "unsectioned").when(head.rlike(EXCLUDED_HEADING), "excluded")
                 .when(head.rlike(REQUIREMENT_HEADING), "requirements").otherwise("duties"))
        return let(place, lambda p: F.transform(F.split(body, SENTENCE_END), lambda q: F.struct(p.alias("location"), trimmed(q).alias("quote"))))

    everything = F.flatten(F.transform(F.split(marked, "\u0001"), one))
    return F.filter(everything, lambda s: (s["quote"] != "") & ~s["quote"].rlike(BOILERPLATE)
                    & (F.lit(keep_excluded) | (s["location"] != "excluded")))


def split_sections(df: DataFrame, body: str = "job_description", english: bool = False) -> DataFrame:
    """One row per kept sentence, numbered inside its posting."""
    return (df.select("*", F.posexplode(sections(body, english)).alias("sentence_no", "_s"))
            .select("*", F.col("_s.location").alias("location"), F.col("_s.quote").alias("quote")).drop("_s"))


def sections_text(c: str | Column = "job_description") -> Column:
    return F.array_join(F.transform(sections(c), lambda s: s["quote"]), "\n")


def duties_text(c: str | Column = "job_description") -> Column:
    """C11: from the duty heading to the requirement heading."""
    raw = F.coalesce(col(c), F.lit(""))
    body = F.regexp_replace(raw, f"(?s)^.*?(?=(?:{DUTY_START}))", "")
    return F.regexp_replace(body, f"(?s)(?:{DUTY_END}).*$", "")


def _head_mid_tail(c: Column, limit: int, head: int, half: int, tail: int, glue: str = " … ") -> Column:
    n = F.length(c)
    mid = F.floor(n / 2).cast("int")
    short = F.concat(F.substring(c, 1, head), F.lit(glue), F.substring(c, mid - half + 1, F.lit(2 * half)), F.lit(glue),
                     F.substring(c, n - tail + 1, F.lit(tail)))
    return F.when(n > limit, short).otherwise(c)


def classifier_input(df: DataFrame, title: str = "job_name", body: str = "job_description", contract: str = "v1") -> DataFrame:
    """Text given to the classifiers.

    v1 is title plus compressed duties, v2 adds the scoped detail, interview takes the
    post as it is. Adds input_text, input_body, input_mode and body_chars.
    """
    t, b = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    if contract == "interview":
        clean = lambda c: F.trim(F.regexp_replace(F.lower(halfwidth(c)), rf"{SPACE}+", " "))
        df = df.withColumns({"_title": F.substring(clean(t), 1, 100), "_body": clean(b)})
        excerpt = _head_mid_tail(F.col("_body"), 2400, 1200, 300, 600)
        return df.withColumns({
            "input_body": excerpt, "input_text": F.concat("_title", F.lit("。"), excerpt),
            "input_mode": F.lit("interview"), "body_chars": F.length("_body")}).drop("_title", "_body")
    if contract == "discovery":
        quotes = lambda place: F.filter(F.col("_sec"), lambda s: s["location"] == place)
        df = df.withColumn("_sec", sections(body))
        own = F.when(F.size(quotes("duties")) > 0, quotes("duties")).otherwise(quotes("unsectioned"))
        df = df.withColumn("_body", F.array_join(F.transform(own, lambda s: s["quote"]), "\n"))
        excerpt = _head_mid_tail(F.col("_body"), 420, 160, 65, 130, "\n…\n")
        keep = (F.length(F.regexp_replace("_body", SPACE, "")) >= 100) & (F.length(b) <= 9000) & (F.length(text(title)) > 0)
        return df.filter(keep).withColumns({
            "input_body": excerpt, "input_text": F.concat(F.substring(text(title), 1, 60), F.lit("\n主要职责："), excerpt),
            "input_mode": F.when(F.size(quotes("duties")) > 0, "explicit_duties").otherwise("unsectioned"),
            "body_chars": F.length("_body")}).drop("_sec", "_body")
    df = df.withColumn("_flat", F.trim(F.regexp_replace(b, rf"{SPACE}+", " ")))
    df = df.withColumn("_at", F.regexp_instr("_flat", F.lit(INPUT_START)))
    df = df.withColumn("_part", F.when(F.col("_at") > 0, F.regexp_replace("_flat", f"^.*?(?:{INPUT_START})", "")).otherwise(F.col("_flat")))
    df = df.withColumn("_end", F.regexp_instr("_part", F.lit(INPUT_END)))
    floor = F.when(F.col("_at") > 0, 35).otherwise(50)
    df = df.withColumn("_part", F.when(F.col("_end") - 1 >= floor, F.substring(F.col("_part"), F.lit(1), F.col("_end") - 1)).otherwise(F.col("_part")))
    duties = _head_mid_tail(F.col("_part"), 420, 200, 55, 110)
    head = F.concat(F.substring(t, 1, 60), F.lit("。主要工作："), duties)
    df = df.withColumns({"input_body": duties, "input_text": head, "body_chars": F.length(b),
                         "input_mode": F.when(F.col("_at") > 0, "duties_heading").otherwise("fallback_body")})
    if contract == "v2":
        df = df.withColumn("_foot", F.regexp_instr("_flat", F.lit(FOOTER)))
        detail = F.when(F.col("_foot") - 1 >= 80, F.substring(F.col("_flat"), F.lit(1), F.col("_foot") - 1)).otherwise(F.col("_flat"))
        df = df.withColumn("_detail", _head_mid_tail(detail, 2400, 1200, 300, 600))
        df = df.withColumns({"input_text": F.concat("input_text", F.lit("。岗位与任职要求："), "_detail"),
                             "input_body": F.concat("input_body", F.lit("。"), "_detail"),
                             "input_mode": F.lit("duties-and-requirements-v2")}).drop("_detail", "_foot")
    return df.drop("_flat", "_at", "_part", "_end")


def evidence_options(c: str | Column, most: int = 30, shortest: int = 10, longest: int = 120) -> Column:
    """Array of (id, quote) sentences offered as evidence."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[^。！？\n；;]+[。！？；;]?"), 0)
    kept = F.slice(F.filter(F.transform(found, trimmed), lambda q: F.length(q) >= shortest), 1, most)
    return F.transform(kept, lambda q, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("id"), F.substring(q, 1, longest).alias("quote")))


def _starts(length: Column, step: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(step))


def evidence_windows(c: str | Column, size: int = 480, step: int = 400) -> Column:
    """Every sentence in windows of `size` characters, one every `step`."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[\n。；;]+"), trimmed), lambda q: q != "")
    cut = F.flatten(F.transform(lines, lambda q: F.transform(_starts(F.length(q), step), lambda at: F.substring(q, at + 1, F.lit(size)))))
    return F.transform(cut, lambda q, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("id"), q.alias("quote")))


def question_excerpts(c: str | Column = "content", most: int = 60) -> Column:
    """Distinct question lines of a post."""
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\n+"), trimmed)
    good = F.filter(lines, lambda q: F.length(q).between(4, 420) & q.rlike(QUESTION_HINT) & (q.rlike(QUESTION_MARK) | q.rlike("[？?]")))
    return F.slice(F.array_distinct(F.transform(good, lambda q: F.substring(q, 1, 320))), 1, most)


def question_key(q: Column) -> Column:
    """Comparison form of a question."""
    flat = F.lower(F.regexp_replace(halfwidth(q), SPACE, ""))
    plain = F.regexp_replace(flat, r"^(?:\d{1,3}[.、)）]|[-*•]|问[:：])+", "")
    return F.regexp_replace(plain, r"[，。？?！!、:：；;“”\"'()（）]", "")


def tokens(c: str | Column, mode: str = "terms") -> Column:
    """C20: token arrays.

    terms: distinct latin terms and CJK pairs side by side; words: words in order, latin or
    CJK; mixed: latin, CJK and numbers in order. There is no dictionary segmenter here, so in
    the last two all overlapping pairs of CJK characters stand for words.
    """
    low = F.lower(halfwidth(c))
    if mode == "terms":
        return F.array_distinct(F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9+#.-]*|[一-鿿]{2}"), 0))
    if mode == "words":
        return F.filter(F.regexp_extract_all(cjk_pairs(low), F.lit(r"[a-z0-9]+|[一-鿿]{2}"), 0), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$"))
    if mode == "mixed":
        found = F.regexp_extract_all(cjk_pairs(low), F.lit(r"[a-z][a-z0-9_+#.-]*|[一-鿿]{2}|\d+(?:\.\d+)?"), 0)
        return F.filter(found, lambda w: (F.length(w) > 1) | w.isin("c", "r"))
    raise ValueError(f"unknown token mode {mode}")


def cjk_pairs(c: Column) -> Column:
    """A text with every overlapping pair of CJK characters written apart: 大数据 is 大数 数据."""
    return F.regexp_replace(c, "([一-鿿])(?=([一-鿿]))", "$1$2 ")


def phrase_text(words: Column) -> Column:
    """Neighbouring words as one phrase; CJK pairs that overlap give their characters once."""
    add = lambda a, w: F.when((F.substring(a, -1, 1) == F.substring(w, 1, 1)) & w.rlike("^[一-鿿]"), F.concat(a, F.substring(w, 2, 1 << 20))).otherwise(F.concat(a, w))
    plain = F.array_join(words, "")
    return F.when(plain.rlike("[一-鿿]"), F.aggregate(words, F.lit(""), add)).otherwise(plain)


def phrases(words: str | Column, within: Column, longest: int = 12, sizes: tuple[int, ...] = (2, 3), few: int = 200) -> Column:
    """C20: phrases of neighbouring words, up to `longest` characters, that stand in the text `within` (lower case, no white space).

    The work for a text grows with its length, not with its length times its words: up to `few` phrases of
    a length are searched for one by one, more are met with all pieces of the text of that length.
    """
    cjk = re.compile("[一-鿿]").search

    def spelled(ws: Sequence[str]) -> str:  # as phrase_text
        out = ""
        for w in ws:
            out += w[1:] if "一" <= w[:1] <= "鿿" and out[-1:] == w[:1] else w
        return out

    def standing(wanted: set[str], t: str) -> set[str]:
        by_length: dict[int, set[str]] = {}
        for p in wanted:
            by_length.setdefault(len(p), set()).add(p)
        out: set[str] = set()
        for n, some in by_length.items():
            out |= {p for p in some if p in t} if len(some) <= few else some.intersection(t[i:i + n] for i in range(len(t) - n + 1))
        return out

    def in_place(ws: list[str], t: str, lengths: list[int]) -> list[bool]:
        """Whether a word is followed at once by the next one, as met walking through the text. Words that are not met so are looked for."""
        at, places = 0, []
        for w, n in zip(ws, lengths):
            i = t.find(w, at)
            places.append(i)
            if i >= 0:
                at = i + n
        return [i >= 0 and j == i + n for i, j, n in zip(places, places[1:], lengths)]

    def of(many: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for ws, t in zip(many, texts):
            ws = [] if ws is None or t is None else list(ws)
            if sizes == (2, 3) and ws and not cjk(t):
                # Words without CJK characters are put together as they are; what stands at its own place need not be looked for.
                lengths = list(map(len, ws))
                beside = in_place(ws, t, lengths)
                two = [(a + b, j) for a, b, m, n, j in zip(ws, ws[1:], lengths, lengths[1:], beside) if m + n <= longest]
                three = [(a + b + c, j and k) for a, b, c, m, n, o, j, k in zip(ws, ws[1:], ws[2:], lengths, lengths[1:], lengths[2:], beside, beside[1:]) if m + n + o <= longest]
                there = {p for p, j in two if j}
                there.update(p for p, j in three if j)
                wanted = {p for some in (two, three) for p, j in some if not j and p not in there}
                if wanted:
                    there |= standing(wanted, t)
                out.append([p for some in (two, three) for p, _ in some if p in there])
                continue
            made = [p for n in sizes for p in map(spelled, zip(*[ws[i:] for i in range(n)])) if len(p) <= longest]
            there = standing(set(made), t) if made else ()
            out.append([p for p in made if p in there])
        return pd.Series(out, dtype=object)

    # Not deterministic for the planner: filters on the terms would otherwise read every text once more. Filter rows before.
    return F.pandas_udf(of, "array<string>").asNondeterministic()(col(words), within)


def text_windows(df: DataFrame, body: str = "job_description", size: int = 350, overlap: int = 40) -> DataFrame:
    """Overlapping windows covering the whole text: window_no, window_start, window_end, window_text."""
    step = size - overlap
    n = F.length(F.coalesce(F.col(body), F.lit("")))
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    df = df.select("*", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return df.withColumns({
        "window_start": F.col("window_no") * step,
        "window_end": F.least(F.col("window_no") * step + size, n),
        "window_text": F.substring(F.coalesce(F.col(body), F.lit("")), F.col("window_no") * step + 1, F.lit(size))})


def char_grams(c: str | Column, low: int, high: int) -> Column:
    """All character n-grams of a text, lengths low to high, with repeats.

    A look-ahead walks the text once per length; substring by position would walk it
    from the start for every gram.
    """
    t = F.coalesce(col(c), F.lit(""))
    parts = [F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]
