"""I: keyword and phrase mining, and matching postings against what was mined.

Term tables are built once per corpus: every text becomes a distinct term array inside
its row, terms are exploded and counted with early combination, and only candidate terms
(bounded lists) go back to the postings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.core import SPACE, compact, filled, first_per_key, halfwidth, let, rnd, shuffle_width, text, top_rows
from hirelens.functions.labels import hits
from hirelens.functions.text import cjk_pairs, duties_text, phrase_text, phrases, sections, tokens
from hirelens.operators.clean import match_key
from hirelens.operators.sample import hash_bucket
from hirelens.session import cut_lineage

Rules = Sequence[tuple[str, str]]


# Words that say nothing about an occupation.
STOP_WORDS = (
    "岗位 工作 负责 完成 参与 协助 公司 相关 要求 任职 优先 熟悉 掌握 能力 经验 本科 以上 学历 专业 团队 使用 具备 良好 实习 实习生 内容 技术 工具 模型 数据 项目 学习 支持 优化 流程 进行 输出 "
    "以及 包括 等 设计 制作 创作 ai aigc 业务 场景 应用 落地 持续 基于 迭代 智能 知识 方案 产品 平台 系统 开发 工程师 客户 服务 需求 实现 建设 管理 维护 解决 结合 提升 推动 核心 领域 实际 问题 高效 "
    "任务 日常 其他 各类 不断 通过 对接 协作 沟通 质量 效果 方向 规划 工作职责 岗位职责 任职要求 职位要求").split()


def term_documents(df: DataFrame, body: Column | None = None, longest: int = 12, stop: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Rows with `words` in order, without stop words, and distinct `terms`: words and the 2 to 3 word phrases that stand in the text."""
    df = df.withColumn("_src", body if body is not None else duties_text())
    df = df.withColumn("words", term_words(F.col("_src"), stop))
    return df.withColumn("terms", F.array_distinct(F.concat("words", phrases("words", compact(halfwidth("_src")), longest)))).drop("_src")


def term_words(body: Column, stop: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Words of a text in order, without stop words."""
    return F.filter(tokens(body, "words"), lambda w: ~w.isin(*stop)) if stop else tokens(body, "words")


def document_frequency(df: DataFrame, name: str = "df") -> DataFrame:
    return df.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias(name))


def _sizes(seeds: DataFrame, other: DataFrame) -> DataFrame:
    return seeds.agg(F.count(F.lit(1)).alias("_seeds")).crossJoin(F.broadcast(other.agg(F.count(F.lit(1)).alias("_rows"))))


def _counted(seeds: DataFrame, other: DataFrame, name: str, least: int) -> DataFrame:
    """Terms of at least `least` seeds with their counts on both sides, which are added up before anything moves."""
    side = lambda d, a, b: d.select(F.explode("terms").alias("term"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    both = side(seeds, 1, 0).unionByName(side(other, 0, 1))
    return both.groupBy("term").agg(F.sum("_a").alias("seed_df"), F.sum("_b").alias(name)).filter(F.col("seed_df") >= least)


def tfidf_keywords(seeds: DataFrame, background: DataFrame, k: int | None = 100, least: int = 2) -> DataFrame:
    """Seed rate × smoothed inverse background frequency, the k best terms seen in two seeds."""
    out = _counted(seeds, background, "background_df", least).crossJoin(F.broadcast(_sizes(seeds, background)))
    score = F.col("seed_df") / F.col("_seeds") * (F.log((F.col("_rows") + 1) / (F.col("background_df") + 1)) + 1)
    out = out.withColumn("score", rnd(score, 6)).filter("score > 0")
    return top_rows(out, [F.col("score").desc(), F.col("term")], k, "rank") if k else out


def contrast_keywords(seeds: DataFrame, negatives: DataFrame, k: int | None = 100, least: int = 2) -> DataFrame:
    """Smoothed log-odds against the negatives × seed rate."""
    out = _counted(seeds, negatives, "negative_df", least).crossJoin(F.broadcast(_sizes(seeds, negatives)))
    a, b = F.col("seed_df"), F.col("negative_df")
    odds = F.log(((a + 0.5) / (F.col("_seeds") - a + 0.5)) / ((b + 0.5) / (F.col("_rows") - b + 0.5)))
    out = out.withColumn("score", rnd(odds * a / F.col("_seeds"), 6)).filter("score > 0")
    return top_rows(out, [F.col("score").desc(), F.col("term")], k, "rank") if k else out


def word_centrality(docs: DataFrame, window: int = 4, rounds: int = 40, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Centrality of words in the co-occurrence graph, (word, centrality).

    Edges are distinct word pairs within the window. A round is one join and one sum per
    word; values are checkpointed every few rounds so the plan does not grow.
    """
    # Single words are taken by place: a slice copies the whole list each time.
    near = let(F.col("words"), lambda w: F.flatten(F.transform(w, lambda a, i: F.array(*[F.struct(a.alias("a"), F.get(w, i + n).alias("b")) for n in range(1, window + 1)]))))
    pairs = docs.select(F.explode(near).alias("p")).select("p.a", "p.b").filter("a <> b").distinct()
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("_d"))
    # One weight per edge: what the far end hands over.
    edges = cut_lineage(edges.join(degree.select(F.col("a").alias("b"), (damping / F.col("_d")).alias("_w")), "b").select("a", "b", "_w"))
    rank = cut_lineage(degree.select(F.col("a").alias("word"), F.lit(1.0).alias("centrality")))
    for i in range(rounds):
        given = edges.join(rank, edges["b"] == rank["word"]).groupBy("a").agg(F.sum(F.col("_w") * F.col("centrality")).alias("_in"))
        rank = given.select(F.col("a").alias("word"), (F.lit(1 - damping) + F.col("_in")).alias("centrality"))
        if (i + 1) % every == 0:
            rank = cut_lineage(rank)
    return rank


def _runs(words: Column, n: int) -> Column:
    """Every word with its n - 1 followers, nulls beyond the end."""
    return let(words, lambda w: F.transform(w, lambda a, i: F.array(a, *[F.get(w, i + j) for j in range(1, n)])))


def textrank_keywords(seeds: DataFrame, k: int | None = 100, least: int = 2, rounds: int = 40, longest: int = 12) -> DataFrame:
    """Terms by the centrality of their words, shortened for length, × seed rate; `longest` as in `term_documents`."""
    central = word_centrality(seeds, rounds=rounds)
    sd = document_frequency(seeds, "seed_df").filter(F.col("seed_df") >= least)
    # A term is its own word, or the words of the phrase it was built from.
    run = seeds.select(F.explode(_runs(F.col("words"), 3)).alias("r"))
    piece = F.explode(F.filter(F.array(*[F.when(F.col("r")[n - 1].isNotNull(), F.slice("r", 1, n)) for n in (1, 2, 3)]), lambda p: p.isNotNull()))
    # Phrases longer than any term are none; equal pieces are one before they move.
    parts = run.select(piece.alias("parts")).withColumn("term", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(phrase_text(F.col("parts"))))
    parts = parts.filter((F.size("parts") == 1) | (F.length("term") <= longest)).distinct()
    spelled = parts.join(sd.select("term"), "term", "left_semi").groupBy("term").agg(F.min("parts").alias("parts"))
    total = seeds.agg(F.count(F.lit(1)).alias("_seeds"))
    summed = spelled.select("term", F.explode("parts").alias("word")).join(central, "word").groupBy("term").agg(F.sum("centrality").alias("_c"))
    out = sd.join(summed, "term").crossJoin(F.broadcast(total))
    score = F.col("_c") / F.greatest(F.lit(1.0), F.length("term") / 2) * F.col("seed_df") / F.col("_seeds")
    out = out.withColumn("score", rnd(score, 6)).filter("score > 0")
    return top_rows(out, [F.col("score").desc(), F.col("term")], k, "rank") if k else out


def fuse_keywords(lists: Sequence[DataFrame], k: int = 40) -> DataFrame:
    """Reciprocal rank fusion of keyword lists (top-k lists, so bounded)."""
    every = None
    for one in lists:
        part = one.select("term", "seed_df", (1 / (60 + F.col("rank"))).alias("_r"))
        every = part if every is None else every.unionByName(part)
    g = every.groupBy("term").agg(F.max("seed_df").alias("seed_df"), F.sum("_r").alias("score"))
    return top_rows(g, [rnd("score", 10).desc(), F.col("term")], k, "rank")


def learn_role_keywords(df: DataFrame, title_pattern: str, algorithm: str = "tfidf", k: int = 40, lift: float = 2.5, support: float = 0.02, rounds: int = 40, least_seeds: int = 5) -> DataFrame:
    """I4: keywords of an occupation from its title seeds, one seed per duty text; fewer than `least_seeds` seeds are refused."""
    docs = term_documents(df)
    # Texts are told apart before their terms are taken, so that terms never move.
    seed = df.filter(F.col("job_name").rlike(title_pattern)).withColumn("_key", match_key(duties_text())).filter(F.length("_key") > 0).withColumn("_body", F.sha2("_key", 256)).drop("_key")
    seeds = term_documents(first_per_key(seed, ["_body"], [F.col("seq")]).drop("_body"))
    if seeds.limit(least_seeds).count() < least_seeds:
        raise ValueError(f"fewer than {least_seeds} seeds")
    if algorithm == "contrast":
        ranked = contrast_keywords(seeds, term_documents(df.filter(~F.col("job_name").rlike(title_pattern))), 100)
    elif algorithm == "tfidf":
        ranked = tfidf_keywords(seeds, docs, 100)
    elif algorithm == "textrank":
        ranked = textrank_keywords(seeds, 100, rounds=rounds)
    elif algorithm == "fusion":
        ranked = fuse_keywords([tfidf_keywords(seeds, docs, 100), textrank_keywords(seeds, 100, rounds=rounds)], 200)
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    ranked = cut_lineage(ranked.select("term", "score", "seed_df", "rank"))
    bd = docs.select(F.explode("terms").alias("term")).join(F.broadcast(ranked.select("term")), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("background_df"))
    out = ranked.join(bd, "term").crossJoin(F.broadcast(_sizes(seeds, docs)))
    out = out.withColumn("lift", (F.col("seed_df") / F.col("_seeds")) / (F.col("background_df") / F.col("_rows")))
    out = out.filter((F.col("seed_df") >= F.greatest(F.lit(2), F.ceil(F.col("_seeds") * support))) & (F.col("lift") >= lift))
    return top_rows(out, [F.col("rank")], k).drop("_seeds", "_rows")


def match_keywords(df: DataFrame, keywords: DataFrame, minimum: int = 2, body: Column | None = None, block_bytes: int = 1 << 25) -> DataFrame:
    """Postings with enough independent keyword hits; a keyword inside a longer hit does not count.

    Every text is read once by an automaton of all keywords, whatever their number; keywords of more
    than `block_bytes` go through in several automata, which bounds what a task holds.
    """
    words = cut_lineage(keywords.select(F.lower(F.regexp_replace(halfwidth("term"), SPACE, "")).alias("w")).filter("w <> ''").distinct())
    size = words.agg(F.coalesce(F.sum(F.octet_length("w") + 32), F.lit(0))).first()[0]
    parts = max(1, -(-size // block_bytes))
    out = df.withColumns({"_s": match_key(body if body is not None else duties_text()), "_hits": F.array().cast("array<string>")})
    for i in range(parts):
        some = [r["w"] for r in words.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == i).collect()]
        if some:
            out = out.withColumn("_hits", F.concat("_hits", keyword_finder(df.sparkSession, some)(F.col("_s"))))
    out = out.withColumn("_hits", F.array_sort("_hits"))
    out = out.withColumn("keyword_hits", F.filter("_hits", lambda w: ~F.exists("_hits", lambda o: (o != w) & o.contains(w))))
    return out.withColumn("matched", F.size("keyword_hits") >= minimum).drop("_s", "_hits")


def keyword_finder(spark: SparkSession, words: Sequence[str]):
    """A column function from a text to the distinct words it contains: one automaton per worker, Arrow batches of texts."""
    sent = spark.sparkContext.broadcast(list(words))
    made: list = []

    def found(texts: pd.Series) -> pd.Series:
        if not made:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in sent.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            made.append(automaton)
        return texts.map(lambda t: sorted({w for _, w in made[0].iter(t)}) if t else [])

    return F.pandas_udf(found, "array<string>")


# Clauses of the creative occupation.
OBJECT = "短剧|漫剧|分镜|剧本|成片|视频|镜头|动画|短片|宣传片"
MAKE = "制作|创作|剪辑|撰写|拍摄|生成|产出|绘制|设计|编写|执导|导演"
MODEL_WORK = "标注|质检|评测|训练数据|模型训练|算法研发|数据集|架构|准入标准|工具清单"
REAL_WORK = "制作.{0,16}成片|剪辑.{0,16}成片|独立.{0,12}(?:创作|制作)|撰写.{0,12}(?:剧本|分镜)|剧本.{0,12}撰写"
COMPANY = "公司简介|公司介绍|我们是|致力于|服务全球"
EXCLUDED_TITLE = "标注|评测|训练师|数据处理|数据训练|模型训练|算法|运维|架构|研发|技术支持|技术支撑|办公|生态经理|测试|产品经理|产品实习|法务|合规|律师"
STRICT_MODEL_WORK = (MODEL_WORK + "|质量评估|评估标准|效果比对|评估结论|工具产品|功能模块|维护|归档|备份|格式转换|测试报告|合规筛查|版权归属|素材授权链|内容合规风控")
THING = "(?:视频|短剧|漫剧|动画|剧本|分镜|成片|镜头|短片)"
DOING = "(?:制作|创作|剪辑|拍摄|绘制|编写|撰写|执导|导演)"


def production_evidence(body: Column | None = None, strict: bool = False) -> Column:
    """Sentences that state real production duties."""
    t = body if body is not None else duties_text()
    lines = F.filter(F.transform(F.split(F.regexp_replace(t, "(?s)(?:任职条件|工作要求|基本要求|任职资格|岗位资格).*$", "") if strict else t, r"[\n。；;]"), F.trim), lambda s: s != "")
    if strict:
        return F.filter(lines, lambda s: ~s.rlike(COMPANY) & ~s.rlike(STRICT_MODEL_WORK) & (
            s.rlike(f"{DOING}.{{0,24}}{THING}|{THING}.{{0,24}}(?:制作|创作|剪辑|拍摄|绘制|编写|撰写|执导)") | s.rlike("生成.{0,12}(?:视频|镜头|画面|素材)|(?:视频|镜头|画面|素材).{0,12}生成")))
    return F.filter(lines, lambda s: s.rlike(OBJECT) & s.rlike(MAKE) & ~(s.rlike(MODEL_WORK) & ~s.rlike(REAL_WORK)) & ~s.rlike(COMPANY))


def strict_seed(title: str = "job_name") -> Column:
    """Title names the creative occupation, does not exclude it, and the duties prove it."""
    t = halfwidth(title)
    creative = t.rlike("制作|创作|剪辑|编导|导演|编剧|生成|分镜|后期|编辑|主编|抽卡|绘图") | t.rlike("(?i)(?:AI|AIGC)\\s*漫剧(?:师|实习生)")
    return t.rlike(r"(?i)(?:AI|AIGC)\s*(?:短剧|漫剧)|漫剧") & creative & ~t.rlike(EXCLUDED_TITLE) & (F.size(production_evidence(strict=True)) > 0)


def learn_seed_model(df: DataFrame, groups: DataFrame, seed: Column, algorithm: str = "tfidf", k: int = 40, most_seeds: int = 32, node: str = "job_id", rounds: int = 40, least_seeds: int = 5) -> DataFrame:
    """Keywords from one seed per duplicate group of the 60% training groups; none from fewer than `least_seeds` seeds.

    groups: (node, group) of B22, built without looking at labels. The model is fitted on at
    most `most_seeds` seeds, those with the smallest hash of their body.
    """
    rows = df.join(groups, node).filter(hash_bucket("group", 10) < 6)
    order = F.sha2(match_key("job_description", True), 256)
    seeds = first_per_key(rows.filter(seed).withColumn("_o", order), ["group"], [F.col("_o"), F.col(node)])
    train, seeds = term_documents(rows), cut_lineage(term_documents(seeds.orderBy("_o", node).limit(most_seeds).drop("_o")))
    if seeds.count() < least_seeds:
        seeds = seeds.limit(0)
    if algorithm == "tfidf":
        return tfidf_keywords(seeds, train, k)
    if algorithm == "textrank":
        return textrank_keywords(seeds, k, rounds=rounds)
    return fuse_keywords([tfidf_keywords(seeds, train, 100), textrank_keywords(seeds, 100, rounds=rounds)], k)


def match_seed_model(df: DataFrame, keywords: DataFrame, minimum: int = 2) -> DataFrame:
    """Strict seeds always match; others need keyword hits and production duties, and no excluded title."""
    df = match_keywords(df, keywords, minimum).withColumns({"_direct": strict_seed(), "_proof": F.size(production_evidence(strict=True)) > 0, "_out": halfwidth("job_name").rlike(EXCLUDED_TITLE)})
    return df.withColumn("matched", F.col("_direct") | (~F.col("_out") & F.col("matched") & F.col("_proof"))).drop("_direct", "_proof", "_out")


def topic_keywords(df: DataFrame, seed: Column, anchor: str, tokens_col: Column | None = None, k: int = 36) -> DataFrame:
    """I8: strong and supporting topic terms by lift, seed rate and overall rate."""
    toks = tokens_col if tokens_col is not None else tokens(F.concat_ws("。", F.coalesce("job_name", F.lit("")), F.coalesce("skills", F.lit(""))))
    rows = df.select(F.array_distinct(toks).alias("terms"), seed.alias("_seed"))
    sizes = rows.agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_seed").alias("_seeds"))
    g = rows.select(F.explode("terms").alias("name"), "_seed").groupBy("name").agg(F.count(F.lit(1)).alias("total_count"), F.count_if("_seed").alias("seed_count"))
    g = g.filter("seed_count > 0").crossJoin(F.broadcast(sizes))
    sr, gr = F.col("seed_count") / F.col("_seeds"), F.col("total_count") / F.col("_rows")
    g = g.withColumns({"sr": sr, "gr": gr, "lf": sr / F.greatest(gr, 1 / F.col("_rows"))})
    idf = F.log((F.col("_rows") + 1) / (F.col("total_count") + 1)) + 1
    g = g.filter((F.col("_seeds") >= 5) & (F.col("seed_count") >= F.greatest(F.lit(3), F.ceil(F.col("_seeds") * 0.015))) & F.col("name").rlike(anchor) & (F.col("sr") >= 0.025) & (F.col("lf") >= 1.8) & (F.col("gr") <= 0.35))
    g = g.select("name", F.when((F.col("lf") >= 2.2) & (F.col("gr") <= 0.28) & (F.col("sr") >= 0.035), "strong").otherwise("supporting").alias("strength"), "seed_count", "total_count",
                 rnd("sr", 3).alias("seed_rate"), rnd("gr", 3).alias("global_rate"), rnd("lf", 2).alias("lift"), rnd(F.col("sr") * idf * F.log1p("lf"), 4).alias("score"))
    kept = first_per_key(g, ["strength"], [F.col("score").desc(), F.col("lift").desc(), F.col("seed_count").desc(), F.col("name")], 24)
    return top_rows(kept, [F.col("score").desc(), F.col("name")], k, "rank")


def match_topics(df: DataFrame, topics: DataFrame, direct: Column) -> DataFrame:
    """I8: core words, then one strong signal, then combinations of topic terms."""
    lists = topics.groupBy().agg(*[F.array_sort(F.collect_set(F.when(F.col("strength") == s, F.col("name")))).alias(f"_{s}") for s in ("strong", "supporting")])
    df = df.crossJoin(F.broadcast(lists)).withColumns({
        "_sig": tokens(F.concat_ws("。", F.coalesce("job_name", F.lit("")), F.coalesce("skills", F.lit("")))),
        "_any": tokens(F.concat_ws("。", F.coalesce("job_name", F.lit("")), F.coalesce("skills", F.lit("")), F.substring(F.coalesce("job_description", F.lit("")), 1, 2200)))})
    n = lambda a, b: F.size(F.array_intersect(a, b))
    method = (F.when(direct, "核心词直接命中").when(n("_strong", "_sig") > 0, "高区分度主题词命中")
              .when((n("_strong", "_any") >= 2) | (n("_supporting", "_sig") >= 2) | (n("_supporting", "_any") >= 3), "多个主题词联合命中").otherwise("未匹配"))
    return df.withColumn("match_method", method).withColumn("matched", F.col("match_method") != "未匹配").drop("_strong", "_supporting", "_sig", "_any")


def joint_expansion(df: DataFrame, seed: Column, skills: Rules, tasks: Rules) -> tuple[DataFrame, DataFrame]:
    """Learnt skill and duty rules with their rates, and postings holding one of each.

    One pass counts every rule; the surviving rule names are a bounded list sent back.
    """
    source = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("job_name", "skills", "job_description")])
    rules = [("skill", n, p) for n, p in skills] + [("task", n, p) for n, p in tasks]
    tagged = df.withColumn("_src", source)
    flags = tagged.select(seed.alias("_seed"), *[F.col("_src").rlike(p).alias(f"r{i}") for i, (_, _, p) in enumerate(rules)])
    wide = flags.agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_seed").alias("_seeds"), *[F.count_if(F.col(f"r{i}") & F.col("_seed")).alias(f"s{i}") for i in range(len(rules))],
                     *[F.count_if(f"r{i}").alias(f"t{i}") for i in range(len(rules))])
    long = wide.select("_rows", "_seeds", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(f"s{i}").alias("seed_count"), F.col(f"t{i}").alias("total_count")) for i, (k, n, _) in enumerate(rules)])))
    sr = F.col("seed_count") / F.greatest(F.lit(1), F.col("_seeds"))
    lf = sr / F.greatest(F.col("total_count") / F.greatest(F.lit(1), F.col("_rows")), 1 / F.greatest(F.lit(1), F.col("_rows")))
    rate, lift = F.when(F.col("kind") == "skill", 0.03).otherwise(0.08), F.when(F.col("kind") == "skill", 0.0).otherwise(1.5)
    long = long.withColumns({"seed_rate": rnd(sr, 3), "lift": rnd(lf, 2)})
    model = long.filter((F.col("_seeds") >= 5) & (F.col("seed_count") >= F.greatest(F.lit(2), F.ceil(F.col("_seeds") * rate))) & (F.col("seed_rate") >= rate) & (F.col("lift") >= lift)).select("kind", "name", "seed_count", "total_count", "seed_rate", "lift")
    names = {(r["kind"], r["name"]) for r in model.select("kind", "name").collect()}
    keep = lambda kind, rs: [(n, p) for n, p in rs if (kind, n) in names]
    none = F.array().cast("array<string>")
    ks, kt = keep("skill", skills), keep("task", tasks)
    out = tagged.withColumns({"joint_skills": hits(F.col("_src"), ks) if ks else none, "joint_tasks": hits(F.col("_src"), kt) if kt else none})
    return model, out.withColumn("matched", (F.size("joint_skills") > 0) & (F.size("joint_tasks") > 0)).drop("_src")


# Context patterns of the engineering evidence rules.
DOMAIN = r"(?i)(?<![A-Za-z0-9_])agents?(?![A-Za-z0-9_])|智能体|(?<![A-Za-z0-9_])rag(?![A-Za-z0-9_])|检索增强生成|大模型|大语言模型|(?<![A-Za-z0-9_])llms?(?![A-Za-z0-9_])|langchain|dify|coze|模型路由|AI\s*(?:App|应用|服务)"
ENGINEERING = "开发|研发|构建|搭建|集成|接入|封装|部署|编排|实现|建设|二次开发|迭代"
TOOLS_ONLY = r"(?i)(?:使用|利用|借助|应用).{0,25}(?:AI\s*Coding|copilot|cursor|代码助手|编程助手)|辅助.{0,8}(?:编程|编码)|提升.{0,12}(?:编码|编程)效率"
FUTURE = "探索|前瞻|了解|兴趣|关注|培养|未来|方向延伸"
WEAK_TERM = "(?i)^(?:api|生成|机制|增强|解析|自主|拆解|提示|问答|检索|微调|上下文|记忆)$"


def role_evidence(df: DataFrame, keywords: Sequence[str], domain: str = DOMAIN, action: str = ENGINEERING, title_bonus: str = "(?i)智能体|agent|大模型应用|AI.?应用", near: int = 65, threshold: float = 4.0,
                  tools_only: str = TOOLS_ONLY, ambiguous: str = FUTURE) -> DataFrame:
    """Include, review or exclude from the best-scored sentence of each posting, inside its row.

    A sentence scores 4 in duties, 3 elsewhere, if it names the domain near an
    engineering action and holds a strong learnt keyword; +1 for the title, +0.5 for two
    hits. Learnt keywords are a bounded parameter list.
    """
    kw = [k.lower() for k in keywords]
    bonus = F.when(F.coalesce("job_name", F.lit("")).rlike(title_bonus), 1.0).otherwise(0.0)

    def judge(s: Column) -> Column:
        q, low = s["quote"], F.lower(F.regexp_replace(s["quote"], SPACE, ""))
        found = F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])") if re.fullmatch("[a-z0-9]+", k) else low.contains(k), F.lit(k)) for k in kw]))
        return F.struct(s["location"].alias("location"), q.alias("quote"), found.alias("found"), F.regexp_instr(q, F.lit(domain)).alias("d"), F.regexp_instr(q, F.lit(action)).alias("a"))

    def score(e: Column) -> Column:
        alone = F.filter(e["found"], lambda w: ~F.exists(e["found"], lambda o: (o != w) & o.contains(w)))
        strong = F.size(F.filter(alone, lambda w: ~w.rlike(WEAK_TERM))) > 0
        close = (e["d"] > 0) & (e["a"] > 0) & (F.abs(e["d"] - e["a"]) <= near)
        tool = e["quote"].rlike(tools_only)
        base = F.when(close & ~tool & ~e["quote"].rlike(ambiguous) & strong, F.when(e["location"] == "duties", 4.0).otherwise(3.0)).otherwise(0.0)
        full = F.when(base > 0, base + bonus + F.when(F.size(alone) >= 2, 0.5).otherwise(0.0)).otherwise(0.0)
        return F.struct(full.alias("score"), ((e["d"] > 0) & (F.size(alone) > 0) & ~tool).alias("maybe"), e["quote"].alias("quote"), e["location"].alias("location"))

    judged = F.transform(F.transform(sections(), judge), score)
    df = df.withColumn("_e", judged).withColumn("evidence_score", F.coalesce(F.array_max(F.transform("_e", lambda e: e["score"])), F.lit(0.0)))
    decision = F.when(F.col("evidence_score") >= threshold, "include").when(F.exists("_e", lambda e: e["maybe"]), "review").otherwise("exclude")
    best = F.array_max(F.transform("_e", lambda e, i: F.struct(e["score"].alias("s"), (-i).alias("i"), e["quote"].alias("quote"))))
    return df.withColumns({"decision": decision, "evidence_quote": F.when(F.col("evidence_score") > 0, best["quote"])}).drop("_e")


def clause_evidence(df: DataFrame, vocabulary: Rules, action: str, responsibility: str, qualification: str, title_conflict: str = "(?!)", not_clause: str = "(?!)") -> DataFrame:
    """Engineered-domain variant: object, action and responsibility in one clause; conflicts go to review."""
    def judge(s: Column) -> Column:
        def one(c: Column) -> Column:
            found = F.size(hits(c, vocabulary)) > 0
            duty = (s["location"] == "duties") | c.rlike(responsibility)
            strong = found & c.rlike(action) & duty & ~c.rlike(qualification) & ~c.rlike(not_clause)
            return F.when(strong, 4).when(found, 2).otherwise(0)
        return F.array_max(F.transform(F.transform(F.split(s["quote"], "[，,]"), F.trim), one))

    best = F.coalesce(F.array_max(F.transform(sections(), judge)), F.lit(0))
    conflict = halfwidth("job_name").rlike(title_conflict)
    df = df.withColumn("evidence_score", best)
    return df.withColumn("decision", F.when((F.col("evidence_score") >= 4) & ~conflict, "include").when(F.col("evidence_score") > 0, "review").otherwise("exclude"))


# Words that mark a phrase as general talk, words that are too general alone, and fragments of compounds.
CLOUD_NOISE = ("负责|熟悉|掌握|具备|优先|相关|以上|能够|要求|经验|学历|本科|硕士|博士|沟通|团队|学习能力|责任心|待遇|福利|五险|一金|公司|招聘|工作地点|完成|参与|协助|以及|包括|进行|良好|扎实|至少|不限|精通|熟练|"
               "了解|理解|主流|skills?|experience|requirements?|responsibilit|proficien|familiar|knowledge|ability|excellent|strong|candidate")
CLOUD_GENERIC = ("业务|场景|开发|设计|维护|优化|管理|建设|实现|系统|平台|技术|工具|应用|服务|需求|工作|模型|数据|工程|分析|处理|使用|支持|目标|任务|and|the|with|for|from|that|this|you|your|our|are|will|have|"
                 "must|can|able|work|team|using|use|develop|build|design|implement|maintain|data|model|system|platform|service|development|business")
CLOUD_FRAGMENT = ("人工|智能|仓库|计算|体系|保障|支撑|性能|标准|机制|结构|稳定|动态|验证|应对|策略|搭建|框架|架构|能力|效率|深度|持续|基础|软件|语言|程序|功能|方法|方向|环节|日常|实际|独立|协作|质量|内容|"
                  "研发|一门|一种|之一|知识|模块|结合|链路|过程|方式|落地|方案|前沿|规范|准确|及时|专业|计算机|计算机科学|软件工程|ai")


def _general(term: Column) -> Column:
    """Noise, or as a whole a general word or a fragment."""
    return term.rlike(f"(?i){CLOUD_NOISE}") | term.rlike(f"(?i)^(?:{CLOUD_GENERIC}|{CLOUD_FRAGMENT})$")


def literal_phrases(body: Column, low: int = 4, high: int = 12) -> Column:
    """Distinct phrases of two and three words with CJK characters, as written."""
    # Texts without CJK characters have none, so their words are not taken.
    words = F.when(body.rlike("[一-鿿]"), tokens(body, "words"))
    made = F.array_distinct(phrases(words, compact(halfwidth(body)), high))
    return F.filter(made, lambda p: (F.length(p) >= low) & p.rlike("[一-鿿]") & ~p.rlike(r"^\d|\d$") & ~_general(p))


def latin_names(body: Column, longest: int = 32) -> Column:
    """Distinct names of one to three latin words with their dots, pluses and slashes, as written."""
    latin = lambda words: "|".join(w for w in words.split("|") if w.isascii())
    noise, general = re.compile(latin(CLOUD_NOISE), re.I), re.compile(f"{latin(CLOUD_GENERIC)}|{latin(CLOUD_FRAGMENT)}", re.I)
    run, blank = re.compile(r"[A-Za-z0-9.+#/-]+"), re.compile(r"[ \t\n\x0b\f\r]+")

    def of(texts: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def fit(w: str) -> bool:
            """A word that starts with a letter, is longer than that, holds no noise and is not general as a whole: a name is as fit as its words."""
            if w not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[w] = len(w) > 1 and w[0].isalpha() and not noise.search(w) and not general.fullmatch(w)
            return known[w]

        out = []
        for t in texts:
            at = [(m.start(), m.end(), fit(m.group())) for m in run.finditer(t or "")]
            # Whether a fit word is followed by another one, with nothing but white space between.
            beside = [f and g and (t[e:i] == " " or blank.fullmatch(t, e, i) is not None) for (_, e, f), (i, _, g) in zip(at, at[1:])]
            names = [t[i:e] for i, e, f in at if f and e - i <= longest]
            names += [t[at[k][0]:at[k + 1][1]] for k, b in enumerate(beside) if b and at[k + 1][1] - at[k][0] <= longest]
            names += [t[at[k][0]:at[k + 2][1]] for k, (b, c) in enumerate(zip(beside, beside[1:])) if b and c and at[k + 2][1] - at[k][0] <= longest]
            out.append(list(dict.fromkeys(names)))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<string>")(body)


def phrase_cloud(df: DataFrame, seed: Column, k: int = 100, ranked: int = 5000, rounds: int = 40, least_seeds: int = 5) -> DataFrame:
    """Display phrases of the seeds by fused weight, fragments of equally frequent longer phrases left out.

    Candidates are the terms, the CJK phrases as written and the latin names; general words
    are none. The two lists that are fused hold their `ranked` best terms; candidates are
    not cut. Fewer than `least_seeds` seeds give no phrase.
    """
    body = F.regexp_replace(F.array_join(F.transform(sections(), lambda s: s["quote"]), "\n"), "\n", " ")
    df = df.withColumns({"_body": body, "_seed": seed})
    docs = term_documents(df, F.col("_body"))
    keyed = df.filter("_seed").withColumn("_w", term_words(F.col("_body"))).filter(F.size("_w") > 0).withColumn("_key", F.sha2(F.array_join("_w", " "), 256)).drop("_w")
    # Seeds and term scores are read several times and written once.
    seeds = cut_lineage(term_documents(first_per_key(keyed, ["_key"], [F.col("seq")]), F.col("_body")).select("seq", "_body", "words", "terms"))
    base = cut_lineage(tfidf_keywords(seeds, docs, None))
    best = top_rows(base, [F.col("score").desc(), F.col("term")], ranked, "rank")
    weights = fuse_keywords([best, textrank_keywords(seeds, ranked, rounds=rounds)], 2 * ranked).select("term", F.col("score").alias("_fused"))
    # As written: equal names in different case or spacing are one, shown by their first form.
    written = lambda d: d.select(F.explode(F.concat(literal_phrases(F.col("_body")), latin_names(F.col("_body")))).alias("name"), "seq").select(compact("name").alias("term"), "name", "seq").groupBy("term", "seq").agg(F.min("name").alias("name"))
    sw = written(seeds).groupBy("term").agg(F.count(F.lit(1)).alias("seed_df"), F.min("name").alias("name")).join(base.select("term"), "term", "left_anti")
    bw = written(df).join(sw.select("term"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("background_df"))
    extra = sw.join(bw, "term").crossJoin(F.broadcast(_sizes(seeds, docs)))
    extra = extra.withColumn("score", rnd(F.col("seed_df") / F.col("_seeds") * (F.log((F.col("_rows") + 1) / (F.col("background_df") + 1)) + 1), 6))
    every = base.select("term", F.col("term").alias("name"), "seed_df", "background_df", "score", "_seeds").unionByName(extra.select("term", "name", "seed_df", "background_df", "score", "_seeds"))
    floor = F.greatest(F.lit(2), F.ceil(F.col("_seeds") * 0.005))
    c = every.filter((F.col("_seeds") >= least_seeds) & (F.col("seed_df") >= floor) & (F.length("term") <= 32) & ~F.col("term").rlike(r"^\d") & ~_general(F.col("term"))).join(weights, "term", "left")
    c = c.withColumn("score", F.col("score") * (1 + 10 * F.coalesce("_fused", F.lit(0.0))) * F.when(F.col("term").rlike("[一-鿿]") & (F.length("term") >= 4), 1.35).otherwise(1.0))
    c = cut_lineage(c.select("term", "name", "seed_df", "background_df", "score"))
    # Longer candidates are reached through their own contiguous pieces: an equi join.
    o = c.select(F.col("term").alias("longer"), F.col("seed_df").alias("o_df"), F.col("score").alias("o_score"))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.length("longer")), lambda i: F.transform(F.sequence(F.lit(1), F.length("longer") - i + 1), lambda n: F.substring(F.col("longer"), i, n))))
    inner = o.select("longer", "o_df", "o_score", F.explode(F.array_distinct(cut)).alias("term")).filter("term <> longer")
    covered = c.join(inner, "term").filter((F.col("o_df") >= F.col("seed_df") * 0.9) & (F.col("o_score") >= F.col("score") * 0.8)).select("term").distinct()
    best = c.join(covered, "term", "left_anti").select(F.col("name").alias("term"), "seed_df", "background_df", "score")
    return top_rows(best, [rnd("score", 8).desc(), F.col("term")], k, "rank")


def category_cloud(df: DataFrame, seed: Column, vocabulary: dict[str, Sequence[str]], k: int = 100, tail: tuple[str, str] | None = None, least: int = 3, rate: float = 0.005) -> DataFrame:
    """Vocabulary terms seen in `least` seeds and in `rate` of them, categories in turn, and a learnt tail for the named category."""
    # Sections are cut once; the passes over the bodies and the seeds read what was written.
    df = df.withColumn("_body", F.array_join(F.transform(sections(), lambda s: s["quote"]), "\n"))
    df = cut_lineage(df.select("seq", "_body", match_key("_body").alias("_text"), seed.alias("_seed"), F.sha2(match_key(duties_text()), 256).alias("_key")))
    docs = term_documents(df, F.col("_body"))
    seeds = cut_lineage(term_documents(first_per_key(df.filter("_seed"), ["_key"], [F.col("seq")]), F.col("_body")).select("_text", "terms"))
    names = [(c, t) for c, ts in vocabulary.items() for t in ts]
    def present(t: str) -> Column:
        key = re.sub(r"\s+", "", t.lower())
        return F.col("_text").rlike(rf"(?<![a-z0-9]){re.escape(key)}(?![a-z0-9])") if re.fullmatch("[a-z0-9]+", key) else F.col("_text").contains(key)

    count = lambda d: d.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(present(t)).alias(f"c{i}") for i, (_, t) in enumerate(names)])
    a, b = count(seeds), count(docs)
    flat = lambda w, n: w.select(F.col("_n").alias(f"{n}_n"), F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), F.col(f"c{i}").alias(n)) for i, (c, t) in enumerate(names)])))
    both = flat(a, "seed_df").join(flat(b, "background_df"), ["category", "term"])
    idf = F.log((F.col("background_df_n") + 1) / (F.col("background_df") + 1)) + 1
    seen = both.filter(F.col("seed_df") >= F.greatest(F.lit(least), F.ceil(F.col("seed_df_n") * rate)))
    scored = seen.select("category", "term", "seed_df", "background_df", rnd(F.col("seed_df") / F.col("seed_df_n") * idf, 6).alias("score"), F.lit("observed_dictionary").alias("source"))
    if tail:
        category, pattern = tail
        known = [re.sub(r"\s+", "", t.lower()) for _, t in names]
        learnt = tfidf_keywords(seeds, docs, None).filter(F.col("term").rlike(pattern) & ~F.col("term").isin(*known) & (F.col("seed_df") >= F.greatest(F.lit(least), F.ceil(F.col("_seeds") * rate))))
        scored = scored.unionByName(learnt.select(F.lit(category).alias("category"), "term", "seed_df", "background_df", "score", F.lit("learned_unknown").alias("source")))
    order = F.lit(99)
    for i, c in enumerate(vocabulary):
        order = F.when(F.col("category") == c, i).otherwise(order)
    turns = first_per_key(scored, ["category"], [F.col("score").desc(), F.col("term")], k, "turn")
    return top_rows(turns, [F.col("turn"), order, F.col("term")], k, "rank")


def pmi_phrases(df: DataFrame, body: Column | None = None, key: str = "job_id", least: int = 5, rate: float = 0.005, pmi: float = 2.0, nested: float = 0.75, k: int = 200) -> DataFrame:
    """Contiguous phrases of two or three words whose weakest adjacent pair is cohesive.

    Adjacency is kept inside sentences. A fragment of a longer phrase found in nearly as
    many texts is dropped; longer phrases reach their fragments by an equi join.
    """
    quotes = F.transform(sections(), lambda s: s["quote"]) if body is None else F.split(body, r"[。；;\n.]")
    seqs = df.repartition(shuffle_width(df), key).select(F.col(key).alias("_key"), F.explode(quotes).alias("q")).select("_key", F.regexp_extract_all(cjk_pairs(F.lower(halfwidth("q"))), F.lit("[a-z0-9]+|[一-鿿]{2}"), 0).alias("w"))
    # Rows of a text move once, together; its words, pairs and triples are then counted where they lie.
    docs = df.count()
    floor = max(least, math.ceil(docs * rate))

    def frequent(parts: Column, n: int, known: DataFrame | None = None) -> DataFrame:
        """Runs of n words in at least `floor` texts, made of frequent shorter ones only."""
        grams = seqs.select("_key", F.explode(parts).alias("parts")).filter(F.col("parts")[n - 1].isNotNull())
        if n > 1:
            grams = grams.filter(F.length(F.array_join("parts", " ")).between(3, 28))
            for i in (1, 2):
                # At most the mean number of grams of a text divided by `rate`, whatever the number of texts.
                side = known.select(F.col("parts").alias("_p"))
                grams = grams.join(F.broadcast(side) if rate else side, F.slice("parts", i, n - 1) == F.col("_p"), "left_semi")
        return grams.groupBy("parts", "_key").agg(F.count(F.lit(1)).alias("_c")).groupBy("parts").agg(F.count(F.lit(1)).alias("df"), F.sum("_c").alias("n"))

    words = cut_lineage(frequent(_runs(F.col("w"), 1), 1))
    single = words.select(F.col("parts")[0].alias("word"), F.col("n").alias("_f"))
    total = words.agg(F.sum("n").alias("_total"))
    pairs = cut_lineage(frequent(_runs(F.col("w"), 2), 2, words.filter(F.col("df") >= floor)).filter(F.col("df") >= floor))
    counts = pairs.unionByName(frequent(_runs(F.col("w"), 3), 3, pairs).filter(F.col("df") >= floor)).withColumn("_docs", F.lit(docs))
    edges = counts.select("parts", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.slice("parts", i, 2))).alias("e"))
    left, right = single.select(F.col("word").alias("l"), F.col("_f").alias("lf")), single.select(F.col("word").alias("r"), F.col("_f").alias("rf"))
    scored = edges.withColumns({"l": F.col("e")[0], "r": F.col("e")[1]}).join(left, "l").join(right, "r").crossJoin(F.broadcast(total))
    weakest = scored.groupBy("parts").agg(F.min(F.log2(F.col("n") * F.col("_total") / (F.col("lf") * F.col("rf")))).alias("pmi"))
    c = cut_lineage(counts.join(weakest, "parts").filter(F.col("pmi") >= pmi).select("parts", "df", "_docs", "pmi"))
    inner = c.filter(F.size("parts") == 3).select(F.col("df").alias("o_df"), F.explode(F.array(F.slice("parts", 1, 2), F.slice("parts", 2, 2))).alias("parts"))
    nested_in = c.join(inner, "parts").filter(F.col("o_df") >= F.col("df") * nested).select("parts").distinct()
    out = c.join(nested_in, "parts", "left_anti").withColumn("score", rnd(F.col("df") / F.col("_docs") * (F.log((F.col("_docs") + 1) / (F.col("df") + 1)) + 1), 8))
    return top_rows(out.select(F.array_join("parts", " ").alias("name"), "df", rnd("pmi", 6).alias("pmi"), "score"), [F.col("score").desc(), F.col("name")], k, "rank")
