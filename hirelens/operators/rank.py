"""G: ranking, retrieval and top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelens.core import SPACE, compact, filled, first_per_key, halfwidth, hot_key_join, position_within, rnd, text, top_rows
from hirelens.functions.text import sections, tokens
from hirelens.operators import scans
from hirelens.operators.stats import narrowed_quantile
from hirelens.session import cut_lineage

# Weight and scale anchor of each engagement counter.
METRICS = [("view_count", 0.15, 1000), ("like_count", 0.2, 20), ("collect_count", 0.4, 20), ("total_comment_count", 0.25, 10)]


def influence_rank(df: DataFrame, now: str, half_life: float = 180.0, role: str = "role_key", ident: str = "id", created: str = "created_at") -> DataFrame:
    """G1: engagement score per post, ranked inside its role; posts that cannot be scored come last.

    Adds score, rank, relative_weight, coverage, cohort_size, confidence, exclusion and
    place (the total order by role). Medians and sums are per-role aggregates joined back;
    ranks are exact positions, so a role holding most posts is spread over many tasks.
    """
    key = F.trim(halfwidth(role))
    age = (F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("double") - F.col(created).cast("timestamp").cast("double")) / 86400
    known = [F.when(F.col(m) >= 0, F.col(m).cast("double")) for m, _, _ in METRICS]
    cover = sum((F.when(k.isNotNull(), w).otherwise(0.0) for k, (_, w, _) in zip(known, METRICS)), F.lit(0.0))
    df = df.withColumns({"_role": key, "_age": age, "coverage": cover, **{f"_m{i}": F.log1p(k) for i, k in enumerate(known)}})
    df = df.withColumn("exclusion", F.array_join(F.array_compact(F.array(
        F.when(F.col("_role") == "", "missing-role"), F.when(F.col(created).isNull(), "missing-date"), F.when(F.col("_age") < 0, "future-date"), F.when(F.col("coverage") == 0, "missing-all-metrics"))), ","))
    good = df.filter("exclusion = ''")
    counters = good.select("_role", F.posexplode(F.array(*[F.col(f"_m{i}") for i in range(len(METRICS))])).alias("_i", "_v"))
    medians = narrowed_quantile(counters, "_v", 0.5, ["_role", "_i"])
    middle = [F.coalesce(F.max(F.when(F.col("_i") == i, F.col("value"))), F.lit(0.0)) for i in range(len(METRICS))]
    scales = good.groupBy("_role").agg(F.count(F.lit(1)).alias("cohort_size")).join(
        medians.groupBy("_role").agg(*[F.greatest(F.lit(math.log1p(a)), m).alias(f"_s{i}") for i, (m, (_, _, a)) in enumerate(zip(middle, METRICS))]), "_role")
    rows = good.join(scales, "_role")
    part = lambda i, w: F.when(F.col(f"_m{i}").isNotNull(), w * -F.expm1(-F.least(F.col(f"_m{i}") / F.col(f"_s{i}"), F.lit(3.0)))).otherwise(0.0)
    weighted = sum((part(i, w) for i, (_, w, _) in enumerate(METRICS)), F.lit(0.0))
    score = 100 * weighted / F.col("coverage") * F.sqrt("coverage") * F.pow(F.lit(2.0), -F.col("_age") / half_life)
    rows = rows.withColumn("score", score).withColumn("_down", -F.col("score"))
    # Numbering reads its input several times; the scored rows are written once for it.
    rows = cut_lineage(rows)
    totals = rows.groupBy("_role").agg(F.sum("score").alias("_sum"))
    ranked = position_within(rows.withColumn("_id", F.col(ident)), [("_down", True), ("_id", True)], ["_role"], "rank").join(totals, "_role")
    confidence = F.when(F.col("cohort_size") < 10, "small-cohort").when(F.col("coverage") < 1, "partial-metrics").otherwise("complete-metrics")
    keep = [c for c in df.columns if not c.startswith("_")]
    scored = ranked.select(*keep, "score", "rank", F.when(F.col("_sum") > 0, F.col("score") / F.col("_sum")).alias("relative_weight"), "cohort_size", confidence.alias("confidence"))
    rest = df.filter("exclusion <> ''").select(*keep, F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("relative_weight"),
                                               F.lit(0).cast("long").alias("cohort_size"), F.lit("unavailable").alias("confidence"))
    return scored.unionByName(rest)


def interview_retrieval(posts: DataFrame, query: str, roles: Sequence[tuple[str, str, str, str]], families: Sequence[tuple[str, str, str, str]], k: int = 8, ident: str = "id") -> DataFrame:
    """Posts relevant to the asked roles by role match, query hits, kind, completeness and influence.

    `families` are all known occupations, `roles` the asked ones, as (name, title, query,
    content) patterns. Reads title, content, evidence_type, content_status, influence.
    """
    words = sorted(set(_python_terms(query)))
    title, body = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    asked = {r[0] for r in roles} | {"通用软件开发", "后端开发"}
    any_of = lambda tests: _any(tests)
    relevance = (F.when(any_of([title.rlike(t) | title.rlike(q) for _, t, q, _ in roles]), 2)
                 .when(any_of([title.rlike(t) for n, t, _, _ in families if n not in asked]), 0)
                 .when(any_of([body.rlike(q) & body.rlike(c) for _, _, q, c in roles]), 1).otherwise(0))
    low_t, low_b = F.lower(title), F.lower(body)
    hits = sum((F.when(low_t.contains(w), 3).when(low_b.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in posts.columns else F.lit(d)
    df = posts.withColumn("relevance", relevance).filter("relevance > 0")
    score = (F.col("relevance") * 10 + hits + F.when(col("evidence_type", "") == "reported_interview", 6).otherwise(0) + F.when(col("content_status", "") == "detail", 2).otherwise(0) + col("influence", 0.0) / 100)
    return top_rows(df.withColumn("retrieval_score", score), [F.col("retrieval_score").desc(), F.col(ident)], k, "rank")


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _python_terms(query: str) -> list[str]:
    import re
    import unicodedata
    return re.findall(r"[a-z][a-z0-9+#.-]*|[一-鿿]{2}", unicodedata.normalize("NFKC", query).lower())


def _query_blocks(asked: DataFrame, most: int):
    """Arrow tables of the queries' rows, every query whole in one, of about `most` rows each."""
    asked = cut_lineage(asked)
    blocks = max(1, -(-asked.count() // most))
    for i in range(blocks):
        rows = (asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked).toArrow().combine_chunks()
        if rows.num_rows:
            yield rows


def lexical_rank(df: DataFrame, queries: DataFrame, k: int = 20, body: Sequence[str] = ("job_name", "skills_text", "job_description"), key: str = "job_id", most: int = 200_000) -> DataFrame:
    """Postings per query by skill overlap (Dice), then summed IDF of matched query terms.

    queries: query_id, query_text, query_skills. Texts are scanned by `scans`: queries go to the tasks in
    blocks of about `most` terms, and each task keeps its k best postings of a query.
    """
    words = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in body])
    kinds = queries.schema["query_id"].dataType.simpleString(), df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), tokens(words).alias("_t"), F.array_distinct(F.coalesce(F.col("skills"), F.array().cast("array<string>"))).alias("_s"))
    total = df.count()
    terms = queries.select("query_id", F.explode(tokens("query_text")).alias("term"))
    idf = scans.frequencies(rows, "_t", terms).select("term", F.log(1 + (F.lit(total) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    skills = queries.select("query_id", F.explode(F.array_distinct("query_skills")).alias("term"))
    asked = terms.distinct().join(idf, "term").select("query_id", "term", "_idf", F.lit(False).alias("skill")).unionByName(skills.select("query_id", "term", F.lit(1.0).alias("_idf"), F.lit(True).alias("skill")))
    columns, every = ["matching", "overlap", "lexical"], None
    for block in _query_blocks(asked, most):
        part = scans.scan(rows, _lexical_scores(block), _names(block), k, kinds, columns, len(_names(block)))
        every = part if every is None else every.unionByName(part)
    if every is None:
        every = df.sparkSession.createDataFrame([], f"query_id {kinds[0]}, _key {kinds[1]}, matching double, overlap double, lexical double")
    every = every.withColumn("overlap", F.col("overlap").cast("long"))
    return first_per_key(every, ["query_id"], [F.col("matching").desc(), F.col("overlap").desc(), rnd("lexical", 8).desc(), F.col("_key")], k, "rank").withColumnRenamed("_key", key)


def _names(block: pa.Table) -> pa.Array:
    return block.column("query_id").combine_chunks().unique()


def _lexical_scores(block: pa.Table):
    names = _names(block)
    query = pc.index_in(block.column("query_id").combine_chunks(), names).to_numpy().astype(np.int64)
    term, idf, skill = block.column("term").to_pylist(), block.column("_idf").to_numpy(), np.array(block.column("skill").to_pylist())
    pick = lambda mask: scans.Postings([t for t, m in zip(term, mask) if m], query[mask])
    texts, skills = pick(~skill), pick(skill)
    weight = dict(zip([t for t, m in zip(term, skill) if not m], idf[~skill]))
    value = np.array([weight[t] for t in texts.terms.to_pylist()])
    want = np.bincount(query[skill], minlength=len(names))

    def score(batch: pa.RecordBatch):
        n = batch.num_rows
        row, at, _ = scans.cells(batch.column(1), texts.terms)
        lexical = texts.sums(row, at, value[at] if len(at) else np.zeros(0), n, len(names))
        row, at, _ = scans.cells(batch.column(2), skills.terms)
        overlap = skills.sums(row, at, np.ones(len(at)), n, len(names))
        have = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        matching = 2 * overlap / np.maximum(1, have[:, None] + want[None, :])
        hit = np.nonzero((lexical > 0) | (overlap > 0))
        return hit[0], hit[1], np.stack((matching[hit], overlap[hit], lexical[hit]), 1)

    return score


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, k: int = 250, key: str = "doc_id", body: str = "text", most: int = 200_000) -> DataFrame:
    """Greatest BM25 score over the facets of a query, the k best texts per query.

    queries: query_id, facet, query_text. Texts are scanned by `scans`: queries go to the tasks in blocks of
    about `most` terms, and each task keeps its k best texts of a query.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), tokens(body, "mixed").alias("_t"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("average")).first()
    terms = queries.select("query_id", "facet", F.explode(F.array_distinct(tokens("query_text", "mixed"))).alias("term")).distinct()
    idf = scans.frequencies(rows, "_t", terms).select("term", F.log(1 + (F.lit(stats["n"]) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    every = None
    for block in _query_blocks(terms.join(idf, "term").select("query_id", F.col("facet").cast("string").alias("facet"), "term", "_idf"), most):
        score, width = _bm25_scores(block, k1, b, float(stats["average"] or 1.0))
        part = scans.scan(rows, score, _names(block), k, kinds, ["score"], width)
        every = part if every is None else every.unionByName(part)
    if every is None:
        every = docs.sparkSession.createDataFrame([], f"query_id {kinds[0]}, _key {kinds[1]}, score double")
    return first_per_key(every, ["query_id"], [rnd("score", 8).desc(), F.col("_key")], k, "rank").withColumnRenamed("_key", key)


def _bm25_scores(block: pa.Table, k1: float, b: float, average: float):
    names = _names(block)
    query = pc.index_in(block.column("query_id").combine_chunks(), names).to_numpy().astype(np.int64)
    pairs = list(zip(query.tolist(), block.column("facet").to_pylist()))
    # Facets of a query stand side by side, so their greatest score is one reduction.
    number = {p: i for i, p in enumerate(sorted(set(pairs), key=lambda p: (p[0], p[1] is None, p[1] or "")))}
    heads = np.searchsorted([q for q, _ in number], np.arange(len(names)))
    term = block.column("term").to_pylist()
    texts = scans.Postings(term, [number[p] for p in pairs])
    weight = dict(zip(term, block.column("_idf").to_pylist()))
    value = np.array([weight[t] for t in texts.terms.to_pylist()])

    def score(batch: pa.RecordBatch):
        n = batch.num_rows
        row, at, times = scans.cells(batch.column(1), texts.terms)
        length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        gain = value[at] * times * (k1 + 1) / (times + k1 * (1 - b + b * length[row] / average)) if len(at) else np.zeros(0)
        best = np.maximum.reduceat(texts.sums(row, at, gain, n, len(number)), heads, axis=1)
        hit = np.nonzero(best > 0)
        return hit[0], hit[1], best[hit][:, None]

    return score, len(number)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_retrieval(chunks: DataFrame, queries: DataFrame, k: int = 250, owner: str = "owner", block: int = 2048) -> DataFrame:
    """Greatest cosine over chunks and facets per owner, the k best owners per query.

    Vectors are unit length. Each task multiplies its chunks with a block of about `block` query
    vectors at a time and keeps the k best owners of every query, so what is shuffled are at most
    tasks x queries x k rows, whatever the number of chunks. Any number of queries goes through in
    blocks by query. Rows with a null or odd-sized vector, or one with a null, have no score.
    """
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (chunks, owner))}
    asked = cut_lineage(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("query_id IS NOT NULL AND vector IS NOT NULL"))
    blocks = max(1, -(-asked.count() // block))
    src = chunks.filter(F.col(owner).isNotNull() & F.col("vector").isNotNull()).select(F.col(owner).alias("_o"), F.col("vector").cast("array<double>").alias("_v"))
    every = None
    for i in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if some.num_rows:
            part = src.mapInArrow(_products(some, k), f"query_id {kinds['query_id']}, {owner} {kinds[owner]}, _s double")
            every = part if every is None else every.unionByName(part)
    if every is None:
        every = chunks.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, {owner} {kinds[owner]}, _s double")
    best = every.groupBy("query_id", owner).agg(F.max("_s").alias("score"))
    return first_per_key(best, ["query_id"], [rnd("score", 8).desc(), F.col(owner)], k, "rank")


def _products(asked: pa.Table, k: int):
    """The work of a task: (query, owner, score) of the k best owners of each query among the task's vectors."""
    names = asked.column("query_id").combine_chunks().dictionary_encode()
    number, ids = names.indices.to_numpy(), names.dictionary
    lists = asked.column("vector").to_pylist()

    def run(batches):
        tops: dict[int, tuple] = {}
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for size in sorted({len(v) for v in lists}):
                at = np.array([i for i, v in enumerate(rows) if len(v) == size and None not in v], np.int64)
                q = np.array([i for i, v in enumerate(lists) if len(v) == size and None not in v], np.int64)
                if not len(at) or not len(q) or not size:
                    continue
                chunk, owners = np.array([rows[i] for i in at]), batch.column(0).take(pa.array(at))
                scores = chunk @ np.array([lists[i] for i in q]).T
                for n in np.unique(number[q]):
                    best = scores[:, number[q] == n].max(axis=1)
                    fine = np.flatnonzero(~np.isnan(best) & (best >= tops[n][2]) if n in tops else ~np.isnan(best))
                    if len(fine):
                        held = tops.get(n, (owners.slice(0, 0), np.zeros(0), -np.inf))
                        tops[n] = _best_owners(pa.concat_arrays([held[0], owners.take(pa.array(fine))]), np.concatenate((held[1], best[fine])), k)
        for n, (owner, score, _) in tops.items():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(score), n))), owner, pa.array(score)], ["query_id", "owner", "_s"])

    return run


def _best_owners(owners: pa.Array, scores: np.ndarray, k: int) -> tuple:
    """(owners, scores, least score that can still matter): the k best distinct owners, equal rounded scores by owner."""
    rank = pc.rank(owners, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((-scores, rank))
    order = order[np.diff(rank[order], prepend=-1) != 0]
    shown = np.floor(np.round(scores, 10) * 1e8 + 0.5)
    order = order[np.lexsort((rank[order], -shown[order]))][:k]
    floor = scores[order].min() - 2e-8 if len(order) == k else -np.inf
    return owners.take(pa.array(order)), scores[order], floor


def rrf(lists: Sequence[DataFrame], key: str, by: Sequence[str] = ("query_id",), k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ties by key."""
    every = None
    for one in lists:
        part = one.select(*by, key, (1 / (F.lit(k) + F.col("rank"))).alias("_r"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(*by, key).agg(F.sum("_r").alias("rrf_score"))
    # A fused list holds at most the rows of its inputs, which are top-k lists already.
    return fused.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(rnd("rrf_score", 10).desc(), F.col(key))))


def rerank(candidates: DataFrame, windows: DataFrame, key: str, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Candidates by their best window score, then fusion score, then key."""
    best = windows.groupBy(*by, key).agg(F.max("window_score").alias("rerank_score"))
    out = candidates.withColumnRenamed("rank", "recall_rank").join(best, [*by, key])
    return out.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("rerank_score").desc(), rnd("rrf_score", 10).desc(), F.col(key))))


def cluster_representatives(df: DataFrame, nearest: int = 24, keep: int = 5, far: int = 2, random: int = 2, audit: int = 2, salt: str = "sample42:", ident: str = "id") -> DataFrame:
    """Per cluster the nearest rows of distinct companies, the farthest, hash-random ones and audit rows.

    Reads cluster, distance, company. All picks are ranked limits, kept per task before
    the shuffle.
    """
    near = first_per_key(df, ["cluster"], [F.col("distance"), F.col(ident)], nearest)
    own = F.coalesce(F.nullif(text("company"), F.lit("")), F.col(ident).cast("string"))
    reps = first_per_key(near.withColumn("_company", own), ["cluster", "_company"], [F.col("distance"), F.col(ident)])
    reps = first_per_key(reps, ["cluster"], [F.col("distance"), F.col(ident)], keep, "place").select("cluster", ident, "place", F.lit("center").alias("kind"))
    rim = first_per_key(df.join(reps.select("cluster", ident), ["cluster", ident], "left_anti"), ["cluster"], [F.col("distance").desc(), F.col(ident)], far, "place")
    rim = rim.select("cluster", ident, "place", F.lit("boundary").alias("kind"))
    used = reps.unionByName(rim).select("cluster", ident)
    rest = df.join(used, ["cluster", ident], "left_anti").withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(ident).cast("string")), 256))
    rest = first_per_key(rest, ["cluster"], [F.col("_h")], random + audit, "place")
    rest = rest.select("cluster", ident, F.when(F.col("place") > random, F.col("place") - random).otherwise(F.col("place")).alias("place"), F.when(F.col("place") > random, "audit").otherwise("random").alias("kind"))
    return reps.unionByName(rim).unionByName(rest)


def round_robin_audit(df: DataFrame, n: int = 12) -> DataFrame:
    """Audit rows taken in turn from (employment, confidence band) groups, smallest group first."""
    band = F.when(F.coalesce("confidence", F.lit(0.0)) < 0.75, "低置信").otherwise("高置信")
    tagged = df.withColumn("_group", F.concat_ws(":", F.coalesce(F.nullif(text("employment_type"), F.lit("")), F.lit("未明确")), band))
    sizes = tagged.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    score = F.when(F.coalesce("evidence_coverage", F.lit(0.0)) < 0.7, 0).otherwise(1)
    few = first_per_key(tagged, ["_group"], [score, F.col("row_no")], n, "_turn")
    return top_rows(few.join(sizes, "_group"), [F.col("_turn"), F.col("_size"), F.col("_group")], n, "place").withColumnRenamed("_group", "audit_group").drop("_turn", "_size")


def company_diverse_order(df: DataFrame, order: str, company: str = "company", ident: str = "id") -> DataFrame:
    """Every company once, then every company twice, and so on; companies by their first row.

    Exact positions inside companies and overall, so a dominant company needs no single task.
    """
    own = df.withColumn("_company", F.coalesce(F.nullif(compact(halfwidth(company)), F.lit("")), F.concat(F.lit("row:"), F.col(ident).cast("string"))))
    own = cut_lineage(own)
    turn = cut_lineage(position_within(own, [(order, True)], ["_company"], "_turn"))
    first = own.groupBy("_company").agg(F.min(order).alias("_first"))
    return position_within(hot_key_join(turn, first, "_company"), [("_turn", True), ("_first", True)], name="place").drop("_company", "_turn", "_first")


def latest_per_context(df: DataFrame, key: str = "context_key", generated: str = "generated_at", ident: str = "snapshot_key") -> DataFrame:
    """Newest snapshot of each context."""
    return first_per_key(df, [key], [F.col(generated).desc(), F.col(ident)])


def evidence_snippet(df: DataFrame, query: str, body: str = "job_description", shortest: int = 16, longest: int = 650) -> DataFrame:
    """The sentence with most query terms, earliest on ties, found inside the row."""
    words = sorted(set(_python_terms(query)))
    lines = F.filter(F.transform(sections(body), lambda s: s["quote"]), lambda q: F.length(q) >= shortest)
    count = lambda q: sum((F.when(F.lower(F.regexp_replace(q, SPACE, "")).contains(w), 1).otherwise(0) for w in words), F.lit(0))
    ranked = F.array_max(F.transform(lines, lambda q, i: F.struct(count(q).alias("hits"), (-i).alias("at"), q.alias("quote"))))
    df = df.withColumn("_best", ranked)
    return df.withColumns({"snippet": F.coalesce(F.substring(F.col("_best.quote"), 1, longest), F.lit("未提供可引用原文")), "snippet_hits": F.coalesce(F.col("_best.hits"), F.lit(0))}).drop("_best")
