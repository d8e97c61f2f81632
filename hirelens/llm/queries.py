"""Registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm.automaton import scan_sql, scan_top_k
from hirelens.llm.common import table
from hirelens.llm.conversations import repair_damaged, repair_sql
from hirelens.llm.embeddings import near_embeddings
from hirelens.llm.language import identify_language
from hirelens.llm.licences import scan_licences
from hirelens.llm.minhash import near_duplicates
from hirelens.llm.mixing import mix_documents, mixing_sql
from hirelens.llm.packing import pack
from hirelens.llm.quality import classify_quality
from hirelens.llm.search import top_k
from hirelens.llm.sharding import shard_documents, sharding_sql
from hirelens.llm.tokens import count_tokens
from hirelens.llm.wrappers import extract_main_text

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


@query("op5_mix_sources", mixing_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "lang", "topic", "tokens", *(F.round(c, 6).alias(c) for c in ("ratio", "probability", "epochs")), "kept", "copies")


@query("op6_minhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"))


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op8_exact_top_k_search")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.filter("doc_id % 50 = 0"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op13_sharding", sharding_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@query("op11_lexical_scan", scan_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_conversation_repair", repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))
