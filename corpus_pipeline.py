"""Corpus pipeline: quality, language, near-duplicates, mixture, packing. Each stage works on what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm.language import fit, held_out, keep_languages
from hirelens.llm.minhash import near_duplicates
from hirelens.llm.mixing import mix_documents, repeated
from hirelens.llm.packing import pack
from hirelens.llm.quality import keep_quality
from hirelens.llm.queries import WORD_BPE
from hirelens.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one that is hardly likelier than the others, go."""
    return keep_languages(docs, fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more, smallest id."""
    gone = near_duplicates(docs, words=5).filter("NOT kept").select("doc_id").distinct()
    # A row without an id matches nothing and stays.
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled, or repeated where a cell is to grow, so that the tokens of the rows written meet the weights of sources, languages and topics."""
    # The row travels whole beside the columns that the mixture reads, so no column of its own can clash.
    read = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_row"))
    return repeated(mix_documents(read)).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens."""
    return pack(docs, WORD_BPE)


STAGES = [("quality classifier", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("mixing sources", mixture), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
