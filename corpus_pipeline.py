"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.session import scratch_dir
from corpusmill.llm.common import numbered_rows, unique_ids
from corpusmill.llm.mixing import mix_documents
from corpusmill.llm.ngram_join import ngram_jaccard_join
from corpusmill.llm.packing import best_fit_pack
from corpusmill.llm.substring_dedup import dedup_texts
from corpusmill.llm.toxicity import fit_toxicity, scored_texts


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored_texts(docs, model).filter("predicted = 0").select("keep.*", "text").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; ids that repeat or are null are numbered first."""
    rows = docs.withColumn("__row", F.col("doc_id").cast("long")) if unique_ids(docs) else numbered_rows(docs, "__row")
    groups = ngram_jaccard_join(rows.select(F.col("__row").alias("doc_id"), "text"))
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of windows that occur earlier; texts that lose nothing stay as they are."""
    kept = dedup_texts(docs)
    count = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("keep.n_chars"))
    rest = [F.col(f"keep.{c}").alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    return kept.select(*rest, F.col("kept").alias("text"), count.alias("n_chars")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("best_fit_packing", packing),
]

#: Models, Newton steps and tokenisers are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
