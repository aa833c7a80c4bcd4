"""From documents to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.chunking import chunk_documents, chunk_id
from corpusmill.sources.files import read_corpus, stable_document_id
from corpusmill.sources.index import index_append, index_read


def ingest(documents: DataFrame, path: str, strategy: str = "recursive", doc: str = "doc_id") -> DataFrame:
    """Chunk and index ``documents(doc_id, text, session_id, source, ...)``; returns (doc_id,
    raw, chunks, indexed) as found in the index afterwards."""
    spark = documents.sparkSession
    chunks = chunk_documents(documents, strategy)
    generation = index_append(with_ids(chunks, doc), path)
    found = index_read(spark, path).filter(F.col("generation") == generation)
    counts = found.groupBy("document_id").agg(F.count("*").alias("indexed"))
    raw = documents.groupBy(F.col(doc).cast("string").alias("document_id")).agg(F.count("*").alias("raw"))
    return raw.join(counts, "document_id", "left").select(
        "document_id", "raw", F.coalesce("indexed", F.lit(0)).alias("chunks"), F.coalesce("indexed", F.lit(0)).alias("indexed")
    )


def with_ids(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    return chunks.withColumns(
        {"document_id": F.col(doc).cast("string"), "chunk_id": chunk_id(F.col(doc), F.col("chunk_index"))}
    )


def ingest_files(spark: SparkSession, files: str, path: str, session_id: str, strategy: str = "recursive", recursive: bool = False) -> DataFrame:
    """Read a folder and ingest it into one session."""
    read = read_corpus(spark, files, recursive)
    documents = read.select(
        stable_document_id(F.col("source"), F.col("size"), F.col("modified")).alias("doc_id"), "text", "source", "file_type",
        F.lit(session_id).alias("session_id"),
    )
    return ingest(documents, path, strategy)
