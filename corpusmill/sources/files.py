"""Reading files. Text kinds are decoded here; binary kinds are reported, not parsed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Loader per suffix.
LOADERS = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".csv": "csv",
}
TEXT_LOADERS = ("markdown", "text", "csv")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _listed(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{" + ",".join(s[1:] for s in LOADERS) + "}").load(path)
    )


def empty_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file_path) of the supported files of zero bytes, which have no rows; they come from the listing that Spark makes for a read."""
    files = _listed(spark, path, recursive)
    # The listing writes local names with three slashes, rows with one.
    named = spark.createDataFrame([(re.sub(r"^file:/+", "file:/", name),) for name in files.inputFiles()], "name string")
    without_rows = named.join(files.select(F.col("_metadata.file_path").alias("name")), "name", "left_anti")
    return without_rows.select(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("file_path"))


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file_path, source, file_type, loader, modified, size, content) of the supported files."""
    files = _listed(spark, path, recursive)
    loader = F.lit(None).cast("string")
    for suffix, name in LOADERS.items():
        loader = F.when(F.col("file_type") == suffix, name).otherwise(loader)
    return (
        files.select(
            F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("source"),
            file_suffix(F.col("path")).alias("file_type"), F.col("modificationTime").alias("modified"),
            F.col("length").alias("size"), "content",
        )
        .withColumn("loader", loader)
    )


@F.pandas_udf(StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    def decode(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for encoding in ("gb18030", "latin-1"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", errors="ignore")

    return content.map(decode)


def decode_text(df: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """UTF-8 (with or without mark) in the JVM; only other encodings go through Python."""
    as_text = F.col(content).cast("string")
    valid = F.is_valid_utf8(as_text)
    other = _decode_other(F.when(~valid, F.col(content)))
    return df.withColumn(text, F.when(valid, F.regexp_replace(as_text, "^﻿", "")).otherwise(other))


def read_corpus(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One decoded document per text file; see ``load_with_errors`` for the rest."""
    files = read_files(spark, path, recursive).filter(F.col("loader").isin(*TEXT_LOADERS))
    return decode_text(files).drop("content", "loader")


def load_with_errors(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Every supported file with a status, those of zero bytes too; a file that gives no text never stops the others."""
    files = decode_text(read_files(spark, path, recursive))
    binary = ~F.col("loader").isin(*TEXT_LOADERS)
    error = F.when(binary, "binary format, decoded outside").when(~F.coalesce("text", F.lit("")).rlike(r"(?U)\S"), "no text")
    empty = empty_files(spark, path, recursive).select(
        "file_path", F.element_at(F.split("file_path", "/"), -1).alias("source"), file_suffix(F.col("file_path")).alias("file_type"),
        F.lit(None).cast("string").alias("text"), F.lit("error").alias("status"), F.lit("no text").alias("error"),
    )
    loaded = files.select(
        "file_path", "source", "file_type", F.when(error.isNull(), F.col("text")).alias("text"),
        F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"),
    )
    return loaded.unionByName(empty)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """One document per CSV row: its cells as columns and ``text`` as ``column: value`` lines."""
    rows = spark.read.csv(path, header=True)
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in rows.columns])
    return rows.withColumns({"text": text, "file_path": F.col("_metadata.file_path"), "file_type": F.lit(".csv")})


def stable_document_id(name: Column, size: Column, modified: Column) -> Column:
    digest = F.sha1(F.concat_ws(":", name, size.cast("string"), modified.cast("string")))
    return F.concat(F.lit("doc-"), F.substring(digest, 1, 16))


def attach_upload_metadata(chunks: DataFrame, session: Column, filename: Column, uploaded_at: Column, request_id: Column) -> DataFrame:
    """New document id below the session, the old one kept, upload facts and a ready mark."""
    old = F.col("document_id").cast("string")
    fresh = F.concat_ws(":", session, F.substring(F.sha2(F.concat_ws("|", session, filename, old), 256), 1, 32))
    return chunks.withColumns(
        {
            "source_document_id": old, "session_id": session, "document_id": fresh, "upload_filename": filename,
            "uploaded_at": uploaded_at, "request_id": request_id, "ingest_status": F.lit("ready"),
        }
    )
