"""Token ids as Parquet list columns in ascending document order, for selective reads.

Files are range partitioned and sorted by doc_id, so footers and page indexes let a reader skip to documents. Ids are
delta or dictionary encoded; row groups and pages have set sizes. Offsets and lengths are columns of their own, so reading
them leaves the ids on disk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.session import scratch_dir
from corpusmill.llm.common import rows, slices
from corpusmill.llm.tokens import shared_encoder

_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, files: int | None = None, encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Write doc_id, part, local_start (ids of the part before it), n_tokens and ids, one file per part.

    ``encoding``: dictionary, or delta for ids without a dictionary. A null or empty text is the end id alone; null
    doc_ids come first; repeated rows are written each, rows of one doc_id in an order that their texts fix.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, at, part = shared_encoder(tokenizer, words=True), end_id.to_bytes(4, "little"), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, texts in slices(batch):
                blobs = [encoder.encode(t.decode()) + end for t in texts]
                size = np.array([len(b) // 4 for b in blobs])
                ends = np.cumsum(size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
                yield rows(schema, (ids.slice(low, high - low), np.full(len(size), part), at + ends - size, size, lists))
                at += int(ends[-1])

    text = F.col("text").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    writer = texts.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(encode, _SCHEMA).write.mode("overwrite")
    options = {
        "parquet.block.size": row_group_mb << 20,
        "parquet.page.size": page_kb << 10,
        "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
        "parquet.enable.dictionary#ids.list.element": str(encoding != "delta").lower(),
        "parquet.page.write-checksum.enabled": "true",
    }
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.parquet(path)


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, read without the ids."""
    index = spark.read.schema(_SCHEMA).parquet(path).drop("ids")
    return _with_start(spark, index, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of a folder of token files; filters on doc_id skip pages."""
    return _with_start(spark, spark.read.schema(_SCHEMA).parquet(path), path).select("doc_id", "start", "n_tokens", "ids")


def _with_start(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """A part's first id follows from the sizes of the parts before it: a row per file reaches the driver."""
    sizes = spark.read.schema(_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, at = [], 0
    for r in sorted(sizes):
        base.append((r.part, at))
        at += r.n
    return df.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part").withColumn("start", F.col("base") + F.col("local_start"))


def token_checks(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            size = np.asarray(pc.list_value_length(ids)).astype(np.int64)
            raw, ends = np.asarray(ids.flatten()).astype("<i4", copy=False).tobytes(), 4 * np.cumsum(size)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends - 4 * size, ends, strict=True)]
            yield rows(schema, (batch.column("doc_id"), batch.column("start"), size, crc))

    return tokens.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write token files to the shared folder and report what reading them back gives, per document."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return token_checks(read_tokens(spark, path))
