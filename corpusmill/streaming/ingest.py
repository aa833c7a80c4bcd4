"""Continuous ingest of documents into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.skew import fits
from corpusmill.operators.chunking import chunk_documents
from corpusmill.plans.ingest import with_ids
from corpusmill.sources.index import exists, index_append, index_read

#: Ids of a batch that are sent to the index at most.
SENT_IDS = 200_000


def stream_ingest(documents: DataFrame, path: str, checkpoint: str, strategy: str = "auto", available_now: bool = True):
    """Start indexing a stream of ``(doc_id, text, session_id, source, file_type)``.

    A document already in the index is skipped, so re-delivered files change nothing. A batch that is run again after a failure, before
    or after its write was recorded, neither doubles nor loses chunks. The ids of a batch are sent to the index where they are
    few, so that only the columns of ids are read and nothing of the index is shuffled. A document without an id is known by its
    content, whose hash is in ``document_key``.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        content = F.sha2(F.to_json(F.struct(*sorted(c for c in batch.columns if c != "doc_id"))), 256)
        keyed = batch.withColumn("document_key", F.when(F.col("doc_id").isNull(), content))
        fresh = keyed.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), "document_key")).dropDuplicates(["doc_id"])
        if exists(spark, f"{path}/chunks"):
            ids = fresh.select(F.col("doc_id").alias("known_id"))
            index = index_read(spark, path)
            names = [c for c in ("document_id", "document_key") if c in index.columns]
            known = index.select(F.coalesce(*names).alias("known_id"))
            known = known.join(F.broadcast(ids) if fits(ids, SENT_IDS) else ids, "known_id", "left_semi").distinct()
            fresh = fresh.join(known, F.col("doc_id") == F.col("known_id"), "left_anti")
        given = F.col("document_key").isNull()
        chunks = with_ids(chunk_documents(fresh, strategy)).withColumns(
            {
                "doc_id": F.when(given, F.col("doc_id").cast(batch.schema["doc_id"].dataType)),
                "document_id": F.when(given, F.col("document_id")),
            }
        )
        index_append(chunks, path, f"{checkpoint}#{batch_id}")

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
