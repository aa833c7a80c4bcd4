"""The chunk index: an append-only folder of Parquet files.

``<path>/chunks`` holds one folder for each write, partitioned by session; ``<path>/deletes`` the ids taken out;
``<path>/generations`` one row per write, added last. A row counts when its write is recorded and no later delete names
it, so a delete never rewrites data, a reader always sees whole writes, and a write that failed halfway is
written over by the next one. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage
from corpusmill.functions.skew import fits

LOG = "generation long, operation string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _log(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{path}/generations"
    if not exists(spark, folder):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(folder)


def index_generation(spark: SparkSession, path: str) -> int:
    """Number of the last write; caches of derived tables are keyed by it."""
    return _log(spark, path).agg(F.coalesce(F.max("generation"), F.lit(0)).alias("g")).first()["g"]


def _record(spark: SparkSession, path: str, generation: int, operation: str) -> None:
    row = spark.createDataFrame([(generation, operation)], LOG).coalesce(1)
    row.write.mode("append").parquet(f"{path}/generations")


def index_append(chunks: DataFrame, path: str, batch: str | None = None) -> int:
    """Add chunks (``chunk_id``, ``session_id``, ``source``, ``text``, ...); returns the generation.

    A named ``batch`` is added once: if it is recorded, nothing is written and its generation comes back.
    """
    spark = chunks.sparkSession
    operation = "append" if batch is None else f"append {batch}"
    if batch is not None:
        done = _log(spark, path).filter(F.col("operation") == operation).agg(F.max("generation").alias("g")).first()["g"]
        if done is not None:
            return done
    generation = index_generation(spark, path) + 1
    chunks.withColumn("generation", F.lit(generation).cast("long")).write.mode("overwrite").partitionBy("session_id").parquet(
        f"{path}/chunks/write={generation}"
    )
    _record(spark, path, generation, operation)
    return generation


def index_read(spark: SparkSession, path: str) -> DataFrame:
    """Live chunks. Session filters prune folders, other filters reach the files."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/chunks")
    # What a failed write left has the number of the next one.
    rows = rows.filter(F.col("write") <= index_generation(spark, path)).drop("write")
    cleared = _log(spark, path).filter("operation = 'clear'").agg(F.max("generation").alias("g")).first()["g"]
    if cleared is not None:
        rows = rows.filter(F.col("generation") > cleared)
    if not exists(spark, f"{path}/deletes"):
        return rows
    gone = spark.read.parquet(f"{path}/deletes").groupBy("chunk_id").agg(F.max("deleted_in").alias("deleted_in"))
    gone = gone.withColumnRenamed("chunk_id", "gone_id")
    if fits(gone, 100_000):
        gone = F.broadcast(gone)
    return rows.join(gone, (F.col("chunk_id") == F.col("gone_id")) & (F.col("generation") <= F.col("deleted_in")), "left_anti")


def _where(where: dict) -> Column:
    condition = F.lit(True)
    for name, value in where.items():
        if value is not None:
            condition = condition & (F.col(name) == value)
    return condition


def index_delete(spark: SparkSession, path: str, where: dict | DataFrame) -> int:
    """Delete by equality clauses (``None`` clauses dropped) or by a table of ``chunk_id``;
    returns the number of deleted chunks."""
    live = index_read(spark, path)
    if isinstance(where, DataFrame):
        ids = live.join(where.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id")
    else:
        if not any(v is not None for v in where.values()):
            return 0
        ids = live.filter(_where(where)).select("chunk_id")
    generation = index_generation(spark, path) + 1
    # fixed before the delete folder changes under the plan that reads it
    fixed = cut_lineage(ids.withColumn("deleted_in", F.lit(generation).cast("long")))
    count = fixed.count()
    if count:
        fixed.write.mode("append").parquet(f"{path}/deletes")
        _record(spark, path, generation, "delete")
    return count


def index_delete_by_session(spark: SparkSession, path: str, session_id: str) -> int:
    return index_delete(spark, path, {"session_id": session_id})


def index_delete_by_source(spark: SparkSession, path: str, source: str) -> int:
    return index_delete(spark, path, {"source": source})


def index_delete_by_ids(spark: SparkSession, path: str, ids: DataFrame) -> int:
    return index_delete(spark, path, ids)


def index_clear(spark: SparkSession, path: str) -> None:
    """Hide everything written so far."""
    _record(spark, path, index_generation(spark, path) + 1, "clear")


def index_count(spark: SparkSession, path: str) -> int:
    return index_read(spark, path).count()


def list_sources(index: DataFrame) -> DataFrame:
    """Sorted distinct sources, the older ``source_file`` where a row has no source."""
    named = F.col("source")
    if "source_file" in index.columns:
        named = F.coalesce(named, F.col("source_file"))
    return index.select(named.alias("source")).filter("source is not null").distinct().orderBy("source")


DOCUMENT_FACTS = (
    "parse_quality_score", "outline_preview", "element_count", "warning_count", "chunk_strategy", "target_tokens",
    "overlap_tokens", "chunk_plan_reason", "uploaded_at",
)


def list_session_documents(index: DataFrame, session_id: str | None = None) -> DataFrame:
    """Documents of a session (of every session if none is named), newest upload first: chunk
    counts and, for each fact, the first chunk's non-empty value."""
    rows = index if session_id is None else index.filter(F.col("session_id") == session_id)
    text = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) if c in rows.columns else F.lit(None)
    document = F.coalesce(text("document_id"), text("source_document_id"), text("source"), F.lit("unknown"))
    facts = []
    for c in DOCUMENT_FACTS:
        if c in rows.columns:
            filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
            facts.append(F.min_by(c, F.when(filled, F.col("chunk_index"))).alias(c))
    grouped = rows.withColumn("__document", document).groupBy("session_id", "__document").agg(
        F.count("*").alias("chunks"), F.count("*").alias("indexed"), *facts
    ).withColumnRenamed("__document", "document_id")
    return grouped.orderBy(F.desc("uploaded_at")) if "uploaded_at" in grouped.columns else grouped
