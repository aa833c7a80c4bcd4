"""Vector retrieval. Vectors are inputs; ``featurize`` is the stand-in where there are none."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.session import scratch_dir
from corpusmill.functions.vectors import nearest


def featurize(df: DataFrame, dim: int = 256, text: str = "text", vector: str = "vector", idf: bool = True) -> DataFrame:
    """Add a unit-length hashed tf-idf vector per text. Without ``idf`` a vector depends on its own text only, so
    queries, rewrites and later batches share one space."""
    tokens = df.withColumn("__tokens", T.tokenize(F.coalesce(F.col(text), F.lit(""))))
    weighed = "__tfidf" if idf else "__tf"
    stages = [
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dim),
        *([IDF(inputCol="__tf", outputCol="__tfidf")] if idf else []),
        Normalizer(inputCol=weighed, outputCol="__unit"),
    ]
    out = Pipeline(stages=stages).fit(tokens).transform(tokens)
    return out.withColumn(vector, vector_to_array("__unit")).drop("__tokens", "__tf", "__tfidf", "__unit")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 40, threshold: float = 0.0, id: str = "chunk_id") -> DataFrame:
    """Nearest by squared Euclidean distance d, similarity 1 / (1 + d)."""
    return nearest(queries, vectors, k, id, "l2", threshold)


def dense_topk_cosine(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float = 0.0, id: str = "chunk_id") -> DataFrame:
    """Nearest by cosine distance, reported as cosine similarity."""
    return nearest(queries, vectors, k, id, "cosine", threshold)


def rebuild_vectors(entries: DataFrame, path: str | None = None, dim: int = 256, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Recompute every vector into a fresh folder; returns (entries, one row of ok and total)."""
    path = path or scratch_dir(entries.sparkSession, "vectors")
    featurize(entries.drop("vector"), dim, text).write.mode("overwrite").parquet(path)
    rebuilt = entries.sparkSession.read.parquet(path)
    return rebuilt, rebuilt.agg(F.count("vector").alias("ok"), F.count("*").alias("total"))
