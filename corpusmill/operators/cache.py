"""Answer cache: ``cache(key, query, vector, ts, answer)``, times in epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.skew import fits, range_segments, running, salted
from corpusmill.functions.vectors import first_similar

# Lifetime, similarity and size limits.
TTL_SECONDS, SIMILAR, MAX_ENTRIES, EVICT_SHARE = 3600, 0.92, 1000, 5


def cache_key(query: Column) -> Column:
    return F.sha2(F.lower(T.strip(query)), 256)


def _newest(cache: DataFrame) -> DataFrame:
    return cache.groupBy("key").agg(F.max_by(F.struct("ts", "answer"), F.col("ts")).alias("c")).select("key", "c.*")


def cache_lookup_exact(requests: DataFrame, cache: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """(query_id, answer) of requests whose newest stored entry has not expired at ``now``.

    A cache within its limit is broadcast; a larger one is joined with the requests salted, since
    one popular query may make up much of the traffic.
    """
    asked = requests.select("query_id", "now", cache_key(F.col("query")).alias("key"))
    newest = _newest(cache)
    if fits(cache, 10 * MAX_ENTRIES):
        joined = asked.join(F.broadcast(newest), "key")
    else:
        left, right = salted(asked, newest, F.col("query_id"), 16)
        joined = left.join(right, ["key", "salt"])
    return joined.filter(F.col("now") - F.col("ts") <= ttl).select("query_id", "answer")


def cache_lookup_semantic(requests: DataFrame, cache: DataFrame, ttl: int = TTL_SECONDS, similar: float = SIMILAR) -> DataFrame:
    """(query_id, answer, score): for requests without an exact hit, the first stored unexpired
    entry that is similar enough. ``now`` is one moment for the whole request table."""
    missed = requests.join(cache_lookup_exact(requests, cache, ttl), "query_id", "left_anti").filter("vector is not null")
    now = requests.agg(F.max("now")).scalar()
    live = cache.filter((now - F.col("ts") <= ttl) & F.col("vector").isNotNull())
    return first_similar(
        missed.select("query_id", "vector"), live.select("key", "ts", "answer", "vector"), similar, ["ts", "key"]
    ).select("query_id", "answer", "score")


def cache_store(requests: DataFrame) -> DataFrame:
    """Cache rows of the answers that may be stored."""
    allowed = (
        ~F.coalesce("from_cache", F.lit(False)) & ~F.coalesce("scoped", F.lit(False))
        & (F.coalesce("query", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != "")
        & ~F.coalesce("needs_human_review", F.lit(False)) & (F.coalesce("hitl_status", F.lit("none")) != "pending")
    )
    vector = ["vector"] if "vector" in requests.columns else []
    return requests.filter(allowed).select(
        cache_key(F.col("query")).alias("key"), "query", *vector, F.col("now").alias("ts"), "answer"
    )


def cache_evict(cache: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Over the limit, drop the oldest fifth (at least one). Ages are ranked by segments of time,
    so the cache is never sorted in one task."""
    total = cache.agg(F.count("*")).scalar()
    ranked = running(
        cache.withColumn("__all", F.lit(0)), ["__all"], ["ts", "key"], range_segments(cache, "ts"), {"__age": F.lit(1)}
    )
    drop = F.when(total > max_entries, F.greatest(F.lit(1), F.floor(total / EVICT_SHARE))).otherwise(0)
    return ranked.filter(F.col("__age") > drop).drop("__age", "__all")


def cache_stats(log: DataFrame) -> DataFrame:
    """One row from ``log(outcome)``: exact and semantic hits, misses, hit rate."""
    outcome = F.col("outcome")
    counted = log.agg(
        *[F.count(F.when(outcome == v, 1)).alias(n) for v, n in
          (("exact", "exact_hits"), ("semantic", "semantic_hits"), ("miss", "misses"))]
    )
    hits = F.col("exact_hits") + F.col("semantic_hits")
    total = hits + F.col("misses")
    return counted.withColumn("hit_rate", F.when(total > 0, hits / total).otherwise(0.0))
