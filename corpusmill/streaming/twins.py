"""Batch twins on tables, built on the shared steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.streaming.ordered import ordered_scan, speculative_scan
from corpusmill.streaming.steps import BUCKET, REFILL_PER_MINUTE, TTL_SECONDS, Breaker, bucket_step, ttl_step


def quality_breaker(
    results: DataFrame, key: str, ts: str, order: list[str], gated: bool = True, block: int = 10_000, warm: int = 256, **limits
) -> DataFrame:
    """Breaker state after each result: adds ``allowed``, ``status``, ``failure_rate``. A key of more than ``block`` results is spread over tasks."""

    def step(state, now, failed):
        state = Breaker(**limits) if state is None else state
        return state, state.step(now, bool(failed), gated)

    def encode(state):
        return (state or Breaker(**limits)).encode()

    def decode(text):
        return Breaker(**limits).decode(text)

    return speculative_scan(
        results, key, ts, order, ["failed"], step, "allowed boolean, status string, failure_rate double", encode, decode, block, warm
    )


def token_bucket(requests: DataFrame, key: str, ts: str, order: list[str], cap: int = BUCKET, per_minute: int = REFILL_PER_MINUTE) -> DataFrame:
    """Adds ``allowed`` and ``tokens`` left. The bucket is full again after ``cap`` refills, so a
    key is cut at longer gaps."""

    def step(state, now, row):
        tokens, last = state or (None, None)
        tokens, allowed = bucket_step(tokens, last, now, cap, per_minute)
        return (tokens, now if last is None else max(last, now)), {"allowed": allowed, "tokens": tokens}

    return ordered_scan(requests, key, ts, order, step, "allowed boolean, tokens double", cap * 60.0 / per_minute)


def ttl_cache(requests: DataFrame, key: str, ts: str, order: list[str], ttl: float = TTL_SECONDS) -> DataFrame:
    """Adds ``hit``. After a gap longer than the lifetime the next request misses, so a key is cut
    there."""

    def step(state, now, row):
        state, hit = ttl_step(state, now, ttl)
        return state, {"hit": hit}

    return ordered_scan(requests, key, ts, order, step, "hit boolean", ttl)


def review_timeouts(queue: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Undecided items past their timeout become ``pending_timeout`` and stay in the queue."""
    first = decisions.groupBy("review_id").agg(F.min("decided_at").alias("decided_at"))
    due = F.least(F.coalesce("decided_at", now), now) > F.col("timeout_at")
    status = F.when(due & (F.col("decided_at").isNull() | (F.col("decided_at") > F.col("timeout_at"))), "pending_timeout")
    decided = F.when(F.col("decided_at") <= now, "decided").otherwise("pending")
    return queue.join(first, "review_id", "left").withColumn("hitl_status", F.coalesce(status, decided)).drop("decided_at")


def usage_windows(usage: DataFrame, ts: str = "ts", window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Tokens and times per step and window; with a watermark it runs on a stream in append mode."""
    timed = usage.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(ts, watermark)
    return timed.groupBy(F.window(ts, window).alias("w"), "step").agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.avg("ms").alias("avg_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
    ).select(F.col("w.start").alias("window_start"), "step", "requests", "tokens", "avg_ms", "min_ms", "max_ms")
