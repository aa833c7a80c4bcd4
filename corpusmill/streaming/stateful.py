"""Stateful processors on event streams. State is keyed and lives in the state store; within a
micro-batch the rows of a key are taken in (time, id) order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.functions.session import scratch_dir
from corpusmill.streaming.steps import BUCKET, PROBES, REFILL_PER_MINUTE, TTL_SECONDS, Breaker, bucket_step, ttl_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_MESSAGES = 20


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(columns)


class BreakerProcessor(StatefulProcessor):
    def __init__(self, limits: dict | None = None):
        self.limits = limits or {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "breaker", "status string, results string, opened_at double, probes int, successes int"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        breaker = Breaker(**self.limits)
        if self.state.exists():
            status, results, opened_at, probes, successes = self.state.get()
            breaker.status, breaker.opened_at, breaker.probes, breaker.successes = status, opened_at, probes, successes
            breaker.results = [c == "1" for c in results]
        batch = _in_order(rows, ["ts", "event_id"])
        out = [breaker.step(float(t), bool(f)) for t, f in zip(batch["ts"], batch["failed"])]
        bits = "".join("1" if r else "0" for r in breaker.results)
        self.state.update((breaker.status, bits, float(breaker.opened_at), int(breaker.probes), int(breaker.successes)))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"].to_numpy(), **pd.DataFrame(out).to_dict("list")})

    def close(self) -> None:
        pass


class BucketProcessor(StatefulProcessor):
    def __init__(self, cap: int, per_minute: int):
        self.cap, self.per_minute = cap, per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.state.get() if self.state.exists() else (None, None)
        batch = _in_order(rows, ["ts", "event_id"])
        allowed = []
        for now in batch["ts"]:
            tokens, ok = bucket_step(tokens, last, float(now), self.cap, self.per_minute)
            last = float(now) if last is None else max(last, float(now))
            allowed.append(ok)
        self.state.update((float(tokens), float(last)))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


class TtlProcessor(StatefulProcessor):
    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stored", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get()[0] if self.state.exists() else None
        batch = _in_order(rows, ["ts", "event_id"])
        hits = []
        for now in batch["ts"]:
            stored, hit = ttl_step(stored, float(now), self.ttl)
            hits.append(hit)
        self.state.update((float(stored),))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"].to_numpy(), "hit": hits})

    def close(self) -> None:
        pass


class RateProcessor(StatefulProcessor):
    def __init__(self, n: int, threshold: float):
        self.n, self.threshold = n, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("results", "failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [bool(r[0]) for r in self.state.get()]
        batch = _in_order(rows, ["ts", "event_id"])
        rates, flags = [], []
        for failed in batch["failed"]:
            kept = [*kept, bool(failed)][-self.n:]
            rate = sum(kept) / len(kept)
            rates.append(rate)
            flags.append(len(kept) >= self.n // 2 and rate >= self.threshold)
        self.state.put([(r,) for r in kept])
        yield pd.DataFrame(
            {"key": key[0], "event_id": batch["event_id"].to_numpy(), "failure_rate": rates, "open": flags}
        )

    def close(self) -> None:
        pass


class SessionProcessor(StatefulProcessor):
    """The last messages of a session; an idle time longer than the limit starts it anew."""

    def __init__(self, keep: int, idle_seconds: float):
        self.keep, self.idle_seconds = keep, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("messages", "id long, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["ts", "event_id"])
        kept = [(int(i), float(at)) for i, at in self.state.get()]
        for message in zip(batch["event_id"], batch["ts"]):
            if kept and message[1] - kept[-1][1] > self.idle_seconds:
                kept = []
            kept = [*kept, (int(message[0]), float(message[1]))][-self.keep:]
        self.state.put(kept)
        yield pd.DataFrame({"key": [key[0]], "messages": [len(kept)], "newest": [kept[-1][0]], "oldest": [kept[0][0]]})

    def close(self) -> None:
        pass


class TimeoutProcessor(StatefulProcessor):
    """Review items: decided, or timed out when event time passes the deadline first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "deadline long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in _in_order(rows, ["ts", "kind"]).itertuples():
            at = int(row.ts.timestamp() * 1000)
            deadline, status = self.state.get() if self.state.exists() else (None, None)
            if row.kind == "item" and status is None:
                deadline = at + int(row.timeout_ms)
                self.state.update((deadline, "pending"))
                self.handle.registerTimer(deadline)
            elif row.kind == "decision" and status in ("pending", "pending_timeout"):
                late = at > deadline
                if late and status == "pending":
                    out.append("pending_timeout")
                    self.handle.deleteTimer(deadline)
                elif status == "pending":
                    self.handle.deleteTimer(deadline)
                out.append("decided")
                self.state.update((deadline, "decided"))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "status": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] == "pending":
            self.state.update((self.state.get()[0], "pending_timeout"))
            yield pd.DataFrame({"key": [key[0]], "status": ["pending_timeout"]})

    def close(self) -> None:
        pass


def _run(stream: DataFrame, processor: StatefulProcessor, outputs: str, key: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"key {kind}, {outputs}", outputMode="Append", timeMode="None"
    )


def stream_breaker(stream: DataFrame, key: str, **limits) -> DataFrame:
    """``stream(key, ts seconds, event_id, failed)``: decision and state per event."""
    return _run(stream, BreakerProcessor(limits), "event_id long, allowed boolean, status string, failure_rate double", key)


def stream_bucket(stream: DataFrame, key: str, cap: int = BUCKET, per_minute: int = REFILL_PER_MINUTE) -> DataFrame:
    return _run(stream, BucketProcessor(cap, per_minute), "event_id long, allowed boolean", key)


def stream_ttl_cache(stream: DataFrame, key: str, ttl: float = TTL_SECONDS) -> DataFrame:
    return _run(stream, TtlProcessor(ttl), "event_id long, hit boolean", key)


def stream_failure_rate(stream: DataFrame, key: str, n: int = 20, threshold: float = 0.3) -> DataFrame:
    return _run(stream, RateProcessor(n, threshold), "event_id long, failure_rate double, open boolean", key)


def stream_sessions(stream: DataFrame, key: str, keep: int = KEEP_MESSAGES, idle_seconds: float = float("inf")) -> DataFrame:
    return _run(stream, SessionProcessor(keep, idle_seconds), "messages long, newest long, oldest long", key)


def stream_review_timeouts(stream: DataFrame, key: str = "review_id", watermark: str = "0 seconds") -> DataFrame:
    """``stream(review_id, ts, kind item|decision, timeout_ms)``: status changes as they happen."""
    use_rocksdb(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark("ts", watermark).groupBy(key).transformWithStateInPandas(
        statefulProcessor=TimeoutProcessor(), outputStructType=f"key {kind}, status string", outputMode="Append", timeMode="EventTime"
    )


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed.dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, label: str = "stream", limit_seconds: int = 7200) -> DataFrame:
    """Run a stream over what is there and read back what it wrote."""
    spark = stream.sparkSession
    path = scratch_dir(spark, label)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start(f"{path}/rows")
    )
    if not query.awaitTermination(limit_seconds):
        query.stop()
        raise TimeoutError(f"the stream did not finish within {limit_seconds} seconds")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
