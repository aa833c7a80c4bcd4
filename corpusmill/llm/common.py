"""Helpers shared by the training-data operators: words, hashes, blobs and graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage

#: A word is a run of other characters than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy pass handles; longer texts are cut at white space.
SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    _POWERS = np.cumprod(np.full(4096, np.uint64(0xC2B2AE3D27D4EB4F)))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(2 * n, np.uint64(0xC2B2AE3D27D4EB4F)))
    return _POWERS


def _hash_slice(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~_SPACE[buf]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    inside = np.arange(int(lens.sum())) - np.repeat(first, lens)
    value = _BYTE[buf[solid]] * _powers(int(lens.max()))[inside]
    return starts, lens, mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * _STEP)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit hash of all words of a run of bytes."""
    found, at = [], 0
    with np.errstate(over="ignore"):
        while at < len(buf):
            end = min(at + SLICE_BYTES, len(buf))
            while end < len(buf) and not _SPACE[buf[end]]:
                gap = np.flatnonzero(_SPACE[buf[end : end + SLICE_BYTES]])
                end = end + int(gap[0]) if len(gap) else min(end + SLICE_BYTES, len(buf))
            s, n, h = _hash_slice(buf[at:end])
            found.append((s + at, n, h))
            at = end
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 texts, and where each text's words begin (n + 1 offsets)."""
    where, _, hashes = word_spans(np.frombuffer(b"\n".join(texts), np.uint8))
    return hashes, np.searchsorted(where, np.cumsum([0] + [len(t) + 1 for t in texts]))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, by doubling; entry i covers words i to i + k - 1."""
    with np.errstate(over="ignore"):
        out, span, double, width, step = None, 0, h, 1, _WORD_STEP
        while True:
            if k & width:
                if out is None:
                    out, span = double, width
                else:
                    n = len(h) - span - width + 1
                    if n <= 0:
                        return np.empty(0, np.uint64)
                    out, span = out[:n] * step + double[span : span + n], span + width
            width *= 2
            if width > k:
                return mix(out)
            n = len(double) - width // 2
            if n <= 0:
                return np.empty(0, np.uint64)
            double, step = double[:n] * step + double[width // 2 :], step * step


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) of runs of rows with about ``limit`` bytes; null texts come as empty."""
    column = batch.column(text)
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total, low = np.cumsum(size), 0
    while low < len(size):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + limit, "right")))
        yield low, high, [t or b"" for t in column.slice(low, high - low).to_pylist()]
        low = high


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def binary_texts(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes, which Arrow hands over without decoding."""
    return df.select(*keep, F.col("text").cast("binary").alias("text"))


def pack_gaps(x: np.ndarray) -> bytes:
    """Ascending non-negative integers as gaps of seven bits a byte."""
    gaps = np.diff(np.asarray(x, dtype=np.int64), prepend=0)
    if not len(gaps):
        return b""
    if gaps.max() < 128:
        return gaps.astype(np.uint8).tobytes()
    parts = [gaps >> (7 * i) for i in range(max(1, (int(gaps.max()).bit_length() + 6) // 7))]
    used = np.stack([p > 0 for p in parts], axis=1)
    used[:, 0] = True
    low = np.stack([p & 127 for p in parts], axis=1).astype(np.uint8)
    more = np.zeros_like(used)
    more[:, :-1] = used[:, 1:]
    return (low | (more.astype(np.uint8) << 7))[used].tobytes()


def unpack_gaps(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` refers to it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rows(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def numbered_rows(docs: DataFrame, name: str) -> DataFrame:
    """The rows with numbers that ascend with doc_id, nulls first, then in an order that the rows fix; kept in the shared folder.

    For tables in which ids are null or come more than once.
    """
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("__tie")]
    ordered = docs.withColumn("__tie", F.xxhash64(*sorted(docs.columns))).repartitionByRange(count, *order).sortWithinPartitions(*order)
    return cut_lineage(ordered.drop("__tie").withColumn(name, F.monotonically_increasing_id()))


def unique_ids(docs: DataFrame) -> bool:
    """Whether doc_id is never null and never repeated."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 or doc_id is null").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge table; root is the smallest node it can reach.

    Alternating large-star and small-star steps: every round is two shuffles of at most as many rows as
    there are edges, a logarithmic number of rounds. A hub's neighbours are not gathered: the minimum
    of a neighbourhood is an aggregate, joined back to the edges. Each round is written to the shared
    folder, so a lost executor costs one round.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*").filter("u <> v").distinct()
        )
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
