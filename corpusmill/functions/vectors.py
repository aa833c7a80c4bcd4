"""Vector columns and block-wise nearest neighbours.

Comparing a query table with a vector table is matrix work, so the comparison runs in Arrow
batches and only the best ``k`` per query leave a task; pairs are never materialised.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.skew import each, fits, top_k

QUERY_BLOCK = 1024
VECTOR_BLOCK = 20_000
#: Vectors compared with a query block at once.
STRIPE = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, an error for unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    clash = F.raise_error(F.concat(F.lit("vector lengths differ: "), F.size(a), F.lit(" and "), F.size(b)))
    return F.when(F.size(a) != F.size(b), clash.cast("double")).otherwise(value)


#: Sentences whose vectors exist at once.
SENTENCES = 4096


def term_index(terms: pa.Array, dim: int) -> np.ndarray:
    """The place of each term in a hashed vector, as HashingTF has it: its 32-bit Murmur3 hash with seed 42."""

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << 15 | k >> 17) * np.uint32(0x1B873593)

    starts = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    raw = terms.buffers()[2]
    data = np.frombuffer((b"" if raw is None else raw.to_pybytes()) + bytes(4), np.uint8)
    starts, size = starts[:-1], np.diff(starts)
    word = lambda at: sum(data[at + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    h = np.full(len(size), 42, np.uint32)
    block, held = 0, np.flatnonzero(size >= 4)
    while len(held):
        x = h[held] ^ mixed(word(starts[held] + 4 * block))
        h[held] = (x << 13 | x >> 19) * np.uint32(5) + np.uint32(0xE6546B64)
        block += 1
        held = held[size[held] >= 4 * (block + 1)]
    tail = word(starts + size // 4 * 4) & ((np.uint32(1) << (8 * (size % 4)).astype(np.uint32)) - np.uint32(1))
    h ^= mixed(tail)
    h ^= size.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return (h ^ h >> np.uint32(16)).view(np.int32) % dim


def sentence_gaps(tokens: pa.Array, dim: int) -> pa.Array:
    """One less the cosine of each sentence and the next, null for the last of its list, by unit vectors of hashed counts over the
    sentence and its neighbours. ``tokens``: lists of sentences, whose tokens are joined by blanks. Sums run in the order of the dimensions."""
    sentences, n = tokens.flatten(), len(tokens.flatten())
    sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    last, first = np.zeros(n, bool), np.zeros(n, bool)
    last[ends[sizes > 0] - 1] = True
    first[(ends - sizes)[sizes > 0]] = True
    out = np.empty(n)
    for low in range(0, n, SENTENCES):
        high = min(n, low + SENTENCES)
        start, end = max(0, low - 1), min(n, high + 2)
        words = pc.split_pattern(sentences.slice(start, end - start), " ")
        of, terms = pc.list_parent_indices(words), pc.list_flatten(words)
        filled = pc.not_equal(terms, "")
        found = pc.dictionary_encode(terms.filter(filled))
        place = term_index(found.dictionary, dim)[np.asarray(found.indices)]
        m = end - start
        counts = np.bincount(place * m + np.asarray(of.filter(filled)), minlength=dim * m).reshape(dim, m).astype(float)
        at = np.arange(low, min(high + 1, n))
        before, after = np.maximum(at - 1 - start, 0), np.minimum(at + 1 - start, m - 1)
        context = counts[:, at - start] + counts[:, before] * ~first[at] + counts[:, after] * ~last[at]
        norm = np.sqrt((context * context).sum(0))
        context /= np.where(norm == 0, 1, norm)
        own, cross = np.zeros(len(at)), np.zeros(len(at) - 1)
        for x in context:
            own += x * x
            cross += x[:-1] * x[1:]
        norms = np.sqrt(own[:-1]) * np.sqrt(own[1:])
        out[low : low + len(cross)] = 1 - np.where(norms == 0, 0.0, cross / np.where(norms == 0, 1, norms))
    values = pa.array(out, pa.float64(), mask=last)
    edges = pa.array(np.concatenate(([0], ends)), pa.int32(), mask=np.concatenate((np.asarray(tokens.is_null()), [False])))
    return pa.ListArray.from_arrays(edges, values)


def distance_to_similarity(d: Column) -> Column:
    d = d.cast("double")
    usable = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(~usable, F.lit(0.0)).when(d <= 0, F.lit(1.0)).otherwise(1 / (1 + d))


def _similarity(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        qn, vn = np.where(qn == 0, np.inf, qn), np.where(vn == 0, np.inf, vn)
        return (q / qn[:, None]) @ (v / vn[:, None]).T
    d = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)
    return np.where(np.isfinite(d), 1 / (1 + np.maximum(d, 0)), 0.0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype="float64") for x in column])


Reducer = Callable[[pd.DataFrame], pd.DataFrame]


def _compare(q_ids, q: np.ndarray, block: pd.DataFrame, metric: str, floor: float | None, k: int | None) -> pd.DataFrame:
    """Candidate pairs of one block: above the floor and, per query, not below the k-th score."""
    sims = _similarity(q, _matrix(block["vector"]), metric)
    order = np.round(sims, 9)
    mask = np.ones_like(sims, dtype=bool) if floor is None else sims >= floor
    if k is not None and sims.shape[1] > k:
        kth = np.partition(order, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        mask &= order >= kth[:, None]
    qi, vi = np.nonzero(mask)
    rest = {c: block[c].to_numpy()[vi] for c in block.columns if c != "vector"}
    return pd.DataFrame({"query_id": np.asarray(q_ids)[qi], **rest, "score": sims[qi, vi]})


def _striped(
    q_ids, q: np.ndarray, block: pd.DataFrame, metric: str, floor: float | None, k: int | None, reduce: Reducer, best: pd.DataFrame | None = None
) -> pd.DataFrame | None:
    """``best`` and what a block adds to it, reduced after each stripe."""
    for low in range(0, len(block), STRIPE):
        found = _compare(q_ids, q, block.iloc[low : low + STRIPE], metric, floor, k)
        best = reduce(found if best is None else pd.concat([best, found], ignore_index=True))
    return best


def compare_blocks(
    queries: DataFrame, vectors: DataFrame, metric: str, reduce: Reducer, floor: float | None, k: int | None
) -> DataFrame:
    """Reduced candidates of every (query block, vector block).

    ``queries(query_id, vector)``; ``vectors`` has a ``vector`` and any other columns. A query
    table of one block is sent to all tasks and the vectors stay where they are; a larger one is
    cut into blocks that meet the vector blocks in a cogroup.
    """
    queries = queries.select("query_id", "vector")
    others = [f for f in vectors.schema.fields if f.name != "vector"]
    fields = [f"query_id {queries.schema['query_id'].dataType.simpleString()}"]
    fields += [f"{f.name} {f.dataType.simpleString()}" for f in others] + ["score double"]
    schema = ", ".join(fields)

    if fits(queries, QUERY_BLOCK):
        local = queries.toPandas()
        if local.empty:
            return queries.sparkSession.createDataFrame([], schema)
        shared = queries.sparkSession.sparkContext.broadcast((local["query_id"].tolist(), _matrix(local["vector"])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best: pd.DataFrame | None = None
            for batch in batches:
                best = _striped(ids, q, batch, metric, floor, k, reduce, best)
            if best is not None and len(best):
                yield best

        return vectors.mapInPandas(scan, schema)

    q_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    v_blocks = max(1, math.ceil(vectors.count() / VECTOR_BLOCK))

    def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int, key: Column) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(other, each(n_other))

    # Both sides may come from one table: a cogroup needs different columns of them.
    left = spread(queries.withColumnRenamed("vector", "q"), "qb", q_blocks, "vb", v_blocks, F.col("query_id"))
    right = spread(vectors, "vb", v_blocks, "qb", q_blocks, F.struct(*[f.name for f in others]))

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame(columns=["query_id", *[f.name for f in others], "score"])
        return _striped(q["query_id"].tolist(), _matrix(q["q"]), v.drop(columns=["qb", "vb"]), metric, floor, k, reduce)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, schema)


def _best_of(k: int, id: str) -> Reducer:
    """The best ``k`` rows per query by rounded score, ties by id."""

    def cut(found: pd.DataFrame) -> pd.DataFrame:
        tagged = found.assign(__order=found["score"].round(9))
        ordered = tagged.sort_values(["query_id", "__order", id], ascending=[True, False, True])
        return ordered.groupby("query_id", sort=False).head(k).drop(columns="__order")

    return cut


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, id: str, metric: str = "l2", threshold: float = 0.0
) -> DataFrame:
    """(query_id, id, score, rank): exact best ``k`` per query, ties by id."""
    floor = threshold if threshold > 0 else None
    found = compare_blocks(queries, vectors.select(id, "vector"), metric, _best_of(k, id), floor, k)
    return top_k(found, ["query_id"], [F.desc(F.round("score", 9)), F.asc(id)], k)


def first_similar(queries: DataFrame, entries: DataFrame, floor: float, order: list[str]) -> DataFrame:
    """For each query the first entry, by ``order``, whose cosine reaches ``floor``."""

    def cut(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["query_id", *order]).groupby("query_id", sort=False).head(1)

    found = compare_blocks(queries, entries, "cosine", cut, floor, None)
    return top_k(found, ["query_id"], [F.asc(c) for c in order], 1).drop("rank")


def nearest_scoped(queries: DataFrame, members: DataFrame, k: int, id: str, metric: str = "l2") -> DataFrame:
    """``nearest`` inside scopes: ``queries(query_id, scope_id, vector)`` against
    ``members(scope_id, id, vector)``. A scope of any size is spread over blocks of vectors."""
    asked = queries.select("query_id", "scope_id", "vector")
    held = members.select("scope_id", id, "vector")
    v_blocks = max(1, math.ceil(held.count() / VECTOR_BLOCK))
    q_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int, key: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(other, each(n_other))

    left = spread(asked.withColumnRenamed("vector", "q"), "qb", q_blocks, "vb", v_blocks, "query_id")
    right = spread(held, "vb", v_blocks, "qb", q_blocks, id)
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *held.schema.fields]}
    schema = f"query_id {types['query_id']}, {id} {types[id]}, score double"

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame(columns=["query_id", id, "score"])
        return _striped(q["query_id"].tolist(), _matrix(q["q"]), v[[id, "vector"]], metric, None, k, _best_of(k, id))[["query_id", id, "score"]]

    keys = ("scope_id", "qb", "vb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)
    return top_k(found, ["query_id"], [F.desc(F.round("score", 9)), F.asc(id)], k)
