"""Approximate nearest neighbours over inverted lists of product-quantised residuals.

A vector is in the list of its nearest k-means centre, as a code: what is left after the centre is taken off is cut into short pieces, each
named by the nearest of at most 256 fitted ones. A query adds up products from small tables over the codes in the lists that it probes, and
takes each vector's length as it is, so that only the product with the query is approximate; the best vectors by that are scored exactly, on whole
vectors. Centres and pieces are fitted on a bounded sample, all vectors are indexed, and the index is a folder: ``model`` (one row) and
``codes`` (id, cell, squared length and a byte for each piece, sorted by cell).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.session import scratch_dir
from corpusmill.functions.skew import each, fits, top_k
from corpusmill.functions.vectors import dot

#: Cells, cells that a query looks into, vectors on which the model is fitted at most, and components of a piece.
CELLS, PROBE, SAMPLE, PIECE = 64, 56, 20_000, 4
#: Vectors scored exactly for each of the k that are asked for.
RESCORE = 20
QUERY_BLOCK, CODE_BLOCK, STRIPE = 1024, 200_000, 10_000
#: Candidates that are sent to the vectors at most; beyond that both sides are dealt out by id.
SENT_CANDIDATES = 100_000


class Model(NamedTuple):
    centres: np.ndarray  # cells x components, filled up with zeros to whole pieces
    pieces: np.ndarray  # pieces x names x components of a piece


class AnnIndex(NamedTuple):
    model: Model
    codes: DataFrame


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None, :]


def _kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Lloyd's steps from rows that are spread evenly; a centre without rows stays where it is."""
    centre = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64)], axis=0)
    for _ in range(steps):
        own = _squares(x, centre).argmin(1)
        order = np.argsort(own, kind="stable")
        held, first, size = np.unique(own[order], return_index=True, return_counts=True)
        centre[held] = np.add.reduceat(x[order], first) / size[:, None]
    return centre


def _whole(x: np.ndarray, size: int = 0) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, (size or -(-x.shape[1] // PIECE) * PIECE) - x.shape[1])))


def fit_model(vectors: DataFrame, id: str = "chunk_id", cells: int = CELLS, sample: int = SAMPLE) -> Model:
    """Centres and pieces from at most ``sample`` vectors, chosen by hash of the id."""
    some = vectors.filter("vector is not null").select(F.col("vector").cast("array<double>").alias("v"), F.xxhash64(id).alias("h"))
    rows = some.orderBy("h", "v").limit(sample).collect()
    if not rows:
        return Model(np.zeros((0, 0)), np.zeros((0, 0, PIECE)))
    x = _whole(np.array([r.v for r in rows]))
    centres = _kmeans(x, cells)
    rest = x - centres[_squares(x, centres).argmin(1)]
    fitted = [_kmeans(rest[:, i : i + PIECE], 256) for i in range(0, x.shape[1], PIECE)]
    names = max(map(len, fitted))
    return Model(centres, np.stack([np.pad(f, ((0, names - len(f)), (0, 0)), mode="edge") for f in fitted]))


def encode(vectors: DataFrame, model: Model, id: str = "chunk_id") -> DataFrame:
    """(id, cell, square, code) of every vector that is not null."""
    held = vectors.filter("vector is not null").select(id, F.col("vector").cast("array<double>").alias("vector"))
    centres, pieces = model

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = _whole(np.stack(frame["vector"].to_numpy()))
                cell = _squares(x, centres).argmin(1)
                rest = (x - centres[cell]).reshape(len(x), len(pieces), PIECE)
                code = np.stack([_squares(rest[:, j], p).argmin(1) for j, p in enumerate(pieces)], axis=1).astype(np.uint8)
                yield pd.DataFrame({id: frame[id], "cell": cell.astype(np.int32), "square": (x * x).sum(1), "code": [c.tobytes() for c in code]})

    return held.mapInPandas(name, f"{id} {held.schema[id].dataType.simpleString()}, cell int, square double, code binary")


def build_ann_index(vectors: DataFrame, path: str | None = None, id: str = "chunk_id", cells: int = CELLS, sample: int = SAMPLE) -> AnnIndex:
    """Fit, encode and write to ``path``, a fresh folder by default; returns what was written."""
    spark = vectors.sparkSession
    path = path or scratch_dir(spark, "ann")
    model = fit_model(vectors, id, cells, sample)
    (count, size), (pieces, names, _) = model.centres.shape, model.pieces.shape
    row = (count, size, pieces, names, model.centres.ravel().tolist(), model.pieces.ravel().tolist())
    schema = "count int, size int, pieces int, names int, centres array<double>, fitted array<double>"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    codes = encode(vectors, model, id) if count else vectors.limit(0).select(id, F.lit(0).alias("cell"), F.lit(0.0).alias("square"), F.lit(b"").alias("code"))
    codes.sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/codes")
    return read_ann_index(spark, path)


def read_ann_index(spark: SparkSession, path: str) -> AnnIndex:
    r = spark.read.parquet(f"{path}/model").first()
    centres, pieces = np.array(r.centres).reshape(r["count"], r["size"]), np.array(r.fitted).reshape(r.pieces, r.names, PIECE)
    return AnnIndex(Model(centres, pieces), spark.read.parquet(f"{path}/codes"))


def _closest(model: Model, q: np.ndarray, probed: np.ndarray, held: pd.DataFrame, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``keep`` codes nearest to each query, among those in cells that it probes."""
    cell = held["cell"].to_numpy()
    code = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
    near = (q @ model.centres.T)[:, cell]
    for j, p in enumerate(model.pieces):
        near += (q[:, j * PIECE : (j + 1) * PIECE] @ p.T)[:, code[:, j]]
    far = np.where(probed[:, cell], held["square"].to_numpy()[None, :] - 2 * near, np.inf)
    if far.shape[1] > keep:
        at = np.argpartition(far, keep - 1, axis=1)[:, :keep]
    else:
        at = np.broadcast_to(np.arange(far.shape[1]), far.shape)
    value = np.take_along_axis(far, at, axis=1)
    row, column = np.nonzero(np.isfinite(value))
    return row, at[row, column], value[row, column]


def _best(model: Model, ids: np.ndarray, q: np.ndarray, probed: np.ndarray, frames: Iterable[pd.DataFrame], id: str, keep: int) -> pd.DataFrame | None:
    """(query_id, id, far) of the ``keep`` nearest codes of all frames for each query; ``STRIPE`` codes are compared at once."""
    best: pd.DataFrame | None = None
    for frame in frames:
        for low in range(0, len(frame), STRIPE):
            part = frame.iloc[low : low + STRIPE]
            a, b, far = _closest(model, q, probed, part, keep)
            found = pd.DataFrame({"query_id": ids[a], id: part[id].to_numpy()[b], "far": far})
            best = found if best is None else pd.concat([best, found], ignore_index=True)
            best = best.sort_values(["query_id", "far", id]).groupby("query_id", sort=False).head(keep)
    return best


def ann_candidates(queries: DataFrame, index: AnnIndex, keep: int, id: str = "chunk_id", probe: int = PROBE) -> DataFrame:
    """(query_id, id): the ``keep`` vectors nearest to each query by their codes, in the ``probe`` cells with the nearest centres.

    A query table of one block is sent to the codes, which stay where they are; a larger one meets them in blocks by cell. Only
    ``keep`` rows per query leave a task.
    """
    model, codes = index
    spark = codes.sparkSession
    types = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {types}, {id} {codes.schema[id].dataType.simpleString()}, far double"
    asked = queries.filter("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if not len(model.centres):
        return spark.createDataFrame([], schema).drop("far")

    def lists(q: np.ndarray) -> np.ndarray:
        return np.argsort(_squares(q, model.centres), axis=1, kind="stable")[:, :probe]

    if fits(asked, QUERY_BLOCK):
        local = asked.toPandas()
        if local.empty:
            return spark.createDataFrame([], schema).drop("far")
        q = _whole(np.stack(local["vector"].to_numpy()))
        probed = np.zeros((len(q), len(model.centres)), bool)
        np.put_along_axis(probed, lists(q), True, axis=1)
        shared = spark.sparkContext.broadcast((local["query_id"].to_numpy(), q, probed, model))

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, probed, model = shared.value
            best = _best(model, ids, q, probed, frames, id, keep)
            if best is not None:
                yield best

        found = codes.mapInPandas(scan, schema)
    else:
        q_blocks = math.ceil(asked.count() / QUERY_BLOCK)
        v_blocks = max(1, math.ceil(codes.count() / CODE_BLOCK))

        def probing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield frame.assign(cell=lists(_whole(np.stack(frame["vector"].to_numpy()))).tolist())

        block = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))
        left = asked.mapInPandas(probing, f"query_id {types}, vector array<double>, cell array<int>").withColumn("cell", F.explode("cell"))
        left = left.withColumn("qb", block).withColumn("vb", each(v_blocks))
        right = codes.withColumn("vb", F.pmod(F.xxhash64(id), F.lit(v_blocks))).withColumn("qb", each(q_blocks))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query_id": [], id: [], "far": []})
            q = _whole(np.stack(a["vector"].to_numpy()))
            return _best(model, a["query_id"].to_numpy(), q, np.ones((len(q), len(model.centres)), bool), [b], id, keep)

        found = left.groupBy("cell", "qb", "vb").cogroup(right.groupBy("cell", "qb", "vb")).applyInPandas(meet, schema)
    return top_k(found, ["query_id"], [F.asc("far"), F.asc(id)], keep).select("query_id", id)


def _similarity(vector: Column, q: Column) -> Column:
    return F.round(1 / (1 + F.greatest(dot(vector, vector) + dot(q, q) - 2 * dot(vector, q), F.lit(0.0))), 9)


def ann_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 10, id: str = "chunk_id", index: AnnIndex | None = None,
    probe: int = PROBE, rescore: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): approximate neighbours with exact scores, 1 / (1 + squared distance), ties by id.

    ``rescore`` candidates per query, ``RESCORE`` times ``k`` by default, are read as whole vectors. ``index`` is one of these vectors'
    that was built before; otherwise one is built now. Null vectors take no part; queries without one get no rows.
    """
    index = index or build_ann_index(vectors, id=id)
    pairs = ann_candidates(queries, index, rescore or RESCORE * k, id, probe)
    held = vectors.filter("vector is not null").select(id, "vector")
    if fits(queries, SENT_CANDIDATES // (rescore or RESCORE * k)):
        pairs = F.broadcast(pairs)
    scored = held.join(pairs, id).join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    return top_k(scored.select("query_id", id, _similarity(F.col("vector"), F.col("q")).alias("score")), ["query_id"], [F.desc("score"), F.asc(id)], k)


def ann_recall(found: DataFrame, exact: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(query_id, wanted, found, recall): how many of the exact neighbours an approximate search found."""
    hits = exact.select("query_id", id).join(found.select("query_id", id).withColumn("hit", F.lit(1)), ["query_id", id], "left")
    both = hits.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.col("found") / F.col("wanted"))
