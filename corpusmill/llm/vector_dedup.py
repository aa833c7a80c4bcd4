"""Near-duplicate vectors: cells of spherical k-means, cosines of whole blocks within a cell.

Equal vectors are one row with a count. Centroids are fitted on a bounded sample; every vector goes to the cell of its nearest centroid
and to those whose border it is near, so that a pair on two sides of a border meets in the cell that holds the middle between the two. A cell
of any size is cut into blocks; each pair of blocks is one matrix product, whose result leaves the task as link counts per
vector and as a spanning forest, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage
from corpusmill.functions.skew import each
from corpusmill.llm.common import components, rows

#: Bytes of the sampled vectors on which centroids are fitted; at most 1,024 vectors and 64 bytes of it for each cell.
SAMPLE_BYTES = 16_000_000
SAMPLE_ROWS = 16_384
MAX_CELLS = 1024
CELL_ROWS = 1000
BLOCK_ROWS = 4096
#: Rows of a block that are multiplied at once.
STRIPE_ROWS = 512
STEPS = 8
#: Tasks among which the copies of one vector are dealt when results return to the rows.
SALTS = 16

_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; none may be zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(unit: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means over unit vectors, from evenly spread rows; empty cells go."""
    centre = np.unique(unit[np.linspace(0, len(unit) - 1, cells).astype(np.int64)], axis=0)
    for _ in range(steps):
        own = (unit @ centre.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        total = np.add.reduceat(unit[order], first)
        length = np.sqrt((total * total).sum(axis=1))
        centre = np.where(length[:, None] > 1e-9, total / np.maximum(length, 1e-9)[:, None], centre[held])
    return centre


def border(threshold: float, dimensions: int, certain: bool) -> float:
    """How far beyond a cell's border a vector of a linked pair can lie when the middle of the pair is inside.

    Half the chord of the angle, if ``certain``. Otherwise three standard deviations of a difference of that size without a preferred
    direction, which is the less the more dimensions there are.
    """
    half = 2 * math.sin(math.acos(max(-1.0, min(1.0, threshold))) / 4)
    return half if certain else min(half, 3 * half / math.sqrt(dimensions))


def cells_of(unit: np.ndarray, centre: np.ndarray, reach: float) -> np.ndarray:
    """Which cells (columns) each vector goes to: its own and those whose border is at most ``reach`` away."""
    score = unit @ centre.T
    own = score.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centre[own] @ centre.T, 0))
    near = score[np.arange(len(unit)), own][:, None] - score <= reach * apart
    near[np.arange(len(unit)), own] = True
    return near


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(left: dict, right: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, links): by key (u, v) how many rows each vector is linked with, and by id edges of a forest over them (links 0).

    ``right`` None: the block meets itself. Pairs that share a cell with a smaller number were seen there.
    """
    other = left if right is None else right
    width = max(left["lower"].max(initial=0), other["lower"].max(initial=0)) + 1
    seen = [np.zeros((len(x["unit"]), width), np.float32) for x in (left, other)]
    for mark, x in zip(seen, (left, other), strict=True):
        mark[x["of"], x["lower"]] = 1
    found = []
    for low in range(0, len(left["unit"]), STRIPE_ROWS):
        near = left["unit"][low : low + STRIPE_ROWS] @ other["unit"].T >= threshold
        if right is None:
            near[np.arange(len(near)), low + np.arange(len(near))] = False
        a, b = np.nonzero(near)
        new = np.einsum("ij,ij->i", seen[0][low + a], seen[1][b]) == 0 if len(left["lower"]) and len(other["lower"]) else np.ones(len(a), bool)
        found.append((low + a[new], b[new]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(a):
        return (np.empty(0, np.int64),) * 3
    ids = [(left["key"], np.bincount(a, other["copies"][b].astype(np.float64), len(left["id"])))]
    if right is not None:
        ids.append((other["key"], np.bincount(b, left["copies"][a].astype(np.float64), len(other["id"]))))
    u, links = np.concatenate([i[n > 0] for i, n in ids]), np.concatenate([n[n > 0] for _, n in ids]).astype(np.int64)
    both = left["id"] if right is None else np.concatenate((left["id"], other["id"]))
    root = _roots(len(both), a, b if right is None else b + len(left["id"]))
    moved = np.flatnonzero(root != np.arange(len(both)))
    return (
        np.concatenate((u, both[moved])),
        np.concatenate((u, both[root[moved]])),
        np.concatenate((links, np.zeros(len(moved), np.int64))),
    )


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, certain: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links join vectors with a cosine of at least ``threshold``.

    n_links counts other rows linked directly, component_id is the smallest vec_id reachable, kept tells whether it is the row's own. Cosines
    are taken in double precision. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths, nor rows without a vec_id (their component is null and they are kept). Rows that share a vec_id are one
    node of the graph. Other columns, labels too, are ignored. No pair below the threshold is ever linked; with ``certain`` none above it is
    missed, at the price of many more copies of vectors that lie between cells; without it a pair is missed if its difference points across a border by
    more than three standard deviations. Up to twice ``CELL_ROWS`` distinct vectors there is one cell and nothing is missed.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull(), x).alias("x"))
    table = table.withColumn("key", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    distinct = table.filter("x is not null").groupBy("key", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    distinct = cut_lineage(distinct)
    found = cut_lineage(_within_cells(distinct, threshold, certain))
    direct = found.filter("links > 0").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("links = 0"), "u", "v")

    # Back to the rows: copies of one vector are dealt among tasks, a single one needs its own only.
    linked = distinct.select("key", "id", "copies").join(direct, "key", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    linked = linked.filter("copies > 1 or links is not null or root is not null")
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("long")
    several = F.when(F.col("copies") > 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(
        F.array(F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("long"))
    )
    result = linked.select(
        "key", F.explode(several).alias("salt"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root")
    )
    out = table.select("vec_id", "key").withColumn("salt", salt).join(result, ["key", "salt"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _within_cells(distinct: DataFrame, threshold: float, certain: bool) -> DataFrame:
    """(u, v, links) of all pairs of blocks, see ``_links``."""
    spark = distinct.sparkSession
    # One row for each length of vectors; centroids of all lengths together stay within the bounds.
    counts = {r.d: r.n for r in distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    total, centres, offset = max(1, sum(counts.values())), {}, {}
    for d, n in sorted(counts.items()):
        cells = min(MAX_CELLS * n // total, n // CELL_ROWS)
        offset[d] = sum(len(c) for c in centres.values())
        if cells < 2:
            centres[d] = np.zeros((1, d))
            continue
        size = min(SAMPLE_ROWS * n // total, max(1, SAMPLE_BYTES // (8 * d)))
        sample = distinct.filter(F.size("x") == d).select("x", F.xxhash64("x", F.lit(1)).alias("h")).orderBy("h", "x").limit(size)
        centres[d] = fit_centroids(unit_rows(np.array([r.x for r in sample.collect()])), min(cells, max(2, size // 8)))
    shared = spark.sparkContext.broadcast((centres, offset))
    dealt = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("x", pa.list_(pa.float64())), ("copies", pa.int64()), ("cell", pa.int32()), ("lower", pa.list_(pa.int32()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, offset = shared.value
        for batch in batches:
            size = np.asarray(batch.column("x").value_lengths())
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                part = batch.take(pa.array(at))
                unit = unit_rows(np.asarray(part.column("x").flatten()).reshape(len(at), d))
                near = cells_of(unit, centres[d], border(threshold, d, certain))
                row, cell = np.nonzero(near)
                cell = cell + offset[d]
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(at)))[row]
                lower = [cell[i - p : i].tolist() for i, p in enumerate(place.tolist())]
                for low in range(0, len(row), 10_000):
                    k = slice(low, low + 10_000)
                    q = pa.array(row[k])
                    yield rows(dealt, (part.column("key").take(q), part.column("id").take(q), part.column("x").take(q), part.column("copies").take(q), cell[k], lower[k]))

    spread = cut_lineage(distinct.select("key", "id", "x", "copies").mapInArrow(deal, "key long, id long, x array<double>, copies long, cell int, lower array<int>"))
    # One row for each cell, of which there are at most MAX_CELLS and one for each length.
    blocks = {r.cell: -(-r.n // BLOCK_ROWS) for r in spread.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not blocks:
        return spark.createDataFrame([], "u long, v long, links long")
    parts = F.element_at(F.create_map(*[F.lit(int(v)) for kv in blocks.items() for v in kv]), F.col("cell"))
    block = F.pmod(F.xxhash64("key", F.lit(2)), parts).cast("int")
    tiles = spread.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "key", "id", "x", "copies", "lower", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def block_of(table: pa.Table) -> dict:
        size = np.asarray(table.column("lower").combine_chunks().value_lengths())
        return {
            "key": np.asarray(table.column("key")),
            "id": np.asarray(table.column("id")),
            "copies": np.asarray(table.column("copies")),
            "unit": unit_rows(np.asarray(table.column("x").combine_chunks().flatten()).reshape(len(table), -1)),
            "of": np.repeat(np.arange(len(table)), size),
            "lower": np.asarray(table.column("lower").combine_chunks().flatten()),
        }

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        side = np.asarray(table.column("block"))
        left = block_of(table.filter(pa.array(side == i)))
        if i == j:
            u, v, links = _links(left, None, threshold)
        elif (side == j).any() and (side == i).any():
            u, v, links = _links(left, block_of(table.filter(pa.array(side == j))), threshold)
        else:
            u = v = links = np.empty(0, np.int64)
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], schema=_FOUND)

    return tiles.groupBy("cell", "i", "j").applyInArrow(meet, "u long, v long, links long")
