"""Exact top-k inner products over M-trees.

With one more component, sqrt(M - |x|^2) for vectors and 0 for queries (M the largest |x|^2), a larger inner product is a smaller
Euclidean distance. Vectors are dealt by nearest root pivot into blocks of bounded size; a block's tree, built once and kept as a blob, has
paged metric nodes that hold covering radii and distances to the parent pivot. Queries search it best first and in company: in each round
every query names its most promising node, and those that name the same one share one matrix product. Bounds from the triangle inequality over stored
distances leave out most computations. A query searches its own block first and is then sent to those blocks only whose covering
radius lets them hold a better or equal score. Scores are integers; bounds have slack for rounding, and ties are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage
from corpusmill.functions.skew import each
from corpusmill.llm.common import rows

#: Root pivots, a sample of the vectors; any choice gives the same results.
ROOT_PIVOTS = 64
BLOCK_VECTORS = 20_000
PAGE_ENTRIES = 256
#: Queries that search a block in one task, and those that go through its tree together.
TASK_QUERIES = 16_384
TOGETHER = 512
SLACK = 1e-6
#: Scores below this one are exact as doubles, in any order of summing.
EXACT = float(1 << 52)
#: Stands for no score, no id.
NONE, NO_ID = -(1 << 62), (1 << 63) - 1

_HIT = "query_id long, vec_id long, score long"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Node:
    __slots__ = ("ids", "values", "pivots", "radii", "to_parent", "children")


def build(points: np.ndarray, values: np.ndarray, ids: np.ndarray, pivot: np.ndarray) -> Node:
    """A metric node over points; every entry keeps its distance to the node's pivot."""
    node = Node()
    away = np.sqrt(((points - pivot) ** 2).sum(axis=1))
    spread = len(points) > PAGE_ENTRIES and away.max() > 0
    if spread:
        # Pivots farthest from each other in turn.
        chosen, near = [int(away.argmax())], None
        while len(chosen) < min(PAGE_ENTRIES, 2 + len(points) // PAGE_ENTRIES):
            d = ((points - points[chosen[-1]]) ** 2).sum(axis=1)
            near = d if near is None else np.minimum(near, d)
            if near.max() <= 0:
                break
            chosen.append(int(near.argmax()))
        centre = points[chosen]
        d = (points**2).sum(axis=1)[:, None] - 2 * points @ centre.T + (centre**2).sum(axis=1)[None, :]
        owner = d.argmin(axis=1)
        spread = len(np.unique(owner)) > 1
    if not spread:
        # A page, or copies of one point, which share all bounds.
        order = np.argsort(away, kind="stable")
        node.values, node.ids, node.to_parent, node.children = values[order], ids[order], away[order], None
        return node
    node.children, node.pivots, node.radii = [], [], []
    for k in np.unique(owner):
        at = np.flatnonzero(owner == k)
        node.children.append(build(points[at], values[at], ids[at], centre[k]))
        node.pivots.append(centre[k])
        node.radii.append(np.sqrt(((points[at] - centre[k]) ** 2).sum(axis=1)).max())
    node.pivots, node.radii = np.array(node.pivots), np.array(node.radii)
    node.to_parent = np.sqrt(((node.pivots - pivot) ** 2).sum(axis=1))
    return node


class Best:
    """The k best (score, id) of each of a run of queries; of equal scores the smaller ids."""

    def __init__(self, count: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.scores, self.ids = np.full((count, k), NONE, np.int64), np.full((count, k), NO_ID, np.int64)

    def least(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floors)

    def take(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a row of scores for each of the queries ``q``."""
        bar, k = self.least()[q], self.k
        if len(ids) > k:
            bar = np.maximum(bar, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
        a, b = np.nonzero((scores >= bar[:, None]) & (scores > NONE))
        q_all = np.concatenate((np.repeat(q, k), q[a]))
        s, i = np.concatenate((self.scores[q].ravel(), scores[a, b])), np.concatenate((self.ids[q].ravel(), ids[b]))
        order = np.lexsort((i, -s, q_all))
        first = np.flatnonzero(np.diff(q_all[order], prepend=-1))
        at = order[first[:, None] + np.arange(k)]
        self.scores[q_all[at[:, 0]]], self.ids[q_all[at[:, 0]]] = s[at], i[at]


def search(root: Node, pivot: np.ndarray, points: np.ndarray, values: np.ndarray, own: np.ndarray, k: int, lift: float, floors: np.ndarray) -> Best:
    """The k best of a tree for each query. ``floors``: scores that k candidates elsewhere already reach, or NONE.

    ``own`` are ids that don't count for a query.
    """
    best, nodes = Best(len(points), k, floors), [root]
    square = (points**2).sum(axis=1) + lift
    blur = SLACK + np.sqrt(1e-13 * (square + lift))
    number = np.float64 if lift < EXACT else np.int64
    asked = values.astype(number)
    who, bound, node = np.arange(len(points)), np.zeros(len(points)), np.zeros(len(points), np.int64)
    away = np.sqrt(((points - pivot) ** 2).sum(axis=1))
    while True:
        least = best.least()
        reach = np.where(least == NONE, np.inf, np.sqrt(np.maximum(square - 2.0 * least, 0)) * (1 + SLACK) + blur)
        open_ = bound <= reach[who]
        who, bound, node, away = who[open_], bound[open_], node[open_], away[open_]
        if not len(who):
            return best
        order = np.lexsort((bound, who))
        chosen = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
        more = []
        for n in np.unique(node[chosen]):
            at = chosen[node[chosen] == n]
            q, d, page = who[at], away[at], nodes[n]
            near = reach[q]
            if page.children is None:
                low, high = np.searchsorted(page.to_parent, (d - near).min()), np.searchsorted(page.to_parent, (d + near).max(), "right")
                for a in range(low, high, PAGE_ENTRIES):
                    b = min(a + PAGE_ENTRIES, high)
                    scores = (asked[q] @ page.values[a:b].astype(number).T).astype(np.int64)
                    scores[own[q][:, None] == page.ids[None, a:b]] = NONE
                    best.take(q, scores, page.ids[a:b])
                continue
            stored = np.abs(page.to_parent[None, :] - d[:, None]) - page.radii[None, :]
            child = np.flatnonzero((stored <= near[:, None]).any(axis=0))
            centre = page.pivots[child]
            to = np.sqrt(np.maximum((points[q] ** 2).sum(axis=1)[:, None] - 2 * points[q] @ centre.T + (centre**2).sum(axis=1)[None, :], 0))
            lower = np.maximum(np.maximum(to - page.radii[child], stored[:, child]), bound[at][:, None])
            i, j = np.nonzero(lower <= near[:, None])
            more.append((q[i], lower[i, j], len(nodes) + j, to[i, j]))
            nodes.extend(page.children[c] for c in child)
        left = np.ones(len(who), bool)
        left[chosen] = False
        who, bound, node, away = (np.concatenate(x) for x in zip((who[left], bound[left], node[left], away[left]), *more))


def _lifted(x: np.ndarray, lift: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(lift - (x**2).sum(axis=1), 0))[:, None]))


def _query_points(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.zeros((len(x), 1))))


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` highest inner products of each query.

    Needs vec_id and embedding; other columns are ignored. Components become floor(scale * x); scores are taken on these and must fit a long.
    Queries are rows whose vec_id is divisible by ``every``. Vectors (or ids) that are null or hold null or non-finite components take no part,
    nor do empty ones; vectors of different lengths don't meet. Rows with the query's vec_id are its own. Ties go to the smaller vec_id; repeated rows
    are candidates each, while a query asked twice is answered once.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(sound & (F.size(x) > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("x")
    )
    whole = cut_lineage(whole)
    dims = [r.d for r in whole.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    found = [_one_length(whole.filter(F.size("x") == d), k, every) for d in dims]
    if not found:
        return whole.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


def _one_length(vectors: DataFrame, k: int, every: int) -> DataFrame:
    lift = float(vectors.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c))).first()[0])
    sample = vectors.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(ROOT_PIVOTS).collect()
    pivots = np.unique(_lifted(np.array([r.x for r in sample], dtype=np.float64), lift), axis=0)
    dealt = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("region", pa.int32()), ("away", pa.float64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("x")
                x = _lifted(np.asarray(column.flatten(), dtype=np.float64).reshape(batch.num_rows, -1), lift)
                d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :], 0)
                region = d.argmin(axis=1)
                yield rows(dealt, (batch.column("vec_id"), column, region, np.sqrt(((x - pivots[region]) ** 2).sum(axis=1))))

    spread = vectors.mapInArrow(deal, "vec_id long, x array<long>, region int, away double")
    count = {r.region: -(-r.n // BLOCK_VECTORS) for r in spread.groupBy("region").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.create_map(*[F.lit(v) for kv in count.items() for v in kv]), F.col("region"))
    spread = cut_lineage(spread.withColumn("block", F.pmod(F.xxhash64("vec_id"), parts).cast("int")))
    blocks = spread.groupBy("region", "block").agg(F.max("away").alias("radius")).collect()  # one row for each BLOCK_VECTORS
    place = np.array([(b.region, b.block) for b in blocks])
    radius = np.array([b.radius for b in blocks])
    asked = spread.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    queries = cut_lineage(asked.select(F.col("vec_id").alias("query_id"), "x", "region", "block", F.lit(None).cast("long").alias("least")))
    chunks = -(-queries.count() // TASK_QUERIES)
    if not chunks:
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.col("least").alias("score"))
    made = pa.schema([("region", pa.int32()), ("block", pa.int32()), ("tree", pa.binary())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten(), dtype=np.int64).reshape(len(column), -1)

    def plant(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        values = matrix(held.column("x"))
        small = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max)
        tree = build(_lifted(values.astype(np.float64), lift), values.astype(small), held.column("vec_id").to_numpy(), pivots[key[0].as_py()])
        return pa.table([[key[0].as_py()], [key[1].as_py()], [pickle.dumps(tree)]], schema=made)

    trees = cut_lineage(spread.select("region", "block", "vec_id", "x").groupBy("region", "block").applyInArrow(plant, "region int, block int, tree binary"))
    trees = trees.withColumn("chunk", each(chunks))

    def look(key: tuple[pa.Scalar, ...], held: pa.Table, asked: pa.Table) -> pa.Table:
        hits = [_HITS.empty_table()]
        if len(held) and len(asked):
            tree = pickle.loads(held.column("tree")[0].as_py())
            ids, values, least = asked.column("query_id").to_numpy(), matrix(asked.column("x")), asked.column("least").fill_null(NONE).to_numpy()
            for low in range(0, len(ids), TOGETHER):
                at = slice(low, low + TOGETHER)
                best = search(tree, pivots[key[0].as_py()], _query_points(values[at].astype(np.float64)), values[at], ids[at], k, lift, least[at])
                q, i = np.nonzero(best.scores > NONE)
                hits.append(pa.table([ids[at][q], best.ids[q, i], best.scores[q, i]], schema=_HITS))
        return pa.concat_tables(hits)

    def run(asked: DataFrame) -> DataFrame:
        sent = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
        return trees.groupBy("region", "block", "chunk").cogroup(sent.groupBy("region", "block", "chunk")).applyInArrow(look, _HIT)

    home = cut_lineage(run(queries))
    least = home.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    sent = pa.schema([("query_id", pa.int64()), ("x", pa.list_(pa.int64())), ("region", pa.int32()), ("block", pa.int32()), ("least", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            point = _query_points(x)
            away = np.sqrt(np.maximum((point**2).sum(axis=1)[:, None] - 2 * point @ pivots.T + (pivots**2).sum(axis=1)[None, :], 0))
            score = np.array(batch.column("least").to_pylist(), dtype=np.float64)
            reach = np.where(np.isnan(score), np.inf, np.sqrt(np.maximum((x**2).sum(axis=1) + lift - 2 * np.nan_to_num(score), 0)))
            own = (place[None, :, 0] == np.asarray(batch.column("region"))[:, None]) & (place[None, :, 1] == np.asarray(batch.column("block"))[:, None])
            go, to = np.nonzero((away[:, place[:, 0]] - radius[None, :] <= (reach * (1 + SLACK) + SLACK)[:, None]) & ~own)
            for low in range(0, len(go), 10_000):
                q, b = pa.array(go[low : low + 10_000]), to[low : low + 10_000]
                yield rows(sent, (batch.column("query_id").take(q), batch.column("x").take(q), place[b, 0], place[b, 1], batch.column("least").take(q)))

    bounded = queries.drop("least").join(least, "query_id", "left")
    others = run(bounded.mapInArrow(send, "query_id long, x array<long>, region int, block int, least long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = home.union(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
