"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The incidence of a document is its set of distinct 5-word shingles (64-bit hashes). Documents with equal
sets are one row of the matrix. Rows can only reach the bound when they share an n-gram among the first
n - ceil(t n) + 1 of each in one global order; the order puts frequent n-grams last. Over these n-grams the product is taken first, in
column blocks whose counts are summed; pairs that cannot reach their bound any more go. Rows that are left
connected form a block. Blocks are multiplied with themselves over their whole sets: overlap counts are
accumulated column block by column block, and a pair is dropped as soon as its count plus what is
left of the shorter row stays below the bound that the two sizes give. A block too large for a task is
cut into tiles; every two parts of it meet in one tile. A tile returns a spanning forest and the number of
links of each row, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage
from corpusmill.llm.common import binary_texts, components, mix, rolling, rows, signed, slices, word_hashes

#: Most n-grams that the global order ranks by frequency; the rest are ordered by hash. Any order gives the
#: same links, this one keeps blocks small.
RANKED_NGRAMS = 100_000
#: N-grams gathered before local counts are passed on.
COUNTED_AT_ONCE = 4_000_000
#: Prefix n-grams gathered before they are sent to their column blocks.
POSTS_AT_ONCE = 2_000_000
#: Pairs of a column block whose counts are gathered before they are passed on.
PAIRS_AT_ONCE = 4_000_000
#: Bits of the candidates' filter for each of them, and bits of the whole filter at most (64 MB).
FILTER_BITS_EACH, FILTER_BITS = 32, 1 << 29
#: Rows from which on an n-gram is a node of the candidate graph instead of giving pairs.
HOT_ROWS = 200
#: Overlap count of an edge that stays whatever its bound is.
CERTAIN = 1 << 30
#: Rows, and entries, of a block that one task multiplies.
BLOCK_ROWS = 1024
BLOCK_ENTRIES = 4_000_000
#: Columns added to the overlap counts at once.
COLUMN_BLOCK = 2048

#: One n-gram of one row: its low bits, the row, the row's size, its n-grams here and where they end.
POST = np.dtype([("ngram", "<u4"), ("row", "<i8"), ("n", "<u4"), ("q", "<u4"), ("theta", "<u4")])

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    hashes, begin = word_hashes([t.translate(_LOWER) for t in texts])
    windows = rolling(hashes, k)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= k:
            yield np.unique(windows[a : b - k + 1])
        else:
            yield rolling(hashes[a:b], int(b - a)) if b > a else np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(s).sum() + np.uint64(len(s))], dtype=np.uint64))[0]


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n elements with any set that it links to."""
    return -(-percent * n // 100)


def frequent_ngrams(docs: DataFrame, k: int, limit: int = RANKED_NGRAMS) -> tuple[np.ndarray, int]:
    """The ``limit`` most frequent n-grams, rarest first, from counts over all documents, and how many
    of them are not hot."""
    schema = pa.schema([("ngram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return rows(schema, (signed(values[n > 1]), n[n > 1]))

        held, size = [], 0
        for batch in batches:
            for _, _, texts in slices(batch):
                for s in shingle_sets(texts, k):
                    held.append(s)
                    size += len(s)
                if size > COUNTED_AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    counts = binary_texts(docs).mapInArrow(count, "ngram long, n long").groupBy("ngram").agg(F.sum("n").alias("n"))
    top = counts.filter("n >= 4").orderBy(F.desc("n"), "ngram").limit(limit).collect()
    return np.array([r.ngram for r in reversed(top)], dtype=np.int64).view(np.uint64), sum(r.n < HOT_ROWS for r in top)


def incidence(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, cold: int) -> DataFrame:
    """doc_id, n, row (id of the set, null if empty), the set's first n-grams in the global order, apart
    from the hot ones among them, and theta, the place in that order up to which all are given."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("row", pa.int64()), ("prefix", pa.binary()), ("hot", pa.binary()), ("theta", pa.int64())])
    order = np.argsort(frequent)
    known, rank = frequent[order], order.astype(np.uint64) << np.uint64(32) | np.uint64(1 << 63)
    first_hot, last = np.uint64(cold << 32 | 1 << 63), (1 << 32) - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, texts in slices(batch):
                n, row, prefix, hot, theta = [], [], [], [], []
                for s in shingle_sets(texts, k):
                    n.append(len(s))
                    if not len(s):
                        row.append(None)
                        prefix.append(b"")
                        hot.append(b"")
                        theta.append(0)
                        continue
                    key = s >> np.uint64(1)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        key = np.where(known[at] == s, rank[at], key)
                    order = np.argsort(key, kind="stable")[: len(s) - needed(len(s), percent) + 1]
                    first, key = s[order], key[order]
                    q = int(np.searchsorted(key, first_hot))
                    row.append(int(signed(np.array([set_id(s)]))[0]))
                    prefix.append(first[:q].tobytes())
                    hot.append(first[q:].tobytes())
                    theta.append(int(key[-1] >> np.uint64(32)) if q == len(first) else last)
                yield rows(schema, (ids.slice(low, high - low), n, row, prefix, hot, theta))

    return binary_texts(docs, "doc_id").mapInArrow(build, "doc_id long, n long, row long, prefix binary, hot binary, theta long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of the edges in hand; leaves out nodes that reach no smaller one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def candidate_links(spark: SparkSession, matrix: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect every two rows which may link.

    Rows of one n-gram meet in compact blobs; a task adds up what its column block gives for each pair, the
    counts of all column blocks are summed, and pairs below their bound go: up to the smaller of two
    prefix ends the overlap is known, beyond it no more than the rest of that row can be shared. An
    n-gram of very many rows (``HOT_ROWS``) is a node of its own instead, so its rows never meet in one task. One that
    turns out to be so frequent only here, as it was not among the ranked ones, ties its rows to the
    first of them with a count that no bound exceeds: its edges, too, are as many as its rows. Edges to hot n-grams are
    taken from all documents, copies included, so that only prefixes are dealt out by row.
    """
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = pa.schema([("part", pa.int32()), ("posts", pa.binary())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("need", pa.int32())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            post, part = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            post, cuts = post[order], np.searchsorted(part[order], np.arange(parts + 1))
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            return rows(sent, (full, [post[cuts[p] : cuts[p + 1]].tobytes() for p in full]))

        for batch in batches:
            blobs = batch.column("prefix").to_pylist()
            size = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
            ngram = np.frombuffer(b"".join(blobs), np.uint64)
            post = np.empty(len(ngram), POST)
            post["ngram"], post["q"] = ngram & np.uint64(0xFFFFFFFF), np.repeat(size, size)
            for c in ("row", "n", "theta"):
                post[c] = np.repeat(np.asarray(batch.column(c)), size)
            held.append((post, ((ngram >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)))
            waiting += len(post)
            if waiting > POSTS_AT_ONCE:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    def counted(post: np.ndarray, i: list[np.ndarray], j: list[np.ndarray]) -> pa.RecordBatch:
        x, y = post[np.concatenate(i)], post[np.concatenate(j)]
        both, at, count = np.unique(np.stack((x["row"], y["row"]), axis=1), axis=0, return_index=True, return_counts=True)
        x, y = x[at], y[at]
        left_x, left_y = x["n"].astype(np.int64) - x["q"], y["n"].astype(np.int64) - y["q"]
        left = np.where(x["theta"] < y["theta"], left_x, np.where(x["theta"] > y["theta"], left_y, np.maximum(left_x, left_y)))
        least = -(-percent * (x["n"].astype(np.int64) + y["n"]) // (100 + percent))
        return rows(pair, (both[:, 0], both[:, 1], count, least - left))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("posts").to_pylist(), strict=True):
                blobs.setdefault(p, []).append(blob)
        for p in list(blobs):
            post = np.frombuffer(b"".join(blobs.pop(p)), POST)
            order = np.lexsort((post["row"], post["ngram"]))
            run = np.flatnonzero(np.diff(post["ngram"][order], prepend=np.uint32(0)) != 0)
            first = np.union1d([0], run)
            length = np.diff(np.append(first, len(post)))
            i, j, gathered = [], [], 0
            for m in np.unique(length[length > 1]):
                at = order[first[length == m][:, None] + np.arange(m)[None, :]]
                if m >= HOT_ROWS:
                    a, b = np.repeat(post["row"][at[:, 0]], m - 1), post["row"][at[:, 1:]].ravel()
                    a, b = a[a != b], b[a != b]
                    yield rows(pair, (a, b, np.full(len(a), CERTAIN), np.zeros(len(a), np.int64)))
                    continue
                u, v = np.triu_indices(int(m), 1)
                for low in range(0, len(at), max(1, 1_000_000 // len(u))):
                    some = at[low : low + max(1, 1_000_000 // len(u))]
                    x, y = some[:, u].ravel(), some[:, v].ravel()
                    n, o = post["n"][x].astype(np.int64), post["n"][y].astype(np.int64)
                    fit = (100 * np.minimum(n, o) >= percent * np.maximum(n, o)) & (post["row"][x] != post["row"][y])
                    i.append(x[fit])
                    j.append(y[fit])
                    gathered += len(i[-1])
                    if gathered > PAIRS_AT_ONCE:
                        yield counted(post, i, j)
                        i, j, gathered = [], [], 0
            if i:
                yield counted(post, i, j)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("hot").to_pylist()
            if any(blobs):
                yield rows(edge, forest(np.frombuffer(b"".join(blobs), np.int64), np.repeat(np.asarray(batch.column("row")), [len(b) // 8 for b in blobs])))

    held = matrix.filter("row is not null")
    cold = held.select("row", "n", "theta", "prefix").dropDuplicates(["row"]).mapInArrow(spread, "part int, posts binary").repartition(parts // 2, "part").mapInArrow(meet, "a long, b long, c int, need int")
    cold = cold.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).filter("c >= need").select("a", "b")
    return cold.union(held.filter("length(hot) > 0").select("row", "hot").mapInArrow(hot, "a long, b long"))


def product_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the pairs of sets that link, by accumulating overlaps over column blocks."""
    n = np.array([len(s) for s in sets], dtype=np.float64)
    count = len(sets)
    values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), n.astype(np.int64))
    shared = df[column] > 1
    column, owner = (np.cumsum(df > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    left = np.bincount(owner, minlength=count).astype(np.float64)
    least = np.ceil((percent * (n[:, None] + n[None, :]) - 1e-6) / (100 + percent))
    alive = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    np.fill_diagonal(alive, False)
    overlap = np.zeros((count, count), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMN_BLOCK):
        a, b = np.searchsorted(column, (first, first + COLUMN_BLOCK))
        used, place = np.unique(owner[a:b], return_inverse=True)
        block = np.zeros((len(used), COLUMN_BLOCK), dtype=np.float32)
        block[place, column[a:b] - first] = 1
        overlap[np.ix_(used, used)] += block @ block.T
        left -= np.bincount(owner[a:b], minlength=count)
        alive &= overlap + np.minimum(left[:, None], left[None, :]) >= least
        if not alive.any():
            break
    return alive & (100 * overlap >= percent * (n[:, None] + n[None, :] - overlap))


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Components and link counts of documents whose shingle sets have a Jaccard index of percent / 100 or more.

    Needs doc_id and text; other columns are ignored. Returns doc_id, n_shingles, component_id (smallest
    doc_id reachable by links), n_links (documents linked with this one), one row per input row.
    A null or empty text has no shingles and links with nothing. A null doc_id takes part, but a
    component is named by the smallest id that is not null; it is null only if no other member has one.
    Rows that repeat a doc_id are documents of their own. Sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent, cold = frequent_ngrams(docs, k)
    matrix = cut_lineage(incidence(docs, k, percent, frequent, cold))
    size = matrix.filter("row is not null").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("n").alias("n"))
    candidates = components(candidate_links(spark, matrix, percent))
    member = cut_lineage(candidates.withColumnRenamed("node", "row").join(size, "row"))
    blocks = member.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("entries")).filter("m > 1")
    blocks = blocks.select("root", F.ceil(F.greatest(F.col("m") / block_rows, F.col("entries") / block_entries)).cast("int").alias("parts"))
    member = cut_lineage(member.join(blocks, "root").withColumn("own", F.pmod(F.hash("row"), "parts")))
    total = member.agg(F.count("*"), F.sum("n"), F.max("parts")).first()
    if not total[0]:
        links = None
    else:
        links = _multiply(docs, member, k, percent, int(max(total[0] / block_rows, total[1] / block_entries)) + 1)
    if links is None:
        found = size.select("row", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component_id")).limit(0)
        return _labelled(matrix, size, found)
    final = links.filter("root is not null").select("row", "root").distinct()
    if total[2] > 1:
        final = components(final.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "row")
    else:
        final = final.union(final.select(F.col("root").alias("row"), "root")).distinct()
    named = final.join(size.select("row", "doc_id"), "row")
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("row", "component_id")
    degree = links.groupBy("row").agg(F.sum("links").alias("links"))
    return _labelled(matrix, size, degree.join(named, "row", "left"))


def _labelled(matrix: DataFrame, size: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document. Only sets that have copies or links are joined to their documents, in one join of two exchanges
    that adaptive execution can split where a set has very many copies; documents without shingles meet nothing."""
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    degree = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    labels = cut_lineage(size.join(found, "row", "left").filter("copies > 1 or links > 0 or component_id is not null").select("row", component, degree))
    document = ["doc_id", F.col("n").alias("n_shingles"), component, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")]
    alone = ["doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")]
    return matrix.filter("row is not null").join(labels, "row", "left").select(*document).union(matrix.filter("row is null").select(*alone))


def _may_hold(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """The documents whose id is among ``ids``, and few others, without a shuffle of the documents.

    The ids set bits of a filter of ``FILTER_BITS_EACH`` bits for each of the ``count`` ids, ``FILTER_BITS`` (64 MB) at most; beyond that
    it lets more documents through. Its blocks of 4 KB are sent to the documents.
    """
    bits = min(FILTER_BITS, FILTER_BITS_EACH << max(count - 1, 1).bit_length())
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    place = [F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).cast("int").alias("bit")]
    blocks = ids.select(*place).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = F.expr("shiftright(cast(conv(hex(substring(bits, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) & 1 = 1")
    return docs.select("*", *place).join(F.broadcast(blocks), "block").filter(held).select(*docs.columns)


def _multiply(docs: DataFrame, member: DataFrame, k: int, percent: int, groups: int) -> DataFrame:
    """row, root (a row that it links to over others of the tile, or null) and links counted in each tile."""
    held = ["row", "root", "own", "parts", "copies"]
    made = pa.schema([*[(c, pa.int64()) for c in held], ("set", pa.binary())])
    out = pa.schema([("row", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_pylist()
            for low, high, texts in slices(batch):
                found = [s for s in shingle_sets(texts, k)]
                keep = [i for i, s in enumerate(found) if len(s) and int(signed(np.array([set_id(s)]))[0]) == ids[low + i]]
                part = batch.slice(low, high - low).take(pa.array(keep, pa.int64()))
                yield rows(made, (*[part.column(c) for c in held], [found[i].tobytes() for i in keep]))

    def multiply(table: pa.Table) -> pa.Table:
        frame = table.select([*held, "ti", "tj"]).to_pandas()
        blobs = table.column("set")
        pieces = []
        for root, at in frame.groupby("root", sort=True).indices.items():
            part = frame.iloc[at].drop_duplicates("row")
            at = at[np.isin(at, part.index)]
            links = product_links([np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in at], percent)
            row, own, parts, copies = (part[c].to_numpy() for c in ("row", "own", "parts", "copies"))
            counted = links
            if parts[0] > 2:
                other = np.where(own == part["ti"].to_numpy(), part["tj"].to_numpy(), part["ti"].to_numpy())
                counted = links & ((own[:, None] != own[None, :]) | (other == (own + 1) % parts)[:, None])
            a, b = np.nonzero(np.triu(links))
            node, low = forest(row[a], row[b])
            to = dict(zip(node.tolist(), low.tolist(), strict=True))
            pieces.append(pd.DataFrame({"row": row, "root": pd.array([to.get(r) for r in row.tolist()], dtype="Int64"), "links": counted @ copies}))
        return pa.Table.from_pandas(pd.concat(pieces), schema=out, preserve_index=False)

    wanted = member.select("doc_id")
    picked = _may_hold(docs.filter("text is not null"), wanted, wanted.count()).join(member.select(F.col("doc_id").alias("d"), *held), F.col("doc_id").eqNullSafe(F.col("d")))
    picked = picked.select(*held, F.col("text").cast("binary").alias("text")).mapInArrow(sets, ", ".join(f"{c} long" for c in held) + ", set binary")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda b: (b != F.col("own")) | (F.col("parts") == 1))
    tiles = picked.withColumn("other", F.explode(others)).withColumns({"ti": F.least("own", "other"), "tj": F.greatest("own", "other")}).drop("other")
    tiles = tiles.withColumn("group", F.when(F.col("parts") == 1, F.pmod(F.col("root"), F.lit(groups))).otherwise(F.col("root")))
    return cut_lineage(tiles.groupBy("group", "parts", "ti", "tj").applyInArrow(multiply, "row long, root long, links long"))
