"""Postings in shards of documents, with an upper bound for every block of them.

A shard holds the documents of one stretch of a task's rows, numbered by length; it is made where the texts are read, without a shuffle. A term's row
has the numbers and counts of its documents, and for each block of ``BLOCK_DOCS`` numbers the greatest count and the least document length, from
which a bound on the score follows whatever the mean length. Blocks of all terms are aligned, so a query's bound for a block is a sum over its terms:
the blocks with the best bounds are scored first, and of the rest only those whose bound reaches the k-th score found there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.session import scratch_dir
from corpusmill.sources.index import exists, index_generation, index_read

# Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25

#: Documents and tokens of a shard at most, but for single longer documents; numbers of a block; blocks that are scored first.
SHARD_DOCS, SHARD_TOKENS, BLOCK_DOCS, FIRST_BLOCKS = 16_384, 1_000_000, 64, 4
#: Queries that are scored together at most, and numbers in the table of their scores or weights.
GROUP_QUERIES, GROUP_CELLS = 128, 2_000_000
#: Rows of a batch that are copied at once.
PIECE_ROWS = 512


def ints(blob: bytes) -> np.ndarray:
    """Numbers as they are stored: four bytes each, which cross to Python and back without a look at every one."""
    return np.frombuffer(blob, "<i4")


class Postings(NamedTuple):
    """``terms(shard, term, df, cf, numbers, tfs, blocks, max_tf, min_length)`` and ``docs(shard, block_docs, ids, lengths)``.

    ``vocabulary(term, df, cf)`` sums up the shards. Null texts are empty documents. All lists but ``ids`` are binary, see ``ints``.
    """

    terms: DataFrame
    docs: DataFrame
    vocabulary: DataFrame

    def rows(self, id: str = "chunk_id") -> DataFrame:
        """(id, term, tf, doc_length), one row for each posting."""

        def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, ids, lengths in zip(*(batch.column(c) for c in ("shard", "ids", "lengths")), strict=True):
                    n = len(ids.values)
                    columns = [pa.repeat(shard, n), pa.array(np.arange(n)), ids.values, pa.array(ints(lengths.as_py()).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "number", id, "doc_length"])

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, term, numbers, tfs in zip(*(batch.column(c) for c in ("shard", "term", "numbers", "tfs")), strict=True):
                    number, tf = ints(numbers.as_py()).astype(np.int64), ints(tfs.as_py()).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.repeat(x, len(tf)) for x in (shard, term)] + [pa.array(number), pa.array(tf)], ["shard", "term", "number", "tf"])

        kind = self.docs.schema["ids"].dataType.elementType.simpleString()
        held = self.docs.select("shard", "ids", "lengths").mapInArrow(documents, f"shard long, number long, {id} {kind}, doc_length long")
        found = self.terms.select("shard", "term", "numbers", "tfs").mapInArrow(postings, "shard long, term string, number long, tf long")
        return found.join(held, ["shard", "number"]).select(id, "term", "tf", "doc_length")


_LISTS = ("numbers", "tfs", "blocks", "max_tf", "min_length")


def _blobs(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.asarray(values, "<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int32)), data])


#: Kinds of bytes: letters, digits, first bytes of three that may begin a CJK character.
_KINDS = np.zeros(256, np.uint8)
_KINDS[ord("a") : ord("z") + 1], _KINDS[ord("0") : ord("9") + 1], _KINDS[0xE4:0xEA] = 1, 2, 3


def _tokens(lowered: pa.Array) -> pa.Array:
    """A list for each of these lower-cased texts of the tokens that ``text.tokenize`` finds there; found on all bytes at once."""
    texts = pc.fill_null(lowered.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(b"" if raw is None else raw, np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    kind = _KINDS[data]
    lead = np.flatnonzero(kind == 3)
    # U+4E00, where these characters begin, is E4 B8 80, and U+9FFF, the last, E9 BF BF
    outside = lead[(data[lead] == 0xE4) & (data[lead + 1] < 0xB8)]
    kind[outside] = 0
    lead = lead[kind[lead] == 3]
    kind[lead + 1] = kind[lead + 2] = 3
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[ends[ends < len(first)]] = True
    first[lead] = True
    held = kind > 0
    starts = np.flatnonzero(first & held)
    offsets = np.append(np.flatnonzero(first[held]), int(held.sum())).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[held]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), tokens)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Copies of ``PIECE_ROWS`` rows each, so that a shard that waits for more rows does not hold the whole batches that it takes them from."""
    for low in range(0, len(batch), PIECE_ROWS):
        yield batch.take(pa.array(np.arange(low, min(len(batch), low + PIECE_ROWS))))


def _shard(number: int, batches: list[pa.RecordBatch], schema: pa.Schema, block_docs: int) -> pa.RecordBatch:
    """The rows of a shard: first its documents, then its terms in order; blocks of ``block_docs`` documents."""
    table = pa.Table.from_batches(batches)
    lengths = np.asarray(pc.list_value_length(table.column(1))).astype(np.int64)
    # Documents of like length share a block, which brings its bound close to their scores.
    order = np.argsort(lengths, kind="stable")
    table, lengths = table.take(pa.array(order)).combine_chunks(), lengths[order]
    ids, tokens = table.column(0).combine_chunks(), table.column(1).combine_chunks()
    found = pc.dictionary_encode(tokens.flatten())
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    order = np.asarray(pc.sort_indices(found.dictionary)).astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[np.asarray(found.indices)] * max(1, len(ids)) + np.repeat(np.arange(len(ids)), lengths) if len(found) else np.empty(0, np.int64)
    # the longest lists are not needed any more
    found, tokens, table = found.dictionary, None, None
    pair, tf = np.unique(key, return_counts=True)
    del key
    term, doc = pair // max(1, len(ids)), pair % max(1, len(ids))
    block = doc // block_docs
    first = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(block) != 0)))) if len(pair) else np.empty(0, np.int64)
    top = np.maximum.reduceat(tf, first) if len(first) else first
    least = np.minimum.reduceat(lengths[doc], first) if len(first) else first
    edges = np.arange(len(order) + 1)
    by_term, by_block = np.searchsorted(term, edges), np.searchsorted(term[first], edges)
    lists = [_blobs(by_term, doc), _blobs(by_term, tf), _blobs(by_block, block[first]), _blobs(by_block, top), _blobs(by_block, least)]
    total = np.concatenate(([0], np.cumsum(tf)))
    counts = [pa.array(np.diff(by_term), pa.int64()), pa.array(np.diff(total[by_term]), pa.int64())]
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    whole = [ids, _blobs(np.array([0, len(lengths)]), lengths)]
    n = len(order)
    columns = [pa.repeat(pa.scalar(number, pa.int64()), n + 1), pa.concat_arrays([pa.nulls(1, pa.string()), found.take(pa.array(order))])]
    columns.append(pa.concat_arrays([pa.array([block_docs], pa.int32()), pa.nulls(n, pa.int32())]))
    columns += [pa.concat_arrays([pa.nulls(1, x.type), x]) for x in counts + lists]
    columns += [pa.concat_arrays([x, pa.nulls(n, x.type)]) for x in whole]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def build_block_postings(
    chunks: DataFrame, path: str | None = None, id: str = "chunk_id", text: str = "text",
    shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, block_docs: int = BLOCK_DOCS,
) -> Postings:
    """Write the postings of ``chunks`` to ``path``, a fresh folder by default, in one pass over the texts; returns what was written."""
    path = path or scratch_dir(chunks.sparkSession, "postings")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, docs, tokens, schema = TaskContext.get().partitionId(), 0, [], 0, 0, None
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            batch = pa.RecordBatch.from_arrays([batch.column(0), _tokens(batch.column(1))], ["id", "tokens"])
            size = np.asarray(pc.list_value_length(batch.column(1))).astype(np.int64)
            if schema is None:
                fields = [("shard", pa.int64()), ("term", pa.string()), ("block_docs", pa.int32()), ("df", pa.int64()), ("cf", pa.int64())]
                fields += [*[(c, pa.binary()) for c in _LISTS], ("ids", pa.list_(batch.column(0).type)), ("lengths", pa.binary())]
                schema = pa.schema(fields)
            low = 0
            while low < len(size):
                # as many rows as still fit, one at least
                fit = int(np.searchsorted(np.cumsum(size[low:]), shard_tokens - tokens, "right"))
                high = low + max(0 if held else 1, min(fit, shard_docs - docs, len(size) - low))
                if high > low:
                    held.append(batch.slice(low, high - low))
                    docs, tokens, low = docs + high - low, tokens + int(size[low:high].sum()), high
                if low < len(size):
                    made = _shard(part << 32 | count, held, schema, block_docs)
                    count, held, docs, tokens = count + 1, [], 0, 0
                    pa.default_memory_pool().release_unused()
                    yield made
                    del made
        if held:
            yield _shard(part << 32 | count, held, schema, block_docs)

    named = chunks.select(id, F.lower(text).alias("lowered"))
    kind = chunks.schema[id].dataType.simpleString()
    lists = ", ".join(f"{c} binary" for c in _LISTS)
    named.mapInArrow(shards, f"shard long, term string, block_docs int, df long, cf long, {lists}, ids array<{kind}>, lengths binary").write.mode("overwrite").parquet(f"{path}/rows")
    terms = chunks.sparkSession.read.parquet(f"{path}/rows").filter("term is not null")
    terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).write.mode("overwrite").parquet(f"{path}/vocabulary")
    return read_block_postings(chunks.sparkSession, path)


def read_block_postings(spark: SparkSession, path: str) -> Postings:
    rows = spark.read.parquet(f"{path}/rows")
    return Postings(
        rows.filter("term is not null").select("shard", "term", "df", "cf", *_LISTS),
        rows.filter("term is null").select("shard", "block_docs", "ids", "lengths"),
        spark.read.parquet(f"{path}/vocabulary"),
    )


def index_postings(spark: SparkSession, path: str) -> Postings:
    """The postings of a chunk index as of its last write: those of its generation if they are stored, else made and stored now."""
    folder = f"{path}/postings/generation-{index_generation(spark, path)}"
    if exists(spark, f"{folder}/vocabulary/_SUCCESS"):
        return read_block_postings(spark, folder)
    return build_block_postings(index_read(spark, path), folder)


def part_score(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term with weight 1 adds; it grows with the count and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _product(weights: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """``weights`` times the matrix of ``width`` columns with these values; only rows that have some are made."""
    has = np.zeros(weights.shape[1], bool)
    has[row] = True
    dense = np.zeros((int(has.sum()), width))
    dense[(np.cumsum(has) - 1)[row], column] = value
    return weights[:, has] @ dense


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _unblobbed(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all blobs, and where those of each begin and end; read in place, without an object for each blob."""
    wide = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    ends = np.frombuffer(blobs.buffers()[1], wide)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64) if len(blobs) else np.zeros(1, np.int64)
    held = blobs.buffers()[2]
    low, high = int(ends[0]), int(ends[-1])
    return np.frombuffer(held, "<i4", (high - low) // 4, low) if high > low else np.empty(0, "<i4"), (ends - low) // 4


class Shard:
    """A shard's rows in one task; of the terms' lists those that were sent."""

    def __init__(self, table: pa.Table):
        whole = np.asarray(table.column("term").is_null())
        row = table.filter(pa.array(whole)).slice(0, 1)
        self.ids = row.column("ids").combine_chunks().flatten()
        self.lengths = ints(row.column("lengths")[0].as_py())
        self.block_docs = row.column("block_docs")[0].as_py()
        self.n_blocks = -(-len(self.lengths) // self.block_docs)
        terms = table.filter(pa.array(~whole))
        self.terms = _whole(terms.column("term"))
        self.lists, self.ends = {}, {}
        for c in _LISTS:
            if c in table.column_names:
                self.lists[c], self.ends[c] = _unblobbed(_whole(terms.column(c)))

    @functools.cached_property
    def at(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms.to_pylist())}

    def of(self, name: str, term: int) -> np.ndarray:
        return self.lists[name][self.ends[name][term] : self.ends[name][term + 1]]

    @functools.cached_property
    def by_document(self) -> tuple[np.ndarray, ...]:
        """(numbers, terms, counts) in order of documents, then terms, and where those of each block begin and end."""
        number = self.lists["numbers"].astype(np.int64)
        order = np.argsort(number, kind="stable")
        number, term = number[order], np.repeat(np.arange(len(self.terms)), np.diff(self.ends["numbers"]))[order]
        return number, term, self.lists["tfs"][order], np.searchsorted(number, np.arange(self.n_blocks + 1) * self.block_docs)

    def best(self, asked: list[dict[str, float]], mean: float, k: int, members: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """For the weights of each query: (numbers, scores, blocks with a term, blocks scored) of the k best documents, ties by id; ``members``: which ones count.

        A block is scored for all queries of a group that need it by one product of their weights and its documents.
        """
        weights = [{self.at[t]: w for t, w in terms.items() if t in self.at} for terms in asked]
        found, low = [], 0
        while low < len(weights):
            terms, high = set(weights[low]), low + 1
            while high < min(len(weights), low + GROUP_QUERIES):
                more = len(weights[high].keys() - terms)
                if (high + 1 - low) * max(len(terms) + more, len(self.lengths)) > GROUP_CELLS:
                    break
                terms.update(weights[high])
                high += 1
            found += self._best_of(weights[low:high], np.array(sorted(terms), np.int64), mean, k, members)
            low = high
        return found

    def _best_of(self, asked: list[dict[int, float]], terms: np.ndarray, mean: float, k: int, members: np.ndarray | None) -> list:
        n, docs = len(asked), len(self.lengths)
        local = np.full(len(self.terms), -1)
        local[terms] = np.arange(len(terms))
        weights = np.zeros((n, len(terms)))
        for q, held in enumerate(asked):
            weights[q, local[list(held)]] = list(held.values())
        row = np.repeat(local, np.diff(self.ends["blocks"]))
        at = row >= 0
        most = part_score(self.lists["max_tf"][at], self.lists["min_length"][at], mean)
        bounds = _product(np.maximum(weights, 0), row[at], self.lists["blocks"][at], most, self.n_blocks)
        if members is not None:
            bounds[:, np.bincount(np.flatnonzero(members) // self.block_docs, minlength=self.n_blocks) == 0] = 0
        number, term, tf, ends = self.by_document
        scores = np.zeros((n, docs))
        done = np.zeros((n, self.n_blocks), bool)

        def score(chosen: np.ndarray) -> np.ndarray:
            for b in np.flatnonzero(chosen.any(axis=0)):
                row = local[term[ends[b] : ends[b + 1]]]
                at = np.flatnonzero(row >= 0)
                held, first, last = number[ends[b] + at], b * self.block_docs, min(docs, (b + 1) * self.block_docs)
                part, q = part_score(tf[ends[b] + at], self.lengths[held], mean), np.flatnonzero(chosen[:, b])
                made = _product(weights[q], row[at], held - first, part, last - first)
                scores[q, first:last] = made if members is None else np.where(members[first:last], made, 0)
            done[chosen] = True
            # the k-th score of each query, or 0
            return np.maximum(np.partition(scores, docs - k, axis=1)[:, docs - k], 0) if docs >= k else np.zeros(n)

        first = np.zeros((n, self.n_blocks), bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        least = score(first & (bounds > 0))
        least = score((bounds > 0) & ~done & (bounds >= least[:, None] - 1e-8))
        query, found = np.nonzero((scores > 0) & (scores >= least[:, None] - 1e-8))
        exact = self._scores(asked, query, found, mean)
        query, found, exact = query[exact > 0], found[exact > 0], exact[exact > 0]
        order = pc.sort_indices(
            pa.table({"q": query, "s": -np.round(exact, 9), "id": self.ids.take(pa.array(found))}), [("q", "ascending"), ("s", "ascending"), ("id", "ascending")]
        )
        query, found, exact = query[order], found[order], exact[order]
        ends = np.searchsorted(query, np.arange(n + 1))
        held, made = (bounds > 0).sum(axis=1), (done & (bounds > 0)).sum(axis=1)
        return [
            (found[low : min(low + k, high)], exact[low : min(low + k, high)], int(held[q]), int(made[q]))
            for q, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True))
        ]

    def _scores(self, asked: list[dict[int, float]], query: np.ndarray, found: np.ndarray, mean: float) -> np.ndarray:
        """Scores of single documents, added up in the order of a query's terms, so that copies of a text tie in every shard."""
        number, term, tf, _ = self.by_document
        key, total = number * len(self.terms) + term, np.zeros(len(query))
        ends = np.searchsorted(query, np.arange(len(asked) + 1))
        for terms, low, high in zip(asked, ends[:-1], ends[1:], strict=True):
            if low == high:
                continue
            wanted = found[low:high] * len(self.terms) + np.array(list(terms), np.int64)[:, None]
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            part = np.where(key[at] == wanted, part_score(tf[at], self.lengths[found[low:high]], mean), 0)
            total[low:high] = np.cumsum(np.array(list(terms.values()))[:, None] * part, axis=0)[-1]
        return total
