"""Best-fit packing of documents into sequences, planned over the counts of lengths.

Only the histogram of piece lengths, at most one row for each length and salt, reaches the driver. Best fit with
falling lengths runs over counts: all sequences that look alike are one entry. The plan is a table of slot ranges for each
length; pieces number themselves within their length and take the slot of that number by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage
from corpusmill.llm.common import rows, slices
from corpusmill.llm.tokens import shared_encoder

#: Numbering within a length is done in so many groups, so that a common length is no single task.
SALTS = 32


def cut_into_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents as token ids with an end id, long ones cut.

    The first piece of a cut document is the shorter one. A null text is empty.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(tokenizer, words=False), end_id.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, _, texts in slices(batch):
                out = [[] for _ in schema]
                for doc, text in zip(ids[low:], texts):
                    blob = encoder.encode(text.decode()) + end
                    size = len(blob) // 4
                    starts = [0, *range(size % capacity or capacity, size, capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], size], strict=True)):
                        part = blob[4 * a : 4 * b]
                        for column, x in zip(out, (doc, piece, a, b - a, zlib.crc32(part), part)):
                            column.append(x)
                yield rows(schema, out)

    spec = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(cut, spec)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, first, last, sequence, times, offset) of a best fit with falling lengths.

    The pieces first to last of a length (from 0) go to the sequences from ``sequence`` on, ``times`` to each, from
    ``offset`` on. Work and size follow the number of lengths, not of pieces: a length splits at most one group of
    open sequences and starts at most two, so there are no more than three groups for each length, each with at
    most sqrt(2 * capacity) different lengths (139,000 ranges for a capacity of 1024).
    """
    open_: dict[int, list[tuple[int, list[tuple[int, int, int, int]]]]] = {}
    taken = dict.fromkeys(counts, 0)

    def put(length: int, left: int, bins: int, times: int, held: list) -> None:
        first = taken[length]
        taken[length] += bins * times
        open_.setdefault(left - length * times, []).append((bins, [*held, (length, first, times, capacity - left)]))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            left = min((r for r, groups in open_.items() if r >= length and groups), default=capacity)
            groups = open_.get(left)
            bins, held = groups.pop() if groups else (todo, [])
            times = left // length
            full = min(bins, todo // times)
            rest = bins - full
            if full:
                put(length, left, full, times, held)
                todo -= full * times
                held = _later(held, full)
            if todo and todo < times and rest:
                put(length, left, 1, todo, held)
                todo, rest, held = 0, rest - 1, _later(held, 1)
            if rest and groups is not None and held:
                open_[left].append((rest, held))
    plan, sequence = [], 0
    for groups in open_.values():
        for bins, held in groups:
            plan += [(length, first, first + bins * times - 1, sequence, times, offset) for length, first, times, offset in held]
            sequence += bins
    return plan


def _later(held: list, bins: int) -> list:
    """What the sequences hold that come after the first ``bins`` of a group."""
    return [(length, first + bins * times, times, offset) for length, first, times, offset in held]


def best_fit_pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens; only longer documents are cut.

    Needs doc_id and text; other columns are ignored. One row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset (and ids, little-endian 32-bit, if asked for). A null or empty text is the end id alone.
    Repeated rows are packed each; equal rows are interchangeable. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut_into_pieces(docs, tokenizer, end_id, capacity, with_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")))
    histogram = sorted((r.length, r.salt, r.n) for r in pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    before = []
    for length, salt, n in histogram:
        before.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    slots = spark.createDataFrame(plan_best_fit(counts, capacity), "length long, first long, last long, sequence long, times long, place long")
    before = spark.createDataFrame(before, "length long, salt int, before long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("number", F.row_number().over(order)).join(F.broadcast(before), ["length", "salt"]).withColumn("number", F.col("number") - 1 + F.col("before"))
    placed = numbered.join(F.broadcast(slots), (numbered.length == slots.length) & (F.col("number") >= F.col("first")) & (F.col("number") <= F.col("last"))).drop(slots.length)
    inside = F.col("number") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(inside / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.col("length") * F.pmod(inside, F.col("times"))).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
