"""Batch twins of the order-dependent operators: one pass over each key in time order.

Rows are shuffled by key and sorted within tasks; a fold then walks the Arrow batches with the
state of the current key only, so memory does not grow with a key. Where the state is known to
reset after an idle gap, a key is cut there and its parts run in parallel. Where there is no such gap, parts of a key
start from a state that the rows before them suggest; parts whose guess proves wrong run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusmill.functions.session import cut_lineage
from corpusmill.functions.skew import previous_time, running

SEGMENT_SECONDS = 3600
Step = Callable[[object, float, dict], tuple[object, dict]]


def ordered_scan(
    df: DataFrame, key: str, ts: str, order: list[str], step: Step, outputs: str, gap_seconds: float | None = None
) -> DataFrame:
    """Fold ``step(state, ts, row) -> (state, output columns)`` over each key, state first None.

    ``ts`` is in seconds. ``outputs`` is the DDL of the added columns.
    """
    groups = [key]
    if gap_seconds is not None:
        segment = F.floor(F.col(ts) / SEGMENT_SECONDS)
        timed = previous_time(df, [key], ts, [ts, *order], segment, "__before")
        fresh = (F.col("__before").isNull() | (F.col(ts) - F.col("__before") > gap_seconds)).cast("long")
        df = running(timed, [key], [ts, *order], segment, {"__part": fresh}).drop("__before")
        groups = [key, "__part"]
    columns = [f.name for f in df.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + outputs
    added = [part.strip().split(" ")[0] for part in outputs.split(",")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: object = None
        for batch in batches:
            results: dict[str, list] = {name: [] for name in added}
            for row in batch.to_dict("records"):
                group = tuple(row[g] for g in groups)
                if group != current:
                    current, state = group, None
                state, out = step(state, float(row[ts]), row)
                for name in added:
                    results[name].append(out[name])
            yield batch.assign(**results)[[*columns, *added]]

    ordered = df.repartition(*groups).sortWithinPartitions(*groups, ts, *order)
    out = ordered.mapInPandas(walk, schema)
    return out.drop("__part") if gap_seconds is not None else out


def speculative_scan(
    df: DataFrame, key: str, ts: str, order: list[str], uses: list[str], step: Callable[..., tuple[object, dict]],
    outputs: str, encode: Callable[[object], str], decode: Callable[[str], object], block: int = 10_000, warm: int = 256,
) -> DataFrame:
    """Fold ``step(state, ts, *uses) -> (state, output columns)`` over each key, state first None, with a key spread over tasks.

    A key is cut into blocks of ``block`` rows. Every block runs from the state that the ``warm`` rows before it lead to when they
    start from nothing, and leaves the state it ends in. Where that is not the state which the next block started from, that block runs again,
    until all borders agree; then all blocks run once more from the right states, with outputs. The rows are the same as from one ordered pass.
    Most automata forget their start within ``warm`` rows; at worst there is one round for each block of the longest key. ``encode`` and ``decode``
    turn a state into text and back. Keys of one block run once. A null key is a key of its own; rows without a time have no place and are left out.
    """
    numbered = running(
        df.withColumn("__key", F.struct(key)), ["__key"], [ts, *order], F.floor(F.col(ts) / SEGMENT_SECONDS), {"__rn": F.lit(1)}
    ).withColumn("__block", F.floor((F.col("__rn") - 1) / block).cast("long"))
    place = ["__key", "__block"]
    summary = StructType([StructField("__key", numbered.schema["__key"].dataType), StructField("__block", LongType()), StructField("entry", StringType()), StructField("exit", StringType())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part[0], pa.array([part[1]], pa.int64()), pa.array([part[2]], pa.string()), pa.array([encode(state)], pa.string())], names=summary.names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("__first", "__entry", "__own", "__block", ts, *uses)]
            for i, (first, entry, own, number, now, *values) in enumerate(zip(*columns, strict=True)):
                if first:
                    if part:
                        yield closed()
                    state, part = decode(entry) if entry else None, [batch.column("__key").slice(i, 1), number, None]
                if own == number and part[2] is None:
                    part[2] = encode(state)
                state, _ = step(state, float(now), *values)
        if part:
            yield closed()

    def run(rows: DataFrame) -> DataFrame:
        dealt = rows.select(*place, "__first", "__entry", "__own", "__rn", ts, *uses).repartition(*place).sortWithinPartitions(*place, "__rn")
        return dealt.mapInArrow(ends, summary)

    entries = None
    if df.groupBy(key).agg(F.count("*").alias("c")).filter(F.col("c") > block).limit(1).count():
        numbered = cut_lineage(numbered)
        own, at = F.col("__block"), F.pmod(F.col("__rn") - 1, F.lit(block))
        many = numbered.join(numbered.filter(F.col("__rn") == block + 1).select("__key"), "__key", "left_semi")
        carried = F.explode(F.when(at >= block - warm, F.array(own, own + 1)).otherwise(F.array(own)))
        guessed = many.withColumns({"__own": own, "__entry": F.lit(None).cast("string"), "__number": carried}).drop("__block").withColumnRenamed("__number", "__block")
        begin = F.greatest(F.col("__block") * block - warm, F.lit(0)) + 1
        known = cut_lineage(run(guessed.withColumn("__first", F.col("__rn") == begin)).filter("entry is not null"))
        while True:
            before = F.lag("exit").over(Window.partitionBy("__key").orderBy("__block"))
            wrong = cut_lineage(known.withColumn("__entry", before).filter("__entry <> entry").select(*place, "__entry"))
            if not wrong.limit(1).count():
                break
            again = numbered.join(wrong, place).withColumns({"__own": own, "__first": at == 0})
            known = cut_lineage(known.join(wrong, place, "left_anti").unionByName(run(again)))
        entries = known.select(*place, F.col("entry").alias("__entry"))
    rows = numbered.join(entries, place, "left") if entries is not None else numbered.withColumn("__entry", F.lit(None).cast("string"))
    kept, added = df.columns, StructType.fromDDL(outputs)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            results: dict[str, list] = {name: [] for name in added.names}
            columns = [batch.column(c).to_pylist() for c in ("__rn", "__entry", ts, *uses)]
            for rn, entry, now, *values in zip(*columns, strict=True):
                if (rn - 1) % block == 0:
                    state = decode(entry) if entry else None
                state, out = step(state, float(now), *values)
                for name in added.names:
                    results[name].append(out[name])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(results[n]) for n in added.names]], names=[*kept, *added.names]
            )

    ordered = rows.repartition(*place).sortWithinPartitions(*place, "__rn").select(*kept, "__rn", "__entry")
    return ordered.mapInArrow(walk, StructType([*df.schema.fields, *added.fields]))


def rolling_failure_rate(
    results: DataFrame, key: str, ts: str, order: list[str], n: int = 20, threshold: float = 0.3, block: int = 10_000
) -> DataFrame:
    """Failure share of the last ``n`` results of the key and whether it opens the breaker (only
    with at least ``n // 2`` results).

    Rows are numbered per key by segments, then cut into blocks that repeat the ``n - 1`` rows
    before them; so every window is whole and no task holds a key.
    """
    numbered = running(results, [key], [ts, *order], F.floor(F.col(ts) / SEGMENT_SECONDS), {"__rn": F.lit(1)})
    at = F.col("__rn") - 1
    own = F.floor(at / block).cast("long")
    carried = F.pmod(at, F.lit(block)) >= block - (n - 1)
    blocks = numbered.withColumn("__own", own).withColumn(
        "__block", F.explode(F.when(carried, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    window = Window.partitionBy(key, "__block").orderBy("__rn").rowsBetween(-(n - 1), 0)
    rated = blocks.withColumns(
        {"samples": F.count("*").over(window), "failures": F.sum(F.col("failed").cast("long")).over(window)}
    ).filter("__block = __own")
    rate = F.col("failures") / F.col("samples")
    return rated.withColumns(
        {"failure_rate": rate, "open": (F.col("samples") >= n // 2) & (rate >= threshold)}
    ).drop("__rn", "__own", "__block")
