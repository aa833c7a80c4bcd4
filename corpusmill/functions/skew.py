"""Ordered computations that stay distributed when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task. Here a key's
timeline is cut into segments; only per-segment totals (one small row each) are summed in key
order, and every segment is sorted on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_segments(df: DataFrame, order: str, parts: int | None = None) -> Column:
    """Segment number of a numeric order column, from approximate quantile boundaries.

    The boundaries are at most ``parts`` doubles, fixed here once, so that every use of the
    returned column agrees on the cut whatever the physical partitioning.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = df.select(F.col(order).cast("double").alias("v")).approxQuantile(
        "v", [i / parts for i in range(1, parts)], 0.5 / parts
    )
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(bounds, lambda b: b <= F.col(order).cast("double")))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    segment: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key in ``order``.

    ``segment`` must be monotone in the leading order column. Each output name of ``sums`` maps
    to the summed column. Work per task is one (key, segment), never one key.
    """
    seg = "__segment"
    tagged = df.withColumn(seg, segment)
    for name, value in sums.items():
        tagged = tagged.withColumn(f"__v_{name}", value)
    group = [*keys, seg]
    totals = tagged.groupBy(*group).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged
    for name in sums:
        local = local.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(inside))
    out = local.join(offsets, group)
    for name in sums:
        out = out.withColumn(name, F.col(f"__l_{name}") + F.col(f"__o_{name}"))
    return out.drop(seg, *[f"__{p}_{n}" for n in sums for p in "vlo"])


def table_row_number(df: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """Row number over a whole table by a unique numeric column, without one big sort task."""
    return running(
        df.withColumn("__all", F.lit(0)), ["__all"], [order], range_segments(df, order), {name: F.lit(1)}
    ).drop("__all")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows per key. The rank filter lets Spark cut every partition to ``k`` rows per
    key before the shuffle, so a hot key costs ``k`` rows per map task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k).withColumn(
        name, F.col(name).cast("long")
    )


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that to find out."""
    return df.limit(rows + 1).count() <= rows


def each(n: int) -> Column:
    """Repeat a row for every number below ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def salted(big: DataFrame, small: DataFrame, spread: Column, salts: int) -> tuple[DataFrame, DataFrame]:
    """Add a ``salt`` to both sides: each row of ``big`` gets one, ``small`` is repeated for all."""
    return (
        big.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts))),
        small.withColumn("salt", each(salts)),
    )


def previous_time(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], segment: Column, name: str) -> DataFrame:
    """Add the time of the key's row before (null for its first), sorting one segment at a time."""
    tagged = df.withColumn("__segment", segment)
    last = tagged.groupBy(*keys, "__segment").agg(F.max(ts).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "__segment", F.max("__last").over(before).alias("__carried"))
    inside = Window.partitionBy(*keys, "__segment").orderBy(*order)
    out = tagged.withColumn("__lag", F.lag(ts).over(inside)).join(carried, [*keys, "__segment"])
    return out.withColumn(name, F.coalesce("__lag", "__carried")).drop("__lag", "__carried", "__segment")
