"""Unfolding array columns into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: list[str | Column], array: Column | str, pos: str, item: str) -> DataFrame:
    """One row per array item with its position as a long.

    The outer form is used on purpose: for the plain one the optimizer infers a filter on the
    array's size and pushes it below the projections that build the array, which repeats (and,
    inside nested lambdas, multiplies) that work. Rows of empty arrays are dropped afterwards.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
    return out.withColumn(pos, F.col(pos).cast("long"))
