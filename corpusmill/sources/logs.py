"""Sinks for logs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusmill.operators.evaluation import comparison_table


def append_json_log(df: DataFrame, path: str) -> None:
    """One JSON line per row, appended."""
    df.write.mode("append").json(path)


def write_comparison_csv(runs: DataFrame, path: str) -> DataFrame:
    """Write the per-question summary and return what was written."""
    table = comparison_table(runs)
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return table
