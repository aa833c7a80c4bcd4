"""Exact answers from tables: column choice, aggregates, Markdown pipe tables, number checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from corpusmill.functions import text as T
from corpusmill.functions.arrays import unfold
from corpusmill.functions.rule_packs import ZH, matches

Pack = dict[str, tuple[str, ...]]
OPERATIONS = ("max", "min", "avg", "sum", "count", "sort")

# Labels of the answer text.
LABELS_ZH = {
    "count": "共 %s 条记录", "max": "最高: ", "min": "最低: ", "avg": "平均值: ", "sum": "总和: ", "join": "，",
}


def detect_aggregates(queries: DataFrame, pack: Pack = ZH, query: str = "query") -> DataFrame:
    """One boolean per operation the query asks for."""
    return queries.withColumns(
        {f"wants_{op}": F.coalesce(matches(F.col(query), pack[f"calc_{op}"]), F.lit(False)) for op in OPERATIONS}
    )


def target_column(query: Column, columns: list[str]) -> Column:
    """Longest column name written in the query, else the one sharing most characters (the first
    of equals), else null. The names are few and known, so this is one expression per query."""
    written = F.lit(None).cast("string")
    for name in reversed(sorted(columns, key=len, reverse=True)):
        written = F.when(F.contains(query, F.lit(name)), F.lit(name)).otherwise(written)
    shared = {}
    for name in columns:
        total = F.lit(0)
        for char in name:
            total = total + F.contains(query, F.lit(char)).cast("int")
        shared[name] = total
    best = F.greatest(F.lit(0), F.lit(0), *shared.values())
    closest = F.lit(None).cast("string")
    for name in reversed(columns):
        closest = F.when((shared[name] == best) & (best > 0), F.lit(name)).otherwise(closest)
    return F.coalesce(written, closest)


def detect_target_column(queries: DataFrame, columns: list[str], query: str = "query") -> DataFrame:
    return queries.withColumn("target_column", target_column(F.col(query), columns))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, Ty.NumericType)]


def row_text(columns: list[str], join: str = LABELS_ZH["join"]) -> Column:
    return F.concat_ws(
        join, *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    )


def table_statistics(df: DataFrame, order: str) -> DataFrame:
    """(column_name, rows, sum, avg, max_row, min_row) for every numeric column in one pass.

    The table is read once and reduced to one row before the columns are laid out as rows; of
    equal extremes the first row by ``order`` wins.
    """
    names = numeric_columns(df)
    text = row_text(df.columns)
    aggregates = [F.count("*").alias("__rows")]
    for c in names:
        aggregates += [
            F.sum(F.col(c).cast("double")).alias(f"__sum_{c}"),
            F.avg(c).alias(f"__avg_{c}"),
            F.max_by(text, F.struct(F.col(c), -F.col(order))).alias(f"__max_{c}"),
            F.min_by(text, F.struct(F.col(c), F.col(order))).alias(f"__min_{c}"),
        ]
    one = df.agg(*aggregates)
    return one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col("__rows").alias("rows"),
                        F.col(f"__sum_{c}").alias("sum"), F.col(f"__avg_{c}").alias("avg"),
                        F.col(f"__max_{c}").alias("max_row"), F.col(f"__min_{c}").alias("min_row"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        ).alias("s")
    ).select("s.*")


def aggregate_table(
    queries: DataFrame, df: DataFrame, order: str, pack: Pack = ZH, labels: dict = LABELS_ZH
) -> DataFrame:
    """(query_id, target_column, answer): the figures each query asks for, in fixed order.

    Queries without an operation are dropped. A full sort is a table, not a sentence: see
    ``sort_table``.
    """
    names = numeric_columns(df)
    if not names:
        raise ValueError("the table has no numeric column")
    asked = detect_aggregates(queries, pack)
    asked = asked.withColumn("target_column", F.coalesce(target_column(F.col("query"), names), F.lit(names[0])))
    stats = F.broadcast(table_statistics(df, order))  # one row per column of the table
    joined = asked.join(stats, F.col("target_column") == F.col("column_name"))
    name = F.col("target_column")
    parts = F.concat_ws(
        "\n",
        F.when(F.col("wants_count"), F.format_string(labels["count"], F.col("rows").cast("string"))),
        F.when(F.col("wants_max"), F.concat(name, F.lit(labels["max"]), F.col("max_row"))),
        F.when(F.col("wants_min"), F.concat(name, F.lit(labels["min"]), F.col("min_row"))),
        F.when(F.col("wants_avg"), F.concat(name, F.lit(labels["avg"]), T.fixed(F.col("avg"), 2))),
        F.when(F.col("wants_sum"), F.concat(name, F.lit(labels["sum"]), T.fixed(F.col("sum"), 2))),
    )
    return joined.select("query_id", "target_column", parts.alias("answer")).filter("answer != ''")


def sort_table(df: DataFrame, query: str, pack: Pack = ZH) -> DataFrame:
    """The rows ordered by the column the query names, descending unless it asks for ascending.

    A distributed range sort; the sorted rows are the result, with their text in ``row_text``.
    """
    probe = df.sparkSession.range(1).select(
        target_column(F.lit(query), df.columns).alias("c"), matches(F.lit(query), pack["ascending"]).alias("up")
    ).first()
    column = probe["c"] or (numeric_columns(df) or df.columns)[0]
    order = F.asc(column) if probe["up"] else F.desc(column)
    return df.withColumn("row_text", row_text(df.columns)).orderBy(order)


# ---- pipe tables ---------------------------------------------------------------------------------


def _clean_cells(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda c: T.strip(F.regexp_replace(c, "[*`]", "")))


def with_pipe_tables(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tables``: array of (headers, rows) found in the text, tables without rows dropped.

    Each line becomes one letter (pipe row, separator, both, other); a table is a header row, a
    separator and the pipe rows behind it, so one pattern over the letters finds them all.
    """
    keep = df.columns
    lined = df.withColumn(
        "__lines", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), T.strip)
    )

    def letter(x: Column) -> Column:
        row = x.rlike(r"^\|.*\|")
        separator = x.rlike(r"^\|.*[-:]{3,}")
        return F.when(row & separator, "b").when(row, "p").when(separator, "s").otherwise("x")

    runs = F.regexp_extract_all(
        F.array_join(F.transform("__lines", letter), ""), F.lit("[pb][sb][pb]*|."), F.lit(0)
    )
    run = lined.withColumn("__runs", runs)
    placed = run.withColumn(
        "__found",
        F.filter(
            F.transform(
                "__runs",
                lambda r, i: F.struct(
                    F.length(F.array_join(F.slice("__runs", F.lit(1), i), "")).alias("start"), F.length(r).alias("len")
                ),
            ),
            lambda s: s["len"] > 2,
        ),
    )

    def build(s: Column) -> Column:
        headers = _clean_cells(F.get("__lines", s["start"]))
        rows = F.transform(F.slice("__lines", s["start"] + 3, s["len"] - 2), _clean_cells)
        return F.struct(
            headers.alias("headers"), F.filter(rows, lambda r: F.size(r) == F.size(headers)).alias("rows")
        )

    tables = F.filter(F.transform("__found", build), lambda t: F.size(t["rows"]) > 0)
    return placed.withColumn("tables", tables).select(*keep, "tables")


def parse_pipe_tables(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per table row: ``table_no``, ``row_no``, ``headers``, ``cells``."""
    keep = [c for c in df.columns if c != text]
    by_table = unfold(with_pipe_tables(df, text), keep, "tables", "table_no", "t")
    by_row = unfold(by_table, [*keep, "table_no", F.col("t.headers").alias("headers")], "t.rows", "row_no", "cells")
    return by_row.select(*keep, "table_no", "row_no", "headers", "cells")


# Columns of a budget table by keyword, the marker of its total row, the answer text.
BUDGET_ZH = {
    "project": ("项目",), "budget": ("预算",), "q1": ("Q1",), "q2": ("Q2",), "remaining": ("剩余", "结余", "余额"),
    "total_row": "合计", "title": "[Markdown表格确定性计算结果]",
    "line": "- %s: 预算%s万元, Q1支出%s万元, Q2支出%s万元, 剩余%s万元",
    "totals": "总预算: %s万元\n总支出: %s万元\n剩余预算最多: %s, %s万元",
}
BUDGET_EN = {
    "project": ("project", "name"), "budget": ("budget",), "q1": ("Q1",), "q2": ("Q2",), "remaining": ("remaining", "left"),
    "total_row": "total", "title": "[computed from the table]",
    "line": "- %s: budget %s, Q1 %s, Q2 %s, remaining %s",
    "totals": "total budget: %s\ntotal spent: %s\nmost remaining: %s, %s",
}


def aggregate_markdown(
    contexts: DataFrame, pack: Pack = ZH, words: dict = BUDGET_ZH, text: str = "text"
) -> DataFrame:
    """(query_id, answer, total_budget, total_spent, top_project, top_remaining) from the first
    budget table in rank order, for queries that ask for one.

    ``contexts(query_id, query, rank, text)``. Everything up to the choice of the first table
    happens inside the row.
    """
    asked = contexts.filter(matches(F.col("query"), pack["table_total"]))
    tabled = unfold(with_pipe_tables(asked, text), ["query_id", "rank"], "tables", "table_no", "t")
    headers = F.col("t.headers")
    names = ("project", "budget", "q1", "q2", "remaining")

    def position(name: str) -> Column:
        found = [
            F.array_position(F.transform(headers, lambda h, w=w: F.contains(h, F.lit(w))), F.lit(True)) for w in words[name]
        ]
        return F.coalesce(*[F.when(p > 0, p) for p in found])

    placed = tabled.withColumns({f"__{n}": position(n) for n in names})
    complete = F.col("__project").isNotNull()
    for n in names[1:]:
        complete = complete & F.col(f"__{n}").isNotNull()
    by_order = (F.size(headers) >= 5) & F.exists(headers, lambda h: F.contains(h, F.lit("Q1")))
    placed = placed.filter(complete | by_order).withColumns(
        {f"__{n}": F.when(complete, F.col(f"__{n}")).otherwise(F.lit(i + 1)).cast("int") for i, n in enumerate(names)}
    )
    row_type = "struct<project:string,budget:double,q1:double,q2:double,remaining:double>"
    rows = F.transform(
        "t.rows",
        lambda r: F.struct(
            F.get(r, F.col("__project") - 1).alias("project"),
            *[T.first_number(F.get(r, F.col(f"__{n}") - 1)).alias(n) for n in names[1:]],
        ).cast(row_type),
    )
    usable = F.filter(
        rows,
        lambda r: ~F.contains(r["project"], F.lit(words["total_row"])) & r["budget"].isNotNull() & r["q1"].isNotNull()
        & r["q2"].isNotNull() & r["remaining"].isNotNull(),
    )
    with_rows = placed.select("query_id", "rank", "table_no", usable.alias("rows")).filter(F.size("rows") > 0)
    first = with_rows.groupBy("query_id").agg(F.min_by("rows", F.struct("rank", "table_no")).alias("rows"))
    total = lambda f: F.aggregate("rows", F.lit(0.0), lambda acc, r: acc + f(r))
    most = F.array_max(F.transform("rows", lambda r: r["remaining"]))
    top = F.element_at(F.filter("rows", lambda r: r["remaining"] == most), 1)
    whole = lambda c: T.fixed(c, 0)
    lines = F.transform(
        "rows",
        lambda r: F.format_string(
            words["line"], r["project"], whole(r["budget"]), whole(r["q1"]), whole(r["q2"]), whole(r["remaining"])
        ),
    )
    figures = first.select(
        "query_id", "rows",
        total(lambda r: r["budget"]).alias("total_budget"),
        total(lambda r: r["q1"] + r["q2"]).alias("total_spent"),
        top["project"].alias("top_project"), top["remaining"].alias("top_remaining"),
    )
    summary = F.format_string(
        words["totals"], whole(F.col("total_budget")), whole(F.col("total_spent")), F.col("top_project"),
        whole(F.col("top_remaining")),
    )
    return figures.select(
        "query_id", F.concat_ws("\n", F.lit(words["title"]), F.array_join(lines, "\n"), summary).alias("answer"),
        "total_budget", "total_spent", "top_project", "top_remaining",
    )


# ---- numbers ---------------------------------------------------------------------------------------


def validate_numbers(answers: DataFrame, pack: Pack = ZH) -> DataFrame:
    """``answers(query_id, query, answer, correct array)``: null when the query is not numeric or
    nothing was computed, else whether every correct number stands in the answer."""
    numeric = matches(F.col("query"), pack["numeric"])
    stated = T.extract_numbers(F.col("answer"))
    known = F.coalesce(F.size("correct") > 0, F.lit(False))
    verdict = F.when(numeric & known, F.size(F.array_except("correct", stated)) == 0)
    return answers.withColumn("numeric_match", verdict)


def csv_sources(hits: DataFrame, scope_chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, source, position): distinct CSV sources of the hits in rank order; for queries
    with none, those of all chunks in their scope (``scope_chunks(query_id, source)``)."""
    is_csv = F.lower("source").endswith(".csv")
    own = hits.filter(is_csv).groupBy("query_id", "source").agg(F.min("rank").cast("long").alias("position"))
    if scope_chunks is None:
        return own
    other = (
        scope_chunks.filter(is_csv).select("query_id", "source").distinct()
        .join(own.select("query_id").distinct(), "query_id", "left_anti")
        .withColumn("position", F.lit(None).cast("long"))
    )
    return own.unionByName(other)
