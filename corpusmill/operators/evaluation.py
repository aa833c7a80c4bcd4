"""Scores of answers and the comparison of retrieval paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from corpusmill.functions import text as T

# Weight of each metric, alert thresholds, tie and latency limits of path choice.
WEIGHTS = {
    "faithfulness": 0.4, "answer_relevancy": 0.3, "context_precision": 0.1, "context_recall": 0.1, "numeric_match": 0.3,
}
THRESHOLDS = {"faithfulness": 0.6, "answer_relevancy": 0.5, "context_precision": 0.5}
QUALITY_TIE, LATENCY_GAIN_MS = 0.03, 500
METRICS = tuple(WEIGHTS)


def clean_score(df: DataFrame, name: str) -> Column:
    """First item of a list, as a finite number; anything else is null, never zero."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, Ty.ArrayType):
        col = F.get(col, F.lit(0))
    value = col.cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def clean_scores(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Cleaned metric columns and ``missing_metrics``."""
    cleaned = df.withColumns({m: clean_score(df, m) for m in metrics})
    missing = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]))
    return cleaned.withColumn("missing_metrics", missing)


def quality_column(columns: list[str]) -> Column:
    """Weighted mean of the metrics that are there; null when none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name in WEIGHTS:
        if name in columns:
            value = F.col(name).cast("double")
            total = total + F.coalesce(value * WEIGHTS[name], F.lit(0.0))
            weight = weight + F.when(value.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def quality_score(df: DataFrame) -> DataFrame:
    return df.withColumn("quality", quality_column(df.columns))


def _by_path(runs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per query with ``<path>_<column>`` for each path."""
    return runs.groupBy("query_id").agg(
        *[
            F.max(F.when(F.col("path") == path, F.col(c))).alias(f"{path}_{c}")
            for path in ("direct", "standard", "adaptive") for c in columns
        ]
    )


def _choice() -> tuple[Column, Column]:
    s, a = F.col("standard_quality"), F.col("adaptive_quality")
    st, at = F.coalesce("standard_time_ms", F.lit(0.0)), F.coalesce("adaptive_time_ms", F.lit(0.0))
    faster = F.when(st <= at, "standard").otherwise("adaptive")
    clear = F.abs(a - s) > QUALITY_TIE
    winner = (
        F.when(s.isNull() & a.isNull(), faster)
        .when(s.isNull(), "adaptive").when(a.isNull(), "standard")
        .when(clear, F.when(a > s, "adaptive").otherwise("standard"))
        .otherwise(faster)
    )
    reason = (
        F.when(s.isNull() & a.isNull(), "no_quality")
        .when(s.isNull(), "standard_missing").when(a.isNull(), "adaptive_missing")
        .when(clear, "better_quality")
        .when(F.abs(at - st) >= LATENCY_GAIN_MS, "faster").otherwise("similar")
    )
    return winner, reason


def select_path(runs: DataFrame) -> DataFrame:
    """Recommended path per query from ``runs(query_id, path, quality, time_ms)``."""
    winner, reason = _choice()
    return _by_path(runs, ["quality", "time_ms"]).select("query_id", winner.alias("winner"), reason.alias("reason"))


def metric_deltas(runs: DataFrame, metrics: tuple[str, ...] = ("faithfulness", "answer_relevancy", "context_precision")) -> DataFrame:
    """(query_id, metric, delta_pct): change from standard to adaptive where the base is positive."""
    wide = _by_path(runs, list(metrics))
    items = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.when(
                    F.col(f"standard_{m}") > 0,
                    (F.col(f"adaptive_{m}") - F.col(f"standard_{m}")) / F.col(f"standard_{m}") * 100,
                ).alias("delta_pct"),
            )
            for m in metrics
        ]
    )
    return wide.select("query_id", F.explode(items).alias("d")).select("query_id", "d.*").filter("delta_pct is not null")


def signed_percent(value: Column) -> Column:
    whole = T.fixed(value, 0)
    shown = F.when(whole == "-0", "-0").otherwise(whole)
    return F.concat(F.when(shown.startswith("-"), shown).otherwise(F.concat(F.lit("+"), shown)), F.lit("%"))


# Wording of the comparison report.
REPORT_ZH = {
    "paths": {"standard": "标准 RAG", "adaptive": "自适应 RAG"},
    "metrics": {"faithfulness": "忠实度", "answer_relevancy": "答案相关性", "context_precision": "上下文精确率"},
    "complexity": {"simple": "简单", "medium": "中等", "complex": "复杂"},
    "strategy": {"no_retrieval": "不检索，直接回答", "single_step": "单步检索", "multi_step": "多步检索", "adaptive": "自适应路由"},
    "title": "## 对比总结\n", "path": "推荐路径：%s", "why": "推荐理由：%s", "quality": "综合质量分：标准 RAG %s，自适应 RAG %s",
    "changes": "- 指标变化：%s", "no_changes": "- 指标差异暂不明显；建议增加更多样本后再做更稳定的对比。",
    "no_quality": "RAGAS 未返回可用质量分，按耗时更低的路径推荐。",
    "standard_missing": "标准 RAG 缺少可用质量分，自适应 RAG 的评估结果更完整。",
    "adaptive_missing": "自适应 RAG 缺少可用质量分，标准 RAG 的评估结果更完整。",
    "better_quality": "%s 的综合质量分更高：标准 RAG %s，自适应 RAG %s。",
    "faster": "两条 RAG 路径质量差异不明显，%s 回答延迟更低：%sms vs %sms。",
    "similar": "两条 RAG 路径质量与耗时差异都不明显，优先选择实现更直接的 %s。",
    "times": (
        ("- 直接回答耗时：%s", "direct_time_ms"), ("- 标准 RAG 回答耗时（不含 RAGAS）：%s", "standard_time_ms"),
        ("- 标准 RAG 的 RAGAS 评估耗时：%s", "standard_eval_time_ms"), ("- 标准 RAG 总耗时（含 RAGAS）：%s", "standard_total_time_ms"),
        ("- 自适应 RAG 回答耗时（不含 RAGAS）：%s", "adaptive_time_ms"), ("- 自适应 RAG 的 RAGAS 评估耗时：%s", "adaptive_eval_time_ms"),
        ("- 自适应 RAG 总耗时（含 RAGAS）：%s", "adaptive_total_time_ms"),
    ),
    "routing": "- 自适应策略：查询复杂度=%s，检索策略=%s",
}


def _label(col: Column, names: dict[str, str]) -> Column:
    out = F.when(F.coalesce(col, F.lit("")) == "", "N/A").otherwise(col)
    for key, name in names.items():
        out = F.when(col == key, name).otherwise(out)
    return out


def comparison_report(runs: DataFrame, words: dict = REPORT_ZH) -> DataFrame:
    """(query_id, winner, report) from ``runs(query_id, path, quality, time_ms, eval_time_ms,
    total_time_ms, complexity, strategy, <metrics>)``."""
    metrics = list(words["metrics"])
    wide = _by_path(runs, ["quality", "time_ms", "eval_time_ms", "total_time_ms", "complexity", "strategy", *metrics])
    winner, reason = _choice()
    wide = wide.withColumns({"winner": winner, "__reason": reason})
    s, a = F.col("standard_quality"), F.col("adaptive_quality")
    st, at = F.coalesce("standard_time_ms", F.lit(0.0)), F.coalesce("adaptive_time_ms", F.lit(0.0))
    name = _label(F.col("winner"), words["paths"])
    code = F.col("__reason")
    why = (
        F.when(code == "better_quality", F.format_string(words["better_quality"], name, T.fixed(s, 2), T.fixed(a, 2)))
        .when(code == "faster", F.format_string(words["faster"], name, T.fixed(F.least(st, at), 0), T.fixed(F.greatest(st, at), 0)))
        .when(code == "similar", F.format_string(words["similar"], name))
        .when(code == "no_quality", words["no_quality"])
        .when(code == "standard_missing", words["standard_missing"]).otherwise(words["adaptive_missing"])
    )
    changes = F.concat_ws(
        ", ",
        *[
            F.when(
                (F.col(f"standard_{m}") > 0) & F.col(f"adaptive_{m}").isNotNull(),
                F.concat(
                    F.lit(label + " "),
                    signed_percent((F.col(f"adaptive_{m}") - F.col(f"standard_{m}")) / F.col(f"standard_{m}") * 100),
                ),
            )
            for m, label in words["metrics"].items()
        ],
    )
    shown = lambda c: F.when(F.col(c).isNotNull(), F.concat(T.fixed(F.col(c), 0), F.lit("ms"))).otherwise("-")
    parts = [
        F.lit(words["title"]), F.format_string(words["path"], name), F.format_string(words["why"], why),
        F.when(s.isNotNull() & a.isNotNull(), F.format_string(words["quality"], T.fixed(s, 2), T.fixed(a, 2))),
        F.when(changes != "", F.format_string(words["changes"], changes)).otherwise(words["no_changes"]),
        *[F.format_string(pattern, shown(c)) for pattern, c in words["times"]],
        F.format_string(
            words["routing"], _label(F.col("adaptive_complexity"), words["complexity"]),
            _label(F.col("adaptive_strategy"), words["strategy"]),
        ),
    ]
    return wide.select("query_id", "winner", F.concat_ws("\n", *parts).alias("report"))


def threshold_alerts(df: DataFrame) -> DataFrame:
    """Metrics under their threshold as texts."""
    alerts = [
        F.when(F.col(m) < limit, F.concat(F.lit(f"{m}="), T.fixed(F.col(m), 3), F.lit(f" < {limit}")))
        for m, limit in THRESHOLDS.items()
    ]
    return df.withColumn("alerts", F.array_compact(F.array(*alerts)))


def comparison_table(runs: DataFrame) -> DataFrame:
    """One summary row per query: times, documents and metrics of each path, deltas as text."""
    short = {"faithfulness": "Faithfulness", "answer_relevancy": "Relevancy", "context_precision": "Precision"}
    wide = _by_path(runs, ["time_ms", "docs_count", "complexity", "strategy", *short])

    def figure(path: str, metric: str) -> Column:
        return F.coalesce(T.fixed(F.col(f"{path}_{metric}"), 3), F.lit(""))

    def delta(metric: str) -> Column:
        base, new = F.col(f"standard_{metric}"), F.col(f"adaptive_{metric}")
        return F.when(base.isNull() | new.isNull() | (base == 0), "N/A").otherwise(signed_percent((new - base) / base * 100))

    whole = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 0).cast("long")
    return wide.select(
        F.col("query_id").alias("ID"),
        whole("direct_time_ms").alias("Direct_Time_ms"),
        whole("standard_time_ms").alias("StdRAG_Time_ms"),
        F.coalesce("standard_docs_count", F.lit(0)).alias("StdRAG_Docs"),
        *[figure("standard", m).alias(f"StdRAG_{n}") for m, n in short.items()],
        whole("adaptive_time_ms").alias("AdpRAG_Time_ms"),
        F.coalesce("adaptive_complexity", F.lit("?")).alias("AdpRAG_Complexity"),
        F.coalesce("adaptive_strategy", F.lit("?")).alias("AdpRAG_Strategy"),
        F.coalesce("adaptive_docs_count", F.lit(0)).alias("AdpRAG_Docs"),
        *[figure("adaptive", m).alias(f"AdpRAG_{n}") for m, n in short.items()],
        *[delta(m).alias(f"{n}_Delta_pct") for m, n in short.items()],
    )
