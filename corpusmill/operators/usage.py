"""Token, cost and time accounting, and summaries of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Price per million tokens (input, output), budgets (total, input, output).
PRICES = {
    "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "gpt-3.5-turbo": (0.50, 1.50), "deepseek-chat": (0.14, 0.28),
}
DEFAULT_MODEL = "gpt-4o-mini"
BUDGETS = {"simple": (500, 400, 100), "medium": (2000, 1500, 500), "complex": (4000, 3000, 1000)}


def estimate_cost(usage: DataFrame, prices: dict[str, tuple[float, float]] = PRICES, default: str = DEFAULT_MODEL) -> DataFrame:
    """Add ``cost``; an unknown model has the default model's price."""

    def price(side: int) -> Column:
        out = F.lit(prices[default][side])
        for model, pair in prices.items():
            out = F.when(F.col("model") == model, F.lit(pair[side])).otherwise(out)
        return out

    cost = F.col("input_tokens") / 1e6 * price(0) + F.col("output_tokens") / 1e6 * price(1)
    return usage.withColumn("cost", cost)


def token_budget(queries: DataFrame) -> DataFrame:
    """Budget columns by complexity, the medium ones for an unknown class."""

    def part(i: int) -> Column:
        out = F.lit(BUDGETS["medium"][i])
        for name, values in BUDGETS.items():
            out = F.when(F.col("complexity") == name, F.lit(values[i])).otherwise(out)
        return out.cast("long")

    return queries.withColumns({"total_budget": part(0), "input_budget": part(1), "output_budget": part(2)})


def needs_compression(current: Column, maximum: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(F.when(maximum > 0, current / maximum), F.lit(0.0)) >= threshold


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    return F.substring(text, 1, 4 * tokens)


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Totals overall, by step and by model in one pass (``level`` tells which)."""
    figures = usage.groupingSets([["step"], ["model"], []], "step", "model").agg(
        F.grouping_id("step", "model").alias("g"),
        F.sum("input_tokens").alias("prompt_tokens"),
        F.sum("output_tokens").alias("completion_tokens"),
        F.sum("cost").alias("total_cost"),
        F.count("*").alias("requests_count"),
    )
    level = F.when(F.col("g") == 1, "step").when(F.col("g") == 2, "model").otherwise("total")
    return figures.select(
        level.alias("level"), F.coalesce("step", "model", F.lit("")).alias("name"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        "prompt_tokens", "completion_tokens", "total_cost", "requests_count",
    )


def latency_stats(timings: DataFrame) -> DataFrame:
    return timings.groupBy("name").agg(
        F.count("*").alias("count"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("avg_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
    )


def request_summary(requests: DataFrame, chars: int = 200) -> DataFrame:
    """Selected fields of each request, its answer cut."""
    answer = F.coalesce(F.when(F.col("final_response") != "", F.col("final_response")), F.col("answer"), F.lit(""))
    return requests.select(
        "query_id", "session_id", "complexity", "strategy",
        (F.coalesce("cache_hit", F.lit(False)) | F.coalesce("from_cache", F.lit(False))).alias("cache_hit"),
        T.preview(answer, chars).alias("answer"),
    )


def latest_session_state(requests: DataFrame, sources: DataFrame | None = None, at: str = "created_at", chars: int = 4000, n: int = 8) -> DataFrame:
    """Newest request of each session, its answer cut, with its first ``n`` sources if given."""
    newest = requests.groupBy("session_id").agg(
        F.max_by(F.struct("query_id", "query", "answer"), F.struct(F.col(at), F.col("query_id"))).alias("r")
    ).select("session_id", "r.*").withColumn("answer", T.preview(F.col("answer"), chars))
    if sources is None:
        return newest
    kept = sources.filter(F.col("rank") <= n).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]).alias("sources")
    )
    return newest.join(kept, "query_id", "left")


def merge_updates(updates: DataFrame) -> DataFrame:
    """(request_id, field, value, items) from partial updates in ``seq`` order: list updates
    (``items``) append, any other keeps its last written value."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("seq", "items"))))
    return updates.groupBy("request_id", "field").agg(
        F.max_by("value", F.when(F.col("items").isNull(), F.col("seq"))).alias("value"),
        F.flatten(F.transform(ordered, lambda s: s["items"])).alias("items"),
    )
