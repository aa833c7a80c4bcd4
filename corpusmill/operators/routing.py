"""Query classes, intents, strategies and rewrites: column rules on a query table, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.arrays import unfold
from corpusmill.functions.rule_packs import ZH, matches

Pack = dict[str, tuple[str, ...]]
FLAGS = ("simple", "complex", "diagnostic", "inference", "aggregate", "low_cost", "single_fact", "list", "medium")
STRATEGIES = {"simple": "no_retrieval", "medium": "single_step", "complex": "multi_step"}


def match_rules(queries: DataFrame, pack: Pack = ZH, query: str = "query") -> DataFrame:
    """One boolean column per rule set: ``is_simple``, ``is_aggregate``, ..."""
    q = T.strip(F.coalesce(F.col(query), F.lit("")))
    hit = {name: matches(q, pack[name]) for name in FLAGS}
    other = hit["diagnostic"] | hit["inference"]
    single = hit["single_fact"] & ~other & (q != "")
    flags = {**hit, "single_fact": single, "low_cost": ~other & (single | hit["low_cost"])}
    return queries.withColumns({f"is_{name}": F.coalesce(c, F.lit(False)) for name, c in flags.items()})


def complexity_column(query: str = "query") -> Column:
    """Ordered decision on the flags of ``match_rules``; null where no rule decides."""
    q = T.strip(F.coalesce(F.col(query), F.lit("")))
    return (
        F.when(q == "", "simple")
        .when(F.col("is_aggregate"), "medium")
        .when(F.col("is_inference"), "complex")
        .when(F.col("is_list"), "medium")
        .when(F.col("is_single_fact"), "medium")
        .when(F.col("is_simple"), "simple")
        .when(F.col("is_diagnostic"), "complex")
        .when(F.col("is_complex"), "complex")
        .when(F.col("is_medium"), "medium")
        .when(F.length(q) <= 15, "medium")
    )


def quick_classify(queries: DataFrame, pack: Pack = ZH, query: str = "query") -> DataFrame:
    """Complexity, its confidence, reasoning and query type."""
    flagged = match_rules(queries, pack, query).withColumn("complexity", complexity_column(query))
    decided = F.col("complexity").isNotNull()
    return flagged.withColumns(
        {
            "complexity_confidence": F.when(decided, F.lit(1.0)),
            "classification_reasoning": F.when(decided, F.lit("quick_rule")),
            "query_type": F.when(decided & F.col("is_aggregate"), "aggregate").when(
                decided & F.col("is_low_cost"), "low_cost_retrieval"
            ),
        }
    ).drop(*[f"is_{f}" for f in FLAGS])


def route(queries: DataFrame, pack: Pack = ZH, query: str = "query", scoped: str | None = None) -> DataFrame:
    """Strategy per query. ``complexity`` may come with the queries (a judged class), else the
    rules decide; ``scoped`` names a boolean column telling that a filter is active."""
    flagged = match_rules(queries, pack, query)
    given = F.col("complexity") if "complexity" in queries.columns else F.lit(None).cast("string")
    flagged = flagged.withColumn("complexity", F.coalesce(given, complexity_column(query)))
    active = F.coalesce(F.col(scoped), F.lit(False)) if scoped else F.lit(False)
    level = F.when((F.col("complexity") == "simple") & active, "medium").otherwise(F.col("complexity"))
    strategy = F.when(F.col("is_aggregate"), "single_step")
    for name, target in STRATEGIES.items():
        strategy = strategy.when(level == name, target)
    return flagged.withColumns(
        {"strategy": strategy.otherwise("single_step"), "retrieval_top_k": _top_k_column()}
    ).drop(*[f"is_{f}" for f in FLAGS])


def _top_k_column() -> Column:
    return F.when(F.col("is_low_cost"), F.when(F.col("is_list"), 5).otherwise(3)).cast("long")


def retrieval_top_k(queries: DataFrame, pack: Pack = ZH, query: str = "query") -> DataFrame:
    """5 for low-cost list queries, 3 for other low-cost ones, else null."""
    flagged = match_rules(queries, pack, query)
    return flagged.withColumn("retrieval_top_k", _top_k_column()).drop(*[f"is_{f}" for f in FLAGS])


def query_intent(queries: DataFrame, pack: Pack = ZH, query: str = "query") -> DataFrame:
    q = T.strip(F.coalesce(F.col(query), F.lit("")))
    intent = (
        F.when(q == "", "unknown")
        .when(matches(q, pack["intent_aggregate"]), "table_aggregation")
        .when(matches(q, pack["intent_count"]), "global_count")
        .when(matches(q, pack["intent_list"]), "global_list")
        .when(matches(q, pack["intent_summary"]), "summary")
        .when(matches(q, pack["intent_compare"]), "comparison")
        .otherwise("local_fact")
    )
    return queries.withColumn("query_intent", intent)


# Text added to the abstract query and to the sub-queries of inference questions.
STEP_BACK_ZH = " 相关证据 背景 原因 时间线 状态 风险 影响"
SUB_QUERIES_ZH = (" 团队成员及其技能", " 各项目当前进度和人力需求", " 技术栈匹配情况")
STEP_BACK_EN = " evidence background cause timeline status risk impact"
SUB_QUERIES_EN = (" team members and skills", " project progress and staffing", " technology match")


def expand_queries(
    queries: DataFrame,
    rewrites: DataFrame,
    pack: Pack = ZH,
    step_back: str = STEP_BACK_ZH,
    sub_queries: tuple[str, ...] = SUB_QUERIES_ZH,
    max_rewrites: int = 3,
) -> DataFrame:
    """(query_id, list_no, query, kind, k): the original, its distinct rewrites, an abstract query
    for analytical questions, and three narrow queries for inference questions.

    ``rewrites(query_id, rewrites array)`` comes from outside.
    """
    q = T.strip(F.coalesce(F.col("query"), F.lit("")))
    joined = match_rules(queries, pack).join(rewrites.select("query_id", "rewrites"), "query_id", "left")
    cleaned = F.array_distinct(F.filter(F.transform("rewrites", T.squeeze), lambda x: (x != "") & (x != q)))
    kept = F.slice(F.coalesce(cleaned, F.array().cast("array<string>")), 1, max_rewrites)
    analytical = (
        (q != "") & ~matches(q, pack["tabular"]) & ~F.col("is_aggregate") & ~F.col("is_list") & ~F.col("is_single_fact")
        & (F.col("is_diagnostic") | matches(q, pack["step_back"]))
    )

    def entry(value: Column, kind: str, k: int | None = None) -> Column:
        return F.struct(value.alias("query"), F.lit(kind).alias("kind"), F.lit(k).cast("long").alias("k"))

    none = F.array().cast("array<struct<query:string,kind:string,k:bigint>>")
    narrow = F.when(
        matches(q, pack["inference_search"]),
        F.array(*[entry(F.concat("query", F.lit(s)), "sub_query", 3) for s in sub_queries]),
    ).otherwise(none)
    abstract = F.when(
        analytical & ~F.array_contains(kept, F.concat("query", F.lit(step_back))),
        F.array(entry(F.concat("query", F.lit(step_back)), "step_back")),
    ).otherwise(none)
    everything = F.concat(
        narrow, F.array(entry(F.col("query"), "original")), F.transform(kept, lambda x: entry(x, "rewrite")), abstract
    )
    return unfold(joined, ["query_id"], everything, "list_no", "e").select("query_id", "list_no", "e.*")


def _unfence(col: Column) -> Column:
    text = T.strip(col)
    body = T.strip(F.regexp_replace(F.regexp_replace(text, r"^```(?i:json)?\s*", ""), r"\s*```$", ""))
    return F.when(text.startswith("```"), body).otherwise(text)


def parse_rewrites(col: Column) -> Column:
    """Array of queries from a JSON list, a JSON object with ``queries``, or plain lines."""
    text = _unfence(F.coalesce(col, F.lit("")))
    as_list = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    parsed = F.when(text.startswith("{"), F.from_json(text, "queries array<string>, query_rewrites array<string>"))
    as_object = F.coalesce(
        F.when(F.size(parsed["queries"]) > 0, parsed["queries"]), parsed["query_rewrites"],
        F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.array().cast("array<string>")),
    )
    line = lambda x: F.regexp_replace(
        T.strip(F.regexp_replace(x, r"^\s*([-*]|[0-9]+[.)]|[\"'])\s*", "")), r"^[ ,'\"]+|[ ,'\"]+$", ""
    )
    as_lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), line), lambda x: x != "")
    return F.coalesce(as_list, as_object, as_lines)


def parse_json_payload(col: Column) -> Column:
    """The JSON object inside a model's text: as is, unfenced, without a ``json`` prefix, or the
    outermost braces; ``{}`` when nothing parses. Returned as JSON text."""
    text = T.strip(F.coalesce(col, F.lit("")))
    lines = F.split(text, "\n")
    last = F.element_at(lines, -1).startswith("```")
    inner = F.slice(lines, F.lit(2), F.size(lines) - F.when(last, 2).otherwise(1))
    unfenced = F.when(
        text.startswith("```") & (F.size(lines) >= 2), T.strip(F.array_join(inner, "\n"))
    ).otherwise(text)
    bare = T.strip(F.regexp_replace(unfenced, "^json", ""))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    usable = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(usable(text), usable(bare), usable(braces), F.lit("{}"))


def final_query(hyde: Column, semantic: Column, keyword: Column, original: Column) -> Column:
    """First non-empty of the three rewrites, else the original."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(hyde), filled(semantic), filled(keyword), original)
