"""Fusing, reranking and selecting hits.

``hits(query_id, chunk_id, rank, score, ...)`` hold a bounded number of rows per query (the
search depth times the number of lists), so windows and lists per query stay small.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.skew import top_k

RRF_K = 60
ScoreFunction = Callable[[Column, Column], Column]


def _ranked(df: DataFrame, order: list[Column], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window).cast("long"))


def rrf_fuse(first: DataFrame, second: DataFrame, k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """Sum of 1 / (k + rank) over both lists, best first."""
    lists = first.select("query_id", key, "rank").unionByName(second.select("query_id", key, "rank"))
    fused = lists.groupBy("query_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return _ranked(fused, [F.desc(F.round("score", 9)), F.asc(key)])


def rrf_fuse_lists(hits: DataFrame, k: int = RRF_K, key: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Fuse any number of lists (``list_id``): of each item the copy with the best own score is
    kept, ``best_score`` and its list reported, and the fused score replaces the old one."""
    best = F.max_by(F.struct("score", "list_id"), F.struct(F.col("score"), -F.col("list_id")))
    fused = hits.groupBy("query_id", *key).agg(
        F.sum(1 / (k + F.col("rank"))).alias("fused"), best.alias("best")
    ).select("query_id", *key, F.col("fused").alias("score"), F.col("best.score").alias("best_score"),
             F.col("best.list_id").alias("list_id"))
    return _ranked(fused, [F.desc(F.round("score", 9)), *[F.asc(c) for c in key]])


def with_content(hits: DataFrame, chunks: DataFrame, columns: list[str], id: str = "chunk_id") -> DataFrame:
    """Late fetch of content and metadata for the few rows that ranked."""
    return hits.join(chunks.select(id, *columns), id)


def rerank(
    hits: DataFrame,
    scorer: ScoreFunction | None = T.token_overlap,
    pool: int = 20,
    k: int = 6,
    threshold: float = 0.0,
    query: str = "query",
    content: str = "text",
) -> DataFrame:
    """Score the first ``pool`` hits, drop those under the threshold, keep ``k``.

    ``scorer`` builds a score column from the query and content columns (a pandas_udf is one);
    ``None`` keeps the fused order with score 0.
    """
    pooled = hits.filter(F.col("rank") <= pool).withColumnRenamed("rank", "__old")
    if scorer is None:
        scored = pooled.withColumn("score", F.lit(0.0))
    else:
        scored = pooled.withColumn("score", scorer(F.col(query), F.col(content)).cast("double"))
        scored = scored.filter(F.col("score") >= threshold)
    return top_k(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("__old")], k).drop("__old")


def rerank_keep_all(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Reorder by ``scores(query_id, chunk_id, new_score)``; unscored hits follow in old order."""
    joined = hits.withColumnRenamed("rank", "__old").join(scores, ["query_id", "chunk_id"], "left")
    order = [F.col("new_score").isNull(), F.desc(F.round("new_score", 9)), F.asc("__old")]
    return (
        _ranked(joined, order).withColumn("score", F.coalesce("new_score", "score")).drop("__old", "new_score")
    )


def rejoin_metadata(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Metadata by key, the rerank score kept beside it; chunk_index falls back to the position."""
    index = F.col("meta_chunk_index").cast("string").try_cast("long")
    meta = chunks.select("chunk_id", "source", F.col("chunk_index").alias("meta_chunk_index"))
    return hits.join(meta, "chunk_id", "left").select(
        *hits.columns,
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(index, F.col("rank") - 1).alias("chunk_index"),
        F.col("score").cast("string").alias("rerank_score"),
    )


def dedupe_hits(hits: DataFrame, prefix: int | None = None, content: str = "text") -> DataFrame:
    """Across rounds, keep the first hit of each chunk, or, if ``prefix`` is given, of each content prefix."""
    key = F.col("chunk_id") if prefix is None else F.substring(content, 1, prefix)
    first = Window.partitionBy("query_id", key).orderBy("round", "rank", "chunk_id")
    return hits.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def limit_hits(hits: DataFrame, limits: DataFrame) -> DataFrame:
    """Per-query ``k`` given as text: invalid or absent means no limit, negative means none."""
    k = F.col("k").cast("string").try_cast("long")
    return hits.join(limits.select("query_id", "k"), "query_id", "left").filter(
        k.isNull() | (F.col("rank") <= F.greatest(k, F.lit(0)))
    ).drop("k")


# ---- structure-first search --------------------------------------------------------------------

# Intents answered from the structure, intents and words that prefer body text.
GLOBAL_INTENTS = ("global_count", "global_list", "table_aggregation", "summary", "comparison")
BODY_INTENTS = ("table_aggregation", "summary", "comparison")
BODY_WORDS = r"分别|描述|介绍|详情|技术栈|时间|亮点|职责|内容|怎么|如何"
BODY_ELEMENTS = ("section", "table", "row_group")


def structure_search(queries: DataFrame, scoped_chunks: DataFrame, k: int = 18, body_words: str = BODY_WORDS) -> DataFrame:
    """Outline first, then body or headings (by intent), longer first.

    ``queries(query_id, query, query_intent, scope_id)``; ``scoped_chunks(scope_id, chunk_id,
    element_type, text)``, or ``chars`` in place of ``text``. The best ``k`` of a scope are found in one pass for both orders,
    so a scope of any size is cut before it meets the queries that use it.
    """
    asked = queries.filter(F.col("query_intent").isin(*GLOBAL_INTENTS)).select(
        "query_id", "query_intent", "scope_id",
        (F.col("query_intent").isin(*BODY_INTENTS) | F.col("query").rlike(body_words)).alias("body_first"),
    )
    kind = F.col("element_type")
    usable = scoped_chunks.filter(kind.isin("outline", "heading", *BODY_ELEMENTS)).select(
        "scope_id", "chunk_id", kind, F.col("chars") if "chars" in scoped_chunks.columns else F.length("text").alias("chars"),
        F.explode(F.array(F.lit(True), F.lit(False))).alias("body_first"),
    )
    body = F.when(F.col("body_first"), 1).otherwise(2)
    priority = F.when(kind == "outline", 0).when(kind.isin(*BODY_ELEMENTS), body).when(kind == "heading", 3 - body).otherwise(3)
    best = top_k(usable, ["scope_id", "body_first"], [priority, F.desc("chars"), F.asc("chunk_id")], k)
    score = F.greatest(F.lit(0.0), 1.0 - (F.col("rank") - 1) * 0.02)
    return asked.join(best, ["scope_id", "body_first"]).select(
        "query_id", "chunk_id", "rank", score.alias("score"), "query_intent"
    )


# ---- evidence and sufficiency ----------------------------------------------------------------

class Evidence(NamedTuple):
    """What shows one kind of evidence: any of the words in the text or source, whatever their case; all words of one of the sets
    in the text as written; any of the titles in a heading or the source."""

    name: str
    words: tuple[str, ...] = ()
    together: tuple[tuple[str, ...], ...] = ()
    titles: tuple[str, ...] = ()


#: Columns that hold headings or the source, where hits have them.
TITLE_COLUMNS = ("heading_path", "h1", "h2", "h3", "source")

# Words that show each kind of evidence, in promotion order.
EVIDENCE_ZH = (
    Evidence("personnel", together=(("姓名", "所属部门", "技能"), ("| 姓名 |", "| 职位 |")), titles=("团队成员",)),
    Evidence("project_status", words=("项目", "进度", "预计", "发布", "滞后")),
    Evidence("timeline_resource", words=("预算", "时间线", "q1", "q2", "支出", "剩余", "测试中")),
)
EVIDENCE_EN = (
    Evidence("personnel", together=(("name", "department", "skills"), ("| name |", "| position |")), titles=("team members",)),
    Evidence("project_status", words=("project", "progress", "expected", "release", "behind")),
    Evidence("timeline_resource", words=("budget", "timeline", "q1", "q2", "spent", "remaining", "in test")),
)


def _any(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def shows(evidence: Evidence, hits: DataFrame, content: str) -> Column:
    """Whether a hit shows the evidence; null texts and headings hold no words."""
    text = F.coalesce(content, F.lit(""))
    source = F.coalesce("source", F.lit("")) if "source" in hits.columns else F.lit("")
    titles = F.concat_ws(" ", *[c for c in TITLE_COLUMNS if c in hits.columns])
    anywhere = [F.contains(F.lower(c), F.lit(w.lower())) for w in evidence.words for c in (text, source)]
    whole = [functools.reduce(operator.and_, [F.contains(text, F.lit(w)) for w in words]) for words in evidence.together]
    return _any([*anywhere, *whole, *[F.contains(titles, F.lit(t)) for t in evidence.titles]])


def evidence_coverage(
    hits: DataFrame, queries: DataFrame, evidence: tuple[Evidence, ...] = EVIDENCE_ZH,
    window: int = 6, content: str = "text", flag: str = "is_inference",
) -> DataFrame:
    """Give each evidence type that the first ``window`` hits miss the place right behind them.

    Applies to queries whose ``flag`` holds and that have at least four hits. Adds ``new_rank``.
    """
    flags = hits.select("*", *[shows(e, hits, content).alias(f"__m{i}") for i, e in enumerate(evidence)])
    top = F.col("rank") <= window
    found = flags.groupBy("query_id").agg(
        F.count("*").alias("__n"),
        *[F.max(F.col(f"__m{i}") & top).alias(f"__in{i}") for i in range(len(evidence))],
        *[F.array_sort(F.collect_list(F.when(F.col(f"__m{i}") & ~top, F.col("rank")))).alias(f"__later{i}")
          for i in range(len(evidence))],
    ).join(queries.select("query_id", flag), "query_id")
    # each pick skips the hits promoted before it
    picked = found.withColumn("__picks", F.array().cast("array<bigint>"))
    for i in range(len(evidence)):
        choice = F.try_element_at(F.array_except(f"__later{i}", "__picks"), F.lit(1))
        picked = picked.withColumn(
            "__picks",
            F.when(~F.col(f"__in{i}") & choice.isNotNull(), F.concat("__picks", F.array(choice))).otherwise(F.col("__picks")),
        )
    usable = F.col(flag) & (F.col("__n") >= 4)
    moves = picked.select(
        "query_id", F.when(usable, F.col("__picks")).otherwise(F.array().cast("array<bigint>")).alias("__picks")
    )
    place = F.array_position("__picks", F.col("rank"))
    group = F.when(top, 0).when(place > 0, 1).otherwise(2)
    order = Window.partitionBy("query_id").orderBy(group, F.when(group == 1, place).otherwise(F.col("rank")))
    joined = hits.join(moves, "query_id", "left").withColumn("__picks", F.coalesce("__picks", F.array().cast("array<bigint>")))
    return joined.withColumn("new_rank", F.row_number().over(order).cast("long")).drop("__picks")


# Question words that are no keywords.
QUESTION_WORDS = ("什么", "怎么", "如何", "为什么", "多少", "哪些", "哪个")


def sufficiency(queries: DataFrame, hits: DataFrame, content: str = "text") -> DataFrame:
    """Whether the hits look enough to answer: two different openings of 100 characters, one good score, volume, keyword cover.

    Keywords are runs of two letters or digits of any language and more, so an accented word is one keyword.
    """
    words = F.filter(
        F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))),
        lambda w: ~w.isin(*QUESTION_WORDS),
    )
    asked = queries.select("query_id", words.alias("__words"))
    seen = F.filter("__words", lambda w: F.contains(F.lower(content), w))
    figures = hits.join(asked, "query_id").groupBy("query_id").agg(
        F.count_distinct(F.substring(F.coalesce(content, F.lit("")), 1, 100)).alias("unique_docs"),
        F.sum((F.col("score") >= 0.5).cast("long")).alias("good_docs"),
        F.sum(F.length(content)).cast("long").alias("chars"),
        F.size(F.array_distinct(F.flatten(F.collect_list(seen)))).alias("covered"),
    )
    size = F.size("__words")
    enough = (
        (F.col("unique_docs") > 1) & (F.col("good_docs") > 0) & (F.col("chars") >= 300)
        & ((size == 0) | (F.col("covered") / size >= 0.4))
    )
    return asked.join(figures, "query_id", "left").select("query_id", F.coalesce(enough, F.lit(False)).alias("sufficient"))


# ---- selection and text ------------------------------------------------------------------------


def select_review_docs(hits: DataFrame, limit: int = 12, content: str = "text") -> DataFrame:
    """First outline, then content-bearing hits, then the rest, each in rank order."""
    kind = F.coalesce("element_type", F.lit(""))
    group = (
        F.when(kind == "outline", 0)
        .when(kind.isin(*BODY_ELEMENTS) | (F.length(T.strip(F.col(content))) >= 80), 1).otherwise(2)
    )
    grouped = hits.withColumn("__group", group)
    one = Window.partitionBy("query_id", "__group").orderBy("rank")
    kept = grouped.withColumn("__n", F.row_number().over(one)).filter("__group > 0 or __n = 1")
    return top_k(kept, ["query_id"], [F.asc("__group"), F.asc("rank")], limit, "review_rank").drop("__group", "__n")


# Labels of a context block and its hints.
CONTEXT_LABELS = {
    "block": "### 文档片段 ", "source": "**来源**: ", "score": "**相关度**: ", "meta": "**结构元数据**: ",
    "unknown": "未知来源", "tail": "\n*(...还有 %d 个文档片段因长度限制未展示)*",
    "empty": "（未检索到相关文档内容，请根据常识回答并明确告知用户）",
    "hints": (("retrieval_scope", "检索范围"), ("query_intent", "查询意图"), ("element_type", "结构类型"),
              ("section_path", "章节路径"), ("row_range", "行范围")),
}


def assemble_context(
    queries: DataFrame, hits: DataFrame, max_tokens: int = 6000, per_hit: int = 1500,
    content: str = "text", labels: dict = CONTEXT_LABELS,
) -> DataFrame:
    """Context text per query: labelled blocks until the next one would pass two characters per
    token, then a note with the number left out."""
    hints = [
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
        for c, name in labels["hints"] if c in hits.columns
    ]
    hint_line = F.concat_ws("; ", *hints) if hints else F.lit("")
    meta = F.when(hint_line != "", F.concat(F.lit(labels["meta"]), hint_line, F.lit("\n"))).otherwise(F.lit(""))
    block = F.concat(
        F.lit(labels["block"]), F.col("rank").cast("string"), F.lit("\n" + labels["source"]),
        F.coalesce("source", F.lit(labels["unknown"])), F.lit("\n" + labels["score"]),
        T.fixed(F.col("score"), 2), F.lit("\n"), meta, F.lit("\n"), F.substring(content, 1, per_hit), F.lit("\n"),
    )
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = hits.select("query_id", "rank", block.alias("block")).withColumn("__run", F.sum(F.length("block")).over(upto))
    grouped = sized.groupBy("query_id").agg(
        F.count("*").alias("__n"),
        F.array_sort(
            F.collect_list(F.when(F.col("__run") <= max_tokens * 2, F.struct("rank", "block")))
        ).alias("__kept"),
    )
    body = F.transform("__kept", lambda s: s["block"])
    left = F.col("__n") - F.size("__kept") - 1
    note = F.when(left > 0, F.array(F.format_string(labels["tail"], left))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(body, note), "\n---\n")
    return queries.select("query_id").join(grouped, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit(labels["empty"])).alias("context")
    )


def search_summary(hits: DataFrame, n: int = 5, content: str = "text") -> DataFrame:
    """Numbered preview lines of the first hits."""
    line = F.concat(
        F.format_string("[%d] (%s) ", "rank", T.fixed(F.col("score"), 2)), F.substring(content, 1, 150), F.lit("...")
    )
    return hits.filter(F.col("rank") <= n).groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n"
        ).alias("summary")
    )


def source_list(hits: DataFrame) -> DataFrame:
    """Distinct sources and document ids per query, sorted."""
    return hits.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))), ", ").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("document_id")), ", ").alias("document_ids"),
    )


def serialized_sources(hits: DataFrame, n: int = 8, limit: int = 1000, content: str = "text") -> DataFrame:
    """First ``n`` hits with their content cut to ``limit`` characters."""
    return hits.filter(F.col("rank") <= n).withColumn(content, T.preview(F.col(content), limit))
