"""Conversations, preferences and long-term memory as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.skew import top_k
from corpusmill.operators import dense, lexical

# Wording of the history text and of the topic line.
HISTORY_ZH = {
    "user": "用户: ", "assistant": "AI: ", "cut": "\n... (前 %d 轮对话已省略，共 %d 轮)",
    "topics": "共 %d 轮对话，最近话题: %s", "arrow": " → ", "none": "（无对话历史）",
}


def conversation_rounds(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, query, answer): each user turn with the assistant turn right behind it.

    Joined on (conversation, turn), so one very long conversation spreads over all tasks.
    """
    asked = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    replied = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(replied, ["conv_id", "turn"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def last_rounds(conv: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` rounds per conversation; ``back`` counts from the newest."""
    return top_k(conversation_rounds(conv), ["conv_id"], [F.desc("turn")], n, "back")


def last_exchange(conv: DataFrame) -> DataFrame:
    """Newest query and answer per conversation."""
    return last_rounds(conv, 1).select("conv_id", F.col("query").alias("last_query"), F.col("answer").alias("last_answer"))


def history_text(
    conv: DataFrame, max_chars: int = 2000, rounds: int = 10, newest_first: bool = False, words: dict = HISTORY_ZH
) -> DataFrame:
    """History per conversation up to a budget: rounds in order, stopping at the first that does
    not fit, with a note. ``newest_first`` spends the budget from the newest round instead."""
    kept = last_rounds(conv, rounds)
    line = F.concat(
        F.lit(words["user"]), F.col("query"), F.lit("\n"),
        F.when(F.col("answer") != "", F.concat(F.lit(words["assistant"]), F.col("answer"), F.lit("\n"))).otherwise(""),
    )
    order = F.asc("back") if newest_first else F.desc("back")
    upto = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sized = kept.withColumn("__line", line).withColumns(
        {"__run": F.sum(F.length("__line")).over(upto), "__no": F.row_number().over(Window.partitionBy("conv_id").orderBy(order))}
    )
    grouped = sized.groupBy("conv_id").agg(
        F.count("*").alias("__n"),
        F.array_sort(F.collect_list(F.when(F.col("__run") <= max_chars, F.struct("__no", "__line")))).alias("__in"),
    )
    body = F.transform("__in", lambda s: s["__line"])
    fitted = F.size("__in")
    note = F.when(fitted < F.col("__n"), F.array(F.format_string(words["cut"], fitted, F.col("__n")))).otherwise(
        F.array().cast("array<string>")
    )
    return grouped.select("conv_id", F.array_join(F.concat(body, note), "\n").alias("history"))


def recent_messages(conv: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` messages of the rounds, ``position`` from the newest."""
    both = conversation_rounds(conv).select(
        "conv_id",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.col("turn").alias("turn"), F.lit("user").alias("role"), F.col("query").alias("content")),
                    F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
                ),
                lambda m: (m["role"] == "user") | (m["content"] != ""),
            )
        ),
    )
    return top_k(both, ["conv_id"], [F.desc("turn"), F.desc("role")], n, "position")


def topic_summary(conv: DataFrame, rounds: int = 10, shown: int = 3, chars: int = 30, words: dict = HISTORY_ZH) -> DataFrame:
    """Number of kept rounds and the last topics of every conversation."""
    kept = last_rounds(conv, rounds)
    topics = kept.groupBy("conv_id").agg(
        F.count("*").alias("__n"),
        F.array_sort(
            F.collect_list(F.when(F.col("back") <= shown, F.struct("turn", F.substring("query", 1, chars).alias("topic"))))
        ).alias("__t"),
    )
    text = F.format_string(words["topics"], F.col("__n"), F.array_join(F.transform("__t", lambda s: s["topic"]), words["arrow"]))
    return conv.select("conv_id").distinct().join(topics, "conv_id", "left").select(
        "conv_id", F.coalesce(F.when(F.col("__n") > 0, text), F.lit(words["none"])).alias("summary")
    )


# ---- preferences and session facts -----------------------------------------------------------


def upsert_preferences(current: DataFrame, updates: DataFrame, key: str = "user_id", at: str = "updated_at") -> DataFrame:
    """Current rows replaced or extended by updates: the latest row per user."""
    rest = [c for c in current.columns if c != key]
    both = current.unionByName(updates)
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(key, "r.*")


def preferences_of(users: DataFrame, preferences: DataFrame, style: str = "detailed") -> DataFrame:
    """Preferences of the asked users, the default row where there is none."""
    return users.select("user_id").join(preferences, "user_id", "left").withColumn(
        "preferred_style", F.coalesce("preferred_style", F.lit(style))
    )


def record_sessions(history: DataFrame, sessions: DataFrame) -> DataFrame:
    return history.unionByName(sessions)


def common_topics(history: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent non-empty topics per user, ties by name."""
    counted = history.filter("dominant_topic != ''").groupBy("user_id", "dominant_topic").agg(F.count("*").alias("sessions"))
    return top_k(counted, ["user_id"], [F.desc("sessions"), F.asc("dominant_topic")], limit)


def forget_user(table: DataFrame, user_id: str | int) -> DataFrame:
    return table.filter(F.col("user_id") != user_id)


# ---- long-term memory ------------------------------------------------------------------------


def memory_search(queries: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, entry_id, score, rank, match): by vector, by token sets where that finds nothing.

    ``queries(query_id, query, vector)`` (vector may be null), ``entries(entry_id, content,
    importance, vector)``.
    """
    with_vector = queries.filter("vector is not null").select("query_id", "vector")
    near = dense.dense_topk_cosine(
        with_vector, entries.filter("vector is not null").select("entry_id", "vector"), k, threshold=-1.0, id="entry_id"
    ).withColumn("match", F.lit("vector"))
    rest = queries.join(near.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "query")
    words = lexical.jaccard_topk(rest, entries.select("entry_id", "content", "importance"), k).withColumn("match", F.lit("keyword"))
    columns = ["query_id", "entry_id", "score", "rank", "match"]
    return near.select(*columns).unionByName(words.select(*columns))


def touch_entries(entries: DataFrame, hits: DataFrame, at: Column) -> DataFrame:
    """Access counters after a search: each vector hit counts once."""
    used = hits.filter("match = 'vector'").groupBy("entry_id").agg(F.count("*").alias("__hits"))
    return entries.join(used, "entry_id", "left").withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("__hits", F.lit(0)),
            "last_accessed_at": F.when(F.col("__hits").isNotNull(), at).otherwise(F.col("last_accessed_at")),
        }
    ).drop("__hits")


def memory_add(entries: DataFrame, added: DataFrame) -> DataFrame:
    return entries.unionByName(added, allowMissingColumns=True)


def memory_forget(entries: DataFrame, forgotten: DataFrame) -> DataFrame:
    return entries.join(forgotten.select("entry_id"), "entry_id", "left_anti")


def memory_by_importance(entries: DataFrame, threshold: float = 0.5) -> DataFrame:
    return entries.filter(F.col("importance") >= threshold)


def summary_fallback(conversations: DataFrame, max_length: int = 500, importance: float = 0.5) -> DataFrame:
    """Entry made without a model: the first characters at half the importance."""
    return conversations.select(
        "conv_id", F.substring("text", 1, max_length).alias("content"), F.lit(importance * 0.5).alias("importance")
    )


# Wording of the memory context.
MEMORY_ZH = {"title": "## 长期记忆 (历史对话摘要)\n", "entry": "### 记忆 %d (重要性: %s)"}


def memory_context(entries: DataFrame, n: int = 3, floor: float = 0.3, owner: str = "owner", words: dict = MEMORY_ZH) -> DataFrame:
    """Text of the first ``n`` sufficiently important entries of each owner, in order of entry."""
    from corpusmill.functions.text import fixed

    first = top_k(memory_by_importance(entries, floor), [owner], [F.asc("entry_id")], n)
    block = F.concat(
        F.format_string(words["entry"], F.col("rank"), fixed(F.col("importance"), 2)), F.lit("\n"), F.col("content"), F.lit("\n")
    )
    gathered = first.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    text = F.concat(F.lit(words["title"] + "\n"), F.array_join(F.transform("bs", lambda s: s["b"]), "\n"))
    return gathered.select(owner, text.alias("context"))
