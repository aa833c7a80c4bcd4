"""Answer review and the human review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.rule_packs import ZH, matches

# Limits of the fast path, thresholds of the triggers, queue timing, reject text.
FAST_SCORE, FAST_CHARS = 0.65, 250
TRIGGERS = (("faithfulness", "faithfulness", 0.6), ("answer_relevancy", "relevancy", 0.5), ("context_precision", "precision", 0.5))
TIMEOUT_SECONDS = 1800
REJECTED_ANSWER = "回答未通过质量审核，请重新提问"
PENDING = ("pending", "pending_timeout")


def review_fast_path(requests: DataFrame, hits: DataFrame, pack: dict = ZH) -> DataFrame:
    """(query_id, quality_score, quality_passed, review_reason, needs_judge) without a judge:
    ``requests(query_id, answer, complexity)``, ``hits(query_id, score)``."""
    found = hits.groupBy("query_id").agg(F.avg("score").alias("mean_score"))
    joined = requests.join(found, "query_id", "left")
    answer = F.coalesce("answer", F.lit(""))
    confident = (
        (F.coalesce("complexity", F.lit("medium")) == "medium") & (F.round("mean_score", 9) >= FAST_SCORE)
        & (F.length(answer) <= FAST_CHARS) & ~matches(answer, pack["hedge"])
    )
    case = (
        F.when(F.col("complexity") == "simple", "skipped_for_simple_query")
        .when(answer == "", "empty_answer")
        .when(F.col("mean_score").isNull(), "no_documents")
        .when(confident, "fast_path_high_confidence")
        .otherwise("needs_judge")
    )
    reason = F.col("review_reason")
    score = (
        F.when(reason == "empty_answer", 0.0).when(reason.isin("skipped_for_simple_query", "no_documents"), 0.7)
        .when(reason == "fast_path_high_confidence", 0.8)
    )
    return joined.withColumn("review_reason", case).select(
        "query_id", score.alias("quality_score"),
        F.when(reason != "needs_judge", reason != "empty_answer").alias("quality_passed"),
        "review_reason", (reason == "needs_judge").alias("needs_judge"),
    )


def trigger_column() -> Column:
    """Reasons to send a request to review; a missing value triggers nothing."""
    level = F.col("safety_risk_level")
    reasons = [
        F.when(~F.coalesce("quality_passed", F.lit(True)), "quality_not_passed"),
        F.when(F.coalesce("needs_human_review", F.lit(False)), "safety_flagged"),
        F.when(level.isin("high", "critical"), F.concat(F.lit("safety_"), level)),
    ]
    for metric, short, limit in TRIGGERS:
        value = F.col(metric)
        text = F.concat(F.lit(f"ragas_{short}_"), T.fixed(value, 2), F.lit(f"_lt_{limit}"))
        reasons.append(F.when(value < limit, text))
    return F.array_compact(F.array(*reasons))


def review_triggers(requests: DataFrame) -> DataFrame:
    return requests.withColumn("trigger_reasons", trigger_column())


def enqueue_reviews(requests: DataFrame, hits: DataFrame, docs: int = 5, chars: int = 300) -> DataFrame:
    """Pending review items for requests with at least one reason, ``created_at`` = request time.

    Texts are cut where the hits are; only what is shown of them is dealt out by request."""
    due = review_triggers(requests).filter(F.size("trigger_reasons") > 0)
    item = ("rank", F.substring("text", 1, chars).alias("content"), "score", F.coalesce("source", F.lit("")).alias("source"))
    shown = hits.filter(F.col("rank") <= docs).select("query_id", *item).repartition("query_id").join(due.select("query_id"), "query_id", "left_semi")
    previews = shown.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "content", "score", "source"))).alias("retrieved_docs_preview")
    )
    none = F.array().cast("array<struct<rank:bigint,content:string,score:double,source:string>>")
    return due.join(previews, "query_id", "left").withColumns(
        {
            "review_id": F.substring(F.sha2(F.concat_ws(":", "session_id", "query_id"), 256), 1, 12),
            "retrieved_docs_preview": F.coalesce(F.col("retrieved_docs_preview").cast(
                "array<struct<rank:bigint,content:string,score:double,source:string>>"), none),
            "hitl_status": F.lit("pending"),
            "hitl_decision": F.lit(None).cast("string"),
            "hitl_edited_answer": F.lit(None).cast("string"),
            "updated_at": F.col("created_at"),
            "timeout_at": F.col("created_at") + F.expr(f"interval {TIMEOUT_SECONDS} seconds"),
        }
    )


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue after decisions: status, final answer and whether the item leaves the queue.

    ``decisions(review_id, decision, edited_answer, decided_at)``; the latest one per item counts.
    """
    latest = decisions.groupBy("review_id").agg(
        F.max_by(F.struct("decision", "edited_answer", "decided_at"), "decided_at").alias("d")
    )
    choice = F.col("d.decision")
    late = F.col("d.decided_at") > F.col("timeout_at")
    final = choice.isin("approve", "reject", "edit")
    status = (
        F.when(choice == "approve", "approved").when(choice == "reject", "rejected").when(choice == "edit", "edited")
        .when(choice.isNotNull() & late, "pending_timeout").otherwise(F.col("hitl_status"))
    )
    edited = F.when(F.col("d.edited_answer") != "", F.col("d.edited_answer"))
    answer = (
        F.when(choice == "reject", REJECTED_ANSWER).when(choice == "edit", F.coalesce(edited, F.col("answer")))
        .otherwise(F.col("answer"))
    )
    decided = F.when(final, choice).when(choice.isNotNull() & late, "pending_timeout").otherwise(F.col("hitl_decision"))
    changed = final | (choice.isNotNull() & late)
    return queue.join(latest, "review_id", "left").withColumns(
        {
            "hitl_status": status,
            "hitl_decision": decided,
            "hitl_edited_answer": F.when(choice == "reject", REJECTED_ANSWER).when(choice == "edit", F.col("d.edited_answer"))
            .otherwise(F.col("hitl_edited_answer")),
            "answer": answer,
            "updated_at": F.when(changed, F.col("d.decided_at")).otherwise(F.col("updated_at")),
            "archived": F.coalesce(final, F.lit(False)),
        }
    ).drop("d")


def list_pending(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("hitl_status").isin(*PENDING)).orderBy("review_id")


def get_pending(queue: DataFrame, review_id: str) -> DataFrame:
    return queue.filter(F.col("review_id") == review_id)


def review_stats(queue: DataFrame, archive: DataFrame) -> DataFrame:
    """One row: open and handled items, decisions, approval rate, mean handling time."""
    d = F.col("hitl_decision")
    opened = queue.agg(F.count(F.when(F.col("hitl_status").isin(*PENDING), 1)).alias("pending"))
    handled = archive.agg(
        F.count("*").alias("processed"),
        *[F.count(F.when(d == v, 1)).alias(n) for v, n in
          (("approve", "approved"), ("reject", "rejected"), ("edit", "edited"), ("pending_timeout", "timed_out"))],
        F.avg(F.unix_micros("updated_at") / 1e6 - F.unix_micros("created_at") / 1e6).alias("mean_seconds"),
    )
    decided = F.col("approved") + F.col("rejected") + F.col("edited")
    return handled.withColumn("pending", opened.scalar()).withColumn(
        "approval_rate", F.when(decided > 0, (F.col("approved") + F.col("edited")) / decided)
    )


def reason_histogram(items: DataFrame) -> DataFrame:
    """Reasons counted by their first word."""
    words = items.select(F.explode("trigger_reasons").alias("r")).select(F.element_at(F.split("r", "_"), 1).alias("reason"))
    return words.groupBy("reason").agg(F.count("*").alias("items"))

