"""Rule-based safety triage. Judged verdicts come in as tables and fail safe when missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.rule_packs import ZH, matches

Pack = dict[str, tuple[str, ...]]

# Fixed value: the answer of a blocked request.
BLOCKED_ANSWER = "Input content is unsafe; request blocked."


def prescreen_column(text: Column, pack: Pack = ZH) -> Column:
    """unsafe (blank), uncertain (suspicious or not allow-listed) or safe."""
    return (
        F.when(T.strip(F.coalesce(text, F.lit(""))) == "", "unsafe")
        .when(matches(text, pack["injection"]), "uncertain")
        .when(matches(text, pack["allowed"]), "safe")
        .otherwise("uncertain")
    )


def prescreen_input(df: DataFrame, pack: Pack = ZH, text: str = "text") -> DataFrame:
    verdict = prescreen_column(F.col(text), pack)
    return df.withColumn("prescreen", verdict).withColumn(
        "risk_level", F.when(F.col("prescreen").isin("unsafe", "safe"), F.lit("low"))
    )


def low_risk_column(query: Column, answer: Column, pack: Pack = ZH) -> Column:
    return matches(query, pack["low_risk"]) & ~matches(answer, pack["high_risk"])


def low_risk_domain(df: DataFrame, pack: Pack = ZH) -> DataFrame:
    return df.withColumn("low_risk", F.coalesce(low_risk_column(F.col("query"), F.col("answer"), pack), F.lit(False)))


def safety_gate(requests: DataFrame, input_verdicts: DataFrame, output_verdicts: DataFrame, pack: Pack = ZH) -> DataFrame:
    """Final safety state of every request.

    ``requests(query_id, query, answer, search_count)``;
    ``input_verdicts(query_id, valid, safe, risk_level)`` and
    ``output_verdicts(query_id, valid, risk_level, needs_human_review)`` are judged outside. A
    missing or invalid verdict blocks the input, or marks the output high with review.
    """
    inputs = input_verdicts.filter("valid").select(
        "query_id", F.lit(True).alias("__in"), F.coalesce("safe", F.lit(True)).alias("__safe"),
        F.coalesce("risk_level", F.lit("low")).alias("__in_risk"),
    )
    outputs = output_verdicts.filter("valid").select(
        "query_id", F.lit(True).alias("__out"), F.coalesce("risk_level", F.lit("low")).alias("__out_risk"),
        F.coalesce("needs_human_review", F.lit(False)).alias("__review"),
    )
    joined = requests.join(inputs, "query_id", "left").join(outputs, "query_id", "left")
    cleared = prescreen_column(F.col("query"), pack) == "safe"
    input_safe = F.when(cleared, True).when(F.col("__in"), F.col("__safe")).otherwise(False)
    input_risk = F.when(cleared, "low").when(F.col("__in"), F.col("__in_risk")).otherwise("high")
    quiet = (F.coalesce("answer", F.lit("")) == "") | low_risk_column(F.col("query"), F.col("answer"), pack)
    output_risk = F.when(quiet, "low").when(F.col("__out"), F.col("__out_risk")).otherwise("high")
    review = F.when(quiet, False).when(F.col("__out"), F.col("__review")).otherwise(True)
    safe = F.col("input_safe")
    return joined.withColumns({"input_safe": input_safe, "input_risk": input_risk}).select(
        "query_id",
        "input_safe",
        "input_risk",
        F.when(safe, output_risk != "critical").otherwise(True).alias("output_safe"),
        F.when(safe, output_risk).alias("safety_risk_level"),
        F.when(safe, review).otherwise(True).alias("needs_human_review"),
        F.when(safe, F.col("search_count")).otherwise(0).cast("long").alias("search_count"),
        F.when(safe, F.col("answer")).otherwise(F.lit(BLOCKED_ANSWER)).alias("answer"),
    )
