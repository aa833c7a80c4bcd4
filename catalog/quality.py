"""Scores, path comparison and the review queue: ``labels`` score, ``events`` are requests."""

from pyspark.sql import functions as F

from catalog.registry import query, table
from corpusmill.functions.rule_packs import EN
from corpusmill.operators import evaluation as ev
from corpusmill.operators import review as rv

RAW_SQL = """rs as (select doc_id, case doc_id % 6 when 0 then 'nan' when 1 then 'inf' when 2 then 'n/a' else (quality * 0.5 + doc_id % 10 / 20.0)::double::varchar end as faithfulness,
  case when doc_id % 4 = 0 then [] else [(toxic * 0.25 + doc_id % 7 / 10.0)::double::varchar, '0.9'] end as answer_relevancy,
  case when doc_id % 5 = 0 then null else doc_id % 9 / 8.0::double end as context_precision from labels),
cs as (select doc_id, case when isfinite(try_cast(faithfulness as double)) then try_cast(faithfulness as double) end as faithfulness,
  try_cast(answer_relevancy[1] as double) as answer_relevancy, context_precision from rs)"""
THREE = ("faithfulness", "answer_relevancy", "context_precision")


def raw_scores(spark, sf):
    i = F.col("doc_id")
    faith = F.when(i % 6 == 0, "nan").when(i % 6 == 1, "inf").when(i % 6 == 2, "n/a").otherwise(
        (F.col("quality") * 0.5 + i % 10 / 20.0).cast("string")
    )
    relevancy = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.array((F.col("toxic") * 0.25 + i % 7 / 10.0).cast("string"), F.lit("0.9"))
    )
    return table(spark, sf, "labels").select(
        "doc_id", faith.alias("faithfulness"), relevancy.alias("answer_relevancy"),
        F.when(i % 5 != 0, i % 9 / 8.0).alias("context_precision"),
    )


def cleaned(spark, sf):
    return ev.clean_scores(raw_scores(spark, sf), THREE)


@query(
    "clean_scores",
    f"""with {RAW_SQL} select doc_id, round(faithfulness, 6) as faithfulness, round(answer_relevancy, 6) as answer_relevancy,
    round(context_precision, 6) as context_precision, concat_ws(',', case when faithfulness is null then 'faithfulness' end,
    case when answer_relevancy is null then 'answer_relevancy' end, case when context_precision is null then 'context_precision' end) as missing from cs""",
)
def _(spark, sf):
    return cleaned(spark, sf).select(
        "doc_id", *[F.round(m, 6).alias(m) for m in THREE], F.array_join("missing_metrics", ",").alias("missing")
    )


QUALITY_SQL = """(coalesce(faithfulness * 0.4::double, 0) + coalesce(answer_relevancy * 0.3::double, 0) + coalesce(context_precision * 0.1::double, 0))
  / nullif(case when faithfulness is null then 0::double else 0.4 end + case when answer_relevancy is null then 0::double else 0.3 end + case when context_precision is null then 0::double else 0.1 end, 0)"""


@query("quality_score", f"with {RAW_SQL} select doc_id, round({QUALITY_SQL}, 6) as quality from cs")
def _(spark, sf):
    return ev.quality_score(cleaned(spark, sf)).select("doc_id", F.round("quality", 6).alias("quality"))


@query(
    "threshold_alerts",
    f"""with {RAW_SQL} select doc_id, concat_ws('; ', case when faithfulness < 0.6 then 'faithfulness=' || printf('%.3f', faithfulness) || ' < 0.6' end,
    case when answer_relevancy < 0.5 then 'answer_relevancy=' || printf('%.3f', answer_relevancy) || ' < 0.5' end,
    case when context_precision < 0.5 then 'context_precision=' || printf('%.3f', context_precision) || ' < 0.5' end) as alerts from cs""",
)
def _(spark, sf):
    return ev.threshold_alerts(cleaned(spark, sf)).select("doc_id", F.array_join("alerts", "; ").alias("alerts"))


# Three runs per order: metrics and times from its price, some missing.
RUNS_SQL = f"""ru as (select o_orderkey as query_id, p as path, (o_totalprice / 100 + o_orderkey % 7 * i * 150)::double as time_ms,
  case when o_orderkey % 9 != i then (1 + (o_custkey + 3 * i) % 10) / 10.0::double end as faithfulness,
  case when o_orderkey % 4 != 0 then (1 + (o_custkey + i) % 8) / 8.0::double end as answer_relevancy,
  case when o_orderkey % 5 != i then (o_custkey % 4) / 4.0::double end as context_precision,
  (o_orderkey % 6 + i)::bigint as docs_count, case o_custkey % 3 when 0 then 'simple' when 1 then 'medium' else 'complex' end as complexity,
  case o_custkey % 3 when 0 then 'no_retrieval' when 1 then 'single_step' else 'multi_step' end as strategy
  from orders, (values ('direct', 0), ('standard', 1), ('adaptive', 2)) v(p, i)),
qr as (select *, {QUALITY_SQL} as quality from ru)"""


def runs(spark, sf):
    paths = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for i, p in enumerate(("direct", "standard", "adaptive"))]))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", paths.alias("v")).select("*", "v.*")
    key, cust, i = F.col("o_orderkey"), F.col("o_custkey"), F.col("i")
    out = o.select(
        key.alias("query_id"), F.col("p").alias("path"), (F.col("o_totalprice") / 100 + key % 7 * i * 150).alias("time_ms"),
        F.when(key % 9 != i, (1 + (cust + 3 * i) % 10) / 10.0).alias("faithfulness"),
        F.when(key % 4 != 0, (1 + (cust + i) % 8) / 8.0).alias("answer_relevancy"),
        F.when(key % 5 != i, (cust % 4) / 4.0).alias("context_precision"),
        (key % 6 + i).cast("long").alias("docs_count"),
        F.when(cust % 3 == 0, "simple").when(cust % 3 == 1, "medium").otherwise("complex").alias("complexity"),
        F.when(cust % 3 == 0, "no_retrieval").when(cust % 3 == 1, "single_step").otherwise("multi_step").alias("strategy"),
    )
    return ev.quality_score(out)


SIDES = ", ".join(
    f"max(case when path = '{p}' then {c} end) as {p[0]}_{c}"
    for p in ("direct", "standard", "adaptive")
    for c in ("quality", "time_ms", "docs_count", "faithfulness", "answer_relevancy", "context_precision", "complexity", "strategy")
)
CHOSEN_SQL = f"""{RUNS_SQL}, w as (select query_id, {SIDES} from qr group by 1),
ch as (select *, case when s_quality is null and a_quality is null then case when s_time_ms <= a_time_ms then 'standard' else 'adaptive' end
  when s_quality is null then 'adaptive' when a_quality is null then 'standard'
  when abs(a_quality - s_quality) > 0.03 then case when a_quality > s_quality then 'adaptive' else 'standard' end
  when s_time_ms <= a_time_ms then 'standard' else 'adaptive' end as winner,
  case when s_quality is null and a_quality is null then 'no_quality' when s_quality is null then 'standard_missing'
  when a_quality is null then 'adaptive_missing' when abs(a_quality - s_quality) > 0.03 then 'better_quality'
  when abs(a_time_ms - s_time_ms) >= 500 then 'faster' else 'similar' end as reason from w)"""


@query("select_path", f"with {CHOSEN_SQL} select query_id, winner, reason from ch")
def _(spark, sf):
    return ev.select_path(runs(spark, sf))


@query(
    "metric_deltas",
    f"with {CHOSEN_SQL} " + " union all ".join(
        f"select query_id, '{m}' as metric, round((a_{m} - s_{m}) / s_{m} * 100, 6) as delta_pct from ch where s_{m} > 0 and a_{m} is not null"
        for m in THREE
    ),
)
def _(spark, sf):
    return ev.metric_deltas(runs(spark, sf)).withColumn("delta_pct", F.round("delta_pct", 6))


def _pct(m):
    return f"case when s_{m} > 0 and a_{m} is not null then '{ev.REPORT_ZH['metrics'][m]} ' || printf('%+.0f', (a_{m} - s_{m}) / s_{m} * 100) || '%' end"


def _case(col, names):
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"


W = ev.REPORT_ZH
@query(
    "comparison_report",
    f"""with {CHOSEN_SQL}, c2 as (select *, case winner when 'standard' then '标准 RAG' else '自适应 RAG' end as nm, concat_ws(', ', {', '.join(_pct(m) for m in THREE)}) as chg from ch)
    select query_id, winner, concat_ws(chr(10), '## 对比总结' || chr(10), '推荐路径：' || nm, '推荐理由：' || case reason
      when 'better_quality' then nm || ' 的综合质量分更高：标准 RAG ' || printf('%.2f', s_quality) || '，自适应 RAG ' || printf('%.2f', a_quality) || '。'
      when 'faster' then '两条 RAG 路径质量差异不明显，' || nm || ' 回答延迟更低：' || printf('%.0f', least(s_time_ms, a_time_ms)) || 'ms vs ' || printf('%.0f', greatest(s_time_ms, a_time_ms)) || 'ms。'
      when 'similar' then '两条 RAG 路径质量与耗时差异都不明显，优先选择实现更直接的 ' || nm || '。'
      when 'no_quality' then '{W['no_quality']}' when 'standard_missing' then '{W['standard_missing']}' else '{W['adaptive_missing']}' end,
      case when s_quality is not null and a_quality is not null then '综合质量分：标准 RAG ' || printf('%.2f', s_quality) || '，自适应 RAG ' || printf('%.2f', a_quality) end,
      case when chg != '' then '- 指标变化：' || chg else '{W['no_changes']}' end,
      '- 直接回答耗时：' || printf('%.0f', d_time_ms) || 'ms', '- 标准 RAG 回答耗时（不含 RAGAS）：' || printf('%.0f', s_time_ms) || 'ms',
      '- 标准 RAG 的 RAGAS 评估耗时：' || printf('%.0f', s_docs_count * 100.0::double) || 'ms', '- 标准 RAG 总耗时（含 RAGAS）：-',
      '- 自适应 RAG 回答耗时（不含 RAGAS）：' || printf('%.0f', a_time_ms) || 'ms', '- 自适应 RAG 的 RAGAS 评估耗时：' || printf('%.0f', a_docs_count * 100.0::double) || 'ms',
      '- 自适应 RAG 总耗时（含 RAGAS）：-',
      '- 自适应策略：查询复杂度=' || {_case('a_complexity', W['complexity'])} || '，检索策略=' || {_case('a_strategy', W['strategy'])}) as report from c2""",
)
def _(spark, sf):
    timed = runs(spark, sf).withColumns(
        {"eval_time_ms": F.col("docs_count") * 100.0, "total_time_ms": F.lit(None).cast("double")}
    )
    return ev.comparison_report(timed)


def _fig(side, m):
    return f"coalesce(printf('%.3f', {side}_{m}), '')"


def _delta(m):
    return f"case when s_{m} is null or a_{m} is null or s_{m} = 0 then 'N/A' else printf('%+.0f', (a_{m} - s_{m}) / s_{m} * 100) || '%' end"


COMPARISON_TABLE_SQL = f"""with {CHOSEN_SQL} select query_id as "ID", round_even(d_time_ms, 0)::bigint as "Direct_Time_ms", round_even(s_time_ms, 0)::bigint as "StdRAG_Time_ms",
  s_docs_count as "StdRAG_Docs", {_fig('s', THREE[0])} as "StdRAG_Faithfulness", {_fig('s', THREE[1])} as "StdRAG_Relevancy", {_fig('s', THREE[2])} as "StdRAG_Precision",
  round_even(a_time_ms, 0)::bigint as "AdpRAG_Time_ms", a_complexity as "AdpRAG_Complexity", a_strategy as "AdpRAG_Strategy", a_docs_count as "AdpRAG_Docs",
  {_fig('a', THREE[0])} as "AdpRAG_Faithfulness", {_fig('a', THREE[1])} as "AdpRAG_Relevancy", {_fig('a', THREE[2])} as "AdpRAG_Precision",
  {_delta(THREE[0])} as "Faithfulness_Delta_pct", {_delta(THREE[1])} as "Relevancy_Delta_pct", {_delta(THREE[2])} as "Precision_Delta_pct" from ch"""

# Requests: one per event.
REQUESTS_SQL = """rq as (select event_id as query_id, user_id as session_id, event_type || ' ' || props as query, 'answer ' || event_id || case when event_id % 7 = 0 then ' maybe' else '' end as full_answer,
  case when event_id % 19 = 0 then '' else 'answer ' || event_id || case when event_id % 7 = 0 then ' maybe' else '' end end as answer, ts as created_at, event_type != 'error' as quality_passed,
  event_id % 13 = 0 as needs_human_review, case event_id % 17 when 0 then 'high' when 1 then 'critical' else 'low' end as safety_risk_level,
  case when event_id % 3 != 0 then least(1, value / 10) end as faithfulness, case when event_id % 4 != 0 then least(1, value / 8) end as answer_relevancy,
  case when event_id % 5 != 0 then least(1, value / 6) end as context_precision,
  case event_id % 4 when 0 then 'simple' when 1 then 'complex' else 'medium' end as complexity from events),
ht as (select event_id as query_id, r as rank, d.doc_id, d.text, d.lang as source, (1 - 0.1 * r - event_id % 5 / 20.0)::double as score
  from events, (select unnest([1, 2, 3]) as r) join documents d on d.doc_id = (event_id + 7 * r) % (select count(*) from documents) where event_id % 6 != 0)"""


def requests(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    answer = F.concat(F.lit("answer "), i.cast("string"), F.when(i % 7 == 0, " maybe").otherwise(""))
    return table(spark, sf, "events").select(
        i.alias("query_id"), F.col("user_id").alias("session_id"), F.concat("event_type", F.lit(" "), "props").alias("query"),
        F.when(i % 19 == 0, "").otherwise(answer).alias("answer"), F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_type") != "error").alias("quality_passed"), (i % 13 == 0).alias("needs_human_review"),
        F.when(i % 17 == 0, "high").when(i % 17 == 1, "critical").otherwise("low").alias("safety_risk_level"),
        F.when(i % 3 != 0, F.least(F.lit(1.0), v / 10)).alias("faithfulness"),
        F.when(i % 4 != 0, F.least(F.lit(1.0), v / 8)).alias("answer_relevancy"),
        F.when(i % 5 != 0, F.least(F.lit(1.0), v / 6)).alias("context_precision"),
        F.when(i % 4 == 0, "simple").when(i % 4 == 1, "complex").otherwise("medium").alias("complexity"),
    )


def request_hits(spark, sf):
    e = table(spark, sf, "events").filter("event_id % 6 != 0").select("event_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("source"))
    size = docs.agg(F.count("*")).scalar()
    keyed = e.withColumn("doc_id", (F.col("event_id") + 7 * F.col("rank")) % size)
    score = 1 - 0.1 * F.col("rank") - F.col("event_id") % 5 / 20.0
    return keyed.join(docs, "doc_id").select(
        F.col("event_id").alias("query_id"), F.col("rank").cast("long").alias("rank"), "doc_id", "text", "source", score.alias("score")
    )


@query(
    "review_fast_path",
    f"""with {REQUESTS_SQL}, m as (select query_id, avg(score) as ms from ht group by 1),
    c as (select rq.query_id, case when complexity = 'simple' then 'skipped_for_simple_query' when answer = '' then 'empty_answer'
      when ms is null then 'no_documents' when complexity = 'medium' and round(ms, 9) >= 0.65 and length(answer) <= 250 and not regexp_matches(answer, '(?i)\\b(maybe|perhaps|possibly|allegedly|not sure|not found)\\b')
      then 'fast_path_high_confidence' else 'needs_judge' end as review_reason from rq left join m using (query_id))
    select query_id, review_reason, review_reason = 'needs_judge' as needs_judge,
      case review_reason when 'empty_answer' then 0.0::double when 'skipped_for_simple_query' then 0.7 when 'no_documents' then 0.7 when 'fast_path_high_confidence' then 0.8 end as quality_score,
      case when review_reason != 'needs_judge' then review_reason != 'empty_answer' end as quality_passed from c""",
)
def _(spark, sf):
    return rv.review_fast_path(requests(spark, sf), request_hits(spark, sf), EN)


TRIGGERED = f"""{REQUESTS_SQL}, tr as (select *, list_filter([case when not quality_passed then 'quality_not_passed' end, case when needs_human_review then 'safety_flagged' end,
  case when safety_risk_level != 'low' then 'safety_' || safety_risk_level end,
  case when faithfulness < 0.6 then 'ragas_faithfulness_' || printf('%.2f', faithfulness) || '_lt_0.6' end,
  case when answer_relevancy < 0.5 then 'ragas_relevancy_' || printf('%.2f', answer_relevancy) || '_lt_0.5' end,
  case when context_precision < 0.5 then 'ragas_precision_' || printf('%.2f', context_precision) || '_lt_0.5' end], lambda x: x is not null) as reasons from rq)"""


@query("review_triggers", f"with {TRIGGERED} select query_id, array_to_string(reasons, ',') as reasons from tr")
def _(spark, sf):
    return rv.review_triggers(requests(spark, sf)).select("query_id", F.array_join("trigger_reasons", ",").alias("reasons"))


QUEUE_SQL = f"""{TRIGGERED}, pv as (select query_id, string_agg(rank || ':' || text[1:300] || ':' || source, '|' order by rank) as previews from ht where rank <= 5 group by 1),
qu as (select tr.*, sha256(session_id || ':' || tr.query_id)[1:12] as review_id, coalesce(previews, '') as previews from tr left join pv using (query_id) where len(reasons) > 0)"""


def queue(spark, sf):
    return rv.enqueue_reviews(requests(spark, sf), request_hits(spark, sf))


@query(
    "enqueue_reviews",
    f"""with {QUEUE_SQL} select query_id, review_id, previews, array_to_string(reasons, ',') as reasons, 'pending' as hitl_status,
    epoch_us(created_at) + 1800000000 as timeout_us from qu""",
)
def _(spark, sf):
    shown = F.array_join(
        F.transform("retrieved_docs_preview", lambda p: F.concat_ws(":", p["rank"].cast("string"), p["content"], p["source"])), "|"
    )
    return queue(spark, sf).select(
        "query_id", "review_id", shown.alias("previews"), F.array_join("trigger_reasons", ",").alias("reasons"), "hitl_status",
        F.unix_micros("timeout_at").alias("timeout_us"),
    )


# Two decisions per decided item, the second counts; some come after the timeout, some never.
DECIDED_SQL = f"""{QUEUE_SQL}, de as (select *, case query_id % 5 when 0 then 'approve' when 1 then 'reject' when 2 then 'edit' when 3 then 'skip' end as decision,
  case when query_id % 10 = 2 then '' else 'edited ' || query_id end as edited,
  created_at + case when query_id % 2 = 0 then interval 600 seconds else interval 4000 seconds end as decided_at from qu),
ap as (select *, case decision when 'approve' then 'approved' when 'reject' then 'rejected' when 'edit' then 'edited'
  when 'skip' then case when query_id % 2 = 1 then 'pending_timeout' else 'pending' end else 'pending' end as hitl_status,
  case when decision in ('approve', 'reject', 'edit') then decision when decision = 'skip' and query_id % 2 = 1 then 'pending_timeout' end as hitl_decision,
  case decision when 'reject' then '回答未通过质量审核，请重新提问' when 'edit' then coalesce(nullif(edited, ''), answer) else answer end as final_answer,
  coalesce(decision in ('approve', 'reject', 'edit'), false) as archived from de)"""


def decided(spark, sf):
    items = queue(spark, sf)
    i = F.col("query_id")
    choice = F.when(i % 5 == 0, "approve").when(i % 5 == 1, "reject").when(i % 5 == 2, "edit").when(i % 5 == 3, "skip")
    later = F.col("created_at") + F.when(i % 2 == 0, F.expr("interval 600 seconds")).otherwise(F.expr("interval 4000 seconds"))
    last = items.select(
        "review_id", choice.alias("decision"),
        F.when(i % 10 == 2, "").otherwise(F.concat(F.lit("edited "), i.cast("string"))).alias("edited_answer"), later.alias("decided_at"),
    ).filter("decision is not null")
    first = last.select(
        "review_id", F.lit("approve").alias("decision"), F.lit(None).cast("string").alias("edited_answer"),
        (F.col("decided_at") - F.expr("interval 60 seconds")).alias("decided_at"),
    )
    return rv.apply_decisions(items, last.unionByName(first))


@query("apply_decisions", f"with {DECIDED_SQL} select review_id, hitl_status, hitl_decision, final_answer as answer, archived from ap")
def _(spark, sf):
    return decided(spark, sf).select("review_id", "hitl_status", "hitl_decision", "answer", "archived")


@query("list_pending", f"with {DECIDED_SQL} select review_id, hitl_status from ap where hitl_status in ('pending', 'pending_timeout')")
def _(spark, sf):
    return rv.list_pending(decided(spark, sf)).select("review_id", "hitl_status")


@query(
    "review_stats",
    f"""with {DECIDED_SQL} select count(*) filter (where hitl_status in ('pending', 'pending_timeout')) as pending, count(*) filter (where archived) as processed,
    count(*) filter (where archived and decision = 'approve') as approved, count(*) filter (where archived and decision = 'reject') as rejected,
    count(*) filter (where archived and decision = 'edit') as edited, 0 as timed_out,
    round(avg(epoch_us(decided_at) / 1e6 - epoch_us(created_at) / 1e6) filter (where archived), 3) as mean_seconds,
    round(count(*) filter (where decision in ('approve', 'edit')) / count(*) filter (where archived), 6) as approval_rate from ap""",
)
def _(spark, sf):
    items = decided(spark, sf)
    stats = rv.review_stats(items.filter("not archived"), items.filter("archived"))
    return stats.withColumns({"mean_seconds": F.round("mean_seconds", 3), "approval_rate": F.round("approval_rate", 6)})


@query(
    "reason_histogram",
    f"with {QUEUE_SQL}, r as (select unnest(reasons) as r from qu) select string_split(r, '_')[1] as reason, count(*) as items from r group by 1",
)
def _(spark, sf):
    return rv.reason_histogram(queue(spark, sf))
