"""Sessions, memory, cache and usage over ``conversations`` and ``events``."""

from pyspark.sql import functions as F

from catalog.quality import REQUESTS_SQL, request_hits, requests
from catalog.registry import query, table
from catalog.retrieval import JACCARD, MEMORY_TOKENS
from corpusmill.operators import cache as ca
from corpusmill.operators import sessions as se
from corpusmill.operators import usage as us


def conversations(spark, sf):
    return table(spark, sf, "conversations")


ROUNDS = """ro as (select u.conv_id, u.turn, u.text as query, coalesce(a.text, '') as answer from conversations u
  left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'),
rb as (select *, row_number() over (partition by conv_id order by turn desc) as back from ro)"""


@query("last_rounds", f"with {ROUNDS} select conv_id, turn, query, answer, back from rb where back <= 2")
def _(spark, sf):
    return se.last_rounds(conversations(spark, sf), 2)


@query("last_exchange", f"with {ROUNDS} select conv_id, query as last_query, answer as last_answer from rb where back = 1")
def _(spark, sf):
    return se.last_exchange(conversations(spark, sf))


@query(
    "history_text",
    f"""with {ROUNDS}, l as (select *, '用户: ' || query || chr(10) || case when answer != '' then 'AI: ' || answer || chr(10) else '' end as line from rb where back <= 10),
    r as (select *, sum(length(line)) over (partition by conv_id order by back desc) as run from l)
    select conv_id, coalesce(string_agg(line, chr(10) order by back desc) filter (where run <= 800), '')
      || case when count(*) filter (where run <= 800) < count(*) then case when count(*) filter (where run <= 800) > 0 then chr(10) else '' end || chr(10) || '... (前 ' || count(*) filter (where run <= 800)
        || ' 轮对话已省略，共 ' || count(*) || ' 轮)' else '' end as history from r group by conv_id""",
)
def _(spark, sf):
    return se.history_text(conversations(spark, sf), 800)


@query(
    "recent_messages",
    f"""with {ROUNDS}, m as (select conv_id, turn, 'user' as role, query as content from ro union all
      select conv_id, turn + 1, 'assistant', answer from ro where answer != ''),
    r as (select *, row_number() over (partition by conv_id order by turn desc, role desc) as position from m)
    select * from r where position <= 3""",
)
def _(spark, sf):
    return se.recent_messages(conversations(spark, sf), 3)


@query(
    "topic_summary",
    f"""with {ROUNDS}, t as (select conv_id, count(*) as n, string_agg(query[1:30], ' → ' order by turn) filter (where back <= 3) as ts from rb where back <= 10 group by 1)
    select c.conv_id, coalesce('共 ' || n || ' 轮对话，最近话题: ' || ts, '（无对话历史）') as summary
    from (select distinct conv_id from conversations) c left join t using (conv_id)""",
)
def _(spark, sf):
    return se.topic_summary(conversations(spark, sf))


# Preferences from events: each event sets the user's style and topic at its time.
@query(
    "upsert_preferences",
    """with p as (select user_id, event_type as preferred_style, props as topics, event_id as updated_at from events)
    select user_id, arg_max(preferred_style, updated_at) as preferred_style, arg_max(topics, updated_at) as topics, max(updated_at) as updated_at from p group by 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("preferred_style"), F.col("props").alias("topics"), F.col("event_id").alias("updated_at")
    )
    halfway = F.col("preferred_style").isin("click", "view")
    return se.upsert_preferences(rows.filter(halfway), rows.filter(~halfway))


@query(
    "preferences_of",
    """select c.c_custkey as user_id, coalesce(s, 'detailed') as preferred_style from customer c left join
    (select user_id, arg_max(event_type, event_id) as s from events group by 1) p on p.user_id = c.c_custkey""",
)
def _(spark, sf):
    prefs = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("preferred_style"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return se.preferences_of(users, prefs)


TOPICS = """sh as (select user_id, event_id as session_id, case when event_type = 'view' then '' else event_type || ' ' || (props->>'$.k')::int // 20 end as dominant_topic from events)"""


def session_history(spark, sf):
    band = F.floor(F.get_json_object("props", "$.k").cast("int") / 20).cast("string")
    topic = F.when(F.col("event_type") == "view", "").otherwise(F.concat_ws(" ", "event_type", band))
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("session_id"), topic.alias("dominant_topic"))


@query(
    "common_topics",
    f"""with {TOPICS}, c as (select user_id, dominant_topic, count(*) as sessions from sh where dominant_topic != '' group by all),
    r as (select *, row_number() over (partition by user_id order by sessions desc, dominant_topic) as rank from c) select * from r where rank <= 5""",
)
def _(spark, sf):
    return se.common_topics(session_history(spark, sf))


@query("record_sessions", f"with {TOPICS} select user_id, count(*) * 2 as sessions from sh group by 1")
def _(spark, sf):
    facts = session_history(spark, sf)
    return se.record_sessions(facts, facts).groupBy("user_id").agg(F.count("*").alias("sessions"))


# Memory: messages; embeddings lend vectors to entries and queries by position.
MEMORY_SQL = JACCARD + f""",
mv as (select conv_id * 1000 + turn as entry_id, row_number() over (order by conv_id, turn) - 1 as n from conversations)"""


def memory_entries(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("turn_key"), F.col("embedding").alias("vector"))
    base = conversations(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("text").alias("content"),
        (F.length("text") % 10 / F.lit(10.0)).alias("importance"), F.col("conv_id").alias("owner"),
        (F.col("conv_id") * 3 + F.col("turn")).alias("turn_key"), F.lit(0).cast("long").alias("access_count"),
        F.lit(0).cast("long").alias("last_accessed_at"),
    )
    return base.join(vectors, "turn_key", "left").drop("turn_key")


def memory_queries(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return asked.join(vectors, "query_id", "left").withColumn("vector", F.when(F.col("query_id") % 2 == 0, F.col("vector")))


SEARCH_SQL = f"""{JACCARD},
mem as (select conv_id * 1000 + turn as entry_id, e.embedding::double[] as v from conversations join embeddings e on e.vec_id = conv_id * 3 + turn),
mq as (select item_id as query_id, embedding::double[] as v from benchmark join embeddings on vec_id = item_id where item_id % 2 = 0),
ms as (select query_id, entry_id, list_cosine_similarity(mq.v, mem.v) as score from mq, mem),
mr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, entry_id) as rank from ms),
sr as (select query_id, entry_id, score, rank, 'vector' as match from mr where rank <= 5
  union all select query_id, entry_id, score, rank, 'keyword' from jr where rank <= 5 and query_id not in (select query_id from mr))"""


@query("memory_search", f"with {SEARCH_SQL} select query_id, entry_id, rank, match, round(score, 6) as score from sr")
def _(spark, sf):
    return se.memory_search(memory_queries(spark, sf), memory_entries(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "touch_entries",
    f"""with {SEARCH_SQL}, h as (select entry_id, count(*) as n from sr where match = 'vector' group by 1)
    select conv_id * 1000 + turn as entry_id, coalesce(n, 0) as access_count, case when n is null then 0 else 99 end as last_accessed_at
    from conversations left join h on h.entry_id = conv_id * 1000 + turn""",
)
def _(spark, sf):
    entries = memory_entries(spark, sf)
    hits = se.memory_search(memory_queries(spark, sf), entries)
    touched = se.touch_entries(entries, hits, F.lit(99).cast("long"))
    return touched.select("entry_id", "access_count", "last_accessed_at")


ENTRIES = "en2 as (select conv_id * 1000 + turn as entry_id, conv_id as owner, text as content, length(text) % 10 / 10.0::double as importance, role from conversations)"


@query("memory_by_importance", f"with {ENTRIES} select entry_id, importance from en2 where importance >= 0.5")
def _(spark, sf):
    return se.memory_by_importance(memory_entries(spark, sf)).select("entry_id", "importance")


@query("memory_forget", f"with {ENTRIES} select entry_id from en2 where role != 'system'")
def _(spark, sf):
    gone = conversations(spark, sf).filter("role = 'system'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"))
    return se.memory_forget(memory_entries(spark, sf), gone).select("entry_id")


@query(
    "memory_add",
    f"""with {ENTRIES} select entry_id, content, importance from en2
    union all select -1 - entry_id, content[1:500], 0.25::double from en2""",
)
def _(spark, sf):
    entries = memory_entries(spark, sf).select("entry_id", "content", "importance")
    short = se.summary_fallback(entries.select(F.col("entry_id").alias("conv_id"), F.col("content").alias("text")))
    added = short.select((-1 - F.col("conv_id")).alias("entry_id"), "content", "importance")
    return se.memory_add(entries, added)


@query(
    "memory_context",
    f"""with {ENTRIES}, r as (select *, row_number() over (partition by owner order by entry_id) as rank from en2 where importance >= 0.3)
    select owner, '## 长期记忆 (历史对话摘要)' || chr(10) || chr(10) || string_agg('### 记忆 ' || rank || ' (重要性: ' || printf('%.2f', importance) || ')' || chr(10)
      || content || chr(10), chr(10) order by rank) as context from r where rank <= 3 group by owner""",
)
def _(spark, sf):
    return se.memory_context(memory_entries(spark, sf))


# ---- cache: user turns are requests, one second per conversation, a minute per turn -----------

NOW = "conv_id * 40 + turn * 60"


@query("cache_key", "select conv_id, turn, sha256(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13)))) as key from conversations")
def _(spark, sf):
    return conversations(spark, sf).select("conv_id", "turn", ca.cache_key(F.col("text")).alias("key"))


def cache_rows(spark, sf):
    """Stored answers: every user turn with the time it was asked and its vector."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    c = conversations(spark, sf).filter("role = 'user'")
    rows = c.select(
        ca.cache_key(F.col("text")).alias("key"), (F.col("conv_id") * 40 + F.col("turn") * 60).alias("ts"),
        F.concat(F.lit("answer "), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("answer"),
        (F.col("conv_id") * 2 + F.col("turn")).alias("v"),
    )
    return rows.join(vectors, "v", "left").drop("v")


def cache_requests(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    c = conversations(spark, sf).filter("role != 'system'")
    now = c.agg(F.max(F.col("conv_id") * 40 + 600)).scalar()
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit(" "), F.col("text")).alias("query"),
        now.alias("now"), (F.col("conv_id") + F.col("turn")).alias("v"),
    )
    return rows.join(vectors, "v", "left").drop("v")


STRIPPED = "lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13)))"
CACHE_SQL = f"""cr as (select sha256({STRIPPED}) as key, {NOW} as ts, 'answer ' || conv_id || '/' || turn as answer, e.embedding::double[] as v
  from conversations left join embeddings e on e.vec_id = conv_id * 2 + turn where role = 'user'),
nw as (select max(conv_id * 40 + 600) as now from conversations where role != 'system'),
rqs as (select conv_id * 1000 + turn as query_id, sha256(lower(trim(' ' || text, chr(32) || chr(9) || chr(10) || chr(13)))) as key, now, e.embedding::double[] as v
  from conversations left join embeddings e on e.vec_id = conv_id + turn, nw where role != 'system'),
nst as (select key, max(ts) as ts, arg_max(answer, ts) as answer from cr group by key),
ex as (select query_id, answer from rqs join nst using (key) where now - ts <= 3600)"""


@query("cache_lookup_exact", f"with {CACHE_SQL} select * from ex")
def _(spark, sf):
    return ca.cache_lookup_exact(cache_requests(spark, sf), cache_rows(spark, sf))


@query(
    "cache_lookup_semantic",
    f"""with {CACHE_SQL}, m as (select query_id, cr.answer, cr.ts, cr.key, list_cosine_similarity(rqs.v, cr.v) as score from rqs, cr, nw
      where query_id not in (select query_id from ex) and rqs.v is not null and cr.v is not null and nw.now - cr.ts <= 3600),
    r as (select *, row_number() over (partition by query_id order by ts, key) as n from m where score >= 0.92)
    select query_id, answer, round(score, 6) as score from r where n = 1""",
)
def _(spark, sf):
    found = ca.cache_lookup_semantic(cache_requests(spark, sf), cache_rows(spark, sf))
    return found.withColumn("score", F.round("score", 6))


STORE_SQL = f"""{REQUESTS_SQL}, cs as (select sha256(lower(trim(query))) as key, query, floor(epoch(created_at))::bigint as ts, answer, query_id from rq
  where query_id % 8 != 0 and query_id % 9 != 0 and answer != '' and not needs_human_review and query_id % 10 != 0)"""


def storable(spark, sf):
    i = F.col("query_id")
    return requests(spark, sf).withColumns(
        {
            "from_cache": i % 8 == 0, "scoped": i % 9 == 0, "now": F.unix_seconds("created_at"),
            "hitl_status": F.when(i % 10 == 0, "pending").otherwise("none"),
        }
    )


@query("cache_store", f"with {STORE_SQL} select key, query, ts, answer from cs")
def _(spark, sf):
    return ca.cache_store(storable(spark, sf))


@query(
    "cache_evict",
    f"""with {STORE_SQL}, k as (select key, max(ts) as ts, arg_max(answer, ts) as answer from cs group by key),
    r as (select *, row_number() over (order by ts, key) as age, count(*) over () as n from k)
    select key, ts from r where n <= 100 or age > greatest(1, n // 5)""",
)
def _(spark, sf):
    stored = ca._newest(ca.cache_store(storable(spark, sf)))
    return ca.cache_evict(stored, 100).select("key", "ts")


@query(
    "cache_stats",
    """with o as (select case when event_type = 'click' then 'exact' when event_type = 'view' then 'semantic' else 'miss' end as outcome from events)
    select count(*) filter (where outcome = 'exact') as exact_hits, count(*) filter (where outcome = 'semantic') as semantic_hits,
    count(*) filter (where outcome = 'miss') as misses, round(count(*) filter (where outcome != 'miss') / count(*), 6) as hit_rate from o""",
)
def _(spark, sf):
    kind = F.col("event_type")
    log = table(spark, sf, "events").select(F.when(kind == "click", "exact").when(kind == "view", "semantic").otherwise("miss").alias("outcome"))
    return ca.cache_stats(log).withColumn("hit_rate", F.round("hit_rate", 6))


# ---- usage -----------------------------------------------------------------------------------

USAGE_SQL = """ug as (select event_id, event_type as step, ['gpt-4o-mini', 'gpt-4o', 'deepseek-chat', 'other'][user_id % 4 + 1] as model,
  (props->>'$.k')::bigint as input_tokens, floor(value)::bigint as output_tokens from events),
uc as (select *, input_tokens / 1e6 * case model when 'gpt-4o' then 2.5 when 'deepseek-chat' then 0.14 else 0.15 end::double
  + output_tokens / 1e6 * case model when 'gpt-4o' then 10 when 'deepseek-chat' then 0.28 else 0.6 end::double as cost from ug)"""


def usage(spark, sf):
    model = F.get(F.array(*map(F.lit, ("gpt-4o-mini", "gpt-4o", "deepseek-chat", "other"))), (F.col("user_id") % 4).cast("int"))
    rows = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("step"), model.alias("model"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.floor("value").cast("long").alias("output_tokens"),
    )
    return us.estimate_cost(rows)


@query("estimate_cost", f"with {USAGE_SQL} select event_id, model, round(cost, 9) as cost from uc")
def _(spark, sf):
    return usage(spark, sf).select("event_id", "model", F.round("cost", 9).alias("cost"))


@query(
    "token_budget",
    f"""with {REQUESTS_SQL}, {USAGE_SQL} select query_id, case complexity when 'simple' then 500 when 'complex' then 4000 else 2000 end as total_budget,
    case complexity when 'simple' then 400 when 'complex' then 3000 else 1500 end as input_budget,
    case complexity when 'simple' then 100 when 'complex' then 1000 else 500 end as output_budget,
    input_tokens * 20 / case complexity when 'simple' then 500 when 'complex' then 4000 else 2000 end >= 0.5 as compress
    from rq join ug on ug.event_id = rq.query_id""",
)
def _(spark, sf):
    budgeted = us.token_budget(requests(spark, sf).select("query_id", "complexity"))
    used = usage(spark, sf).select(F.col("event_id").alias("query_id"), "input_tokens")
    flag = us.needs_compression(F.col("input_tokens") * 20, F.col("total_budget"))
    return budgeted.join(used, "query_id").withColumn("compress", flag).drop("complexity", "input_tokens")


@query("truncate_to_tokens", "select doc_id, text[1:200] as text from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", us.truncate_to_tokens(F.col("text"), 50).alias("text"))


@query(
    "usage_rollup",
    f"""with {USAGE_SQL} select case when grouping(step) = 0 then 'step' when grouping(model) = 0 then 'model' else 'total' end as level,
    coalesce(step, model, '') as name, sum(input_tokens + output_tokens)::bigint as total_tokens, sum(input_tokens)::bigint as prompt_tokens,
    sum(output_tokens)::bigint as completion_tokens, round(sum(cost), 6) as total_cost, count(*) as requests_count from uc group by grouping sets ((step), (model), ())""",
)
def _(spark, sf):
    return us.usage_rollup(usage(spark, sf)).withColumn("total_cost", F.round("total_cost", 6))


@query(
    "latency_stats",
    """select event_type as name, count(*) as count, round(sum(value), 4) as total_ms, round(avg(value), 6) as avg_ms, min(value) as min_ms, max(value) as max_ms
    from events group by 1""",
)
def _(spark, sf):
    timings = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("value").alias("ms"))
    return us.latency_stats(timings).withColumns({"total_ms": F.round("total_ms", 4), "avg_ms": F.round("avg_ms", 6)})


@query(
    "request_summary",
    f"""with {REQUESTS_SQL} select query_id, session_id, complexity, safety_risk_level as strategy, query_id % 8 = 0 or query_id % 9 = 0 as cache_hit,
    case when length(a) <= 10 then a else a[1:9] || '…' end as answer from (select *, case when query_id % 3 = 0 then answer else query end as a from rq)""",
)
def _(spark, sf):
    i = F.col("query_id")
    rows = requests(spark, sf).withColumns(
        {
            "strategy": F.col("safety_risk_level"), "cache_hit": i % 8 == 0, "from_cache": i % 9 == 0,
            "final_response": F.when(i % 3 == 0, "").otherwise(F.col("query")),
        }
    )
    return us.request_summary(rows, 10)


@query(
    "latest_session_state",
    f"""with {REQUESTS_SQL}, l as (select session_id, arg_max(query_id, [epoch_us(created_at), query_id]) as query_id from rq group by 1),
    s as (select query_id, string_agg(source, ',' order by rank) as sources from ht where rank <= 8 group by 1)
    select session_id, query_id, query, case when length(answer) <= 4000 then answer else answer[1:3999] || '…' end as answer, coalesce(sources, '') as sources
    from l join rq using (session_id, query_id) left join s using (query_id)""",
)
def _(spark, sf):
    latest = us.latest_session_state(requests(spark, sf), request_hits(spark, sf))
    return latest.withColumn("sources", F.coalesce(F.array_join("sources", ","), F.lit("")))


@query(
    "merge_updates",
    """with u as (select event_id // 10 as request_id, event_type as field, event_id as seq, case when event_type in ('click', 'view') then null else value end as value,
      case when event_type in ('click', 'view') then [event_id, (props->>'$.k')::bigint] end as items from events)
    select request_id, field, round(arg_max(value, seq) filter (where items is null), 6) as value,
      coalesce(string_agg(items[1] || ',' || items[2], ',' order by seq) filter (where items is not null), '') as items from u group by all""",
)
def _(spark, sf):
    listed = F.col("event_type").isin("click", "view")
    updates = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 10).alias("request_id"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"),
        F.when(~listed, F.col("value")).alias("value"),
        F.when(listed, F.array("event_id", F.get_json_object("props", "$.k").cast("long"))).alias("items"),
    )
    return us.merge_updates(updates).select(
        "request_id", "field", F.round("value", 6).alias("value"), F.array_join("items", ",").alias("items")
    )
