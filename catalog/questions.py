"""Routing and rewriting: user turns of ``conversations``, each behind a question opening."""

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query, table
from corpusmill.functions import text as T
from corpusmill.functions.rule_packs import EN, rules_from_table, rule_table
from corpusmill.operators import routing

# Opening, and whether it is the whole query.
OPENINGS = (
    ("how many projects are in ", False), ("list all members of ", False), ("why is it behind plan: ", False),
    ("compare the teams ", False), ("hello", True), ("what is the average amount ", False),
    ("who could support ", False), ("", False), ("summarize ", False), ("what is the budget of atlas", True),
    ("error in ", False), ("thanks!", True), ("  ", True), ("top projects by amount ", False), ("short one", True),
    ("which is due ", False),
)
QUESTIONS_SQL = (
    "qq as (select conv_id * 1000 + turn as query_id, ["
    + ", ".join(f"'{o}'" for o, _ in OPENINGS)
    + f"][(conv_id + turn) % {len(OPENINGS)} + 1] || case when (conv_id + turn) % {len(OPENINGS)} in ("
    + ", ".join(str(i) for i, (_, alone) in enumerate(OPENINGS) if alone)
    + ") then '' else text end as query from conversations where role = 'user')"
)


def user_questions(spark, sf):
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    i = (F.col("conv_id") + F.col("turn")) % len(OPENINGS)
    opening = F.get(F.array(*[F.lit(o) for o, _ in OPENINGS]), i.cast("int"))
    alone = i.isin(*[n for n, (_, whole) in enumerate(OPENINGS) if whole])
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat(opening, F.when(alone, F.lit("")).otherwise(F.col("text"))).alias("query"),
    )


Q = S.strip("query")


def _rule(name):
    return S.any_rule("q", EN[name])


FLAGS = f"""{QUESTIONS_SQL}, q0 as (select query_id, query, {Q} as q from qq),
q1 as (select *, {', '.join(f'{_rule(n)} as r_{n}' for n in routing.FLAGS)} from q0),
fl as (select query_id, query, q, r_simple as is_simple, r_complex as is_complex, r_diagnostic as is_diagnostic,
  r_inference as is_inference, r_aggregate as is_aggregate, r_list as is_list, r_medium as is_medium,
  r_single_fact and not (r_diagnostic or r_inference) and q != '' as is_single_fact,
  not (r_diagnostic or r_inference) and (r_single_fact or r_low_cost) as is_low_cost from q1),
cl as (select *, case when q = '' then 'simple' when is_aggregate then 'medium' when is_inference then 'complex' when is_list then 'medium'
  when is_single_fact then 'medium' when is_simple then 'simple' when is_diagnostic then 'complex' when is_complex then 'complex'
  when is_medium then 'medium' when length(q) <= 15 then 'medium' end as complexity from fl)"""
FLAG_COLUMNS = [f"is_{n}" for n in routing.FLAGS]


@query("match_rules", f"with {FLAGS} select query_id, {', '.join(FLAG_COLUMNS)} from fl")
def _(spark, sf):
    """The pack takes the round trip through its table form."""
    pack = rules_from_table(rule_table(spark, "en"))
    return routing.match_rules(user_questions(spark, sf), pack).select("query_id", *FLAG_COLUMNS)


@query(
    "quick_classify",
    f"""with {FLAGS} select query_id, complexity, case when complexity is not null then 1.0::double end as complexity_confidence,
    case when complexity is not null then 'quick_rule' end as classification_reasoning,
    case when complexity is null then null when is_aggregate then 'aggregate' when is_low_cost then 'low_cost_retrieval' end as query_type from cl""",
)
def _(spark, sf):
    return routing.quick_classify(user_questions(spark, sf), EN).drop("query")


@query(
    "route",
    f"""with {FLAGS} select query_id, case when is_aggregate then 'single_step'
      when complexity = 'simple' then case when query_id % 2 = 0 then 'single_step' else 'no_retrieval' end
      when complexity = 'complex' then 'multi_step' else 'single_step' end as strategy from cl""",
)
def _(spark, sf):
    asked = user_questions(spark, sf).withColumn("scoped", F.col("query_id") % 2 == 0)
    return routing.route(asked, EN, scoped="scoped").select("query_id", "strategy")


@query(
    "query_intent",
    f"""with {QUESTIONS_SQL}, q0 as (select query_id, {Q} as q from qq)
    select query_id, case when q = '' then 'unknown' when {_rule('intent_aggregate')} then 'table_aggregation'
      when {_rule('intent_count')} then 'global_count' when {_rule('intent_list')} then 'global_list'
      when {_rule('intent_summary')} then 'summary' when {_rule('intent_compare')} then 'comparison' else 'local_fact' end as query_intent from q0""",
)
def _(spark, sf):
    return routing.query_intent(user_questions(spark, sf), EN).drop("query")


@query(
    "retrieval_top_k",
    f"with {FLAGS} select query_id, case when is_low_cost then case when is_list then 5 else 3 end end as retrieval_top_k from fl",
)
def _(spark, sf):
    return routing.retrieval_top_k(user_questions(spark, sf), EN).drop("query")


# Outside rewrites: the assistant turn's lines, some blank, repeated or padded.
REWRITES_SQL = """rw as (select conv_id * 1000 + turn as query_id,
  ['  a   b ', lang_hint, '', query_text, 'a b', 'x ' || turn, 'y', 'z'] as rewrites
  from (select conv_id, turn, role as lang_hint, text as query_text from conversations where role = 'user'))"""


def outside_rewrites(spark, sf):
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.array(F.lit("  a   b "), F.col("role"), F.lit(""), F.col("text"), F.lit("a b"),
                F.concat(F.lit("x "), F.col("turn").cast("string")), F.lit("y"), F.lit("z")).alias("rewrites"),
    )


def _lists(values, kind, k="null"):
    return f"select query_id, {values} as vs, '{kind}' as kind, {k}::bigint as k"


@query(
    "expand_queries",
    f"""with {FLAGS}, {REWRITES_SQL},
    c as (select cl.*, list_filter(list_transform(rewrites, lambda x: {S.squeeze('x')}), lambda x: x != '' and x != q) as rs from cl left join rw using (query_id)),
    d as (select *, list_slice(list_transform(list_sort(list_transform(list_distinct(rs), lambda x: {{'p': list_position(rs, x), 'x': x}})),
      lambda s: s.x), 1, 3) as kept,
      q != '' and not {_rule('tabular')} and not is_aggregate and not is_list and not is_single_fact and (is_diagnostic or {_rule('step_back')}) as sb,
      {_rule('inference_search')} as inf from c),
    e as (select query_id, case when inf then list_transform(['{"', '".join(routing.SUB_QUERIES_EN)}'], lambda x: {{'query': query || x, 'kind': 'sub_query', 'k': 3::bigint}}) else [] end
      || [{{'query': query, 'kind': 'original', 'k': null::bigint}}] || list_transform(kept, lambda x: {{'query': x, 'kind': 'rewrite', 'k': null::bigint}})
      || case when sb and not list_contains(kept, query || '{routing.STEP_BACK_EN}') then [{{'query': query || '{routing.STEP_BACK_EN}', 'kind': 'step_back', 'k': null::bigint}}] else [] end as es from d)
    select query_id, list_no, s.query as query, s.kind as kind, s.k as k from (select query_id, unnest(range(len(es))) as list_no, unnest(es) as s from e)""",
)
def _(spark, sf):
    return routing.expand_queries(
        user_questions(spark, sf), outside_rewrites(spark, sf), EN, routing.STEP_BACK_EN, routing.SUB_QUERIES_EN
    )


@query(
    "parse_rewrites",
    """select event_id, case event_id % 4 when 0 then 'a ' || event_type || '|b' when 1 then 'c|' || event_type when 2 then 'd'
      else 'first ' || event_type || '|second|third' end as queries from events""",
)
def _(spark, sf):
    kind, name = F.col("event_id") % 4, F.col("event_type")
    response = (
        F.when(kind == 0, F.concat(F.lit('["a '), name, F.lit('", "b"]')))
        .when(kind == 1, F.concat(F.lit('{"queries": ["c", "'), name, F.lit('"]}')))
        .when(kind == 2, F.lit('```json\n["d"]\n```'))
        .otherwise(F.concat(F.lit("- first "), name, F.lit('\n2. second\n"third"')))
    )
    events = table(spark, sf, "events").withColumn("response", response)
    return events.select("event_id", F.array_join(routing.parse_rewrites(F.col("response")), "|").alias("queries"))


@query(
    "parse_json_payload",
    """select event_id, case when event_id % 5 = 4 then null else (props->>'$.k')::bigint end as k from events""",
)
def _(spark, sf):
    """The payload arrives bare, fenced, prefixed, inside prose, or broken."""
    kind, props = F.col("event_id") % 5, F.col("props")
    reply = (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("json "), props))
        .when(kind == 3, F.concat(F.lit("Here it is: "), props, F.lit(" as asked.")))
        .otherwise(F.concat(F.lit("no object, "), F.substring(props, 2, 3)))
    )
    payload = routing.parse_json_payload(reply)
    return table(spark, sf, "events").select("event_id", F.get_json_object(payload, "$.k").cast("long").alias("k"))


@query(
    "final_query",
    """select doc_id, coalesce(case when doc_id % 3 = 0 then lang end, case when doc_id % 4 = 0 then source end,
    case when doc_id % 5 = 0 then 'kw' end, text) as final_query from documents""",
)
def _(spark, sf):
    i = F.col("doc_id")
    pick = lambda n, c: F.when(i % n == 0, c).otherwise(F.lit(""))
    final = routing.final_query(
        pick(3, F.col("lang")), pick(4, F.col("source")), F.when(i % 5 == 0, F.lit("kw")), F.col("text")
    )
    return table(spark, sf, "documents").select("doc_id", final.alias("final_query"))


@query("estimate_tokens", """select doc_id, floor(length(text) * 0.3::double)::bigint as tokens, greatest(1, length(text) // 4) as logged from documents""")
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.estimate_tokens(text).alias("tokens"), T.logged_tokens(text).alias("logged")
    )
