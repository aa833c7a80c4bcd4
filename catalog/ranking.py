"""Fusion, reranking and selection over BM25 and vector hits of the benchmark texts."""

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query, table
from catalog.retrieval import BM25, DENSE, corpus, question_vectors, questions, vectors
from corpusmill.operators import dense, fusion, lexical


def bm25_hits(spark, sf):
    return lexical.bm25_topk(questions(spark, sf), corpus(spark, sf))


def dense_hits(spark, sf):
    return dense.dense_topk(question_vectors(spark, sf), vectors(spark, sf))


def fused_hits(spark, sf):
    return fusion.rrf_fuse(bm25_hits(spark, sf), dense_hits(spark, sf))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


FUSED = f"""{BM25}, {DENSE},
fu0 as (select query_id, chunk_id, sum(1 / (60 + rank)) as score from
  (select query_id, chunk_id, rank from bm union all select query_id, chunk_id, rank from dn) group by all),
fu as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from fu0)"""


@query("rrf_fuse", f"with {FUSED} select query_id, chunk_id, rank, round(score, 6) as score from fu")
def _(spark, sf):
    return rounded(fused_hits(spark, sf), "score")


def listed_hits(spark, sf):
    return (
        bm25_hits(spark, sf).withColumn("list_id", F.lit(0))
        .unionByName(dense_hits(spark, sf).withColumn("list_id", F.lit(1)))
    )


@query(
    "rrf_fuse_lists",
    f"""with {BM25}, {DENSE},
    li as (select query_id, chunk_id, rank, score, 0 as list_id from bm union all select query_id, chunk_id, rank, score, 1 from dn),
    g as (select query_id, chunk_id, sum(1 / (60 + rank)) as score, max(score) as best_score, arg_max(list_id, score) as list_id from li group by all)
    select query_id, chunk_id, list_id, round(score, 6) as score, round(best_score, 6) as best_score,
      row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from g""",
)
def _(spark, sf):
    return rounded(fusion.rrf_fuse_lists(listed_hits(spark, sf)), "score", "best_score")


def fused_with_text(spark, sf):
    """Fused hits with query, content and source."""
    hits = fusion.with_content(fused_hits(spark, sf), corpus(spark, sf), ["text", "source", "document_id"])
    return hits.join(questions(spark, sf), "query_id")


OVERLAP = f"""case when len(list_distinct({S.tokens('b.text')})) > 0 then
  len(list_intersect(list_distinct({S.tokens('b.text')}), {S.tokens('d.text')})) / len(list_distinct({S.tokens('b.text')})) else 0 end"""
RERANKED = f"""{FUSED},
po as (select fu.query_id, fu.chunk_id, fu.rank as old, d.text, d.lang as source, {OVERLAP} as score
  from fu join documents d on d.doc_id = fu.chunk_id join benchmark b on b.item_id = fu.query_id where fu.rank <= 20),
rr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, old) as rank from po where score >= 0),
re as (select * from rr where rank <= 6)"""


def reranked_hits(spark, sf):
    return fusion.rerank(fused_with_text(spark, sf))


@query("rerank", f"with {RERANKED} select query_id, chunk_id, rank, round(score, 6) as score from re")
def _(spark, sf):
    return rounded(reranked_hits(spark, sf).select("query_id", "chunk_id", "rank", "score"), "score")


@query(
    "rerank_keep_all",
    f"""with {RERANKED}, ka as (select fu.query_id, fu.chunk_id, fu.rank as old, coalesce(po.score, fu.score) as score, po.score as ns
      from fu left join po on po.query_id = fu.query_id and po.chunk_id = fu.chunk_id)
    select query_id, chunk_id, round(score, 6) as score,
      row_number() over (partition by query_id order by ns is null, round(ns, 9) desc, old) as rank from ka""",
)
def _(spark, sf):
    fused = fused_hits(spark, sf)
    pooled = fusion.rerank(fused_with_text(spark, sf), k=20)
    scores = pooled.select("query_id", "chunk_id", F.col("score").alias("new_score"))
    return rounded(fusion.rerank_keep_all(fused, scores), "score")


@query(
    "rejoin_metadata",
    f"""with {RERANKED} select query_id, chunk_id, rank, round(score, 6) as score, coalesce(source, '') as source,
      coalesce(try_cast(case when chunk_id % 2 = 0 then '' || chunk_id else 'x' end as bigint), rank - 1) as chunk_index from re""",
)
def _(spark, sf):
    """Every second chunk has no usable index, so its rank stands in."""
    index = F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id").cast("string")).otherwise(F.lit("x"))
    meta = corpus(spark, sf).withColumn("chunk_index", index)
    hits = reranked_hits(spark, sf).select("query_id", "chunk_id", "rank", "score")
    return rounded(fusion.rejoin_metadata(hits, meta).drop("rerank_score"), "score")


@query(
    "dedupe_hits",
    f"""with {BM25}, {DENSE}, ro as (select query_id, chunk_id, rank, 1 as round from bm union all select query_id, chunk_id, rank, 2 from dn),
    n as (select ro.*, row_number() over (partition by query_id, chunk_id order by round, rank, chunk_id) as n
      from ro join documents d on d.doc_id = ro.chunk_id)
    select query_id, chunk_id, round::bigint as round, rank from n where n = 1""",
)
def _(spark, sf):
    rounds = listed_hits(spark, sf).withColumn("round", (F.col("list_id") + 1).cast("long"))
    hits = fusion.with_content(rounds, corpus(spark, sf), ["text"])
    return fusion.dedupe_hits(hits).select("query_id", "chunk_id", "round", "rank")


@query(
    "limit_hits",
    f"""with {BM25}, lk as (select item_id as query_id, case when item_id % 4 = 0 then '3' when item_id % 4 = 1 then 'all'
      when item_id % 4 = 2 then '-2' end as k from benchmark)
    select query_id, chunk_id, rank from bm join lk using (query_id)
    where try_cast(k as bigint) is null or rank <= greatest(try_cast(k as bigint), 0)""",
)
def _(spark, sf):
    kind = F.col("query_id") % 4
    k = F.when(kind == 0, F.lit("3")).when(kind == 1, F.lit("all")).when(kind == 2, F.lit("-2"))
    limits = questions(spark, sf).select("query_id", k.alias("k"))
    return fusion.limit_hits(bm25_hits(spark, sf).select("query_id", "chunk_id", "rank"), limits)


# Element types and intents laid over the tables to exercise the structure rules.
KINDS_SQL = """case when n_chars % 7 = 0 then 'outline' when n_chars % 7 in (1, 2) then 'heading'
  when n_chars % 7 in (3, 4) then 'section' when n_chars % 7 = 5 then 'table' else 'paragraph' end"""
INTENTS_SQL = """case when item_id % 5 = 0 then 'global_count' when item_id % 5 = 1 then 'summary' when item_id % 5 = 2 then 'global_list'
  when item_id % 5 = 3 then 'comparison' else 'local_fact' end"""


def kinds():
    m = F.col("n_chars") % 7
    return (
        F.when(m == 0, "outline").when(m.isin(1, 2), "heading").when(m.isin(3, 4), "section")
        .when(m == 5, "table").otherwise("paragraph")
    )


@query(
    "structure_search",
    f"""with q as (select item_id as query_id, 'src' || (item_id % 20) as scope_id, {INTENTS_SQL} as intent, text from benchmark),
    q2 as (select *, intent in ('summary', 'comparison') or regexp_matches(text, 'what|which') as bf from q where intent != 'local_fact'),
    d as (select doc_id, source, length(text) as chars, {KINDS_SQL} as kind from documents),
    r as (select query_id, doc_id as chunk_id, intent as query_intent, row_number() over (partition by query_id order by
      case when kind = 'outline' then 0 when kind = 'heading' then case when bf then 2 else 1 end
        when bf then 1 else 2 end, chars desc, doc_id) as rank from q2 join d on d.source = q2.scope_id where kind != 'paragraph')
    select query_id, chunk_id, query_intent, rank, round(greatest(0, 1 - (rank - 1) * 0.02::double), 6) as score from r where rank <= 18""",
)
def _(spark, sf):
    m = F.col("item_id") % 5
    intent = (
        F.when(m == 0, "global_count").when(m == 1, "summary").when(m == 2, "global_list").when(m == 3, "comparison")
        .otherwise("local_fact")
    )
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), intent.alias("query_intent"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope_id"),
    )
    chunks = table(spark, sf, "documents").select(
        F.col("source").alias("scope_id"), F.col("doc_id").alias("chunk_id"), kinds().alias("element_type"), "text"
    )
    return rounded(fusion.structure_search(asked, chunks, body_words="what|which"), "score")


#: One rule for each way in which a text can show evidence.
EVIDENCE = (
    fusion.Evidence("personnel", together=(("ould", "qu", "sch"), ("the ", "ein ")), titles=("fr",)),
    fusion.Evidence("project_status", words=("WHAT", "que", "es")),
    fusion.Evidence("timeline_resource", words=("eaux",)),
)


@query(
    "evidence_coverage",
    f"""with {FUSED}, x as (select fu.query_id, fu.chunk_id, fu.rank,
      (contains(text, 'ould') and contains(text, 'qu') and contains(text, 'sch')) or (contains(text, 'the ') and contains(text, 'ein ')) or contains(lang, 'fr') as m0,
      contains(lower(text), 'what') or contains(lower(lang), 'what') or contains(lower(text), 'que') or contains(lower(lang), 'que')
        or contains(lower(text), 'es') or contains(lower(lang), 'es') as m1,
      contains(lower(text), 'eaux') or contains(lower(lang), 'eaux') as m2
      from fu join (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents) d on d.doc_id = fu.chunk_id),
    a as (select query_id, count(*) as n, bool_or(m0 and rank <= 6) as i0, bool_or(m1 and rank <= 6) as i1, bool_or(m2 and rank <= 6) as i2,
      min(rank) filter (where m0 and rank > 6) as f0 from x group by 1),
    b as (select *, case when not i0 and n >= 4 and query_id % 3 != 0 then f0 end as p0 from a),
    c as (select b.*, case when not i1 and n >= 4 and query_id % 3 != 0 then (select min(rank) from x where x.query_id = b.query_id
      and m1 and rank > 6 and rank is distinct from p0) end as p1 from b),
    e as (select c.*, case when not i2 and n >= 4 and query_id % 3 != 0 then (select min(rank) from x where x.query_id = c.query_id
      and m2 and rank > 6 and rank is distinct from p0 and rank is distinct from p1) end as p2 from c)
    select x.query_id, chunk_id, rank, row_number() over (partition by x.query_id order by case when rank <= 6 then 0
      when rank in (p0, p1, p2) then 1 else 2 end, case when rank > 6 and rank = p0 then 0 when rank > 6 and rank = p1 then 1
      when rank > 6 and rank = p2 then 2 else rank end) as new_rank from x join e using (query_id)""",
)
def _(spark, sf):
    flagged = questions(spark, sf).withColumn("is_inference", F.col("query_id") % 3 != 0)
    hits = fused_with_text(spark, sf).select("query_id", "chunk_id", "rank", "text", "source")
    moved = fusion.evidence_coverage(hits, flagged, EVIDENCE)
    return moved.select("query_id", "chunk_id", "rank", "new_rank")


@query(
    "sufficiency",
    f"""with {RERANKED},
    w as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as ws from benchmark),
    f as (select query_id, count(distinct coalesce(text, '')[1:100]) as u, count(*) filter (where score >= 0.5) as g, sum(length(text)) as c,
      string_agg(lower(text), chr(10)) as body from re group by 1)
    select w.query_id, coalesce(u > 1 and g > 0 and c >= 300 and (len(ws) = 0 or
      len(list_filter(ws, lambda x: contains(body, x))) / len(ws) >= 0.4), false) as sufficient
    from w left join f using (query_id)""",
)
def _(spark, sf):
    return fusion.sufficiency(questions(spark, sf), reranked_hits(spark, sf).select("query_id", "chunk_id", "score", "text"))


def kinded_hits(spark, sf):
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", kinds().alias("element_type"))
    return fused_hits(spark, sf).join(meta, "chunk_id")


@query(
    "select_review_docs",
    f"""with {FUSED}, x as (select fu.*, {KINDS_SQL} as kind, {S.strip('text')} as body from fu join documents d on d.doc_id = fu.chunk_id),
    g as (select *, case when kind = 'outline' then 0 when kind in ('section', 'table', 'row_group') or length(body) >= 80 then 1 else 2 end as grp from x),
    n as (select *, row_number() over (partition by query_id, grp order by rank) as n from g),
    r as (select *, row_number() over (partition by query_id order by grp, rank) as review_rank from n where grp > 0 or n = 1)
    select query_id, chunk_id, rank, review_rank from r where review_rank <= 12""",
)
def _(spark, sf):
    return fusion.select_review_docs(kinded_hits(spark, sf)).select("query_id", "chunk_id", "rank", "review_rank")


@query(
    "assemble_context",
    f"""with {FUSED}, x as (select fu.query_id, rank, '### 文档片段 ' || rank || chr(10) || '**来源**: ' || lang || chr(10) || '**相关度**: '
      || printf('%.2f', fu.score) || chr(10) || '**结构元数据**: 结构类型: ' || {KINDS_SQL} || chr(10) || chr(10) || text[1:1500] || chr(10) as block
      from fu join documents d on d.doc_id = fu.chunk_id),
    y as (select *, sum(length(block)) over (partition by query_id order by rank) as run from x),
    z as (select query_id, count(*) as n, count(*) filter (where run <= 4000) as kept,
      string_agg(block, chr(10) || '---' || chr(10) order by rank) filter (where run <= 4000) as body from y group by 1)
    select b.item_id as query_id, case when z.n is null then '（未检索到相关文档内容，请根据常识回答并明确告知用户）' else
      concat_ws(chr(10) || '---' || chr(10), body, case when n - kept - 1 > 0 then chr(10) || '*(...还有 ' || (n - kept - 1)
      || ' 个文档片段因长度限制未展示)*' end) end as context from benchmark b left join z on z.query_id = b.item_id""",
)
def _(spark, sf):
    hits = kinded_hits(spark, sf).withColumnRenamed("lang", "source")
    return fusion.assemble_context(questions(spark, sf), hits, 2000)


@query(
    "search_summary",
    f"""with {RERANKED} select query_id, string_agg('[' || rank || '] (' || printf('%.2f', score) || ') ' || text[1:150] || '...',
      chr(10) order by rank) as summary from re where rank <= 5 group by 1""",
)
def _(spark, sf):
    return fusion.search_summary(reranked_hits(spark, sf))


@query(
    "source_list",
    f"""with {RERANKED} select query_id, string_agg(distinct source, ', ' order by source) as sources,
      array_to_string(list_sort(list(distinct chunk_id)), ', ') as document_ids from re group by 1""",
)
def _(spark, sf):
    return fusion.source_list(reranked_hits(spark, sf))


@query(
    "serialized_sources",
    f"""with {RERANKED} select query_id, chunk_id, rank, case when length(text) <= 1000 then text else text[1:999] || '…' end as text
      from re where rank <= 8""",
)
def _(spark, sf):
    return fusion.serialized_sources(reranked_hits(spark, sf)).select("query_id", "chunk_id", "rank", "text")
