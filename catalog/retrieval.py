"""Lexical and vector search: ``benchmark`` asks, ``documents`` and ``embeddings`` answer."""

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query, table
from corpusmill.functions import text as T
from corpusmill.functions.vectors import cosine
from corpusmill.operators import ann, dense, lexical


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus(spark, sf):
    """Documents as chunks: the session is the document's source, the chunk source its language."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("session_id"),
        F.col("doc_id").alias("document_id"), F.col("lang").alias("source"),
    )


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def question_vectors(spark, sf):
    """Every benchmark item stands for the vector of the same number."""
    return questions(spark, sf).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        "query_id",
    )


def label_centroids(spark, sf):
    """Mean vector per label."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("m"))
    gathered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return gathered.select(F.col("label").cast("long").alias("query_id"), F.transform("p", lambda s: s["m"]).alias("vector"))


TOK = f"tok as (select doc_id, {S.tokens('text')} as t from documents)"
POSTINGS = f"""{TOK},
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from tok) group by all),
dl as (select doc_id, len(t) as dl from tok),
tot as (select count(*)::double as n, avg(dl) as al from dl),
voc as (select term, count(*) as df from post group by term),
idf as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from voc, tot),
mi as (select avg(raw) as m from idf)"""
QUERY_TERMS = f"""qt as (select item_id as query_id, term, count(*) as qtf from
  (select item_id, unnest({S.tokens('text')}) as term from benchmark) group by all)"""
BM25 = f"""{POSTINGS}, {QUERY_TERMS},
bs as (select qt.query_id, post.doc_id as chunk_id, sum(qtf * case when raw < 0 then 0.25 * m else raw end
    * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al)))::double as score
  from qt join idf using (term) join post using (term) join dl using (doc_id), tot, mi group by all having score > 0),
bmr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from bs),
bm as (select * from bmr where rank <= 10)"""
DENSE = """
dv as (select b.item_id as query_id, e.vec_id as chunk_id,
  1 / (1 + list_distance(q.embedding::double[], e.embedding::double[]) ** 2) as score
  from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings e),
dnr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from dv),
dn as (select * from dnr where rank <= 40)"""


@query("tokenize", f"select doc_id, array_to_string({S.tokens('text')}, ' ') as tokens from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens")
    )


@query(
    "build_postings",
    f"with {POSTINGS} select doc_id as chunk_id, term, tf, dl as doc_length from post join dl using (doc_id)",
)
def _(spark, sf):
    return lexical.build_postings(corpus(spark, sf))


@query("bm25_topk", f"with {BM25} select query_id, chunk_id, rank, round(score, 6) as score from bm")
def _(spark, sf):
    found = lexical.bm25_topk(questions(spark, sf), corpus(spark, sf))
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


# Scopes cycle through the clause shapes: session; session and sources; documents; sources only.
SCOPES = """
sc as (select item_id as query_id, text, item_id as scope_id,
  case when item_id % 4 in (0, 1) then 'src' || (item_id % 20) end as session_id,
  case when item_id % 4 = 2 then [item_id, item_id + 1, item_id + 7, item_id + 30] end as document_ids,
  case when item_id % 4 in (1, 3) then ['en', 'fr'] end as sources from benchmark),
mem as (select scope_id, query_id, d.doc_id from sc, documents d
  where (session_id is null or d.source = session_id) and (document_ids is null or list_contains(document_ids, d.doc_id))
  and (sources is null or list_contains(sources, d.lang)))"""


def scopes(spark, sf):
    i, kind = F.col("item_id"), F.col("item_id") % 4
    return table(spark, sf, "benchmark").select(
        i.alias("scope_id"),
        F.when(kind.isin(0, 1), F.concat(F.lit("src"), (i % 20).cast("string"))).alias("session_id"),
        F.when(kind == 2, F.array(i, i + 1, i + 7, i + 30)).alias("document_ids"),
        F.when(kind.isin(1, 3), F.array(F.lit("en"), F.lit("fr"))).alias("sources"),
    )


def scoped_questions(spark, sf):
    return questions(spark, sf).withColumn("scope_id", F.col("query_id"))


SCOPED_BM25 = f"""{SCOPES}, {TOK}, {QUERY_TERMS},
sp as (select scope_id, doc_id, term, count(*) as tf from
  (select scope_id, doc_id, unnest(t) as term from mem join tok using (doc_id)) group by all),
sdl as (select scope_id, doc_id, len(t) as dl from mem join tok using (doc_id)),
st as (select scope_id, count(*)::double as n, avg(dl) as al from sdl group by 1),
sv as (select scope_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from sp join st using (scope_id) group by scope_id, term, n),
sm as (select scope_id, avg(raw) as m from sv group by 1),
sb as (select qt.query_id, sp.doc_id as chunk_id, sum(qtf * case when raw < 0 then 0.25 * m else raw end
    * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al)))::double as score
  from qt join sp on sp.term = qt.term and sp.scope_id = qt.query_id join sv on sv.scope_id = sp.scope_id and sv.term = sp.term
  join sdl on sdl.scope_id = sp.scope_id and sdl.doc_id = sp.doc_id join st on st.scope_id = sp.scope_id
  join sm on sm.scope_id = sp.scope_id group by all having score > 0),
sbr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from sb)"""


@query("bm25_topk_scoped", f"with {SCOPED_BM25} select query_id, chunk_id, rank, round(score, 6) as score from sbr where rank <= 10")
def _(spark, sf):
    found = lexical.bm25_topk_scoped(scoped_questions(spark, sf), scopes(spark, sf), corpus(spark, sf))
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("apply_scope", f"with {SCOPES} select scope_id, doc_id as chunk_id from mem")
def _(spark, sf):
    return lexical.scope_members(scopes(spark, sf), corpus(spark, sf))


MEMORY_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\x{{4e00}}-\x{{9fff}}]|[a-z0-9]{{2,}}'))"
JACCARD = f"""
en as (select conv_id * 1000 + turn as entry_id, {MEMORY_TOKENS.format('text')} as t, length(text) % 10 / 10.0::double as importance
  from conversations),
jq as (select item_id as query_id, {MEMORY_TOKENS.format('text')} as q from benchmark),
js as (select query_id, entry_id, case when len(q) = 0 then importance else
  0.6::double * len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))) + 0.4::double * importance end as score
  from jq, en where len(t) > 0 or len(q) = 0),
jr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, entry_id) as rank from js where score > 0)"""


def memories(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("text").alias("content"),
        (F.length("text") % 10 / F.lit(10.0)).alias("importance"),
    )


@query("jaccard_topk", f"with {JACCARD} select query_id, entry_id, rank, round(score, 6) as score from jr where rank <= 5")
def _(spark, sf):
    found = lexical.jaccard_topk(questions(spark, sf), memories(spark, sf))
    return found.select("query_id", "entry_id", "rank", F.round("score", 6).alias("score"))


@query("featurize")
def _(spark, sf):
    out = dense.featurize(corpus(spark, sf))
    return out.select("chunk_id", F.size("vector").alias("dim"), F.size(F.filter("vector", lambda x: x != 0)).alias("set"))


@query(
    "cosine",
    """select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def _(spark, sf):
    v = table(spark, sf, "embeddings")
    shifted = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(shifted, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


CENTROIDS = """
cp as (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
cm as (select label, i, avg(x) as m from cp group by all),
ce as (select label::bigint as query_id, list(m order by i) as q from cm group by label)"""


def _nearest_sql(expression, k):
    return f"""with {CENTROIDS}, s as (select query_id, vec_id as chunk_id, {expression} as score from ce, embeddings),
    r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from s)
    select query_id, chunk_id, rank, round(score, 6) as score from r where rank <= {k}"""


@query("dense_topk", _nearest_sql("1 / (1 + list_distance(q, embedding::double[]) ** 2)", 40))
def _(spark, sf):
    found = dense.dense_topk(label_centroids(spark, sf), vectors(spark, sf), 40)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("dense_topk_cosine", _nearest_sql("list_cosine_similarity(q, embedding::double[])", 5))
def _(spark, sf):
    found = dense.dense_topk_cosine(label_centroids(spark, sf), vectors(spark, sf), 5, -1.0)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("ann_topk")
def _(spark, sf):
    return ann.ann_topk(label_centroids(spark, sf), vectors(spark, sf), 10)


@query(
    "ann_recall",
    """select count(*) filter (where vec_id % 50 = 0) as queries, count(*) filter (where vec_id % 50 = 0) * least(10, count(*)) as wanted,
    true as reached from embeddings where embedding is not null""",
)
def _(spark, sf):
    """Whether every fiftieth vector as a query finds nine tenths of its ten nearest through a stored index."""
    held = vectors(spark, sf)
    asked = held.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    found = ann.ann_topk(asked, held, 10, index=ann.build_ann_index(held))
    both = ann.ann_recall(found, dense.dense_topk(asked, held, 10))
    return both.agg(
        F.count("*").alias("queries"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"),
        F.coalesce(F.sum("found") >= 0.9 * F.sum("wanted"), F.lit(True)).alias("reached"),
    )


@query("rebuild_vectors", "select count(*) as ok, count(*) as total from conversations")
def _(spark, sf):
    return dense.rebuild_vectors(memories(spark, sf))[1]
