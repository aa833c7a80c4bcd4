"""Whole searches: benchmark texts over documents and embeddings."""

from pyspark.sql import functions as F

from catalog.ranking import RERANKED
from catalog.registry import query, table
from catalog.retrieval import corpus, question_vectors, scopes, vectors
from corpusmill.functions.rule_packs import EN
from corpusmill.operators import fusion, routing
from corpusmill.operators.tables import BUDGET_EN
from corpusmill.plans import search as se


def index(spark, sf):
    return se.Index(corpus(spark, sf), vectors(spark, sf))


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("no_retrieval", "select item_id as query_id, item_id as chunk_id, 0 as rank from benchmark where false")
def _(spark, sf):
    return se.no_retrieval(question_vectors(spark, sf), index(spark, sf)).select("query_id", "chunk_id", "rank")


@query("single_step", f"with {RERANKED} select query_id, chunk_id, rank, round(score, 6) as score, source from re")
def _(spark, sf):
    hits = se.single_step(question_vectors(spark, sf), index(spark, sf), pack=EN)
    return rounded(hits.select("query_id", "chunk_id", "rank", "score", "source"))


@query("single_step_scoped")
def _(spark, sf):
    """Every second query has a scope; scoped global questions are answered from the structure."""
    i = F.col("query_id")
    opening = F.when(i % 6 == 0, "list all of ").otherwise("")
    asked = question_vectors(spark, sf).withColumns(
        {"scope_id": F.when(i % 2 == 0, i), "query": F.concat(opening, F.col("query"))}
    )
    kind = F.when(F.col("chunk_id") % 3 == 0, "section").when(F.col("chunk_id") % 3 == 1, "heading").otherwise("paragraph")
    plain = index(spark, sf)
    hits = se.single_step(asked, se.Index(plain.chunks.withColumn("element_type", kind), plain.vectors), scopes(spark, sf), pack=EN)
    return hits.select("query_id", "chunk_id", "rank", "score", "match_type")


#: What the English questions need in place of the Chinese defaults.
COMPLEX = {"evidence": fusion.EVIDENCE_EN, "step_back": routing.STEP_BACK_EN, "sub_queries": routing.SUB_QUERIES_EN}


OPENINGS = ("", "hello", "list all members: ", "")
OPENED_SQL = "benchmark as (select item_id, case item_id % 4 when 1 then 'hello' when 2 then 'list all members: ' || text else text end as text from benchmark)"


def opened(spark, sf):
    i = F.col("query_id") % 4
    return question_vectors(spark, sf).withColumn(
        "query", F.when(i == 1, "hello").when(i == 2, F.concat(F.lit("list all members: "), "query")).otherwise(F.col("query"))
    )


@query(
    "adaptive_search",
    f"""with {OPENED_SQL}, {RERANKED} select query_id, chunk_id, rank, round(score, 6) as score, 'single_step' as strategy from re
    where query_id % 4 != 1 and rank <= case when query_id % 4 = 2 then 5 else 6 end""",
)
def _(spark, sf):
    """Greetings retrieve nothing, low-cost list questions keep five hits, the rest six."""
    hits = se.adaptive_search(opened(spark, sf), index(spark, sf), pack=EN, budget_words=BUDGET_EN, **COMPLEX)
    return rounded(hits.select("query_id", "chunk_id", "rank", "score", "strategy"))


def opened_complex(spark, sf):
    """As ``opened``; the other questions ask for reasons or for people, each every second time."""
    i = F.col("query_id") % 8
    opening = F.when(i == 3, "why is it so: ").when(i == 7, "who could support this: ").otherwise("")
    return opened(spark, sf).withColumn("query", F.concat(opening, "query"))


@query("adaptive_search_all")
def _(spark, sf):
    """As above with complex questions, which search in several steps, with vectors for each rewrite."""
    hits = se.adaptive_search(opened_complex(spark, sf), index(spark, sf), pack=EN, budget_words=BUDGET_EN, **several_steps(spark, sf))
    return rounded(hits.select("query_id", "chunk_id", "rank", "score", "strategy"))


def several_steps(spark, sf):
    """What comes from outside: both halves of each text as rewrites, the text as fallback and suggestion, vectors for all of them."""
    given = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    words, half = F.split("text", " "), F.ceil(F.size(F.split("text", " ")) / 2).cast("int")
    halves = F.array(F.slice(words, 1, half), F.slice(words, half + 1, F.size(words)))
    rewrites = F.filter(F.transform(halves, lambda h: F.array_join(h, " ")), lambda t: t != "")
    return COMPLEX | {
        "rewrites": given.select("query_id", rewrites.alias("rewrites")),
        "fallback": given.select("query_id", F.col("text").alias("query")),
        "suggestions": given.select("query_id", F.col("text").alias("suggestion")),
        "embed": embedder(spark, sf),
    }


def embedder(spark, sf):
    """Texts without a vector stand for one of the given vectors, by hash."""
    given = vectors(spark, sf).agg(F.count("*").alias("n")).first().n
    numbered = table(spark, sf, "embeddings").select(F.col("vec_id").alias("__vec"), F.col("embedding").alias("__embedding"))

    def embed(texts):
        at = F.pmod(F.xxhash64("query"), F.lit(max(given, 1)))
        joined = texts.withColumn("__vec", F.when(F.col("vector").isNull(), at)).join(numbered, "__vec", "left")
        return joined.withColumn("vector", F.coalesce("vector", "__embedding")).drop("__vec", "__embedding")

    return embed


@query("multi_step")
def _(spark, sf):
    i = F.col("query_id") % 3
    opening = F.when(i == 0, "why is it so: ").when(i == 1, "who could support this: ").otherwise("")
    asked = question_vectors(spark, sf).withColumn("query", F.concat(opening, F.col("query")))
    hits = se.multi_step(asked, index(spark, sf), pack=EN, **several_steps(spark, sf))
    return hits.select("query_id", "chunk_id", "rank", "score")


@query(
    "compare_strategies",
    f"""with {OPENED_SQL}, {RERANKED},
    s as (select query_id, 'standard' as path, count(*) as n, string_agg(distinct source, ',' order by source) as sources, sum(case when rank <= 5 then length(text) else 0 end) as c from re group by 1),
    a as (select query_id, 'adaptive' as path, count(*) as n, string_agg(distinct source, ',' order by source) as sources, sum(case when rank <= 5 then length(text) else 0 end) as c from re
      where query_id % 4 != 1 and rank <= case when query_id % 4 = 2 then 5 else 6 end group by 1),
    p as (select item_id as query_id, text, unnest(['direct', 'standard', 'adaptive']) as path from benchmark)
    select p.query_id, p.path, coalesce(n, 0) as docs_count, coalesce(sources, '') as sources, (2 * length(text) + coalesce(c, 0))::bigint as tokens_est
    from p left join (select * from s union all select * from a) u on u.query_id = p.query_id and u.path = p.path""",
)
def _(spark, sf):
    asked = opened(spark, sf)
    paths = F.explode(F.array(*map(F.lit, ("direct", "standard", "adaptive"))))
    answers = asked.select("query_id", F.col("query").alias("answer"), paths.alias("path"))
    return se.compare_strategies(asked, index(spark, sf), answers, pack=EN, budget_words=BUDGET_EN, **COMPLEX)


@query("compare_strategies_all")
def _(spark, sf):
    asked = opened_complex(spark, sf)
    paths = F.explode(F.array(*map(F.lit, ("direct", "standard", "adaptive"))))
    answers = asked.select("query_id", F.col("query").alias("answer"), paths.alias("path"))
    return se.compare_strategies(asked, index(spark, sf), answers, pack=EN, budget_words=BUDGET_EN, **several_steps(spark, sf))


@query(
    "prepend_aggregate",
    f"""with {RERANKED} select query_id, chunk_id, rank + case when query_id % 2 = 0 then 1 else 0 end as rank, round(score, 6) as score, null as chunk_index from re
    union all select item_id, null, 1, 1, -1 from benchmark where item_id % 2 = 0""",
)
def _(spark, sf):
    hits = se.single_step(question_vectors(spark, sf), index(spark, sf), pack=EN)
    computed = question_vectors(spark, sf).filter("query_id % 2 = 0").select(
        "query_id", F.lit("total: 1").alias("answer"), F.lit("table").alias("source")
    )
    moved = se.prepend_aggregate(hits, computed)
    return rounded(moved.select("query_id", "chunk_id", "rank", "score", "chunk_index"))


@query("run_strategy", f"with {RERANKED} select query_id, chunk_id, rank from re where rank <= 2")
def _(spark, sf):
    """A strategy of the user's own: the two best of the single-step search."""
    se.register_strategy("top_two", lambda queries, index, **_: se.single_step(queries, index, pack=EN, top_k=2))
    return se.run_strategy("top_two", question_vectors(spark, sf), index(spark, sf)).select("query_id", "chunk_id", "rank")
