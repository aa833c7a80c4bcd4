"""Search plans over a table of queries.

``queries(query_id, query, vector)``, optionally ``scope_id``; an index is a pair of tables:
``chunks(chunk_id, text, session_id, document_id, source[, element_type])`` and
``vectors(chunk_id, vector)``. Hits are ``(query_id, chunk_id, rank, score, match_type, text,
source)``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.rule_packs import ZH, matches
from corpusmill.functions.session import cut_lineage
from corpusmill.functions.skew import fits
from corpusmill.functions.vectors import nearest_scoped
from corpusmill.operators import dense, fusion, lexical, routing
from corpusmill.operators.postings import Postings, build_block_postings
from corpusmill.operators.tables import BUDGET_ZH, aggregate_markdown

# Depth of each list, candidates to rescore, results kept.
BM25_K, DENSE_K, POOL, TOP_K = 10, 40, 20, 6
#: Hits that are sent to the chunks at most.
SENT_HITS = 100_000
HITS = ("query_id", "chunk_id", "rank", "score", "match_type", "text", "source")


class Index(NamedTuple):
    chunks: DataFrame
    vectors: DataFrame
    postings: Postings | None = None  # stored block postings of the chunks, if there are some


def no_retrieval(queries: DataFrame, index: Index) -> DataFrame:
    """No hits, in the shape of hits."""
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *index.chunks.schema.fields]}
    shape = f"""query_id {types['query_id']}, chunk_id {types['chunk_id']}, rank long, score double, match_type string,
        text string, source {types['source']}"""
    return queries.sparkSession.createDataFrame([], shape)


def _with_content(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts and sources of hits. The few hits of a search are sent to the chunks, whose texts then stay where they are."""
    hits = cut_lineage(hits)
    return fusion.with_content(F.broadcast(hits) if fits(hits, SENT_HITS) else hits, chunks, ["text", "source"])


def single_step(
    queries: DataFrame, index: Index, scopes: DataFrame | None = None, scorer=T.token_overlap, pack: dict = ZH,
    top_k: int = TOP_K, threshold: float = 0.0,
) -> DataFrame:
    """Structure first for scoped global questions; otherwise BM25 and vectors, fused and rescored."""
    chunks, vectors, postings = index
    has_limit = "retrieval_top_k" in queries.columns
    rest, structural = queries, None
    if scopes is not None:
        # read by free and by scoped queries
        postings = _with_postings(index).postings
        rest, scopes = lexical.shared_scopes(queries, scopes)
        members = lexical.scope_members(scopes, chunks)
        scoped = rest.filter("scope_id is not null")
        if "element_type" in chunks.columns:
            # lengths stand for the texts, which would be repeated for each scope
            held = members.join(chunks.select("chunk_id", "element_type", F.length("text").alias("chars")), "chunk_id")
            found = fusion.structure_search(routing.query_intent(scoped, pack), held)
            # few rows, used several times below: written once
            structural = cut_lineage(found.withColumn("match_type", F.lit("keyword")))
            rest = rest.join(structural.select("query_id").distinct(), "query_id", "left_anti")
        inside = rest.filter("scope_id is not null")
        free = rest.filter("scope_id is null")
        words = lexical.bm25_topk(free, chunks, BM25_K, postings=postings).unionByName(
            lexical.bm25_topk_scoped(inside, scopes, chunks, BM25_K, postings=postings)
        )
        near = dense.dense_topk(free.filter("vector is not null"), vectors, DENSE_K).unionByName(
            nearest_scoped(inside.filter("vector is not null"), members.join(vectors, "chunk_id"), DENSE_K, "chunk_id")
        )
    else:
        words = lexical.bm25_topk(rest, chunks, BM25_K, postings=postings)
        near = dense.dense_topk(rest.filter("vector is not null"), vectors, DENSE_K)
    fused = fusion.rrf_fuse(words, near).filter(F.col("rank") <= POOL)
    content = _with_content(fused, chunks)
    ranked = fusion.rerank(content.join(rest.select("query_id", "query"), "query_id"), scorer, POOL, top_k, threshold)
    hits = ranked.withColumn("match_type", F.lit("hybrid")).select(*HITS)
    if has_limit:
        hits = fusion.limit_hits(hits, queries.select("query_id", F.col("retrieval_top_k").alias("k")))
    if structural is not None:
        hits = hits.unionByName(_with_content(structural, chunks).select(*HITS))
    return hits


class Steps(NamedTuple):
    """What searches of several steps need besides the queries; see ``multi_step``."""

    rewrites: DataFrame | None = None
    fallback: DataFrame | None = None
    suggestions: DataFrame | None = None
    rounds: int = 3
    embed: Callable[[DataFrame], DataFrame] | None = None
    evidence: tuple = fusion.EVIDENCE_ZH
    step_back: str = routing.STEP_BACK_ZH
    sub_queries: tuple[str, ...] = routing.SUB_QUERIES_ZH


LABELS = ("sub_id", "owner", "kind", "list_no", "k")


def _labelled_search(asked: DataFrame, index: Index, scopes: DataFrame | None, scorer, pack: dict) -> DataFrame:
    """Hits of ``asked(sub_id, query_id, query, vector, ...)`` with its labels; ``query_id`` is the owning query. All texts, whatever
    asks for them, share one pass over postings and vectors. Written out, so that what follows stays short."""
    owners = asked.select("sub_id", F.col("query_id").alias("owner"), *[c for c in LABELS[2:] if c in asked.columns])
    more = [c for c in ("scope_id", "retrieval_top_k") if c in asked.columns]
    renamed = asked.select(F.col("sub_id").alias("query_id"), "query", "vector", *more)
    hits = single_step(renamed, index, scopes, scorer, pack).withColumnRenamed("query_id", "sub_id").join(owners, "sub_id")
    return cut_lineage(hits.withColumnRenamed("owner", "query_id"))


def _vectored(df: DataFrame, queries: DataFrame, embed: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The original keeps its vector; other texts get one only from ``embed``."""
    scope = ["scope_id"] if "scope_id" in queries.columns else []
    own = queries.select("query_id", *scope, F.col("query").alias("__q"), F.col("vector").alias("__v"))
    kind = queries.schema["vector"].dataType
    joined = df.join(own, "query_id").withColumn("vector", F.when(F.col("query") == F.col("__q"), F.col("__v")).cast(kind))
    joined = joined.drop("__q", "__v")
    return embed(joined) if embed is not None else joined


def _phrasings(queries: DataFrame, steps: Steps, pack: dict) -> DataFrame:
    """The texts that a query of several steps asks first, labelled with kind, list_no and k."""
    rewrites = steps.rewrites
    if rewrites is None:
        rewrites = queries.select("query_id", F.array().cast("array<string>").alias("rewrites"))
    expanded = routing.expand_queries(queries, rewrites, pack, steps.step_back, steps.sub_queries)
    sub = F.concat_ws("#", F.col("query_id").cast("string"), F.col("list_no").cast("string"))
    return _vectored(expanded.withColumn("sub_id", sub), queries, steps.embed)


def _further_rounds(
    queries: DataFrame, first: DataFrame, index: Index, scopes: DataFrame | None, steps: Steps, scorer, pack: dict
) -> DataFrame:
    """Fuse the hits of all phrasings, then ask again for queries that have too little."""

    def search(asked: DataFrame) -> DataFrame:
        return _labelled_search(_vectored(asked, queries, steps.embed), index, scopes, scorer, pack)

    narrow = first.filter((F.col("kind") == "sub_query") & (F.col("rank") <= F.col("k"))).withColumns(
        {"round": F.lit(0), "rank": F.col("list_no") * 100 + F.col("rank")}
    )
    lists = first.filter("kind != 'sub_query'").withColumnRenamed("list_no", "list_id")
    fused = fusion.rrf_fuse_lists(lists)
    fused = _with_content(fused, index.chunks).join(queries.select("query_id", "query"), "query_id")
    scores = fused.select("query_id", "chunk_id", scorer(F.col("query"), F.col("text")).cast("double").alias("new_score"))
    reranked = fusion.rerank_keep_all(fused, scores).withColumns({"round": F.lit(1), "match_type": F.lit("hybrid")})
    columns = [*HITS, "round"]
    found = cut_lineage(fusion.dedupe_hits(narrow.select(*columns).unionByName(reranked.select(*columns))))

    if steps.fallback is not None:
        empty = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
        empty = empty.filter(~matches(F.col("query"), pack["tabular"]))
        if "scope_id" in queries.columns:
            empty = empty.filter("scope_id is null")
        asked = cut_lineage(steps.fallback.join(empty.select("query_id"), "query_id", "left_semi"))
        if not asked.isEmpty():
            asked = asked.withColumn("sub_id", F.col("query_id").cast("string"))
            found = cut_lineage(found.unionByName(search(asked).withColumn("round", F.lit(2)).select(*columns)))

    for number in range(2, steps.rounds + 1):
        enough = fusion.sufficiency(queries, found).filter("sufficient").select("query_id")
        open_queries = queries.join(enough, "query_id", "left_anti").select("query_id", "query")
        if steps.suggestions is not None:
            text = F.concat_ws(" ", "query", F.when(F.col("suggestion") != "", F.col("suggestion")))
            open_queries = open_queries.join(steps.suggestions, "query_id", "left").select("query_id", text.alias("query"))
        open_queries = cut_lineage(open_queries)
        if open_queries.isEmpty():
            break
        more = search(open_queries.withColumn("sub_id", F.col("query_id").cast("string"))).withColumn("round", F.lit(number + 1))
        found = cut_lineage(fusion.dedupe_hits(found.unionByName(more.select(*columns))))

    ordered = fusion._ranked(found.drop("rank"), [F.desc(F.round("score", 9)), F.asc("round"), F.asc("chunk_id")])
    flagged = queries.select("query_id", matches(F.col("query"), pack["inference_search"]).alias("is_inference"))
    covered = fusion.evidence_coverage(ordered, flagged, steps.evidence)
    return covered.drop("rank", "round").withColumnRenamed("new_rank", "rank").select(*HITS)


def _with_postings(index: Index) -> Index:
    """Postings that are read more than once are made once."""
    return index if index.postings is not None else index._replace(postings=build_block_postings(index.chunks))


def multi_step(
    queries: DataFrame, index: Index, rewrites: DataFrame | None = None, scopes: DataFrame | None = None,
    fallback: DataFrame | None = None, suggestions: DataFrame | None = None, rounds: int = 3,
    embed: Callable[[DataFrame], DataFrame] | None = None, scorer=T.token_overlap, pack: dict = ZH,
    evidence=fusion.EVIDENCE_ZH, step_back: str = routing.STEP_BACK_ZH, sub_queries=routing.SUB_QUERIES_ZH,
) -> DataFrame:
    """Several phrasings per query, fused; further rounds only for queries still insufficient.

    ``rewrites(query_id, rewrites)``, ``fallback(query_id, query)`` and ``suggestions(query_id,
    suggestion)`` come from outside, as do vectors of rewritten texts (``embed``). Every round is
    written out before the next, so plans stay short and a lost executor costs one round.
    """
    steps = Steps(rewrites, fallback, suggestions, rounds, embed, evidence, step_back, sub_queries)
    index = _with_postings(index)
    first = _labelled_search(_phrasings(queries, steps, pack), index, scopes, scorer, pack)
    return _further_rounds(queries, first, index, scopes, steps, scorer, pack)


def prepend_aggregate(hits: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Put a computed answer (``aggregates(query_id, answer, source)``) before the hits: rank 0
    becomes 1, score 1, no chunk; every hit moves down by one."""
    head = aggregates.select(
        "query_id", F.lit(None).cast(hits.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(1).cast("long").alias("rank"),
        F.lit(1.0).alias("score"), F.lit("hybrid").alias("match_type"), F.col("answer").alias("text"), "source",
        F.lit(-1).cast("long").alias("chunk_index"),
    )
    moved = hits.join(aggregates.select("query_id", F.lit(1).alias("__up")), "query_id", "left").withColumns(
        {"rank": F.col("rank") + F.coalesce("__up", F.lit(0)), "chunk_index": F.lit(None).cast("long")}
    ).drop("__up")
    return moved.unionByName(head)


# ---- strategies ------------------------------------------------------------------------------

_STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def register_strategy(name: str, fn: Callable[..., DataFrame]) -> None:
    """Make ``fn(queries, index, **kwargs) -> hits`` available under a name."""
    _STRATEGIES[name] = fn


def list_strategies() -> list[str]:
    return sorted(_STRATEGIES)


def clear_strategies() -> None:
    _STRATEGIES.clear()


def run_strategy(name: str, queries: DataFrame, index: Index, **kwargs) -> DataFrame:
    if name not in _STRATEGIES:
        raise ValueError(f"unknown strategy: {name}; registered: {', '.join(list_strategies())}")
    hits = _STRATEGIES[name](queries, index, **kwargs)
    missing = set(HITS) - set(hits.columns)
    if missing:
        raise ValueError(f"strategy {name} gives no {', '.join(sorted(missing))}")
    return hits.select(*HITS)


def register_defaults() -> None:
    register_strategy("no_retrieval", lambda queries, index, **_: no_retrieval(queries, index))
    register_strategy(
        "single_step", lambda queries, index, scopes=None, pack=ZH, **_: single_step(queries, index, scopes, pack=pack)
    )
    register_strategy(
        "multi_step",
        lambda queries, index, rewrites=None, scopes=None, pack=ZH, **kw: multi_step(
            queries, index, rewrites, scopes, pack=pack, **kw
        ),
    )


register_defaults()


def adaptive_search(
    queries: DataFrame, index: Index, rewrites: DataFrame | None = None, scopes: DataFrame | None = None, pack: dict = ZH,
    budget_words: dict = BUDGET_ZH, scorer=T.token_overlap, **multi,
) -> DataFrame:
    """Each query goes the way its class asks for; table answers come first. Adds ``strategy``.

    Queries of one step and all phrasings of complex ones are rows of one table, told apart by labels, and are searched in one
    pass; further rounds take the complex ones that still lack something. Without ``rewrites`` a complex query is searched by its own texts.
    """
    steps = Steps(rewrites, **multi)
    scoped = None
    if "scope_id" in queries.columns:
        queries = queries.withColumn("__scoped", F.col("scope_id").isNotNull())
        scoped = "__scoped"
    routed = cut_lineage(routing.route(queries, pack, scoped=scoped))
    index = _with_postings(index)
    simple, hard = routed.filter("strategy = 'single_step'"), routed.filter("strategy = 'multi_step'")
    none = {c: F.lit(None).cast("long") for c in ("list_no", "k")}
    one = simple.withColumns({"sub_id": F.concat_ws("#", F.lit("one"), F.col("query_id").cast("string")), "kind": F.lit("single"), **none})
    phrased = _phrasings(hard, steps, pack).withColumn("retrieval_top_k", F.lit(None).cast("long"))
    columns = ["sub_id", "query_id", "query", "vector", "retrieval_top_k", *LABELS[2:], *(["scope_id"] if scoped else [])]
    first = _labelled_search(one.select(*columns).unionByName(phrased.select(*columns)), index, scopes, scorer, pack)
    parts = first.filter("kind = 'single'").select(*HITS)
    if not hard.isEmpty():
        parts = parts.unionByName(_further_rounds(hard, first.filter("kind <> 'single'"), index, scopes, steps, scorer, pack))
    # a few rows per query, read below both for table answers and as hits: written once
    parts = cut_lineage(parts)
    asked = routed.filter(matches(F.col("query"), pack["aggregate"]))
    contexts = parts.join(asked.select("query_id", "query"), "query_id").select("query_id", "query", "rank", "text")
    answers = aggregate_markdown(contexts, pack, budget_words).select(
        "query_id", "answer", F.lit("deterministic_table_aggregation").alias("source")
    )
    strategy = routed.select("query_id", "strategy")
    return prepend_aggregate(parts, answers).drop("chunk_index").join(strategy, "query_id")


def compare_strategies(queries: DataFrame, index: Index, answers: DataFrame, contexts: int = 5, **kwargs) -> DataFrame:
    """(query_id, path, docs_count, sources, tokens_est) for direct, standard and adaptive search.

    ``answers(query_id, path, answer)`` are the generated answers of each path.
    """
    index = _with_postings(index)
    standard = single_step(queries, index, kwargs.get("scopes"), pack=kwargs.get("pack", ZH)).withColumn("path", F.lit("standard"))
    adaptive = adaptive_search(queries, index, **kwargs).drop("strategy").withColumn("path", F.lit("adaptive"))
    found = standard.select(*HITS, "path").unionByName(adaptive.select(*HITS, "path")).groupBy("query_id", "path").agg(
        F.count("*").alias("docs_count"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.sum(F.when(F.col("rank") <= contexts, F.length("text")).otherwise(0)).alias("context_chars"),
    )
    paths = queries.select("query_id", F.explode(F.array(*map(F.lit, ("direct", "standard", "adaptive")))).alias("path"))
    joined = paths.join(found, ["query_id", "path"], "left").join(answers, ["query_id", "path"], "left")
    return joined.select(
        "query_id", "path", F.coalesce("docs_count", F.lit(0)).alias("docs_count"), F.coalesce("sources", F.lit("")).alias("sources"),
        (2 * F.length(F.coalesce("answer", F.lit(""))) + F.coalesce("context_chars", F.lit(0))).cast("long").alias("tokens_est"),
    )
