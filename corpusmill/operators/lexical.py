"""BM25 and token-set search for whole tables of queries.

Texts are tokenised once, into postings with block bounds (``operators/postings.py``) that can be kept with an index. Term weights come from sums over
the shards; a shard's task then scores the blocks that can still hold one of the ``k`` best, and only ``k`` rows per query and shard travel to the
final ranking. Weights are sent to the tasks when they are few; more queries meet single postings in a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions import text as T
from corpusmill.functions.arrays import unfold
from corpusmill.functions.session import cut_lineage
from corpusmill.functions.skew import fits, salted, top_k
from corpusmill.operators.postings import EPSILON, K1, B, Postings, Shard, build_block_postings

BROADCAST_QUERIES = 10_000
#: (query, term) weights that are sent to the tasks at most.
SENT_WEIGHTS = 500_000
SALTS = 16
#: Entries that meet all queries at once in the token-set search.
ENTRY_ROWS = 128


def build_postings(chunks: DataFrame, id: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf, doc_length), counted inside each row, where the texts are. Write it out to keep an index generation."""
    tokens = chunks.select(id, *keep, F.sort_array(T.tokenize(F.col(text))).alias("tokens"))
    size = F.size("tokens")
    # where a run of equal tokens begins, and the end of the last
    first = F.transform("tokens", lambda t, i: F.when((i == 0) | (t != F.get("tokens", i - 1)), i))
    starts = tokens.withColumn("starts", F.concat(F.array_compact(first), F.array(size)))
    runs = F.transform(
        F.slice("starts", F.lit(1), F.size("starts") - 1),
        lambda s, i: F.struct(F.get("tokens", s).alias("term"), (F.get("starts", i + 1) - s).cast("long").alias("tf")),
    )
    rows = unfold(starts, [id, *keep, size.cast("long").alias("doc_length")], runs, "run_no", "r")
    return rows.select(id, *keep, "doc_length", "r.term", "r.tf")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf); a repeated term counts as often as it is written."""
    return (
        queries.select("query_id", F.explode_outer(T.tokenize(F.col("query"))).alias("term"))
        .filter("term is not null")
        .groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    )


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def _score(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def _join_terms(postings: DataFrame, wanted: DataFrame, id: str, keys: list[str], small: bool) -> DataFrame:
    """Postings of the wanted terms. A checked small side is broadcast; otherwise frequent terms
    are spread over ``SALTS`` tasks."""
    if small:
        return postings.join(F.broadcast(wanted), keys)
    left, right = salted(postings, wanted, F.col(id), SALTS)
    return left.join(right, [*keys, "salt"]).drop("salt")


def _weight(raw: Column, mean_idf: Column) -> Column:
    return F.col("qtf") * F.when(raw < 0, mean_idf * EPSILON).otherwise(raw)


def _ranked_topk(scored: DataFrame, id: str, k: int) -> DataFrame:
    return top_k(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc(id)], k)


def _dealt(df: DataFrame) -> DataFrame:
    """Dealt out by shard: few rows each, but much work, so that partitions are not merged by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")


def _shards(postings: Postings, terms: DataFrame) -> DataFrame:
    """The documents of all shards and the rows of some terms."""
    return postings.docs.unionByName(postings.terms.join(F.broadcast(terms), "term", "left_semi"), allowMissingColumns=True)


def _best_of_shards(rows: DataFrame, wanted: DataFrame, k: int, id: str, kinds: dict[str, str], members: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, held, scored) of the ``k`` best in every shard; ``held`` and ``scored`` count its blocks.

    ``wanted(query_id, scope_key, term, weight, mean_length)`` is collected; ``members(shard, scope_key, numbers)`` restricts scopes.
    """
    weights: dict = defaultdict(dict)
    scope_of, mean_of = {}, {}
    for r in wanted.collect():
        weights[r.query_id][r.term] = r.weight
        scope_of[r.query_id], mean_of[r.query_id] = r.scope_key, r.mean_length
    # queries of one scope are scored together; phrasings of one question, whose ids begin alike, share most words
    together: dict = defaultdict(list)
    for query in sorted(weights, key=str):
        together[scope_of[query]].append(query)
    shared = rows.sparkSession.sparkContext.broadcast((dict(weights), dict(together), mean_of))
    asked = to_arrow_type(wanted.schema["query_id"].dataType)
    schema = f"query_id {kinds['query_id']}, {id} {kinds[id]}, score double, held long, scored long"

    def search(table: pa.Table, scopes: dict[int, np.ndarray] | None) -> pa.Table:
        weights, together, mean_of = shared.value
        shard, out = Shard(table), []
        for scope, queries in together.items():
            inside = None
            if scopes is not None:
                if scope not in scopes:
                    continue
                inside = np.zeros(len(shard.lengths), bool)
                inside[scopes[scope]] = True
            found = shard.best([weights[q] for q in queries], mean_of[queries[0]], k, inside)
            out += [(q, *x) for q, x in zip(queries, found, strict=True) if len(x[0])]
        size = [len(x[1]) for x in out]
        numbers = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
        columns = {
            "query_id": pa.array([x[0] for x in out], asked).take(pa.array(np.repeat(np.arange(len(out), dtype=np.int64), np.array(size, np.int64)))),
            id: shard.ids.take(pa.array(numbers)),
            "score": np.concatenate([x[2] for x in out]) if out else np.empty(0),
            "held": np.repeat(np.array([x[3] for x in out], np.int64), size),
            "scored": np.repeat(np.array([x[4] for x in out], np.int64), size),
        }
        return pa.table(columns)

    if members is None:
        return _dealt(rows).groupBy("shard").applyInArrow(lambda table: search(table, None), schema)

    def search_scopes(table: pa.Table, inside: pa.Table) -> pa.Table:
        scopes = {s: np.asarray(x) for s, x in zip(inside.column("scope_key").to_pylist(), inside.column("numbers").to_pylist(), strict=True)}
        return search(table, scopes)

    return _dealt(rows).groupBy("shard").cogroup(_dealt(members).groupBy("shard")).applyInArrow(search_scopes, schema)


def _kinds(queries: DataFrame, chunks: DataFrame, id: str) -> dict[str, str]:
    return {"query_id": queries.schema["query_id"].dataType.simpleString(), id: chunks.schema[id].dataType.simpleString()}


def bm25_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    id: str = "chunk_id",
    text: str = "text",
    postings: Postings | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): best ``k`` documents with a positive Okapi score.

    ``postings``: stored ones of these chunks (``build_block_postings``, ``index_postings``); otherwise they are made now.
    """
    found = bm25_blocks(queries, chunks, k, id, text, postings)
    return _ranked_topk(found.select("query_id", id, "score"), id, k)


def bm25_blocks(queries: DataFrame, chunks: DataFrame, k: int, id: str, text: str, postings: Postings | None) -> DataFrame:
    """(query_id, id, score, held, scored): a superset of the ``k`` best of each query, with the blocks of their shard that hold
    one of its terms and those that were scored."""
    postings = build_block_postings(chunks, None, id, text) if postings is None else postings
    n_docs = postings.docs.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    weighed = postings.vocabulary.withColumn("raw", raw_idf(F.lit(n_docs), F.col("df")))
    overall = weighed.agg(F.avg("raw").alias("mean_idf"), F.try_divide(F.sum("cf"), F.lit(n_docs)).alias("mean_length")).first()
    mean_length = F.lit(overall.mean_length).cast("double")
    wanted = query_terms(queries).join(weighed, "term").select(
        "query_id", F.lit(None).cast("long").alias("scope_key"), "term", _weight(F.col("raw"), F.lit(overall.mean_idf).cast("double")).alias("weight"),
        mean_length.alias("mean_length"),
    )
    wanted = cut_lineage(wanted)
    if fits(wanted, SENT_WEIGHTS) and fits(queries, BROADCAST_QUERIES):
        return _best_of_shards(_shards(postings, wanted.select("term").distinct()), wanted, k, id, _kinds(queries, chunks, id))
    matched = _join_terms(postings.rows(id), wanted.select("query_id", "term", "weight"), id, ["term"], False)
    part = F.col("weight") * _score(F.col("tf"), F.col("doc_length"), mean_length)
    scored = matched.groupBy("query_id", id).agg(F.sum(part).alias("score")).filter("score > 0")
    return scored.withColumns({"held": F.lit(0).cast("long"), "scored": F.lit(0).cast("long")})


def scope_members(scopes: DataFrame, chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(scope_id, id) of every chunk inside a scope.

    ``scopes(scope_id, session_id, document_ids, sources)``: present clauses are and-ed, an absent
    or empty clause is ignored. Each scope enters by one equality (session, else document, else
    source), never by comparing it with every chunk; a scope with no clause has no members here.
    """
    docs, sources = F.col("document_ids"), F.col("sources")
    has_docs = F.coalesce(F.size(docs) > 0, F.lit(False))
    has_sources = F.coalesce(F.size(sources) > 0, F.lit(False))
    has_session = F.coalesce(F.col("session_id") != "", F.lit(False))
    s = scopes.select(
        "scope_id",
        F.when(has_session, F.col("session_id")).alias("want_session"),
        F.when(has_docs, docs).alias("want_docs"),
        F.when(has_sources, sources).alias("want_sources"),
    )
    c = chunks.select(id, "session_id", "document_id", "source")
    in_docs = F.col("want_docs").isNull() | F.array_contains("want_docs", F.col("document_id"))
    in_sources = F.col("want_sources").isNull() | F.array_contains("want_sources", F.col("source"))
    by_session = c.join(s.filter("want_session is not null"), F.col("session_id") == F.col("want_session"))
    by_docs = c.join(
        s.filter("want_session is null and want_docs is not null")
        .withColumn("one", F.explode(F.array_distinct("want_docs"))),
        F.col("document_id") == F.col("one"),
    ).drop("one")
    by_source = c.join(
        s.filter("want_session is null and want_docs is null and want_sources is not null")
        .withColumn("one", F.explode(F.array_distinct("want_sources"))),
        F.col("source") == F.col("one"),
    ).drop("one")
    return (
        by_session.unionByName(by_docs).unionByName(by_source).filter(in_docs & in_sources).select("scope_id", id)
    )


def _clauses() -> Column:
    """What a scope asks for, as text; alike for scopes that differ only in the order of their lists."""
    return F.to_json(F.struct(
        "session_id", F.array_sort(F.array_distinct("document_ids")).alias("d"), F.array_sort(F.array_distinct("sources")).alias("s"),
    ))


def shared_scopes(queries: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and scopes where one scope stands for all with the same clauses, and none is left that no query asks for."""
    asked = scopes.join(queries.select("scope_id").distinct(), "scope_id", "left_semi").withColumn("__clauses", _clauses())
    one = asked.groupBy("__clauses").agg(F.min("scope_id").alias("__one"))
    named = cut_lineage(asked.join(one, "__clauses").drop("__clauses"))
    kept = named.filter(F.col("scope_id") == F.col("__one")).drop("__one")
    renamed = queries.join(named.select("scope_id", "__one"), "scope_id", "left")
    return renamed.withColumn("scope_id", F.coalesce("__one", "scope_id")).select(*queries.columns), kept


def bm25_topk_scoped(
    queries: DataFrame,
    scopes: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    id: str = "chunk_id",
    text: str = "text",
    postings: Postings | None = None,
) -> DataFrame:
    """BM25 where document counts, lengths and term weights are those of the query's scope.

    ``queries(query_id, query, scope_id)``; statistics are computed once per distinct set of
    clauses, not per query.
    """
    keyed = scopes.withColumn("scope_key", F.xxhash64(_clauses()))
    distinct = keyed.dropDuplicates(["scope_key"]).drop("scope_id").withColumnRenamed("scope_key", "scope_id")
    members = scope_members(distinct, chunks, id).withColumnRenamed("scope_id", "scope_key")
    postings = build_block_postings(chunks, None, id, text) if postings is None else postings
    numbered = postings.docs.select("shard", F.posexplode("ids").alias("number", id))
    members = cut_lineage(
        members.join(numbered, id).groupBy("shard", "scope_key").agg(F.collect_list("number").alias("numbers"))
    )
    counted = postings.terms.select("shard", "term", "numbers", "tfs")
    everything = _dealt(postings.docs.unionByName(counted, allowMissingColumns=True))
    inside = everything.groupBy("shard").cogroup(_dealt(members).groupBy("shard"))
    vocabulary = cut_lineage(
        inside.applyInArrow(_scope_counts, "scope_key long, term string, df long, cf long").groupBy("scope_key", "term").agg(
            F.sum("df").alias("df"), F.sum("cf").alias("cf")
        )
    )
    sizes = members.groupBy("scope_key").agg(F.sum(F.size("numbers")).alias("n_docs"))
    weighed = vocabulary.join(F.broadcast(sizes), "scope_key").withColumn("raw", raw_idf(F.col("n_docs"), F.col("df")))
    overall = weighed.groupBy("scope_key").agg(
        F.avg("raw").alias("mean_idf"), (F.sum("cf") / F.first("n_docs")).alias("mean_length")
    )
    wanted = (
        query_terms(queries)
        .join(queries.select("query_id", "scope_id").join(keyed.select("scope_id", "scope_key"), "scope_id"), "query_id")
        .join(weighed, ["scope_key", "term"]).join(overall, "scope_key")
        .select("query_id", "scope_key", "term", _weight(F.col("raw"), F.col("mean_idf")).alias("weight"), "mean_length")
    )
    wanted = cut_lineage(wanted)
    if fits(wanted, SENT_WEIGHTS) and fits(queries, BROADCAST_QUERIES):
        rows = _shards(postings, wanted.select("term").distinct())
        found = _best_of_shards(rows, wanted, k, id, _kinds(queries, chunks, id), members)
        return _ranked_topk(found.select("query_id", id, "score"), id, k)
    within = members.select("shard", "scope_key", F.explode("numbers").alias("number")).join(numbered, ["shard", "number"]).select(id, "scope_key")
    matched = _join_terms(postings.rows(id).join(within, id), wanted, id, ["scope_key", "term"], False)
    part = F.col("weight") * _score(F.col("tf"), F.col("doc_length"), F.col("mean_length"))
    return _ranked_topk(matched.groupBy("query_id", id).agg(F.sum(part).alias("score")).filter("score > 0"), id, k)


def _scope_counts(table: pa.Table, inside: pa.Table) -> pa.Table:
    """Of one shard: for each scope the terms of its documents, in how many of these and how often they are."""
    shard = Shard(table)
    number, tf = shard.lists["numbers"], shard.lists["tfs"]
    term = np.repeat(np.arange(len(shard.terms)), np.diff(shard.ends["numbers"]))
    order = np.argsort(number, kind="stable")
    term, tf = term[order], tf[order]
    ends = np.searchsorted(number[order], np.arange(len(shard.lengths) + 1))
    out = []
    for scope, numbers in zip(inside.column("scope_key").to_pylist(), inside.column("numbers").to_pylist(), strict=True):
        low, size = ends[numbers], ends[np.add(numbers, 1)] - ends[numbers]
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        df, cf = np.bincount(term[at], minlength=len(shard.terms)), np.bincount(term[at], tf[at], len(shard.terms))
        held = np.flatnonzero(df)
        out.append((scope, held, df[held], cf[held].astype(np.int64)))
    held = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
    scopes = np.repeat(np.arange(len(out)), np.array([len(x[1]) for x in out], np.int64))
    return pa.table({
        "scope_key": pa.array([x[0] for x in out], pa.int64()).take(pa.array(scopes)),
        "term": shard.terms.take(pa.array(held)),
        "df": np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int64),
        "cf": np.concatenate([x[3] for x in out]) if out else np.empty(0, np.int64),
    })


def _best_overlaps(sets: DataFrame, asked: DataFrame, k: int, id: str) -> DataFrame:
    """(query_id, id, score) of the ``k`` best entries of every task that share a token with a query; the queries are collected."""
    local = asked.select("query_id", "q").filter("n_query > 0").collect()
    asking: dict[str, list[int]] = defaultdict(list)
    for number, r in enumerate(local):
        for term in r.q:
            asking[term].append(number)
    queries = pa.array([r.query_id for r in local], to_arrow_type(asked.schema["query_id"].dataType))
    terms = {t: np.array(n, np.int64) for t, n in asking.items()}
    shared = sets.sparkSession.sparkContext.broadcast((queries, np.array([len(r.q) for r in local], np.int64), terms))
    kind = to_arrow_type(sets.schema[id].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_query, terms = shared.value
        least, best = np.full(len(queries), -np.inf), None
        for batch in batches:
            for low in range(0, len(batch) if len(queries) else 0, ENTRY_ROWS):
                part = batch.slice(low, ENTRY_ROWS)
                tokens, n_entry = part.column(2), np.asarray(pc.list_value_length(part.column(2)))
                pairs = [(terms[t], r) for t, r in zip(tokens.flatten().to_pylist(), pc.list_parent_indices(tokens).to_pylist(), strict=True) if t in terms]
                if not pairs:
                    continue
                keys = np.concatenate([q * len(part) + r for q, r in pairs])
                key, common = np.unique(keys, return_counts=True)
                query, row = key // len(part), key % len(part)
                score = 0.6 * common / (n_entry[row] + n_query[query] - common) + 0.4 * np.asarray(part.column(1))[row]
                order = np.where(np.isnan(score), np.inf, np.round(score, 9))
                kept = np.flatnonzero(order >= least[query])
                ids = part.column(0).take(pa.array(row[kept])).to_pandas()
                found = pd.DataFrame({"query": query[kept], "id": ids, "score": score[kept], "order": order[kept]})
                best = found if best is None else pd.concat([best, found], ignore_index=True)
                best = best.sort_values(["query", "order", "id"], ascending=[True, False, True]).groupby("query", sort=False).head(k)
                last = best.groupby("query")["order"].agg(["size", "min"])
                last = last[last["size"] == k]
                least[last.index.to_numpy()] = last["min"].to_numpy()
        if best is not None:
            columns = [queries.take(pa.array(best["query"].to_numpy())), pa.array(best["id"], kind), pa.array(best["score"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", id, "score"])

    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, {id} {sets.schema[id].dataType.simpleString()}, score double"
    held = sets.filter("importance is not null and n_entry > 0").select(id, F.col("importance").cast("double").alias("importance"), "tokens")
    return held.mapInArrow(search, schema)


def jaccard_topk(
    queries: DataFrame, entries: DataFrame, k: int = 5, id: str = "entry_id", text: str = "content"
) -> DataFrame:
    """0.6 x Jaccard of token sets + 0.4 x importance, best ``k`` positive.

    Entries that share no token differ only by importance, so besides the matches only the ``k``
    most important entries can rank; those are the only ones attached to every query. A checked small
    table of queries is sent to the entries, and only ``k`` of them per query leave a task.
    """
    small = fits(queries, BROADCAST_QUERIES)
    sets = (
        entries.select(id, "importance", T.memory_tokens(F.col(text)).alias("tokens"))
        .withColumn("n_entry", F.size("tokens"))
    )
    asked = queries.select("query_id", T.memory_tokens(F.col("query")).alias("q")).withColumn("n_query", F.size("q"))
    wanted = asked.select("query_id", "n_query", F.explode("q").alias("term"))
    held = sets.select(id, "importance", "n_entry", F.explode("tokens").alias("term"))
    common = _best_overlaps(sets, asked, k, id) if small else (
        _join_terms(held, wanted, id, ["term"], False)
        .groupBy("query_id", id, "importance", "n_entry", "n_query").agg(F.count("*").alias("shared"))
        .select(
            "query_id", id,
            (0.6 * F.col("shared") / (F.col("n_entry") + F.col("n_query") - F.col("shared"))
             + 0.4 * F.col("importance")).alias("score"),
        )
    )
    # An entry without tokens is skipped, unless the query has none either.
    best = F.struct((-F.col("importance")).alias("neg"), F.col(id).alias("entry"))

    def leaders(source: DataFrame) -> Column:
        cut = source.orderBy(F.desc("importance"), F.asc(id)).limit(k)
        return cut.agg(F.array_sort(F.collect_list(best))).scalar()

    backfill = (
        asked.select(
            "query_id",
            F.explode(F.when(F.col("n_query") > 0, leaders(sets.filter("n_entry > 0"))).otherwise(leaders(sets))).alias("b"),
            F.when(F.col("n_query") > 0, 0.4).otherwise(1.0).alias("factor"),
        ).select("query_id", F.col("b.entry").alias(id), (-F.col("b.neg") * F.col("factor")).alias("score"))
    )
    merged = common.unionByName(backfill).groupBy("query_id", id).agg(F.max("score").alias("score")).filter("score > 0")
    return top_k(merged, ["query_id"], [F.desc(F.round("score", 9)), F.asc(id)], k)
