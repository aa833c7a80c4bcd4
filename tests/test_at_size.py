"""What a step holds or sends must not grow with the texts or the batch beside it."""

from __future__ import annotations

import weakref

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from corpusmill.functions import splitting
from corpusmill.functions import text as T
from corpusmill.functions.rule_packs import EN
from corpusmill.operators import lexical, postings, review
from corpusmill.plans import search


class Chunks(list):
    """A list that can be counted while it lives."""


def test_chunks_of_a_batch_are_python_objects_for_a_few_texts_only():
    held, most = [], 0

    def split(text, size, overlap):
        nonlocal most
        found = Chunks(splitting.split_text(text, size, overlap))
        held.append(weakref.ref(found))
        most = max(most, sum(r() is not None for r in held))
        return found

    texts = ["aa bb cc" if i % 3 else None for i in range(1000)]
    got = splitting._in_slices(split, pa.array(texts), pa.array([4] * 1000), pa.array([0] * 1000))
    assert got.to_pylist() == [None if t is None else ["aa", "bb", "cc"] for t in texts]
    assert most <= splitting.SLICE


def test_enqueue_reviews_deals_out_previews_and_no_texts(spark):
    requests = spark.range(4).selectExpr(
        "id as query_id", "id as session_id", "'a' as answer", "timestamp'2024-01-01 00:00:00' as created_at", "id = 3 as quality_passed",
        "false as needs_human_review", "'low' as safety_risk_level", "1D as faithfulness", "1D as answer_relevancy", "1D as context_precision",
    )
    hits = spark.range(12).selectExpr("id % 4 as query_id", "id div 4 + 1 as rank", "concat(id, repeat('x', 400)) as text", "0.5D as score", "string(null) as source")
    queue = review.enqueue_reviews(requests, hits, docs=2)
    plan = queue._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line]
    assert grouped and not any("substring" in line or "text" in line for line in grouped)
    shown = {r.query_id: [(p["rank"], p.content, p.source) for p in r.retrieved_docs_preview] for r in queue.collect()}
    assert shown == {q: [(k + 1, f"{4 * k + q}" + "x" * (300 - len(f"{4 * k + q}")), "") for k in range(2)] for q in range(3)}


def test_postings_are_counted_without_a_shuffle_or_a_table_of_terms(spark):
    chunks = spark.createDataFrame([(1, "b a B c"), (2, None), (3, "--"), (4, "a")], "chunk_id long, text string")
    found = lexical.build_postings(chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert sorted((r.chunk_id, r.term, r.tf, r.doc_length) for r in found.collect()) == [(1, "a", 1, 4), (1, "b", 2, 4), (1, "c", 1, 4), (4, "a", 1, 1)]
    assert found.columns == ["chunk_id", "doc_length", "term", "tf"]


def test_overlaps_of_few_queries_are_cut_in_the_tasks(spark, monkeypatch):
    entries = spark.range(400).selectExpr(
        "id as entry_id", "nullif(concat_ws(' ', 'w' || id % 7, 'w' || id % 11, 'w' || id % 13, 'all'), 'w0 w0 w0 all') as content",
        "case when id % 50 <> 3 then id % 10 / 10D end as importance",
    )
    queries = spark.createDataFrame([(1, "w1 w2 all"), (2, ""), (3, "w5 w5 w6"), (4, "none")], "query_id long, query string")
    monkeypatch.setattr(lexical, "ENTRY_ROWS", 16, raising=False)
    few = lexical.jaccard_topk(queries, entries, 4)
    assert "explode" not in few.filter("score > 0")._jdf.queryExecution().optimizedPlan().toString().replace("explode(CASE", "")
    got = sorted((r.query_id, r["rank"], r.entry_id, round(r.score, 9)) for r in few.collect())
    monkeypatch.setattr(lexical, "BROADCAST_QUERIES", 0)
    assert got == sorted((r.query_id, r["rank"], r.entry_id, round(r.score, 9)) for r in lexical.jaccard_topk(queries, entries, 4).collect())
    assert len(got) == 16


def test_scopes_are_searched_once_and_only_if_asked_for(spark, monkeypatch):
    scopes = spark.createDataFrame(
        [(1, "s", None, ["b", "a"]), (2, "s", None, ["a", "b", "a"]), (3, None, [1, 2], None), (4, "t", None, None), (5, "u", None, None)],
        "scope_id long, session_id string, document_ids array<long>, sources array<string>",
    )
    queries = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 9), (5, None)], "query_id long, scope_id long")
    named, kept = lexical.shared_scopes(queries, scopes)
    assert named.columns == queries.columns
    assert {r.query_id: r.scope_id for r in named.collect()} == {1: 1, 2: 1, 3: 3, 4: 9, 5: None}
    assert sorted(r.scope_id for r in kept.collect()) == [1, 3]

    chunks = spark.range(60).selectExpr(
        "id as chunk_id", "concat('word w', id % 7, ' w', id % 5, repeat(' pad', cast(id % 4 as int))) as text", "if(id % 2 = 0, 's', 't') as session_id",
        "id as document_id", "if(id % 3 = 0, 'a', 'c') as source", "if(id % 4 < 2, 'section', 'heading') as element_type",
    )
    vectors = spark.range(60).selectExpr("id as chunk_id", "array(id / 60D, 1D) as vector")
    asked = spark.range(8).selectExpr(
        "id as query_id", "if(id < 6, id, null) as scope_id", "concat(if(id % 2 = 0, 'list all of ', ''), 'w', id % 7, ' word') as query", "array(id / 8D, 1D) as vector"
    )
    built, build = [], search.build_block_postings
    monkeypatch.setattr(search, "build_block_postings", lambda *a, **k: built.append(1) or build(*a, **k))
    monkeypatch.setattr(lexical, "build_block_postings", lambda *a, **k: built.append(1) or build(*a, **k))
    hits = search.single_step(asked, search.Index(chunks, vectors), scopes, pack=EN).collect()
    assert len(built) == 1
    inside = {1: lambda c: c % 6 == 0, 2: lambda c: c % 6 == 0, 3: lambda c: c in (1, 2), 4: lambda c: c % 2 == 1, 5: lambda c: False}
    assert {h.query_id for h in hits} == {1, 2, 3, 4, 6, 7}
    assert all(inside.get(h.query_id, lambda c: True)(h.chunk_id) for h in hits)
    # headings first, all of one length, so by id
    assert [h.chunk_id for h in sorted(hits, key=lambda h: h["rank"]) if h.query_id == 4 and h.match_type == "keyword"][:2] == [3, 7]


def test_rows_of_an_unfinished_shard_do_not_hold_their_batch():
    whole = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["word " * 50, None] * 1000)], ["id", "tokens"])
    pieces = list(postings._pieces(whole))
    assert pa.Table.from_batches(pieces).to_pylist() == whole.to_pylist()
    assert max(len(p) for p in pieces) <= postings.PIECE_ROWS < len(whole)
    assert all(p.get_total_buffer_size() < whole.get_total_buffer_size() / 2 for p in pieces)


@pytest.mark.parametrize("group, cells", [(128, 2_000_000), (3, 2_000_000), (128, 900)])
def test_a_block_is_scored_once_for_many_queries(spark, monkeypatch, group, cells):
    monkeypatch.setattr(postings, "GROUP_QUERIES", group, raising=False)
    monkeypatch.setattr(postings, "GROUP_CELLS", cells, raising=False)
    # every text three times, some empty
    texts = ["" if i % 50 == 0 else f"all w{i % 7} w{i % 5} " + "x y " * (i % 11) for i in range(100)] * 3
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    kept = postings.build_block_postings(chunks.coalesce(1), block_docs=4)
    shard = postings.Shard(kept.docs.unionByName(kept.terms, allowMissingColumns=True).toArrow())
    asked = [{}, {"none": 1.0}, {"x": -1.0, "all": 0.5}] + [{"w": 0.3, "all": 0.1 + i / 100, "x": 1.5, "y": 0.7 / (i + 1), "5": 2.0, "3": -0.2} for i in range(60)]
    words = [(t or "").replace("w", "w ").split() for t in texts]
    want = []
    for terms in asked:
        scores = [sum(w * postings.part_score(d.count(t), len(d), 12.0) for t, w in terms.items() if t in d) for d in words]
        want.append([(i, round(scores[i], 9)) for i in sorted(range(len(texts)), key=lambda i: (-round(scores[i], 9), i)) if scores[i] > 0][:10])
    calls, part = [], postings.part_score
    monkeypatch.setattr(postings, "part_score", lambda *a: calls.append(1) or part(*a))
    found = shard.best(asked, 12.0, 10)
    assert [[(i, round(s, 9)) for i, s in zip(np.asarray(shard.ids)[n].tolist(), scores, strict=True)] for n, scores, _, _ in found] == want
    assert all(scored <= held for _, _, held, scored in found) and sum(x[3] for x in found) < sum(x[2] for x in found)
    if (group, cells) == (128, 2_000_000):
        # at most twice for a block, and once for each query's best and all bounds
        assert len(calls) <= 2 * shard.n_blocks + len(asked) + 1 < len(asked) * 6
    odd = np.arange(len(shard.lengths)) % 2 == 1
    for (number, scores, _, _), (every, best, _, _) in zip(shard.best(asked, 12.0, 5, odd), shard.best(asked, 12.0, 1000), strict=True):
        inside = odd[every]
        assert np.array_equal(number, every[inside][:5]) and np.array_equal(scores, best[inside][:5])


def test_tokens_of_a_shard_are_found_on_bytes(spark):
    odd = "ab Z09-.é中文\u4e00\u9fff\u4dff\ua000\uf900\U00020000😀\n\x00K\u0130ÀſΣ"
    texts = [None, "", "...", "a1b2中国3c", "\u4dffa", "\u9fff", "é"] + ["".join(odd[(i * i + 7 * j * (i % 5 + 1)) % len(odd)] for j in range(i % 40)) for i in range(600)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    rows = chunks.select(F.lower("text").alias("lowered"), T.tokenize(F.col("text")).alias("tokens")).toArrow()
    lowered, want = rows.column(0).combine_chunks(), [x or [] for x in rows.column(1).to_pylist()]
    assert postings._tokens(lowered).to_pylist() == want
    assert postings._tokens(lowered.slice(5, 100)).to_pylist() == want[5:105]
    assert postings._tokens(lowered.slice(0, 0)).to_pylist() == []
    plain = {tuple(r) for r in lexical.build_postings(chunks).select("chunk_id", "term", "tf", "doc_length").collect()}
    assert {tuple(r) for r in postings.build_block_postings(chunks, shard_tokens=700).rows().collect()} == plain
