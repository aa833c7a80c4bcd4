import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.functions.rule_packs import EN, ZH
from corpusmill.operators import ann, dense, fusion, lexical, postings, routing
from corpusmill.plans import search
from corpusmill.sources.index import index_append, index_read

DOCS = ["the cat sat", "the dog sat", "the bird flew", "the the cat cat cat", "中文 检索 系统", ""]


def okapi(query, docs, tokens):
    """Plain reading of the scoring rule."""
    bags = [Counter(tokens(d)) for d in docs]
    n, mean = len(docs), sum(sum(b.values()) for b in bags) / len(docs)
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for b in bags:
        length = sum(b.values())
        out.append(sum((floor if idf[t] < 0 else idf[t]) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * length / mean))
                       for t in tokens(query) if t in idf))
    return out


def tokens(text):
    import re

    return re.findall(r"[一-鿿]|[a-z]+|[0-9]+", text.lower())


def tables(spark, docs, asked):
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    return queries, chunks


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_bm25_matches_the_rule(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST_QUERIES", broadcast)  # 0 forces the salted join
    asked = ["the cat", "cat cat dog", "", "unknown", "检索", "the"]
    queries, chunks = tables(spark, DOCS, asked)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.bm25_topk(queries, chunks).collect()}
    want = {}
    for q, text in enumerate(asked):
        for d, score in enumerate(okapi(text, DOCS, tokens)):
            if score > 0:
                want[q, d] = score
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def prose(seed, n, words=60):
    """Texts over a skewed vocabulary; some are null, empty or long."""
    r = random.Random(seed)
    word = lambda: "w" + "abcdefghij"[min(9, int(r.expovariate(0.4)))] * r.randrange(1, 6)
    texts = [" ".join(word() for _ in range(r.randrange(1, words))) for _ in range(n)]
    return texts + [None, "", "...", " ".join(word() for _ in range(900))]


@pytest.mark.parametrize("docs, tokens_held, block", [(16_384, 4_000_000, 128), (80, 4_000_000, 4), (16_384, 2000, 4)])
def test_block_postings_skip_blocks_and_lose_nothing(spark, docs, tokens_held, block):
    texts = prose(1, 400)
    queries, chunks = tables(spark, texts, ["waaaa wjjjj", "wb wcc wddd wb", "wzz", "wjj", "", "wa wb wc wd we wf wg"])
    kept = postings.build_block_postings(chunks, shard_docs=docs, shard_tokens=tokens_held, block_docs=block)
    plain = {tuple(r) for r in lexical.build_postings(chunks).select("chunk_id", "term", "tf", "doc_length").collect()}
    assert {tuple(r) for r in kept.rows().collect()} == plain
    # the bound on a block holds for each of its documents and any mean length
    lengths = {r.shard: postings.ints(r.lengths) for r in kept.docs.collect()}
    for r in kept.terms.collect():
        numbers, tfs, blocks, max_tf, min_length = (postings.ints(r[c]).tolist() for c in ("numbers", "tfs", "blocks", "max_tf", "min_length"))
        assert (r.df, r.cf) == (len(tfs), sum(tfs))
        for number, tf in zip(numbers, tfs):
            i = blocks.index(number // block)
            for mean in (1.0, 30.0, 1e4):
                assert postings.part_score(tf, lengths[r.shard][number], mean) <= postings.part_score(max_tf[i], min_length[i], mean)
    for k in (1, 5, 1000):
        want = {}
        for q, text in enumerate(r.query for r in queries.orderBy("query_id").collect()):
            scores = sorted((-round(s, 9), d) for d, s in enumerate(okapi(text, [t or "" for t in texts], tokens)) if round(s, 12) > 0)
            want |= {(q, d): (i, -s) for i, (s, d) in enumerate(scores[:k], 1)}
        got = {(r.query_id, r.chunk_id): (r["rank"], round(r.score, 9)) for r in lexical.bm25_topk(queries, chunks, k, postings=kept).collect()}
        assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key]) for key in got)
    if block < 128:
        blocks = lexical.bm25_blocks(queries, chunks, 1, "chunk_id", "text", kept).agg(F.sum("held"), F.sum("scored")).first()
        assert blocks[1] < 0.9 * blocks[0]
    assert lexical.bm25_topk(queries, chunks.limit(0)).count() == 0 == lexical.bm25_topk(queries.limit(0), chunks, postings=kept).count()


def test_postings_are_made_once_for_each_generation(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, t, "s", f"d{i}", "a") for i, t in enumerate(DOCS)]
    schema = "chunk_id long, text string, session_id string, document_id string, source string"
    index_append(spark.createDataFrame(rows[:3], schema), path)
    first = postings.index_postings(spark, path)
    stored = sorted(os.listdir(tmp_path / "index" / "postings" / "generation-1"))
    again = postings.index_postings(spark, path)
    assert sorted(os.listdir(tmp_path / "index" / "postings" / "generation-1")) == stored
    assert {tuple(r) for r in again.rows().collect()} == {tuple(r) for r in first.rows().collect()}
    index_append(spark.createDataFrame(rows[3:], schema), path)
    queries = spark.createDataFrame([("q", "the cat 检索")], "query_id string, query string")
    live = index_read(spark, path)
    newer = postings.index_postings(spark, path)
    got = {r.chunk_id: round(r.score, 9) for r in lexical.bm25_topk(queries, live, postings=newer).collect()}
    assert got == {d: round(s, 9) for d, s in enumerate(okapi("the cat 检索", DOCS, tokens)) if s > 0}
    assert sorted(os.listdir(tmp_path / "index" / "postings")) == ["generation-1", "generation-2"]


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_scoped_bm25_over_small_shards(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST_QUERIES", broadcast)
    texts = prose(2, 150)
    rows = [(i, t, f"s{i % 3}", f"d{i}", "ab"[i % 2]) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, session_id string, document_id string, source string")
    scopes = spark.createDataFrame([(0, "s0", None, None), (1, None, None, ["b"]), (2, "s0", None, None), (3, "none", None, None)],
                                   "scope_id long, session_id string, document_ids array<string>, sources array<string>")
    asked = ["wjj waaaa", "wb wcc wddd wb", "wa wjjjj", "wa"]
    queries = spark.createDataFrame([(i, q, i) for i, q in enumerate(asked)], "query_id long, query string, scope_id long")
    inside = {0: [i for i in range(len(texts)) if i % 3 == 0], 1: [i for i in range(len(texts)) if i % 2], 3: []}
    inside[2] = inside[0]
    want = {}
    for q, docs in inside.items():
        scores = okapi(asked[q], [texts[d] or "" for d in docs], tokens) if docs else []
        want |= {(q, d): round(s, 7) for s, d in sorted(((-round(s, 9), d) for d, s in zip(docs, scores) if round(s, 12) > 0))[:3] for s in (-s,)}
    kept = postings.build_block_postings(chunks, shard_docs=40, block_docs=4)
    got = {(r.query_id, r.chunk_id): round(r.score, 7) for r in lexical.bm25_topk_scoped(queries, scopes, chunks, 3, postings=kept).collect()}
    assert got == want


def test_scoped_bm25_never_leaves_its_scope(spark):
    rows = [(i, d, f"s{i % 2}", f"d{i}", "a" if i < 3 else "b") for i, d in enumerate(DOCS)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, session_id string, document_id string, source string")
    scopes = spark.createDataFrame(
        [(0, "s0", None, None), (1, "", ["d1", "d2"], []), (2, "s1", [], ["zz"]), (3, None, None, ["a"])],
        "scope_id long, session_id string, document_ids array<string>, sources array<string>",
    )
    queries = spark.createDataFrame([(i, "the cat sat", i) for i in range(4)], "query_id long, query string, scope_id long")
    got = lexical.bm25_topk_scoped(queries, scopes, chunks).collect()
    members = {0: {0, 2, 4}, 1: {1, 2}, 2: set(), 3: {0, 1, 2}}
    for q, inside in members.items():
        docs = sorted(inside)
        want = okapi("the cat sat", [DOCS[d] for d in docs], tokens) if docs else []
        positive = {d: s for d, s in zip(docs, want) if s > 0}
        found = {r["chunk_id"]: r["score"] for r in got if r["query_id"] == q}
        assert found.keys() == positive.keys()
        assert all(abs(found[d] - positive[d]) < 1e-9 for d in found)


def test_jaccard_backfills_by_importance(spark):
    entries = spark.createDataFrame(
        [(1, "alpha beta", 0.1), (2, "gamma", 0.9), (3, "delta", 0.8), (4, "alpha", 0.0), (5, "x", 1.0)],
        "entry_id long, content string, importance double",
    )
    queries = spark.createDataFrame([(1, "alpha"), (2, "")], "query_id long, query string")
    got = lexical.jaccard_topk(queries, entries, 3).orderBy("query_id", "rank").collect()
    assert [r["entry_id"] for r in got if r["query_id"] == 1] == [4, 2, 1]
    assert [r["entry_id"] for r in got if r["query_id"] == 2] == [5, 2, 3]  # empty query: by importance


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [1024, 4])
def test_nearest_is_exact_in_blocks(spark, monkeypatch, metric, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 8)), rng.normal(size=(10, 8))
    v[7] = 0
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, vector array<double>")
    got = V.nearest(queries, vectors, 5, "chunk_id", metric).orderBy("query_id", "rank").collect()
    for i in range(10):
        if metric == "l2":
            sims = 1 / (1 + ((v - q[i]) ** 2).sum(1))
        else:
            norms = np.linalg.norm(v, axis=1) * np.linalg.norm(q[i])
            sims = np.where(norms == 0, 0, (v @ q[i]) / np.where(norms == 0, 1, norms))
        want = sorted(range(60), key=lambda d: (-round(sims[d], 9), d))[:5]
        assert [r["chunk_id"] for r in got if r["query_id"] == i] == want


@pytest.mark.parametrize("stripe", [4096, 5])
def test_nearest_of_rows_of_the_same_table_in_blocks(spark, monkeypatch, stripe):
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(V, "STRIPE", stripe, raising=False)
    vectors = spark.range(60).selectExpr("id as chunk_id", "array(double(id), 0D) as vector")
    asked = vectors.filter("chunk_id % 6 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in V.nearest(asked, vectors, 2, "chunk_id").collect()}
    assert got == {(q, k): q if k == 1 else max(q - 1, 1 if q == 0 else 0) for q in range(0, 60, 6) for k in (1, 2)}
    scoped = V.nearest_scoped(asked.selectExpr("*", "1 as scope_id"), vectors.selectExpr("*", "1 as scope_id"), 2, "chunk_id")
    assert got == {(r.query_id, r["rank"]): r.chunk_id for r in scoped.collect()}


def test_nearest_scoped(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(i, i % 2, rows[i][1]) for i in range(6)], "query_id long, scope_id long, vector array<double>")
    members = vectors.withColumn("scope_id", F.col("chunk_id") % 2)
    got = V.nearest_scoped(queries, members, 3, "chunk_id").collect()
    assert all(r["chunk_id"] % 2 == r["query_id"] % 2 for r in got) and len(got) == 18
    exact = {(r["query_id"], r["chunk_id"]) for r in dense.dense_topk(queries, vectors, 5).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in ann.ann_topk(queries, vectors, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def neighbours(seed, n, clusters=None, dims=13):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    return x if clusters is None else 3 * r.normal(size=(clusters, dims))[np.arange(n) % clusters] + x


def vector_table(spark, x, name="chunk_id", first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")


@pytest.mark.parametrize("clusters, block", [(None, 1024), (20, 1024), (20, 16)])
def test_ann_finds_nine_tenths_from_a_fifth_of_the_vectors(spark, monkeypatch, tmp_path, clusters, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    x = neighbours(1, 1500, clusters)
    vectors, queries = vector_table(spark, x), vector_table(spark, x[:40] + 0.05, "query_id")
    ann.build_ann_index(vectors, str(tmp_path / "ann"))
    index = ann.read_ann_index(spark, str(tmp_path / "ann"))
    assert index.codes.count() == 1500 and index.codes.select("chunk_id").distinct().count() == 1500
    exact = dense.dense_topk(queries, vectors, 10)
    for probe, keep in ((ann.PROBE, 150), (len(index.model.centres), 300)):
        pairs = ann.ann_candidates(queries, index, keep, probe=probe)
        assert pairs.count() == pairs.distinct().count() <= 40 * keep <= 40 * 1500 / 5
        found = ann.ann_topk(queries, vectors, 10, index=index, probe=probe, rescore=keep)
        recall = ann.ann_recall(found, exact).agg(F.avg("recall")).first()[0]
        assert recall >= 0.9
    want = {(r.query_id, r.chunk_id): round(r.score, 6) for r in exact.collect()}
    assert all(want[key] == round(r.score, 6) for r in found.collect() if (key := (r.query_id, r.chunk_id)) in want)


def test_ann_with_few_null_and_equal_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [9.0, 9.0])], "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id long, vector array<float>")
    got = [(r.query_id, r.chunk_id, r["rank"]) for r in ann.ann_topk(queries, vectors, 3).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 3, 2), (1, 4, 3)]
    assert ann.ann_topk(queries, vectors.limit(0), 3).count() == 0 == ann.ann_topk(queries.limit(0), vectors, 3).count()


def test_rrf(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank long")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2), (1, 10, 3)], "query_id long, chunk_id long, rank long")
    got = fusion.rrf_fuse(a, b).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [10, 11, 12]
    assert abs(got[0]["score"] - (1 / 61 + 1 / 63)) < 1e-12
    swapped = fusion.rrf_fuse(b, a).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in swapped] == [(r["chunk_id"], r["score"]) for r in got]
    only = fusion.rrf_fuse(a, b.limit(0)).collect()
    assert len(only) == 2


def test_evidence_moves_behind_the_window(spark):
    hits = spark.createDataFrame(
        [(1, i, i + 1, "plain") for i in range(6)] + [(1, 6, 7, "plain"), (1, 7, 8, "预算 Q1"), (1, 8, 9, "姓名 技能 所属部门 项目")],
        "query_id long, chunk_id long, rank long, text string",
    )
    queries = spark.createDataFrame([(1, True)], "query_id long, is_inference boolean")
    got = fusion.evidence_coverage(hits, queries).orderBy("new_rank").collect()
    assert [r["chunk_id"] for r in got] == [0, 1, 2, 3, 4, 5, 8, 7, 6]


@pytest.mark.parametrize(
    "text, heading, source, found",
    [
        ("姓名 技能 所属部门", None, None, [1, 0, 0]), ("姓名 所属部门", None, None, [0, 0, 0]), ("所属部门 技能 姓名", None, None, [1, 0, 0]),
        ("| 姓名 | 其他 | 职位 |", None, None, [1, 0, 0]), ("姓名 | 职位", None, None, [0, 0, 0]), ("团队成员", None, None, [0, 0, 0]),
        ("x", "一 / 团队成员与职责", None, [1, 0, 0]), ("x", None, "团队成员.md", [1, 0, 0]), ("项目", "预算", None, [0, 1, 0]),
        ("x", None, "项目.md", [0, 1, 0]), ("计划 Q2", None, None, [0, 0, 1]), (None, None, "q1.csv", [0, 0, 1]), (None, None, None, [0, 0, 0]),
    ],
)
def test_each_way_to_show_evidence(spark, text, heading, source, found):
    hits = spark.createDataFrame([(text, heading, source)], "text string, heading_path string, source string")
    got = hits.select(*[fusion.shows(e, hits, "text").cast("int") for e in fusion.EVIDENCE_ZH]).first()
    assert list(got) == found


def test_sufficiency_by_openings_and_accented_words(spark):
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(["décision été", "décision", "什么 décision", "ab cd ef"])], "query_id long, query string")
    same, long = "décision " * 30, "y" * 100
    hits = spark.createDataFrame(
        [(0, 1, 0.9, long + same), (0, 2, 0.1, "z" * 200), (1, 1, 0.9, long + same), (1, 2, 0.9, long + "other " * 40),
         (2, 1, 0.9, same), (2, 2, 0.1, "w" * 90), (3, 1, 0.9, "cision " * 90), (3, 2, 0.9, "ab")],
        "query_id long, chunk_id long, score double, text string",
    )
    got = {r.query_id: r.sufficient for r in fusion.sufficiency(queries, hits).collect()}
    # one of two keywords is covered; two chunks with one opening; the question word does not count; one keyword of three
    assert got == {0: True, 1: False, 2: True, 3: False}


def test_chinese_routing(spark):
    asked = [
        "公司总预算和总支出分别是多少？哪个项目剩余预算最多？", "列出所有项目及其所属部门",
        "如果天枢项目 10 月发布前需要紧急加人，谁最有可能被抽调过去帮忙？为什么？", "你好！", "", "对比两个方案",
    ]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    rows = {r["query_id"]: r for r in routing.quick_classify(df, ZH).collect()}
    assert [rows[i]["complexity"] for i in range(6)] == ["medium", "medium", "complex", "simple", "simple", "complex"]
    assert rows[0]["query_type"] == "aggregate" and rows[1]["query_type"] == "low_cost_retrieval" and rows[2]["query_type"] is None
    routed = {r["query_id"]: r["strategy"] for r in routing.route(df, ZH).collect()}
    assert [routed[i] for i in range(6)] == ["single_step", "single_step", "multi_step", "no_retrieval", "no_retrieval", "multi_step"]
    intents = {r["query_id"]: r["query_intent"] for r in routing.query_intent(df, ZH).collect()}
    assert intents[1] == "global_list" and intents[5] == "comparison" and intents[4] == "unknown"


def test_multi_step_and_fallback(spark):
    docs = [(i, t, "s", f"d{i}", "a") for i, t in enumerate(["alpha beta gamma", "delta epsilon", "zeta eta theta", "rare word"])]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string, session_id string, document_id string, source string")
    vectors = spark.createDataFrame([], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(1, "alpha", None), (2, "nothing", None)], "query_id long, query string, vector array<double>")
    rewrites = spark.createDataFrame([(1, ["delta", "alpha", " delta "])], "query_id long, rewrites array<string>")
    fallback = spark.createDataFrame([(2, "rare word"), (1, "zeta")], "query_id long, query string")
    hits = search.multi_step(queries, search.Index(chunks, vectors), rewrites, fallback=fallback, pack=EN).collect()
    assert {r["chunk_id"] for r in hits if r["query_id"] == 1} == {0, 1}
    assert {r["chunk_id"] for r in hits if r["query_id"] == 2} == {3}
    assert [r["rank"] for r in hits if r["query_id"] == 2] == [1]


def test_strategy_registry(spark):
    search.register_strategy("broken", lambda queries, index, **_: queries)
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    with pytest.raises(ValueError):
        search.run_strategy("broken", queries, None)
    with pytest.raises(ValueError):
        search.run_strategy("absent", queries, None)
    search.clear_strategies()
    search.register_defaults()
    assert search.list_strategies() == ["multi_step", "no_retrieval", "single_step"]
