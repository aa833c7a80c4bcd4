from hypothesis import given, settings
from hypothesis import strategies as hs

import pyarrow as pa

from corpusmill.functions.splitting import SEPARATORS, split_protected, split_text
from corpusmill.operators import chunking as ch
from corpusmill.plans.ingest import ingest


def test_split_prefers_the_first_separator():
    assert split_text("aaaa\n\nbbbb\n\ncccc", 11, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert split_text("one two three four", 9, 0) == ["one two", "three", "four"]
    assert split_text("abcdefghij", 4, 1, ("",)) == ["abcd", "defg", "ghij"]


def test_split_overlap():
    assert split_text("a b c d e f", 5, 2) == ["a b c", "c d", "d e", "e f"]


@settings(max_examples=80, deadline=None)
@given(hs.text(alphabet="ab \n。，", max_size=200), hs.integers(3, 40))
def test_chunks_cover_the_text(text, size):
    chunks = split_text(text, size, 0, SEPARATORS)
    assert all(len(c) <= size for c in chunks)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(chunks)) == squeeze(text)


def test_protected_blocks_stay_whole():
    text = "intro " * 20 + "\n```\n" + "code line\n" * 10 + "```\n| a | b |\n| 1 | 2 |\n" + "- item one\n- item two\n" + "tail " * 20
    chunks = split_protected(text, 60, 0)
    joined = "\n".join(chunks)
    assert "```\n" + "code line\n" * 10 + "```" in joined
    assert any("| a | b |\n| 1 | 2 |" in c for c in chunks) and any("- item one\n- item two" in c for c in chunks)
    assert "_BLOCK_" not in joined


def test_merge_small_chunks(spark):
    rows = [(1, i, "x" * n, {"k": str(i), f"only{i}": "v"}) for i, n in enumerate((50, 120, 30, 30, 200))]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, metadata map<string,string>")
    got = ch.merge_small_chunks(df).orderBy("group_no").collect()
    assert [r["merged"] for r in got] == [1, 3, 1]
    assert got[1]["text"] == "x" * 120 + "\n" + "x" * 30 + "\n" + "x" * 30
    assert got[1]["metadata"] == {"k": "1", "only1": "v", "only2": "v", "only3": "v"}


def test_markdown_sections_respect_fences(spark):
    text = "# A\ntext\n```\n# not a header\n```\n## B\nmore\n# C\nend"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["heading_path"], r["text"]) for r in ch.chunk_markdown(df).orderBy("section_no").collect()]
    assert got == [("A", "# A\ntext\n```\n# not a header\n```"), ("A > B", "## B\nmore"), ("C", "# C\nend")]


def test_auto_chunk_outline_first_and_whole(spark):
    text = "Notes:\n" + "word " * 400 + "\n- a\n- b"
    df = spark.createDataFrame([(7, text, "f/notes.txt", ".txt")], "doc_id long, text string, source string, file_type string")
    got = ch.auto_chunk(df).orderBy("structure_order", "chunk_part").collect()
    assert got[0]["element_type"] == "outline" and "source: notes.txt" in got[0]["text"]
    assert [r["element_type"] for r in got if r["element_type"] != "section"] == ["outline", "heading", "list"]
    assert sum(r["element_type"] == "section" for r in got) > 1
    assert all(len(r["text"]) <= r["target_chars"] for r in got if r["element_type"] == "section")


def test_semantic_keeps_every_sentence(spark):
    text = "Cats purr softly at night. Cats sleep all day long. Stocks fell on Monday morning. Markets were calm after."
    df = spark.createDataFrame([(1, text), (2, "Only one sentence here.")], "doc_id long, text string")
    got = ch.chunk_semantic(df, min_size=10).orderBy("doc_id", "chunk_index").collect()
    assert " ".join(r["text"] for r in got if r["doc_id"] == 1) == text
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["Only one sentence here."]


def test_semantic_keeps_columns_and_cuts_alike_in_any_batch(spark):
    text = "Cats purr softly at night. Cats sleep all day long. Stocks fell on Monday morning. Markets were calm after."
    rows = [(i, f"{text} Document {i} ends. {text}", f"s{i}", None if i else "x") for i in range(6)] + [(9, "", "s9", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, session_id string, source string")
    together = ch.chunk_semantic(df, min_size=10)
    assert together.columns == ["doc_id", "session_id", "source", "chunk_index", "text"]
    alone = ch.chunk_semantic(df.filter("doc_id = 3"), min_size=10).collect()
    assert len(alone) > 1 and sorted(alone) == sorted(together.filter("doc_id = 3").collect())
    assert {(r.doc_id, r.session_id, r.source) for r in together.collect()} == {r[:1] + r[2:] for r in rows if r[1]}


def test_ingest_with_semantic_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "One sentence. Another sentence.", "a", "f.txt"), (2, "", "a", "g.txt")], "doc_id long, text string, session_id string, source string")
    got = {r.document_id: (r.raw, r.indexed) for r in ingest(df, str(tmp_path / "index"), "semantic").collect()}
    assert got["2"] == (1, 0) and got["1"][1] >= 1


def test_auto_chunk_reads_markdown_by_file_type(spark):
    text = "# Title\n```python\nx = 1\n```\n## Two\nSome words here."
    rows = [(1, text, "a.md", ".md"), (2, text, "b.txt", ".txt"), (3, text, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, file_type string")
    got = ch.auto_chunk(df).orderBy("doc_id", "structure_order", "chunk_part").collect()
    by = lambda i, kind: [r["text"] for r in got if r["doc_id"] == i and r["element_type"] == kind]
    assert by(1, "heading") == ["Title", "Two"] and len(by(1, "code")) == 1 and "x = 1" in by(1, "code")[0]
    assert {r["section_path"] for r in got if r["doc_id"] == 1 and r["element_type"] == "section"} == {"Title > Two"}
    assert not by(2, "code") and not by(3, "code") and "Title" not in by(2, "heading")
    whole = ch.auto_chunk(df.filter("doc_id = 1"), markdown=True).orderBy("structure_order", "chunk_part").collect()
    assert whole == [r for r in got if r["doc_id"] == 1]


def test_semantic_chunks_stay_in_their_rows(spark, monkeypatch):
    """Gaps are those of hashed vectors of the contexts, to the last bit; no sentence or vector is shuffled."""
    from pyspark.sql import functions as F

    from corpusmill.functions import vectors
    from corpusmill.operators.dense import featurize

    monkeypatch.setattr(vectors, "SENTENCES", 3, raising=False)
    lists = [["a bb ccc dddd eeeee", "bb 12345678 中 文", "", "a a a zzzzzzzzz"], [], ["only one"], None, ["", ""], ["x y", "x y", "y z", "zz bb", "a"]]
    got = vectors.sentence_gaps(pa.array(lists, pa.list_(pa.string())), 128).to_pylist()
    rows = []
    for d, s in enumerate(lists):
        rows += [(d, i, " ".join(s[max(0, i - 1) : i + 2])) for i in range(len(s or []))]
    vectored = featurize(spark.createDataFrame(rows, "d int, i int, text string"), 128, idf=False).select("d", "i", "vector")
    following = vectored.select("d", (F.col("i") - 1).alias("i"), F.col("vector").alias("next"))
    pairs = vectored.join(following, ["d", "i"]).select("d", "i", (1 - vectors.cosine(F.col("vector"), F.col("next"))).alias("gap"))
    want = {(r.d, r.i): r.gap for r in pairs.collect()}
    assert got == [None if s is None else [want.get((d, i)) for i in range(len(s))] for d, s in enumerate(lists)] and len(want) == 8
    df = spark.createDataFrame([(1, "Cats purr. Dogs bark. Stocks fell."), (2, None)], "doc_id long, text string")
    plan = ch.chunk_semantic(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
