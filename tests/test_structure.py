from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import structure as st

MARKDOWN = """# Guide
Intro line
## Setup:
- one
- two
### Parts:
| a | b |
|---|---|
| 1 | 2 |
```python
x = {1}
```
## End
last words"""


def elements(spark, text, markdown=False):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = st.extract_elements(df, markdown=markdown).orderBy("element_order").collect()
    return [(r["element_type"], r["text"], r["section_path"], r["heading_level"]) for r in rows]


def test_markdown_elements_and_paths(spark):
    got = elements(spark, MARKDOWN, True)
    assert [e[0] for e in got] == ["heading", "section", "heading", "list", "heading", "table", "heading", "section", "code"]
    assert got[2][1:] == ("Setup:", "Guide > Setup:", 2)
    # a colon heading under a colon heading keeps its level, so it replaces it in the path
    assert got[4][1:] == ("Parts:", "Guide > Parts:", 2)
    assert got[1][1] == "Guide\nIntro line"
    assert got[8][1] == "```python\nx = {1}\n```"


def test_heading_edges(spark):
    lines = ["1. x", "1.1 x", "第一章 总则", "2020.01 - 2021.02 work", "Acme Corp", "2019/03-至今", "技能清单", "plain text."]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    rows = {r["line"]: (r["line_class"], r["heading_level"]) for r in st.classify_lines(df).collect()}
    assert rows["1. x"] == ("bullet", None)
    assert rows["1.1 x"] == ("heading", 2)
    assert rows["第一章总则"] == ("heading", 1)
    assert rows["2020.01 - 2021.02 work"][0] == "text"
    assert rows["Acme Corp"] == ("heading", 2)  # a date range follows
    assert rows["技能清单"] == ("heading", 1)
    assert rows["plain text."][0] == "text"


def test_table_run_keeps_its_lines_and_lone_comma_row_is_text(spark):
    got = elements(spark, "before\na, b, c, d\nafter\n1.1 a, b, c, d\n| x | y |\n1.2 p, q, r, s")
    # the lone comma row starts a new text; inside a table run a heading-like row stays in the run
    assert [e[:2] for e in got] == [
        ("paragraph", "before"), ("paragraph", "a, b, c, d\nafter"), ("heading", "1.1 a, b, c, d"),
        ("table", "| x | y |\n1.2 p, q, r, s"),
    ]


def test_normalize_cjk(spark):
    df = spark.createDataFrame([("中 文 字 符 ， 好\r\nab  cd\t e f",)], "t string")
    assert df.select(T.normalize_text(F.col("t"))).first()[0] == "中文字符， 好\nab cd e f"


def test_plan_rounds_half_even(spark):
    row = dict(file_type=".txt", estimated_tokens=2000, avg_paragraph_tokens=30.0, heading_count=0,
               table_like_ratio=0.0, code_like_ratio=0.0)
    plan = st.infer_chunk_plan(spark.createDataFrame([row])).first()
    assert plan["target_tokens"] == 497 and plan["overlap_tokens"] == 56 and plan["target_chars"] == 994
    assert plan["reason"] == "base=txt_paragraph, medium_document_smaller_chunks, short_paragraphs"


def test_profile_table_types(spark):
    rows = [(str(i), "1,000" if i % 2 else "7", f"2024-01-{i + 1:02d}", "ab"[i % 2], "") for i in range(10)]
    got = {r["column_name"]: r for r in st.profile_table(spark.createDataFrame(rows, ["id", "n", "d", "c", "e"])).collect()}
    assert {k: v["column_type"] for k, v in got.items()} == {
        "id": "numeric", "n": "numeric", "d": "date", "c": "categorical", "e": "empty"
    }
    assert got["n"]["max_value"] == 1000 and got["c"]["top_values"] == "a(5); b(5)" and got["e"]["missing"] == 10


def test_spans(spark):
    rows = [(1, 1, 0, "Title", 20.0, False, None), (1, 1, 1, "body one", 10.0, False, None), (1, 2, 2, "Part", 12.0, False, None),
            (1, 2, 3, "body two", 10.0, False, None), (1, 3, 4, "Styled", 10.0, False, "Heading 2"), (1, 3, 5, "end", 10.0, False, None)]
    spans = spark.createDataFrame(rows, "doc_id long, page int, pos int, text string, size double, bold boolean, style string")
    got = [(r["heading_path"], r["page"], r["text"]) for r in st.sections_from_spans(spans).orderBy("section_no").collect()]
    assert got == [("Title", 1, "Title\nbody one"), ("Title > Part", 2, "Part\nbody two"), ("Title > Styled", 3, "Styled\nend")]


def test_lines_meet_only_the_patterns_that_can_change_them(spark):
    """No pattern that matches every character, no level for lines that are no headings, no work on CJK gaps without CJK."""
    texts = ["1.2 Title\nplain words  here\t x y\x00\r\nlast:\rend ", "第一章 背景\n你 好 ， 世界  a  （ 你", " \t\n\r\x0b\f", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels = [(f.h, f.level) for r in st._flagged(df, "text", False).collect() for f in r["__lines"]]
    assert any(h for h, _ in levels) and all((level is not None) == h for h, level in levels)
    got = [r.x for r in df.orderBy("doc_id").select(T.lines_of(F.col("text")).alias("x")).collect()]
    assert got == [["1.2 Title", "plain words here x y", "last:", "end"], ["第一章背景", "你好， 世界 a （你"], [], [], []]
    counts = df.orderBy("doc_id").select(T.count_cjk(F.col("text")), T.is_blank(F.coalesce("text", F.lit("")))).collect()
    assert [tuple(r) for r in counts] == [(0, False), (10, False), (0, True), (0, True), (None, True)]
    plan = st.parse_quality(df)._jdf.queryExecution().optimizedPlan().toString()
    assert f"[^{T.CJK}]" not in plan and "translate(" not in plan
