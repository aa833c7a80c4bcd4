"""Document profiles and structure.

One document is one row, so its lines, elements and headings are handled as arrays inside the
row: no operator here shuffles unless its input already comes as many rows per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.functions.arrays import unfold
from corpusmill.functions.skew import table_row_number, top_k

MARKDOWN_TYPES = (".md", ".markdown")

# Base chunk plan per file type (type, strategy, tokens, overlap).
BASE_PLANS = (
    (".pdf", "pdf_structured", 800, 100),
    (".docx", "docx_structured", 750, 90),
    (".doc", "docx_structured", 750, 90),
    (".md", "markdown_enhanced", 650, 70),
    (".markdown", "markdown_enhanced", 650, 70),
    (".txt", "txt_paragraph", 650, 80),
    (".csv", "csv_rows", 1000, 0),
)
DEFAULT_PLAN = ("txt_paragraph", 650, 80)

ELEMENT = (
    "struct<element_type:string,text:string,section_title:string,section_path:string,"
    "heading_level:int,line_count:int>"
)
HEADING_STATE = (
    "struct<stack:array<struct<level:int,title:string>>,"
    "out:array<struct<start:int,title:string,level:int,path:string>>>"
)


# ---- lines and profile ---------------------------------------------------------------------


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Non-empty normalised lines with their position."""
    return unfold(df, [c for c in df.columns if c != text], T.lines_of(F.col(text)), "line_no", "line")


def _looks_like_table(line: Column) -> Column:
    return (T.occurrences(line, "|") >= 2) | (T.occurrences(line, ",") >= 3)


def _ends_with_colon(line: Column) -> Column:
    return line.endswith(":") | line.endswith("：")


def profile_documents(df: DataFrame, text: str = "text", file_type: str = "file_type") -> DataFrame:
    """Size, paragraph, heading, table and code figures; one row per document, no shuffle."""
    raw = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in df.columns if c != text]
    row_count = F.col("row_count").cast("long") if "row_count" in df.columns else F.lit(None).cast("long")
    keep = [c for c in keep if c != "row_count"]
    lined = df.select(
        *keep,
        row_count.alias("row_count"),
        F.length(raw).cast("long").alias("total_chars"),
        F.filter(F.split(raw, r"\r\n|\r|\n"), lambda x: T.strip(x) != "").alias("__raw"),
        F.size(F.filter(F.split(raw, r"\n[ \t\r\n\f]*\n"), lambda x: T.strip(x) != "")).alias("__blocks"),
    ).withColumn("__lines", F.transform("__raw", T.strip))

    def is_heading(x: Column) -> Column:
        chapter = x.startswith("第") & F.substring(x, 1, 16).rlike("章|节|篇|部分")
        return x.startswith("#") | x.rlike(P.PROFILE_NUMBERED) | chapter

    def is_code(raw_line: Column) -> Column:
        x = T.strip(raw_line)
        return (
            raw_line.startswith("    ") | raw_line.startswith("\t") | x.rlike(P.CODE_LINE_START) | x.rlike(P.CODE_LINE_END)
        )

    short_colon = F.size(F.filter("__lines", lambda x: (F.length(x) <= 40) & _ends_with_colon(x)))
    counted = lined.select(
        *keep,
        "row_count",
        "total_chars",
        F.greatest(F.lit(1), F.floor(F.col("total_chars") / 2)).cast("long").alias("estimated_tokens"),
        F.when(F.col("__blocks") <= 1, F.greatest("__blocks", F.size("__lines")))
        .otherwise(F.col("__blocks")).cast("long").alias("paragraph_count"),
        (
            F.size(F.filter("__lines", is_heading))
            + F.when(F.col(file_type).isin(*MARKDOWN_TYPES), F.lit(0)).otherwise(short_colon)
        ).cast("long").alias("heading_count"),
        F.greatest(F.lit(1), F.size("__lines")).alias("__n"),
        F.size(F.filter("__raw", lambda x: _looks_like_table(x) | T.strip(x).contains("\t"))).alias("__tables"),
        F.size(F.filter("__raw", is_code)).alias("__code"),
    )
    return counted.select(
        *keep,
        "row_count",
        "total_chars",
        "estimated_tokens",
        "paragraph_count",
        F.when(F.col("paragraph_count") > 0, F.col("estimated_tokens") / F.col("paragraph_count"))
        .otherwise(F.col("estimated_tokens").cast("double")).alias("avg_paragraph_tokens"),
        "heading_count",
        F.when((F.col(file_type) == ".csv") & (F.col("row_count") > 0), F.lit(1.0))
        .otherwise(F.col("__tables") / F.col("__n")).alias("table_like_ratio"),
        (F.col("__code") / F.col("__n")).alias("code_like_ratio"),
    )


def infer_chunk_plan(profile: DataFrame, file_type: str = "file_type") -> DataFrame:
    """Chunk plan per profiled document: base by type, then scaled by length and structure."""

    def base(pos: int) -> Column:
        out = F.lit(DEFAULT_PLAN[pos - 1])
        for row in BASE_PLANS:
            out = F.when(F.col(file_type) == row[0], F.lit(row[pos])).otherwise(out)
        return out

    tokens = F.col("estimated_tokens")
    short, medium, large = tokens < 800, tokens < 3000, tokens > 50000
    brief, wordy = F.col("avg_paragraph_tokens") < 40, F.col("avg_paragraph_tokens") > 220
    many = F.col("heading_count") >= 10
    tabular = (F.col("table_like_ratio") > 0.2) | (F.col(file_type) == ".csv")
    coded = F.col("code_like_ratio") > 0.15

    size = F.when(short, F.greatest(F.lit(200.0), tokens.cast("double")))
    size = size.when(medium, base(2) * F.lit(0.85)).when(large, base(2) * F.lit(1.2))
    size = size.otherwise(base(2).cast("double"))
    size = F.when(brief, size * 0.9).when(wordy, size * 1.15).otherwise(size)
    size = F.when(many, size * 0.9).otherwise(size)
    size = F.when(coded, F.least(size, F.lit(700.0))).otherwise(size)

    lap = F.when(short, F.lit(0.0)).otherwise(base(3).cast("double"))
    lap = F.when(brief, lap * 0.7).when(wordy, lap * 1.2).otherwise(lap)
    lap = F.when(tabular, F.least(lap, F.lit(40.0))).otherwise(lap)
    lap = F.when(coded, F.least(lap, F.lit(50.0))).otherwise(lap)

    reason = F.concat_ws(
        ", ",
        F.concat(F.lit("base="), base(1)),
        F.when(short, F.lit("short_document_no_overlap"))
        .when(medium, F.lit("medium_document_smaller_chunks"))
        .when(large, F.lit("large_document_larger_chunks")),
        F.when(brief, F.lit("short_paragraphs")).when(wordy, F.lit("long_paragraphs")),
        F.when(many, F.lit("many_headings")),
        F.when(tabular, F.lit("table_heavy")),
        F.when(coded, F.lit("code_heavy")),
    )
    planned = profile.withColumns(
        {
            "strategy": base(1),
            # half-even, as the rule states
            "target_tokens": F.least(F.lit(1200), F.greatest(F.lit(300), F.bround(size, 0))).cast("long"),
            "__lap": F.bround(lap, 0),
            "preserve_tables": tabular,
            "preserve_code_blocks": coded,
            "reason": reason,
        }
    )
    cap = F.least(F.lit(180), F.floor(F.col("target_tokens") * 0.2))
    return planned.withColumns(
        {
            "target_chars": F.greatest(F.lit(400), F.col("target_tokens") * 2).cast("long"),
            "overlap_tokens": F.greatest(F.lit(0), F.least(cap, F.col("__lap"))).cast("long"),
            "min_tokens": F.lit(100).cast("long"),
        }
    ).withColumn("overlap_chars", F.col("overlap_tokens") * 2).drop("__lap")


# ---- headings and line classes -------------------------------------------------------------


def is_markdown(file_type: str = "file_type") -> Column:
    return F.coalesce(F.lower(F.col(file_type)).isin(*MARKDOWN_TYPES), F.lit(False))


def _by_markdown(markdown: bool | Column, yes: Column, no: Column) -> Column:
    """``yes`` where a text is Markdown; ``markdown`` is one flag for all rows, or a column."""
    if isinstance(markdown, Column):
        return F.when(markdown, yes).otherwise(no)
    return yes if markdown else no


def is_heading(line: Column, following: Column, markdown: bool | Column = False) -> Column:
    dated_next = F.coalesce(following.rlike(P.DATE_RANGE), F.lit(False))
    # lengths first: most lines are too long to be headings and meet no pattern
    shape = (
        ((F.length(line) <= 48) & _ends_with_colon(line))
        | line.rlike(P.NUMBERED_HEADING)
        | line.rlike(P.CHAPTER_HEADING)
        | ((F.length(line) <= 28) & line.rlike(P.HEADING_WORD))
        | ((F.length(line) <= 70) & dated_next)
    )
    plain = (F.length(line) <= 90) & shape & ~line.rlike(P.BULLET)
    plain = _by_markdown(markdown, line.startswith("#") | plain, plain)
    return (line != "") & plain & ~line.rlike(P.DATE_RANGE)


def heading_level(line: Column, following: Column, markdown: bool | Column = False) -> Column:
    number = F.regexp_replace(F.element_at(F.split(line, " "), 1), r"^[.、]+|[.、]+$", "")
    level = (
        F.when(line.rlike(P.NUMBERED_HEADING), F.least(F.lit(4), T.occurrences(number, ".") + 1))
        .when(line.rlike(P.CHAPTER_HEADING), F.lit(1))
        .when(F.coalesce(following.rlike(P.DATE_RANGE), F.lit(False)), F.lit(2))
        .when((F.length(line) <= 28) & line.rlike(P.HEADING_WORD), F.lit(1))
        .otherwise(F.lit(2))
    )
    marks = F.length(line) - F.length(F.regexp_replace(line, "^#+", ""))
    marked = F.when(line.startswith("#"), F.least(F.lit(6), marks)).otherwise(level)
    return _by_markdown(markdown, marked, level).cast("int")


def _flagged(df: DataFrame, text: str, markdown: bool | Column) -> DataFrame:
    """Add ``__lines``: array of (line, tab, h, t, b, level) for the non-empty lines; ``level`` is null where h is false."""
    raw = _by_markdown(markdown, F.regexp_replace(text, P.CODE_FENCE, ""), F.col(text))
    split = T.map_lines(
        raw,
        lambda x, normalize: F.struct(
            normalize(T.strip(x)).alias("line"), (x.contains("\t") & T.strip(x).contains("\t")).alias("tab")
        ),
    )
    df = df.withColumn("__split", F.filter(split, lambda s: s["line"] != ""))

    def flag(s: Column, i: Column) -> Column:
        return F.struct(
            s["line"].alias("line"),
            s["tab"].alias("tab"),
            is_heading(s["line"], F.get("__split", i + 1)["line"], markdown).alias("h"),
            (_looks_like_table(s["line"]) | s["tab"]).alias("t"),
            s["line"].rlike(P.BULLET).alias("b"),
        )

    def leveled(s: Column, i: Column) -> Column:
        level = F.when(s["h"], heading_level(s["line"], F.get("__split", i + 1)["line"], markdown))
        return F.struct(*[s[c].alias(c) for c in ("line", "tab", "h", "t", "b")], level.alias("level"))

    df = df.withColumn("__flags", F.transform("__split", flag))
    return df.withColumn("__lines", F.transform("__flags", leveled)).drop("__split", "__flags")


def classify_lines(df: DataFrame, text: str = "text", markdown: bool | Column = False) -> DataFrame:
    """Class of every line: heading, table, bullet or text, in that precedence."""
    keep = [c for c in df.columns if c != text]
    flagged = unfold(_flagged(df, text, markdown), keep, "__lines", "line_no", "f")
    kind = (
        F.when(F.col("f.h"), "heading").when(F.col("f.t"), "table").when(F.col("f.b"), "bullet").otherwise("text")
    )
    return flagged.select(
        *keep,
        "line_no",
        F.col("f.line").alias("line"),
        kind.alias("line_class"),
        F.col("f.level").cast("long").alias("heading_level"),
    )


def _kinds(lines: str = "__lines") -> Column:
    """One letter per line: h heading, t pipe or tab row, k comma row, b bullet, x text.

    Inside a run of table rows (or bullets) a line of the same shape stays in the run whatever
    else it looks like; so the letter depends on the letter before it.
    """

    def step(acc: Column, f: Column) -> Column:
        last = F.substring(acc, -1, 1)
        table = F.when(f["line"].contains("|") | f["tab"], F.lit("t")).otherwise(F.lit("k"))
        return F.concat(
            acc,
            F.when(f["t"] & last.isin("t", "k"), table)
            .when(f["b"] & (last == "b"), F.lit("b"))
            .when(f["h"], F.lit("h"))
            .when(f["t"], table)
            .when(f["b"], F.lit("b"))
            .otherwise(F.lit("x")),
        )

    return F.aggregate(lines, F.lit(""), step)


# A heading with its text, a table of two or more rows or one true row, a list, a lone comma row
# with the text behind it, plain text.
RUNS = r"hx*|[tk]{2,}|t|b+|kx*|x+"


def _heading_fold(lines: str, pieces: str) -> Column:
    """Path of every heading: levels at or above the new one are closed first."""
    start = F.struct(
        F.array().cast("array<struct<level:int,title:string>>").alias("stack"),
        F.array().cast("array<struct<start:int,title:string,level:int,path:string>>").alias("out"),
    ).cast(HEADING_STATE)

    def step(acc: Column, p: Column) -> Column:
        line = F.get(lines, p["start"])
        top = F.try_element_at(acc["stack"], F.lit(-1))
        nested = F.when(_ends_with_colon(top["title"]), top["level"]).otherwise(
            F.least(F.lit(6), top["level"] + 1)
        )
        level = F.when(_ends_with_colon(line["line"]) & top.isNotNull(), nested).otherwise(line["level"])
        title = p["title"]
        kept = F.filter(acc["stack"], lambda s: s["level"] < level)
        # levels on the stack grow strictly, so dropping the tail is the same as this filter
        stack = F.concat(kept, F.array(F.struct(level.alias("level"), title.alias("title"))))
        path = F.array_join(F.transform(stack, lambda s: s["title"]), " > ")
        item = F.struct(p["start"].alias("start"), title.alias("title"), level.alias("level"), path.alias("path"))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(item)).alias("out")).cast(HEADING_STATE)

    return F.aggregate(F.filter(pieces, lambda p: p["kind"] == "h"), start, step, lambda acc: acc["out"])


def with_elements(df: DataFrame, text: str = "text", markdown: bool | Column = False) -> DataFrame:
    """Add ``elements``: the ordered typed elements of the document as one array column."""
    keep = df.columns
    flagged = _flagged(df, text, markdown).withColumn(
        "__runs", F.regexp_extract_all(_kinds(), F.lit(RUNS), F.lit(0))
    )

    def locate(run: Column, i: Column) -> Column:
        start = F.length(F.array_join(F.slice("__runs", F.lit(1), i), ""))
        title = F.get("__lines", start)["line"]
        title = _by_markdown(markdown, T.strip(F.regexp_replace(title, "^#+", "")), title)
        return F.struct(
            F.substring(run, 1, 1).alias("kind"),
            run.alias("run"),
            F.length(run).alias("len"),
            start.cast("int").alias("start"),
            title.alias("title"),
        )

    placed = flagged.withColumn("__pieces", F.transform("__runs", locate))
    headed = placed.withColumn("__heads", _heading_fold("__lines", "__pieces"))

    def build(p: Column) -> Column:
        head = F.try_element_at(F.filter("__heads", lambda h: h["start"] <= p["start"]), F.lit(-1))
        body = F.transform(F.slice("__lines", p["start"] + 1, p["len"]), lambda s: s["line"])

        def element(kind: Column, value: Column, count: Column) -> Column:
            return F.struct(
                kind.alias("element_type"),
                value.alias("text"),
                head["title"].alias("section_title"),
                head["path"].alias("section_path"),
                head["level"].alias("heading_level"),
                count.cast("int").alias("line_count"),
            ).cast(ELEMENT)

        none = F.lit(None)
        joined = F.array_join(body, "\n")
        after = F.array_join(F.slice(body, F.lit(2), p["len"]), "\n")
        own = F.when(head.isNotNull(), F.lit("section")).otherwise(F.lit("paragraph"))
        as_heading = F.concat(
            F.array(element(F.lit("heading"), p["title"], none)),
            F.when(p["len"] > 1, F.array(element(F.lit("section"), F.concat(p["title"], F.lit("\n"), after), none)))
            .otherwise(F.array().cast(f"array<{ELEMENT}>")),
        )
        repeats_title = F.coalesce(joined == head["title"], F.lit(False))
        return (
            F.when(p["kind"] == "h", as_heading)
            .when(p["run"].rlike("^(kx*|x+)$"),
                  F.when(repeats_title, F.array().cast(f"array<{ELEMENT}>"))
                  .otherwise(F.array(element(own, joined, none))))
            .when(p["kind"] == "b", F.array(element(F.lit("list"), joined, p["len"])))
            .otherwise(F.array(element(F.lit("table"), joined, p["len"])))
        )

    elements = F.flatten(F.transform("__pieces", build))
    if isinstance(markdown, Column) or markdown:
        code = F.transform(
            F.regexp_extract_all(F.col(text), F.lit(P.CODE_FENCE), F.lit(0)),
            lambda c: F.struct(
                F.lit("code").alias("element_type"), T.normalize_text(c).alias("text"),
                F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("section_path"),
                F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("int").alias("line_count"),
            ).cast(ELEMENT),
        )
        elements = _by_markdown(markdown, F.concat(elements, code), elements)
    return headed.withColumn("elements", elements).select(*keep, "elements")


def extract_elements(df: DataFrame, text: str = "text", markdown: bool | Column = False) -> DataFrame:
    """One row per element, in document order."""
    keep = [c for c in df.columns if c != text]
    return (
        unfold(with_elements(df, text, markdown), keep, "elements", "element_order", "e")
        .select(*keep, "element_order", "e.*")
        .withColumn("heading_level", F.col("heading_level").cast("long"))
        .withColumn("line_count", F.col("line_count").cast("long"))
    )


def section_paths(df: DataFrame, text: str = "text", markdown: bool | Column = False) -> DataFrame:
    """Headings with their level and the path of the headings above them."""
    found = extract_elements(df, text, markdown).filter(F.col("element_type") == "heading")
    return found.drop("line_count", "section_title", "element_type").withColumnRenamed("text", "heading")


def code_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Fenced code blocks in order, and (``without_code``) the text they were cut from."""
    keep = [c for c in df.columns if c != text]
    rest = F.regexp_replace(text, P.CODE_FENCE, "").alias("without_code")
    found = F.regexp_extract_all(F.col(text), F.lit(P.CODE_FENCE), F.lit(0))
    return unfold(df, [*keep, rest], found, "block_no", "code")


def _count(kinds: tuple[str, ...]) -> Column:
    return F.size(F.filter("elements", lambda e: e["element_type"].isin(*kinds)))


BODY_TYPES = ("section", "paragraph", "row_group")


def outline_column(
    document_id: Column, source: Column, file_type: Column, warnings: Column | None = None
) -> Column:
    """Outline text of a row that has ``elements``."""
    headings = F.transform(
        F.filter("elements", lambda e: e["element_type"] == "heading"),
        lambda e: F.concat(
            F.repeat(F.lit("  "), F.greatest(F.lit(1), F.coalesce(e["heading_level"], F.lit(1))) - 1),
            F.lit("- "), e["text"],
        ),
    )
    counted = F.concat(F.lit("- Document sections: "), _count(BODY_TYPES).cast("string"))
    parts = [
        F.lit("Document structural outline"),
        F.concat(F.lit("document_id: "), document_id),
        F.concat(F.lit("source: "), F.element_at(F.split(source, "/"), -1)),
        F.concat(F.lit("file_type: "), file_type),
        F.concat(F.lit("elements: "), F.size("elements").cast("string")),
        F.concat(F.lit("tables: "), _count(("table",)).cast("string")),
        F.concat(F.lit("lists: "), _count(("list",)).cast("string")),
        F.lit("headings:"),
        F.when(F.size(headings) > 0, F.array_join(headings, "\n")).otherwise(counted),
    ]
    if warnings is not None:
        shown = F.transform(F.slice(warnings, 1, 5), lambda w: F.concat(F.lit("- "), w))
        parts.append(F.when(F.size(warnings) > 0, F.concat(F.lit("warnings:\n"), F.array_join(shown, "\n"))))
    return F.concat_ws("\n", *parts)


def build_outline(df: DataFrame, document_id: str, source: str, file_type: str, text: str = "text",
                  markdown: bool | Column = False) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    outline = outline_column(F.col(document_id).cast("string"), F.col(source), F.col(file_type))
    return with_elements(df, text, markdown).select(*keep, outline.alias("outline"))


def quality_column(text: Column, warnings: Column | None = None) -> Column:
    """Parse quality between 0 and 1 of a row that has ``elements``."""
    cjk = T.count_cjk(text)
    spaced = F.size(F.regexp_extract_all(text, F.lit(rf"[{T.CJK}]\s+[{T.CJK}]"), F.lit(0)))
    count = F.size(warnings) if warnings is not None else F.lit(0)
    score = (
        F.lit(0.55)
        + F.when(F.length(text) > 200, 0.15).otherwise(0.0)
        + F.when(_count(("heading",)) > 0, 0.15).otherwise(0.0)
        + F.when(_count(BODY_TYPES) >= 2, 0.10).otherwise(0.0)
        - F.when(spaced / F.greatest(cjk, F.lit(1)) > 0.08, 0.20).otherwise(0.0)
        - F.least(F.lit(0.20), count * F.lit(0.04))
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 3)))
    return F.when(T.is_blank(F.coalesce(text, F.lit(""))), F.lit(0.0)).otherwise(bounded)


def parse_quality(df: DataFrame, text: str = "text", markdown: bool | Column = False) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return with_elements(df, text, markdown).select(*keep, quality_column(F.col(text)).alias("parse_quality"))


def document_title(df: DataFrame, source: str, text: str = "text", markdown: bool | Column = False) -> DataFrame:
    """First heading, else the file stem."""
    keep = [c for c in df.columns if c != text]
    stem = F.regexp_replace(F.element_at(F.split(F.col(source), "/"), -1), r"(.)\.[^.]*$", "$1")
    first = F.try_element_at(F.filter("elements", lambda e: e["element_type"] == "heading"), F.lit(1))["text"]
    return with_elements(df, text, markdown).select(*keep, F.coalesce(first, stem).alias("title"))


# ---- tables ---------------------------------------------------------------------------------


def _value_counts(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """(column_name, value, n) with blanks as empty strings. Values are counted before anything
    is keyed by column, so neither a hot value nor a hot column meets one task."""
    columns = columns or df.columns
    wide = df.select(*[T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    long = wide.unpivot([], columns, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def _number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def _column_profile(counts: DataFrame) -> DataFrame:
    filled, n = F.col("value") != "", F.col("n")
    number = _number(F.col("value"))
    grouped = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(filled, n)), F.lit(0)).alias("filled"),
        F.count(F.when(filled, 1)).alias("distinct_values"),
        F.coalesce(F.sum(F.when(filled & number.isNotNull(), n)), F.lit(0)).alias("numeric_rows"),
        F.coalesce(F.sum(F.when(filled & F.col("value").rlike(P.DATE_LIKE), n)), F.lit(0)).alias("date_rows"),
        F.min(F.when(filled, number)).alias("min_value"),
        F.max(F.when(filled, number)).alias("max_value"),
        F.sum(F.when(filled, number * n)).alias("sum_value"),
    )
    kind = (
        F.when(F.col("filled") == 0, "empty")
        .when(F.col("numeric_rows") / F.col("filled") >= 0.8, "numeric")
        .when(F.col("date_rows") / F.col("filled") >= 0.6, "date")
        .when(F.col("distinct_values") / F.col("filled") <= 0.5, "categorical")
        .otherwise("text")
    )
    return grouped.withColumn("column_type", kind)


def infer_column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _column_profile(_value_counts(df, columns)).select("column_name", "column_type")


def profile_table(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """Per column: type, missing cells, numeric figures, or the most frequent values."""
    counts = _value_counts(df, columns)
    best = top_k(counts.filter("value != ''"), ["column_name"], [F.desc("n"), F.asc("value")], top)
    tops = best.groupBy("column_name").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                lambda s: F.concat(s["value"], F.lit("("), s["n"].cast("string"), F.lit(")")),
            ),
            "; ",
        ).alias("top_values")
    )
    numeric = F.col("column_type") == "numeric"
    return (
        _column_profile(counts)
        .join(tops, "column_name", "left")
        .select(
            "column_name",
            "column_type",
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col("filled")).alias("missing"),
            *[F.when(numeric, F.col(c)).alias(c) for c in ("min_value", "max_value", "sum_value")],
            F.when(numeric, F.col("sum_value") / F.col("numeric_rows")).alias("avg_value"),
            F.when(~numeric, F.col("top_values")).alias("top_values"),
        )
    )


def row_groups(df: DataFrame, order: str, n: int | Column = 50, columns: list[str] | None = None) -> DataFrame:
    """Consecutive groups of ``n`` rows as text: header line, then ``column=value`` lines.

    ``order`` is a unique numeric column; numbering is segmented, so no task sorts the table.
    """
    columns = columns or [c for c in df.columns if c != order]
    cells = F.concat_ws(
        ", ",
        *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns],
    )
    size = n if isinstance(n, Column) else F.lit(n)
    numbered = table_row_number(df.select(order, cells.alias("__row")), order).select(
        F.floor((F.col("rn") - 1) / size).cast("long").alias("group_no"), "rn", "__row"
    )
    grouped = numbered.groupBy("group_no").agg(
        F.min("rn").alias("__from"),
        F.max("rn").alias("__to"),
        F.array_sort(F.collect_list(F.struct("rn", "__row"))).alias("__rows"),
    )
    body = F.array_join(F.transform("__rows", lambda r: r["__row"]), "\n")
    return grouped.select(
        "group_no",
        F.concat(F.col("__from").cast("string"), F.lit("-"), F.col("__to").cast("string")).alias("row_range"),
        F.concat(F.lit(" | ".join(columns) + "\n"), body).alias("text"),
    )


# ---- spans ----------------------------------------------------------------------------------


def sections_from_spans(spans: DataFrame, doc: str = "doc_id", delta: float = 2.0, join: str = " ") -> DataFrame:
    """Sections of laid-out text.

    ``spans(doc, page, pos, text, size, bold, style)``: headings are larger than the document's
    most common size (or bold and slightly larger), or carry a ``Heading n`` style. A document's
    spans were one file, so they are gathered into one row and folded there.
    """
    usual = (
        spans.groupBy(doc, "size").agg(F.count("*").alias("n"))
        .groupBy(doc).agg(F.max_by("size", F.struct(F.col("n"), -F.col("size"))).alias("body_size"))
    )
    gap, chars = F.col("size") - F.col("body_size"), F.length("text")
    style = F.regexp_extract(F.coalesce("style", F.lit("")), r"^Heading *([0-9]*)", 1)
    styled = F.coalesce("style", F.lit("")).startswith("Heading")
    level = (
        F.when(styled, F.coalesce(style.try_cast("int"), F.lit(1)))
        .when((gap >= 2 * delta) & (chars < 120), 1)
        .when((gap >= delta) & (chars < 120), 2)
        .when(F.col("bold") & (gap >= 1) & (chars < 80), 3)
    )
    leveled = spans.join(usual, doc).withColumn("level", level.cast("int"))
    by_doc = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = leveled.withColumn("section_no", F.count("level").over(by_doc))
    heads = (
        numbered.filter("level is not null")
        .groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("section_no", "level", "text"))).alias("heads"))
    )

    def path(h: Column) -> Column:
        # a heading above is still open when no later heading up to here is at its level or above
        upto = F.filter("heads", lambda o: o["section_no"] <= h["section_no"])
        is_open = F.filter(
            upto,
            lambda o: ~F.exists(upto, lambda p: (p["section_no"] > o["section_no"]) & (p["level"] <= o["level"])),
        )
        return F.array_join(F.transform(is_open, lambda o: o["text"]), " > ")

    titled = heads.select(
        doc,
        F.explode_outer(
            F.transform(
                "heads",
                lambda h: F.struct(
                    h["section_no"].alias("section_no"), h["text"].alias("heading"),
                    h["level"].alias("heading_level"), path(h).alias("heading_path"),
                ),
            )
        ).alias("h"),
    ).select(doc, "h.*")
    body = numbered.groupBy(doc, "section_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "text")))),
                lambda s: s["text"],
            ),
            join,
        ).alias("body"),
        F.coalesce(F.min(F.when(F.col("level").isNull(), F.col("page"))), F.min("page")).alias("page"),
    )
    heading = F.coalesce(F.col("heading"), F.lit(""))
    text = (
        F.when(F.col("body") == "", heading)
        .when((heading != "") & ~F.contains(F.col("body"), heading), F.concat(heading, F.lit("\n"), F.col("body")))
        .otherwise(F.col("body"))
    )
    return body.join(titled, [doc, "section_no"], "left").select(
        doc,
        F.col("section_no").cast("long").alias("section_no"),
        heading.alias("heading"),
        F.coalesce(F.col("heading_level"), F.lit(0)).cast("long").alias("heading_level"),
        F.coalesce(F.col("heading_path"), F.lit("")).alias("heading_path"),
        F.col("page").cast("long").alias("page"),
        text.alias("text"),
    )
