"""Chunks of documents. A document is one row, so every strategy works inside the row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.arrays import unfold
from corpusmill.functions.splitting import FIXED_SEPARATORS, MARKDOWN_SEPARATORS, SEPARATORS, chunks_column
from corpusmill.functions.vectors import sentence_gaps
from corpusmill.operators import structure as st

# Default sizes.
SIZE, OVERLAP, MIN_SIZE = 800, 100, 100


def _rest(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c != text]


def chunk_recursive(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separators=SEPARATORS, text: str = "text") -> DataFrame:
    pieces = df.withColumn("__pieces", chunks_column(F.col(text), size, overlap, separators))
    return unfold(pieces, _rest(df, text), "__pieces", "chunk_index", "text")


def chunk_fixed_named(df: DataFrame, size: int = 512, overlap: int = 50, text: str = "text") -> DataFrame:
    """The strategy called "fixed size": recursive splitting with other separators."""
    return chunk_recursive(df, size, overlap, FIXED_SEPARATORS, text)


def chunk_fixed(df: DataFrame, size: int = 512, overlap: int = 50, text: str = "text") -> DataFrame:
    """True fixed windows of ``size`` characters every ``size - overlap``."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    windows = F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))
    return unfold(df, _rest(df, text), windows, "chunk_index", "text")


def _markdown_sections(df: DataFrame, text: str) -> DataFrame:
    """Unfold into header sections: ``section_no, body, heading_path, heading_level``."""
    lined = df.withColumn("__lines", F.split(T.unify_breaks(F.col(text)), "\n"))

    def letter(acc: Column, line: Column) -> Column:
        inside = F.substring(acc, -1, 1).isin("f", "c")
        fence = F.ltrim(line).startswith("```")
        return F.concat(
            acc,
            F.when(inside, F.when(fence, "g").otherwise("c"))
            .when(fence, "f").when(line.rlike("^#{1,4} "), "h").otherwise("x"),
        )

    runs = F.regexp_extract_all(F.aggregate("__lines", F.lit(""), letter), F.lit("h[^h]*|[^h]+"), F.lit(0))
    placed = lined.withColumn("__runs", runs).withColumn(
        "__sections",
        F.transform(
            "__runs",
            lambda r, i: F.struct(
                i.alias("no"),
                F.array_join(
                    F.slice("__lines", F.length(F.array_join(F.slice("__runs", F.lit(1), i), "")) + 1, F.length(r)), "\n"
                ).alias("body"),
                F.when(
                    r.startswith("h"), F.get("__lines", F.length(F.array_join(F.slice("__runs", F.lit(1), i), "")))
                ).alias("head"),
            ),
        ),
    )
    level = lambda s: F.length(F.regexp_extract(s["head"], "^#+", 0))
    placed = placed.withColumn(
        "__heads",
        F.transform(
            F.filter("__sections", lambda s: s["head"].isNotNull()),
            lambda s: F.struct(s["no"].alias("no"), level(s).alias("level"), T.strip(F.regexp_replace(s["head"], "^#+", "")).alias("title")),
        ),
    )

    def open_heads(s: Column) -> Column:
        upto = F.filter("__heads", lambda h: h["no"] <= s["no"])
        return F.filter(upto, lambda h: ~F.exists(upto, lambda o: (o["no"] > h["no"]) & (o["level"] <= h["level"])))

    full = F.transform(
        "__sections",
        lambda s: F.struct(
            s["body"].alias("body"),
            F.array_join(F.transform(open_heads(s), lambda h: h["title"]), " > ").alias("heading_path"),
            F.size(open_heads(s)).alias("heading_level"),
        ),
    )
    placed = placed.withColumn("__full", full)
    rest = _rest(df, text)
    return unfold(placed, rest, "__full", "section_no", "s").select(*rest, "section_no", "s.*").filter(T.strip(F.col("body")) != "")


def chunk_markdown(df: DataFrame, size: int = 1000, text: str = "text") -> DataFrame:
    """Header sections, long ones split with an overlap of 50. Position is (section_no, chunk_part)."""
    sections = _markdown_sections(df, text)
    keep = [*_rest(df, text), "section_no", "heading_path", "heading_level"]
    pieces = chunks_column(F.col("body"), size, 50, MARKDOWN_SEPARATORS)
    return unfold(sections.withColumn("__p", pieces), keep, "__p", "chunk_part", "text")


def chunk_markdown_protected(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """As ``chunk_markdown``, never cutting code fences, tables or lists; flags code and tables."""
    sections = _markdown_sections(df, text).withColumns(
        {"has_code": F.col("body").contains("```"), "has_table": F.col("body").rlike(r"(?m)^\|.+\|.+$")}
    )
    keep = [*_rest(df, text), "section_no", "heading_path", "heading_level", "has_code", "has_table"]
    pieces = chunks_column(F.col("body"), size, overlap, protected=True)
    return unfold(sections.withColumn("__p", pieces), keep, "__p", "chunk_part", "text")


def chunk_paragraphs(df: DataFrame, size: int | None = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Paragraphs between blank lines; those over ``size`` become sentence groups."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n[ \t\r\n\f]*\n"), T.strip), lambda p: p != "")
    rest = _rest(df, text)
    rows = unfold(df, rest, paragraphs, "paragraph_index", "__p")
    if size is None:
        return rows.withColumnRenamed("__p", "text").withColumn("chunk_type", F.lit("paragraph"))
    kind = F.when(F.length("__p") > size, "sentence_group").otherwise("paragraph")
    cut = rows.withColumns({"chunk_type": kind, "__c": chunks_column(F.col("__p"), size, overlap)})
    return unfold(cut, [*rest, "paragraph_index", "chunk_type"], "__c", "chunk_part", "text")


def chunk_table_rows(df: DataFrame, order: str, size: int = SIZE, columns: list[str] | None = None) -> DataFrame:
    """Groups of whole rows under a repeated header; as many rows as fit, judged by the first 20."""
    columns = columns or [c for c in df.columns if c != order]
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    first = df.select(order, F.length(row).alias("n")).orderBy(order).limit(20)
    per_chunk = F.least(F.lit(200), F.greatest(F.lit(1), F.floor(size / F.greatest(F.avg("n"), F.lit(1.0))))).cast("int")
    n = first.agg(per_chunk).scalar()
    total = df.agg(F.count("*")).scalar()
    return st.row_groups(df, order, n, columns).withColumn("total_rows", total)


def merge_small_chunks(df: DataFrame, min_size: int = MIN_SIZE, doc: str = "doc_id", order: str = "chunk_index", text: str = "text") -> DataFrame:
    """A chunk under ``min_size`` joins the previous kept one; the first of a document is kept.

    Metadata (a map column, if any) of the joined chunks fills absent keys only.
    """
    content = T.strip(F.col(text))
    by_doc = Window.partitionBy(doc).orderBy(order)
    kept = (F.length(content) >= min_size) | (F.row_number().over(by_doc) == 1)
    grouped = df.withColumn("__kept", kept).withColumn(
        "group_no", F.sum(F.col("__kept").cast("long")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)) - 1
    )
    shown = F.when(F.col("__kept"), F.col(text)).otherwise(content)
    fields = [F.col(order).alias("o"), shown.alias("t")]
    with_meta = "metadata" in df.columns
    if with_meta:
        fields.append(F.col("metadata").alias("m"))
    gathered = grouped.groupBy(doc, "group_no").agg(
        F.min(order).alias(order), F.count("*").alias("merged"), F.array_sort(F.collect_list(F.struct(*fields[:2]))).alias("__parts"),
        *([F.collect_list(F.struct(F.col(order).alias("o"), F.col("metadata").alias("m"))).alias("__meta")] if with_meta else []),
    )
    out = [doc, "group_no", order, "merged", F.array_join(F.transform("__parts", lambda p: p["t"]), "\n").alias(text)]
    if with_meta:
        ordered = F.array_sort("__meta", lambda a, b: a["o"].cast("int") - b["o"].cast("int"))
        merged = F.aggregate(
            F.transform(ordered, lambda s: s["m"]), F.create_map().cast("map<string,string>"),
            lambda acc, m: F.map_concat(acc, F.map_filter(m, lambda k, _: ~F.map_contains_key(acc, k))),
        )
        out.append(merged.alias("metadata"))
    return gathered.select(*out)


def chunk_semantic(df: DataFrame, percentile: float = 0.9, min_size: int = MIN_SIZE, doc: str = "doc_id", text: str = "text", dim: int = 128) -> DataFrame:
    """Break where neighbouring sentences (each with one sentence of context) differ most.

    The distance limit is the given percentile within the document; a group shorter than
    ``min_size`` grows on. Documents with one sentence stay whole. Vectors depend on the sentences alone, so a
    document is cut the same way in any batch. Other columns come along. Sentences stay in their row: nothing is shuffled.
    """
    sentences = F.filter(F.split(F.col(text), r"(?<=[.?!。！？])\s+"), lambda s: ~T.is_blank(s))
    rest = [c for c in _rest(df, text) if c != doc]

    @F.arrow_udf("array<double>")
    def gaps(tokens: pa.Array) -> pa.Array:
        return sentence_gaps(tokens, dim)

    listed = df.select(doc, *rest, sentences.alias("__s"))
    spaced = listed.withColumn("__gaps", gaps(F.transform("__s", lambda s: F.array_join(T.tokenize(s), " "))))
    placed = spaced.withColumn("__sorted", F.array_sort(F.array_compact("__gaps")))
    # the exact percentile, between its two neighbours
    at = (F.size("__sorted") - 1) * F.lit(percentile)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    below, above = F.get("__sorted", low), F.get("__sorted", high)
    limit = F.when((low == high) | (below == above), below).otherwise((high - at) * below + (at - low) * above)
    gathered = placed.withColumn("__limit", limit).withColumn(
        "s",
        F.zip_with("__s", "__gaps", lambda s, g: F.struct(s.alias("sentence"), F.coalesce(g > F.col("__limit"), F.lit(False)).alias("cut"))),
    )
    state = "struct<open:string,done:array<string>>"
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        grown = F.concat_ws(" ", acc["open"], s["sentence"])
        close = s["cut"] & (F.length(grown) >= min_size)
        return F.struct(
            F.when(~close, grown).alias("open"),
            F.when(close, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"),
        ).cast(state)

    groups = F.aggregate(
        "s", start, step,
        lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    return unfold(gathered.withColumn("__g", groups), [doc, *rest], "__g", "chunk_index", "text")


UNSPLIT = ("outline", "row_group", "code")


def auto_chunk(df: DataFrame, doc: str = "doc_id", source: str = "source", file_type: str = "file_type", text: str = "text", markdown: bool | None = None) -> DataFrame:
    """Planned chunks: the outline first, then each element, split when longer than the plan's
    target (outline, row group and code never). Narrow from end to end. Each row is read as Markdown
    or not by its file type, unless ``markdown`` says it for all."""
    kept = [c for c in df.columns if c != text]
    planned = st.infer_chunk_plan(st.profile_documents(df.withColumn("__body", F.col(text)), text, file_type), file_type)
    plan = ["strategy", "target_tokens", "target_chars", "overlap_tokens", "overlap_chars", "reason"]
    shaped = st.with_elements(planned.select(*kept, "__body", *plan), "__body", st.is_markdown(file_type) if markdown is None else markdown)
    outline = st.outline_column(F.col(doc).cast("string"), F.col(source), F.col(file_type))
    head = F.struct(
        F.lit("outline").alias("element_type"), outline.alias("text"), F.lit("Document Outline").alias("section_title"),
        F.lit("Document Outline").alias("section_path"), F.lit(None).cast("int").alias("heading_level"),
        F.lit(None).cast("int").alias("line_count"),
    ).cast(st.ELEMENT)
    measured = shaped.withColumns(
        {
            "parse_quality_score": st.quality_column(F.col("__body")), "element_count": F.size("elements").cast("long"),
            "__all": F.concat(F.array(head), F.col("elements")),
        }
    )
    extra = [*kept, *plan, "parse_quality_score", "element_count"]
    rows = unfold(measured, extra, "__all", "structure_order", "e").select(*extra, "structure_order", "e.*")
    rows = rows.filter(T.strip(F.col("text")) != "")
    limit = F.when(F.col("element_type").isin(*UNSPLIT), F.length("text")).otherwise(F.col("target_chars").cast("int"))
    split = rows.withColumn("__c", chunks_column(F.col("text"), limit, F.col("overlap_chars").cast("int")))
    keep = [*extra, "structure_order", "element_type", "section_title", "section_path", "heading_level"]
    return unfold(split, keep, "__c", "chunk_part", "text")


def number_chunks(df: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    """chunk_index per document and a chunk_id that is the same on every run."""
    by_doc = Window.partitionBy(doc).orderBy(*order)
    index = (F.row_number().over(by_doc) - 1).cast("long")
    return df.withColumn("chunk_index", index).withColumn("chunk_id", chunk_id(F.col(doc), F.col("chunk_index")))


def chunk_id(doc: Column, index: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", doc.cast("string"), index.cast("string"))), 1, 16)


def keyword_coverage(chunks: DataFrame, expected: DataFrame, min_chunks: int = 1, doc: str = "doc_id") -> DataFrame:
    """Expected keywords found and missing per document, and whether it has enough chunks."""
    counts = chunks.groupBy(doc).agg(F.count("*").alias("chunks"))
    seen = (
        expected.join(chunks.select(doc, "text"), doc, "left")
        .groupBy(doc, "keyword").agg(F.coalesce(F.max(F.contains("text", "keyword")), F.lit(False)).alias("found"))
    )
    listed = seen.groupBy(doc).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("found"), F.col("keyword")))), ",").alias("found"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("keyword")))), ",").alias("missing"),
    )
    return listed.join(counts, doc, "left").select(
        doc, F.coalesce("chunks", F.lit(0)).alias("chunks"), "found", "missing",
        ((F.col("missing") == "") & (F.coalesce("chunks", F.lit(0)) >= min_chunks)).alias("passed"),
    )


STRATEGIES = {
    "recursive": lambda df: chunk_recursive(df),
    "fixed_size": lambda df: chunk_fixed_named(df),
    "semantic": lambda df: chunk_semantic(df),
    "markdown": lambda df: number_chunks(chunk_markdown(df), ["section_no", "chunk_part"]),
    "paragraph": lambda df: number_chunks(chunk_paragraphs(df), ["paragraph_index", "chunk_part"]),
    "auto": lambda df: number_chunks(auto_chunk(df), ["structure_order", "chunk_part"]),
}


def chunk_documents(df: DataFrame, strategy: str = "recursive") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return STRATEGIES[strategy](df)
