"""Chunking and ingest over ``documents``, ``part`` and ``lineitem``."""

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.documents import markdown_documents, structured_documents, typed_documents, with_file_type
from catalog.registry import query, table
from corpusmill.functions import text as T
from corpusmill.functions.session import scratch_dir
from corpusmill.operators import chunking as ch
from corpusmill.plans.ingest import ingest, with_ids


def texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("chunk_recursive")
def _(spark, sf):
    return ch.chunk_recursive(texts(spark, sf))


@query("chunk_fixed_named")
def _(spark, sf):
    return ch.chunk_fixed_named(texts(spark, sf))


@query(
    "chunk_fixed",
    """select doc_id, unnest(range(len(s))) as chunk_index, unnest(list_transform(s, lambda x: text[x + 1:x + 512])) as text
    from (select doc_id, text, range(0, length(text), 462) as s from documents)""",
)
def _(spark, sf):
    return ch.chunk_fixed(texts(spark, sf))


@query("chunk_markdown")
def _(spark, sf):
    return ch.chunk_markdown(markdown_documents(spark, sf).select("doc_id", "text"))


@query("chunk_markdown_protected")
def _(spark, sf):
    return ch.chunk_markdown_protected(markdown_documents(spark, sf).select("doc_id", "text"), 300, 40)


# Every document as two paragraphs: its source line and its text.
PARAGRAPHS_SQL = "pd as (select doc_id, source || chr(10) || '  ' || chr(10) || text || chr(10) || chr(10) as text from documents)"


def paragraphed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("\n  \n"), "text", F.lit("\n\n")).alias("text"))


@query(
    "chunk_paragraphs",
    f"""with {PARAGRAPHS_SQL}, p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\r\\n\\f]*\\n'),
      lambda x: {S.strip('x')}), lambda x: x != '') as ps from pd)
    select doc_id, unnest(range(len(ps))) as paragraph_index, unnest(ps) as text, 'paragraph' as chunk_type from p""",
)
def _(spark, sf):
    return ch.chunk_paragraphs(paragraphed(spark, sf), None)


@query("chunk_paragraphs_split")
def _(spark, sf):
    return ch.chunk_paragraphs(paragraphed(spark, sf))


@query(
    "chunk_table_rows",
    """with n as (select *, row_number() over (order by p_partkey) as rn, count(*) over () as total from part),
    g as (select least(200, greatest(1, floor(800 / greatest(avg(length(concat_ws(',', p_name, p_brand, p_size::varchar))), 1))))::int as n from n where rn <= 20)
    select (rn - 1) // g.n as group_no, min(rn) || '-' || max(rn) as row_range, max(total) as total_rows, 'p_name | p_brand | p_size' || chr(10)
      || string_agg('p_name=' || p_name || ', p_brand=' || p_brand || ', p_size=' || p_size, chr(10) order by rn) as text from n, g group by 1""",
)
def _(spark, sf):
    return ch.chunk_table_rows(table(spark, sf, "part"), "p_partkey", 800, ["p_name", "p_brand", "p_size"])


@query(
    "merge_small_chunks",
    f"""with l as (select doc_id, {S.lines('text')} as ls from documents),
    e as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from l),
    k as (select *, length(line) >= 100 or i = 0 as kept from e),
    g as (select *, sum(kept::int) over (partition by doc_id order by i) - 1 as group_no from k)
    select doc_id, group_no::bigint as group_no, min(i) as chunk_index, count(*) as merged, string_agg(line, chr(10) order by i) as text from g group by 1, 2""",
)
def _(spark, sf):
    from corpusmill.operators.structure import explode_lines

    lines = explode_lines(texts(spark, sf)).select("doc_id", F.col("line_no").alias("chunk_index"), F.col("line").alias("text"))
    return ch.merge_small_chunks(lines)


@query("chunk_semantic")
def _(spark, sf):
    return ch.chunk_semantic(texts(spark, sf))


@query("auto_chunk")
def _(spark, sf):
    chunks = ch.auto_chunk(with_file_type(structured_documents(spark, sf)))
    return chunks.select("doc_id", "structure_order", "chunk_part", "element_type", "section_path", "strategy", "text")


@query(
    "number_chunks",
    f"""with l as (select doc_id, {S.lines('text')} as ls from documents), e as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from l),
    n as (select doc_id, line, row_number() over (partition by doc_id order by i) - 1 as chunk_index from e)
    select doc_id, chunk_index, sha1(doc_id || ':' || chunk_index)[1:16] as chunk_id, line from n""",
)
def _(spark, sf):
    from corpusmill.operators.structure import explode_lines

    return ch.number_chunks(explode_lines(texts(spark, sf)), ["line_no"]).drop("line_no")


@query(
    "keyword_coverage",
    f"""with x as (select doc_id, source, case when length(text) > 0 then len(range(0, length(text), 462)) else 0 end as n, text, {S.lines('text')}[1] as l from documents),
    k as (select doc_id, n, text, unnest([l[1:4], 'zz' || source]) as kw from x)
    select doc_id, max(n) as chunks, coalesce(string_agg(kw, ',' order by kw) filter (where contains(text, kw)), '') as found,
      coalesce(string_agg(kw, ',' order by kw) filter (where not contains(text, kw)), '') as missing,
      count(*) filter (where not contains(text, kw)) = 0 and max(n) >= 1 as passed from k group by 1""",
)
def _(spark, sf):
    """Expected per document: the start of its first line, and one word it never has."""
    docs = table(spark, sf, "documents")
    words = F.array(F.substring(F.get(T.lines_of(F.col("text")), F.lit(0)), 1, 4), F.concat(F.lit("zz"), F.col("source")))
    expected = docs.select("doc_id", F.explode(words).alias("keyword"))
    return ch.keyword_coverage(ch.chunk_fixed(texts(spark, sf)), expected)


@query(
    "ingest",
    f"""with {PARAGRAPHS_SQL} select doc_id::varchar as document_id, 1 as raw, n as chunks, n as indexed
    from (select doc_id, len(list_filter(string_split_regex(text, '\\n[ \\t\\r\\n\\f]*\\n'), lambda x: {S.strip('x')} != '')) as n from pd)""",
)
def _(spark, sf):
    """Paragraph chunks of the two-paragraph documents, kept whole so that the count is known."""
    docs = paragraphed(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("session_id"), F.col("lang").alias("source")), "doc_id")
    ch.STRATEGIES.setdefault(
        "whole_paragraph", lambda df: ch.chunk_paragraphs(df, None).withColumnRenamed("paragraph_index", "chunk_index")
    )
    return ingest(docs, scratch_dir(spark, "index"), "whole_paragraph")


@query("ingest_auto")
def _(spark, sf):
    docs = typed_documents(spark, sf).withColumn("session_id", F.col("source"))
    return ingest(docs, scratch_dir(spark, "index"), "auto")


def paragraph_chunks(spark, sf):
    """Index rows used by the source and sink queries: one chunk per document line group."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", F.col("source").alias("session_id"), F.col("lang").alias("source"), "n_chars"
    )
    return with_ids(ch.chunk_fixed(docs))
