"""Profiles and structure over ``documents``, ``orders`` and ``pages``."""

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query, table
from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.functions.arrays import unfold
from corpusmill.operators import structure as st

FILE_TYPES = {"en": ".md", "fr": ".txt", "de": ".pdf", "es": ".docx"}
FILE_TYPE_SQL = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in FILE_TYPES.items()) + " else '.txt' end"


def with_file_type(df):
    kind = F.lit(".txt")
    for lang, suffix in FILE_TYPES.items():
        kind = F.when(F.col("lang") == lang, F.lit(suffix)).otherwise(kind)
    return df.withColumn("file_type", kind)


def typed_documents(spark, sf_dir):
    """Documents with a file type per language."""
    return with_file_type(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


# Every document with the line shapes the structure rules look for around its own text.
STRUCTURED_SQL = """
sd as (select doc_id, source, lang, 'Background' || chr(10) || '1.2 ' || source || chr(10) || text || chr(10) || 'Details:' || chr(10)
  || '- item ' || lang || chr(10) || '- item, ' || source || ', x, y' || chr(10) || 'a, b, c, ' || n_chars || chr(10)
  || '2.1 x, y, z, ' || doc_id || chr(10) || 'Conclusion:' || chr(10) || 'end of ' || doc_id || chr(10) || 'lone, comma, row, here'
  || chr(10) || 'tail line' || chr(10) || '| k | v |' || chr(10) || 'Conclusion:' as text from documents)
"""


def structured_documents(spark, sf_dir):
    doc, chars = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    text = F.concat(
        F.lit("Background\n1.2 "), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\nDetails:\n- item "),
        F.col("lang"), F.lit("\n- item, "), F.col("source"), F.lit(", x, y\na, b, c, "), chars,
        F.lit("\n2.1 x, y, z, "), doc, F.lit("\nConclusion:\nend of "), doc,
        F.lit("\nlone, comma, row, here\ntail line\n| k | v |\nConclusion:"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("text"))


@query("normalize_text", f"select doc_id, {S.normalize('text')} as text from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


LINES = f"""{STRUCTURED_SQL},
l as (select doc_id, {S.lines('text')} as ls from sd),
e as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as line_no,
      unnest(list_transform(range(len(ls)), lambda i: ls[i + 2])) as nxt from l)
"""


@query("explode_lines", f"with {LINES} select doc_id, line_no, line from e")
def _(spark, sf):
    return st.explode_lines(structured_documents(spark, sf).select("doc_id", "text"))


PROFILE = f"""
a as (select doc_id, {FILE_TYPE_SQL} as file_type, text, length(text) as total_chars,
      list_filter(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: {S.strip('x')} != '') as raw,
      len(list_filter(string_split_regex(text, '\\n[ \\t\\r\\n\\f]*\\n'), lambda x: {S.strip('x')} != '')) as blocks
      from documents),
b as (select *, list_transform(raw, lambda x: {S.strip('x')}) as ls from a),
c as (select doc_id, file_type, total_chars, greatest(1, total_chars // 2) as estimated_tokens,
      case when blocks <= 1 then greatest(blocks, len(ls)) else blocks end as paragraph_count,
      len(list_filter(ls, lambda x: starts_with(x, '#') or {S.rx('x', P.PROFILE_NUMBERED)}
          or (starts_with(x, '第') and {S.rx('x[1:16]', '章|节|篇|部分')})))
      + case when file_type in ('.md', '.markdown') then 0
        else len(list_filter(ls, lambda x: length(x) <= 40 and {S.colon_end('x')})) end as heading_count,
      greatest(1, len(ls)) as n,
      len(list_filter(raw, lambda x: {S.is_table('x')} or contains({S.strip('x')}, chr(9)))) as tables,
      len(list_filter(raw, lambda x: starts_with(x, '    ') or starts_with(x, chr(9))
          or {S.rx(S.strip('x'), P.CODE_LINE_START)} or {S.rx(S.strip('x'), P.CODE_LINE_END)})) as code
      from b),
profile as (select doc_id, file_type, total_chars, estimated_tokens, paragraph_count,
      case when paragraph_count > 0 then estimated_tokens / paragraph_count
           else estimated_tokens::double end as avg_paragraph_tokens,
      heading_count, tables / n as table_like_ratio, code / n as code_like_ratio from c)
"""


@query(
    "profile_documents",
    f"""with {PROFILE} select doc_id, total_chars, estimated_tokens, paragraph_count,
    round(avg_paragraph_tokens, 6) as avg_paragraph_tokens, heading_count,
    round(table_like_ratio, 6) as table_like_ratio, round(code_like_ratio, 6) as code_like_ratio from profile""",
)
def _(spark, sf):
    rounded = [F.round(c, 6).alias(c) for c in ("avg_paragraph_tokens", "table_like_ratio", "code_like_ratio")]
    return st.profile_documents(typed_documents(spark, sf)).select(
        "doc_id", "total_chars", "estimated_tokens", "paragraph_count", "heading_count", *rounded
    )


def _base(field):
    rows = " ".join(f"when '{r[0]}' then {r[field]!r}" for r in st.BASE_PLANS)
    return f"case file_type {rows} else {st.DEFAULT_PLAN[field - 1]!r} end"


PLAN = f"""
p as (select *, {_base(1)} as strategy, {_base(2)} as bt, {_base(3)} as bl from profile),
s1 as (select *, case when estimated_tokens < 800 then greatest(200.0::double, estimated_tokens::double)
   when estimated_tokens < 3000 then bt * 0.85::double when estimated_tokens > 50000 then bt * 1.2::double
   else bt::double end as sz, case when estimated_tokens < 800 then 0::double else bl::double end as lp,
   table_like_ratio > 0.2 or file_type = '.csv' as tabular, code_like_ratio > 0.15 as coded from p),
s2 as (select * replace (case when avg_paragraph_tokens < 40 then sz * 0.9::double when avg_paragraph_tokens > 220
   then sz * 1.15::double else sz end as sz, case when avg_paragraph_tokens < 40 then lp * 0.7::double
   when avg_paragraph_tokens > 220 then lp * 1.2::double else lp end as lp) from s1),
s3 as (select * replace (case when heading_count >= 10 then sz * 0.9::double else sz end as sz,
   case when tabular then least(lp, 40::double) else lp end as lp) from s2),
s4 as (select * replace (case when coded then least(sz, 700::double) else sz end as sz,
   case when coded then least(lp, 50::double) else lp end as lp) from s3),
s5 as (select *, least(1200, greatest(300, round_even(sz, 0)))::bigint as target_tokens from s4)
select doc_id, strategy, target_tokens, greatest(400, target_tokens * 2) as target_chars,
  greatest(0, least(least(180, floor(target_tokens * 0.2::double)), round_even(lp, 0)))::bigint as overlap_tokens,
  2 * greatest(0, least(least(180, floor(target_tokens * 0.2::double)), round_even(lp, 0)))::bigint as overlap_chars,
  tabular as preserve_tables, coded as preserve_code_blocks,
  concat_ws(', ', 'base=' || strategy,
    case when estimated_tokens < 800 then 'short_document_no_overlap'
         when estimated_tokens < 3000 then 'medium_document_smaller_chunks'
         when estimated_tokens > 50000 then 'large_document_larger_chunks' end,
    case when avg_paragraph_tokens < 40 then 'short_paragraphs' when avg_paragraph_tokens > 220 then 'long_paragraphs' end,
    case when heading_count >= 10 then 'many_headings' end, case when tabular then 'table_heavy' end,
    case when coded then 'code_heavy' end) as reason from s5
"""


@query("infer_chunk_plan", f"with {PROFILE}, {PLAN}")
def _(spark, sf):
    plan = st.infer_chunk_plan(st.profile_documents(typed_documents(spark, sf)))
    return plan.select(
        "doc_id", "strategy", "target_tokens", "target_chars", "overlap_tokens", "overlap_chars",
        "preserve_tables", "preserve_code_blocks", "reason",
    )


CLASSED = f"""
k as (select doc_id, line_no, line,
  case when {S.is_heading('line', 'nxt')} then 'heading' when {S.is_table('line')} then 'table'
  when {S.rx('line', P.BULLET)} then 'bullet' else 'text' end as line_class,
  {S.heading_level('line', 'nxt')} as lv from e)
"""


@query(
    "is_heading",
    f"""with {LINES}, {CLASSED} select doc_id, line_no, line, lv::bigint as heading_level
    from k where line_class = 'heading'""",
)
def _(spark, sf):
    classed = st.classify_lines(structured_documents(spark, sf).select("doc_id", "text"))
    return classed.filter("line_class = 'heading'").select("doc_id", "line_no", "line", "heading_level")


@query("classify_lines", f"with {LINES}, {CLASSED} select doc_id, line_no, line, line_class from k")
def _(spark, sf):
    classed = st.classify_lines(structured_documents(spark, sf).select("doc_id", "text"))
    return classed.select("doc_id", "line_no", "line", "line_class")


# The run letters of a document, its runs, and its elements (without heading paths).
ELEMENTS = f"""
f as (select doc_id, ls, list_transform(ls, lambda x, i: {{'line': x, 'h': {S.is_heading('x', 'ls[i + 1]')},
      't': {S.is_table('x')}, 'b': {S.rx('x', P.BULLET)}}}) as fs from l),
g as (select doc_id, ls, list_reduce(list_prepend('', list_transform(fs, lambda s:
      (case when s.h then 'H' else '-' end) || (case when s.t and contains(s.line, '|') then 'T' when s.t then 'K' else '-' end)
      || (case when s.b then 'B' else '-' end))),
      lambda a, s: a || case when s[2] != '-' and a[-1] in ('t', 'k') then lower(s[2])
        when s[3] = 'B' and a[-1] = 'b' then 'b' when s[1] = 'H' then 'h'
        when s[2] != '-' then lower(s[2]) when s[3] = 'B' then 'b' else 'x' end) as kinds from f),
r as (select doc_id, ls, regexp_extract_all(kinds, 'hx*|[tk]{{2,}}|t|b+|kx*|x+') as runs from g),
p as (select doc_id, ls, unnest(runs) as run, unnest(range(len(runs))) as run_no,
      unnest(list_transform(runs, lambda x, i: length(list_aggregate(['', *runs[1:i - 1]], 'string_agg', ''))))::bigint as start
      from r),
t as (select *, array_to_string(ls[start + 1:start + length(run)], chr(10)) as body,
      last_value(case when run[1] = 'h' then ls[start + 1] end ignore nulls) over (partition by doc_id order by run_no) as title
      from p),
u as (select doc_id, run_no, 0 as part, 'heading' as element_type, title as text, title as section_title from t where run[1] = 'h'
  union all select doc_id, run_no, 1, 'section', body, title from t where run[1] = 'h' and length(run) > 1
  union all select doc_id, run_no, 0, 'list', body, title from t where run[1] = 'b'
  union all select doc_id, run_no, 0, 'table', body, title from t where run = 't' or regexp_matches(run, '^[tk]{{2,}}$')
  union all select doc_id, run_no, 0, case when title is null then 'paragraph' else 'section' end, body, title from t
    where regexp_matches(run, '^(kx*|x+)$') and (title is null or body != title)),
el as (select doc_id, row_number() over (partition by doc_id order by run_no, part) - 1 as element_order,
  element_type, text, section_title from u)
""".replace("['', *runs[1:i - 1]]", "list_prepend('', runs[1:i - 1])")


@query("extract_elements", f"with {LINES}, {ELEMENTS} select * from el")
def _(spark, sf):
    found = st.extract_elements(structured_documents(spark, sf).select("doc_id", "text"))
    return found.select("doc_id", "element_order", "element_type", "text", "section_title")


# Heading paths by stepping through the headings of each document.
HEADS = f"""
hd as (select doc_id, section_title as line, element_order, row_number() over (partition by doc_id order by element_order) as hn
  from el where element_type = 'heading'),
hl as (select hd.*, k.lv from hd join (select doc_id, line, lv, line_no, row_number() over (partition by doc_id order by line_no) as hn
  from k3) k on k.doc_id = hd.doc_id and k.hn = hd.hn),
w as (select doc_id, hn, lv as level, [{{'l': lv, 't': line}}] as stack from hl where hn = 1
  union all
  select doc_id, hn, lv, list_append(list_filter(stack, lambda q: q.l < lv), {{'l': lv, 't': line}}) from (
    select hl.doc_id, hl.hn, w.stack, hl.line, case when {S.colon_end('hl.line')} then
      case when {S.colon_end('w.stack[-1].t')} then w.stack[-1].l else least(6, w.stack[-1].l + 1) end else hl.lv end as lv
    from w join hl on hl.doc_id = w.doc_id and hl.hn = w.hn + 1)),
heads as (select hl.doc_id, hl.element_order, hl.line as heading, w.level::bigint as heading_level,
  array_to_string(list_transform(stack, lambda q: q.t), ' > ') as section_path
  from w join hl on hl.doc_id = w.doc_id and hl.hn = w.hn)
"""
# Heading lines in document order: the lines whose run letter is h.
HEAD_LINES = f"""
k3 as (select doc_id, line_no, line, {S.heading_level('line', 'nxt')} as lv from (
  select g.doc_id, unnest(g.ls) as line, unnest(range(len(g.ls))) as line_no,
    unnest(list_transform(range(len(g.ls)), lambda i: g.ls[i + 2])) as nxt, unnest(string_split(g.kinds, '')) as kind from g)
  where kind = 'h')
"""


@query(
    "section_paths",
    f"with recursive {LINES}, {ELEMENTS}, {HEAD_LINES}, {HEADS} select * from heads",
)
def _(spark, sf):
    found = st.section_paths(structured_documents(spark, sf).select("doc_id", "text"))
    return found.select("doc_id", "element_order", "heading", "heading_level", "section_path")


# A Markdown text made of every document: heading, fenced first line, a pipe table, the text.
MARKDOWN_SQL = """
m as (select doc_id, source, lang, '# ' || source || chr(10) || '```' || chr(10) || lang || ' = ' || doc_id || chr(10) || '```'
  || chr(10) || '| name | value |' || chr(10) || '|---|---|' || chr(10) || '| chars | ' || n_chars || ' |' || chr(10)
  || '| doc | ' || doc_id || ' |' || chr(10) || chr(10) || '## ' || lang || chr(10) || '- first' || chr(10) || '- second' || chr(10)
  || chr(10) || text as text from documents)
"""


def markdown_documents(spark, sf_dir):
    doc, chars = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    text = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n```\n"), F.col("lang"), F.lit(" = "), doc, F.lit("\n```\n"),
        F.lit("| name | value |\n|---|---|\n| chars | "), chars, F.lit(" |\n| doc | "), doc,
        F.lit(" |\n\n## "), F.col("lang"), F.lit("\n- first\n- second\n\n"), F.col("text"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("text"))


@query(
    "code_blocks",
    rf"""with {MARKDOWN_SQL}, c as (select doc_id, text, regexp_extract_all(text, '{P.CODE_FENCE}') as cs from m)
    select doc_id, unnest(range(len(cs))) as block_no, unnest(cs) as code,
    length(regexp_replace(text, '{P.CODE_FENCE}', '', 'g')) as rest_chars from c""",
)
def _(spark, sf):
    found = st.code_blocks(markdown_documents(spark, sf))
    return found.select("doc_id", "block_no", "code", F.length("without_code").cast("long").alias("rest_chars"))


def _counts(where):
    return f"count(*) filter (where {where})"


@query(
    "build_outline",
    f"""with recursive {LINES}, {ELEMENTS}, {HEAD_LINES}, {HEADS},
    c as (select el.doc_id, count(*) as n, {_counts("element_type = 'table'")} as nt, {_counts("element_type = 'list'")} as nl,
      {_counts("element_type in ('section', 'paragraph')")} as nb,
      string_agg(repeat('  ', heading_level - 1) || '- ' || text, chr(10) order by el.element_order)
        filter (where element_type = 'heading') as hs
      from el left join heads on heads.doc_id = el.doc_id and heads.element_order = el.element_order group by el.doc_id)
    select d.doc_id, 'Document structural outline' || chr(10) || 'document_id: ' || d.doc_id || chr(10) || 'source: ' || d.source
      || chr(10) || 'file_type: ' || {FILE_TYPE_SQL} || chr(10) || 'elements: ' || coalesce(n, 0) || chr(10) || 'tables: ' || coalesce(nt, 0)
      || chr(10) || 'lists: ' || coalesce(nl, 0) || chr(10) || 'headings:' || chr(10)
      || coalesce(hs, '- Document sections: ' || coalesce(nb, 0)) as outline
    from sd d left join c on c.doc_id = d.doc_id""",
)
def _(spark, sf):
    typed = with_file_type(structured_documents(spark, sf))
    return st.build_outline(typed, "doc_id", "source", "file_type").select("doc_id", "outline")


@query(
    "parse_quality",
    f"""with {LINES}, {ELEMENTS},
    c as (select doc_id, {_counts("element_type = 'heading'")} as nh, {_counts("element_type in ('section', 'paragraph')")} as nb
      from el group by doc_id)
    select d.doc_id, case when {S.strip('d.text')} = '' then 0 else
      round(0.55 + case when length(d.text) > 200 then 0.15 else 0 end + case when coalesce(nh, 0) > 0 then 0.15 else 0 end
      + case when coalesce(nb, 0) >= 2 then 0.1 else 0 end, 3) end::double as parse_quality
    from sd d left join c on c.doc_id = d.doc_id""",
)
def _(spark, sf):
    return st.parse_quality(structured_documents(spark, sf)).select("doc_id", "parse_quality")


@query(
    "document_title",
    f"""with {LINES}, {ELEMENTS},
    c as (select doc_id, arg_min(text, element_order) filter (where element_type = 'heading') as title from el group by doc_id)
    select d.doc_id, coalesce(title, d.source) as title from sd d left join c on c.doc_id = d.doc_id""",
)
def _(spark, sf):
    return st.document_title(structured_documents(spark, sf), "source").select("doc_id", "title")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CELLS = " union all ".join(
    f"select '{c}' as column_name, coalesce({c}::varchar, '') as value from orders" for c in ORDER_COLUMNS
)
COLUMN_PROFILE = f"""
cells as ({CELLS}),
vc as (select column_name, value, count(*) as n from cells group by all),
cp as (select column_name, sum(n)::bigint as row_count, (sum(n) filter (where value = ''))::bigint as blank,
  (sum(n) filter (where value != ''))::bigint as filled, count(*) filter (where value != '') as nd,
  (sum(n) filter (where value != '' and try_cast(replace(value, ',', '') as double) is not null))::bigint as nn,
  (sum(n) filter (where value != '' and regexp_matches(value, '{P.DATE_LIKE}')))::bigint as nt,
  min(try_cast(replace(value, ',', '') as double)) as mn, max(try_cast(replace(value, ',', '') as double)) as mx,
  sum(try_cast(replace(value, ',', '') as double) * n) as sm from vc group by column_name),
ct as (select *, case when coalesce(filled, 0) = 0 then 'empty' when coalesce(nn, 0) / filled >= 0.8 then 'numeric'
  when coalesce(nt, 0) / filled >= 0.6 then 'date' when nd / filled <= 0.5 then 'categorical' else 'text' end as column_type from cp)
"""


@query("infer_column_types", f"with {COLUMN_PROFILE} select column_name, column_type from ct")
def _(spark, sf):
    return st.infer_column_types(table(spark, sf, "orders"), ORDER_COLUMNS)


@query(
    "profile_table",
    f"""with {COLUMN_PROFILE},
    b as (select *, row_number() over (partition by column_name order by n desc, value) as rank from vc where value != ''),
    tp as (select column_name, string_agg(value || '(' || n || ')', '; ' order by rank) as tops from b where rank <= 5 group by 1)
    select ct.column_name, column_type, row_count, coalesce(blank, 0) as missing,
      case when column_type = 'numeric' then round(mn, 4) end as min_value,
      case when column_type = 'numeric' then round(mx, 4) end as max_value,
      case when column_type = 'numeric' then round(sm, 4) end as sum_value,
      case when column_type = 'numeric' then round(sm / nn, 4) end as avg_value,
      case when column_type != 'numeric' then tops end as top_values
    from ct left join tp on tp.column_name = ct.column_name""",
)
def _(spark, sf):
    profile = st.profile_table(table(spark, sf, "orders"), ORDER_COLUMNS)
    return profile.withColumns({c: F.round(c, 4) for c in ("min_value", "max_value", "sum_value", "avg_value")})


@query(
    "row_groups",
    """with n as (select *, row_number() over (order by o_orderkey) as rn from orders)
    select (rn - 1) // 50 as group_no, min(rn) || '-' || max(rn) as row_range,
      'o_custkey | o_orderstatus | o_orderpriority' || chr(10) || string_agg('o_custkey=' || o_custkey || ', o_orderstatus=' || o_orderstatus
      || ', o_orderpriority=' || o_orderpriority, chr(10) order by rn) as text from n group by 1""",
)
def _(spark, sf):
    return st.row_groups(
        table(spark, sf, "orders"), "o_orderkey", 50, ["o_custkey", "o_orderstatus", "o_orderpriority"]
    )


def page_spans(spark, sf_dir):
    """Text spans of every page: heading and body tags with the size a browser gives them."""
    # Up to the next tag of a block, which is not taken in: it may open the next span.
    tag = r"<(h1|h2|h3|li|p)>(.*?)(?=</?(?:h1|h2|h3|li|p|ul|article|body|html)>|$)"
    found = F.regexp_extract_all("html", F.lit(rf"(?s){tag}"), F.lit(0))
    pages = unfold(table(spark, sf_dir, "pages"), [F.col("page_id").alias("doc_id")], found, "pos", "m")
    name = F.regexp_extract("m", "^<([a-z0-9]+)>", 1)
    text = T.squeeze(F.regexp_replace("m", r"<[^>]*>", " "))
    size = F.when(name == "h1", 24.0).when(name == "h2", 18.0).when(name == "h3", 14.0).otherwise(12.0)
    return pages.select(
        "doc_id", F.lit(1).alias("page"), "pos", text.alias("text"), size.alias("size"),
        F.col("m").contains("<b>").alias("bold"), F.lit(None).cast("string").alias("style"),
    ).filter("text != ''")


@query("sections_from_spans")
def _(spark, sf):
    return st.sections_from_spans(page_spans(spark, sf))
