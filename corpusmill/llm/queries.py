"""The registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm.chat_format import chat_digests, format_chats
from corpusmill.llm.collocations import collocations
from corpusmill.llm.exact_search import exact_top_k
from corpusmill.llm.license_scan import scan_licenses
from corpusmill.llm.mixing import mix_sources
from corpusmill.llm.ngram_join import ngram_jaccard_join
from corpusmill.llm.packing import best_fit_pack
from corpusmill.llm.periodic_runs import periodic_runs, run_digests
from corpusmill.llm.quality_rules import quality_verdicts
from corpusmill.llm.substring_dedup import substring_dedup
from corpusmill.llm.token_files import token_round_trip
from corpusmill.llm.toxicity import fit_toxicity, is_held_out, score_toxicity
from corpusmill.llm.vector_dedup import near_duplicate_vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOW = WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@query(
    "op1_ngram_join",
    f"""with recursive w as (select doc_id, coalesce({_LOW}, []) w from documents),
    s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from w),
    n as (select doc_id, count(*) n from s group by doc_id),
    o as (select a.doc_id a, b.doc_id b, count(*) o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
    d as (select a doc_id, count(*) k from l group by a),
    r(doc_id, c) as (select a, a from l union select l.b, r.c from r join l on l.a = r.doc_id),
    m as (select doc_id, min(c) c from r group by doc_id)
    select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(m.c, w.doc_id) component_id,
        coalesce(d.k, 0)::bigint n_links
    from w left join n using (doc_id) left join d using (doc_id) left join m using (doc_id)""",
)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"))


_RAW = WORDS.format("text")


@query(
    "op4_substring_dedup",
    f"""with w as (select doc_id, coalesce({_RAW}, []) w from documents),
    s as (select doc_id, unnest(range(1, len(w) - 18)) p, w from w where len(w) >= 20),
    g as (select doc_id, p, row_number() over (partition by array_to_string(w[p:p + 19], ' ') order by doc_id, p) r from s),
    c as (select distinct doc_id, unnest(range(p, p + 20)) p from g where r > 1),
    k as (select u.doc_id, count(c.p) g, coalesce(string_agg(x, ' ' order by p) filter (c.p is null), '') t
        from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from w) u left join c using (doc_id, p) group by 1)
    select w.doc_id, len(w)::bigint n_words, coalesce(g, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
    from w left join k using (doc_id)""",
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op6_quality_rules",
    rf"""with t as (select doc_id, coalesce(text, '') text, coalesce({_RAW}, []) w from documents),
    l as (select doc_id, count(*) n, count(distinct x) d from
        (select doc_id, unnest(string_split(text, chr(10))) x from t) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
    v as (select doc_id, p, array_to_string(w[p:p + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) p from t)),
    r as (select doc_id, p from v qualify count(*) over (partition by doc_id, g) > 1),
    c as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + 8)) q from r) group by 1),
    m as (select t.doc_id, len(w)::bigint n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(l.n, 0)::bigint n_lines,
        coalesce(l.n - l.d, 0)::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words
        from t left join l using (doc_id) left join c using (doc_id)),
    b as (select *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, n_words > 1000000, word_chars < 2 * n_words,
        word_chars > 20 * n_words, 10 * n_symbols > 3 * n_words, 10 * n_dup_lines > 6 * n_lines] f from m)
    select * exclude (f), list_sum(list_transform(f, lambda x, i: case when x then 1 << (i - 1) else 0 end))::bigint failed,
        f[1] or f[2] base_failed, not list_bool_or(f) kept from b""",
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"))


#: A conversation whose texts hold the marks of a template.
TRICKY = r"\### Assistant: </turn> ok"

_ESCAPED = r"regexp_replace(replace(text, '\', '\e'), '<(turn:|/turn>|part/>)', '\\l\1', 'g')"


@query(
    "op7_chat_format",
    rf"""with t as (select conv_id, turn, role, coalesce(text, '') text from conversations
        union all select -7, 0, 'user', '{TRICKY}' union all select -7, 1, 'assistant', '{TRICKY}'),
    e as (select *, lag(role) over (partition by conv_id order by turn, role, text) is not distinct from role s, {_ESCAPED} x from t)
    select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
        sum(length(x) + case when s then 7 else 16 + length(role) end)::bigint formatted_chars from e group by conv_id""",
)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(TRICKY).alias("text"))
    return chat_digests(format_chats(turns.unionByName(tricky)))


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


@query(
    "op8_exact_top_k",
    """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) x from embeddings
        where vec_id is not null and len(embedding) > 0 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))))
    select query_id, rank::int rank, vec_id, score from (
        select q.vec_id query_id, v.vec_id, list_dot_product(q.x, v.x)::bigint score,
            row_number() over (partition by q.vec_id order by list_dot_product(q.x, v.x) desc, v.vec_id) rank
        from v q join v on q.vec_id <> v.vec_id and len(q.x) = len(v.x) where q.vec_id % 50 = 0) where rank <= 5""",
)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


@query(
    "op11_vector_dedup",
    """with v as (select vec_id, list_transform(embedding, lambda x: x::double) x from embeddings where vec_id is not null and len(embedding) > 0
        and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
        and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.9),
    d as (select a vec_id, count(*) n from l group by 1),
    r(vec_id, c) as (select a, a from l union select l.b, r.c from r join l on l.a = r.vec_id),
    m as (select vec_id, min(c) c from r group by 1)
    select vec_id, coalesce(n, 0)::bigint n_links, coalesce(c, vec_id) component_id, coalesce(c = vec_id, true) kept
    from embeddings left join d using (vec_id) left join m using (vec_id)""".replace("with v", "with recursive v", 1),
)
def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


@query(
    "op12_collocations",
    r"""with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
    w as (select lang, row_number() over () piece, regexp_extract_all(p, '[^\x20\x09]+') w from p),
    u as (select lang, piece, unnest(w) x, unnest(range(len(w))) i from w),
    t as (select lang, x, lead(x) over v y, lead(x, 2) over v z from u window v as (partition by piece order by i)),
    n as (select lang, count(*) n from u group by 1),
    f1 as (select lang, x, count(*) a from t group by 1, 2 having count(*) >= 10),
    f2 as (select lang, x, y, count(*) a from t where y is not null group by 1, 2, 3 having count(*) >= 10),
    f3 as (select lang, x, y, z, count(*) a from t where z is not null group by 1, 2, 3, 4 having count(*) >= 10),
    c as (select lang, x || ' ' || y phrase, x, y, null z, f2.a, 1 k, l.a l, r.a r
            from f2 join f1 l using (lang, x) join (select lang, x y, a from f1) r using (lang, y)
        union all select lang, x || ' ' || y || ' ' || z, x, y, z, f3.a, 1, l.a, r.a
            from f3 join f1 l using (lang, x) join (select lang, x y, y z, a from f2) r using (lang, y, z)
        union all select lang, x || ' ' || y || ' ' || z, x, y, z, f3.a, 2, l.a, r.a
            from f3 join f2 l using (lang, x, y) join (select lang, x z, a from f1) r using (lang, z)),
    s as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint score from c),
    m as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    i as (select lang, x, y, max(a) longer from (select lang, x, y, a from f3 union all select lang, y, z, a from f3) group by 1, 2, 3),
    q as (select m.* from m left join i on i.lang = m.lang and i.x = m.x and i.y = m.y and m.z is null where longer is null or 100 * longer < 50 * m.a)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score
    from q join n using (lang) qualify rank <= 2000""",
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text; in a tenth of the documents those from some place on repeat the first of them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(read(spark, sf_dir, "documents"), prepare=repeating))


QUERIES["pipeline"] = corpus_pipeline.run
