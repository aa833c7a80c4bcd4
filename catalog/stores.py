"""Sources and sinks: files and indexes are written from the tables into the scratch folder."""

from pyspark.sql import functions as F

from catalog.chunks import paragraph_chunks
from catalog.quality import COMPARISON_TABLE_SQL, QUEUE_SQL, queue, runs
from catalog.registry import query, table
from corpusmill.functions.session import scratch_dir
from corpusmill.sources import files as fs
from corpusmill.sources import index as ix
from corpusmill.sources import logs


#: Rows of a text file, at most.
FILE_ROWS = 100

#: Files that give no text, are empty or not in UTF-8.
ODD_FILES = {
    "empty.txt": b"", "blank.txt": b" \n\n", "latin.txt": b"caf\xe9 \xff\xfe\x80", "notes.md": b"# Notes\n\nline\n", "table.csv": b"a,b\n1,2\n",
    "paper.pdf": b"%PDF-1.4\n\x00\xff", "letter.docx": b"PK\x03\x04\x00", "picture.png": b"\x89PNG",
}


def text_folder(spark, sf):
    """Text files of the documents, one folder per source, each task writing files of bounded size; and a folder of odd ones."""
    path = scratch_dir(spark, "texts")
    docs = table(spark, sf, "documents").select(F.col("source").alias("folder"), "text")
    docs.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("folder").text(path)
    jvm = spark._jvm
    for name, content in ODD_FILES.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/odd/{name}")
        out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    return path


@query("read_corpus")
def _(spark, sf):
    read = fs.read_corpus(spark, text_folder(spark, sf), recursive=True)
    return read.select("source", "file_type", F.length("text").alias("chars"))


@query("load_with_errors")
def _(spark, sf):
    loaded = fs.load_with_errors(spark, text_folder(spark, sf), recursive=True)
    return loaded.select("file_type", "status", "error", F.length("text").alias("chars"))


@query("decode_text", "select doc_id, text from documents")
def _(spark, sf):
    """A third of the rows in UTF-8 with a mark, the others without."""
    mark = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    raw = table(spark, sf, "documents").select("doc_id", F.concat(mark, F.encode("text", "UTF-8")).alias("content"))
    return fs.decode_text(raw).select("doc_id", "text")


@query(
    "read_csv_rows",
    """select 'p_partkey: ' || p_partkey || chr(10) || 'p_name: ' || p_name || chr(10) || 'p_retailprice: ' || p_retailprice as text, '.csv' as file_type from part""",
)
def _(spark, sf):
    path = scratch_dir(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").write.option("header", True).csv(path)
    return fs.read_csv_rows(spark, path).select("text", "file_type")


@query("stable_document_id", "select page_id, 'doc-' || sha1(url || ':' || length(html) || ':' || page_id)[1:16] as document_id from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", fs.stable_document_id(F.col("url"), F.length("html"), F.col("page_id")).alias("document_id")
    )


@query(
    "attach_upload_metadata",
    """select doc_id, doc_id::varchar as source_document_id, source as session_id, source || ':' || sha256(source || '|' || lang || '.txt|' || doc_id)[1:32] as document_id,
    lang || '.txt' as upload_filename, 'ready' as ingest_status from documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("document_id", F.col("doc_id"))
    name = F.concat("lang", F.lit(".txt"))
    out = fs.attach_upload_metadata(docs, F.col("source"), name, F.current_timestamp(), F.lit("request"))
    return out.select("doc_id", "source_document_id", "session_id", "document_id", "upload_filename", "ingest_status")


CHUNKS_SQL = """ck as (select doc_id, source as session_id, lang as source, n_chars, unnest(range(len(s))) as chunk_index
  from (select *, range(0, length(text), 462) as s from documents))"""


def built_index(spark, sf):
    path = scratch_dir(spark, "index")
    ix.index_append(paragraph_chunks(spark, sf), path)
    return path


@query("index_append", f"with {CHUNKS_SQL} select session_id, count(*) as chunks, 1 as generation from ck group by 1")
def _(spark, sf):
    path = built_index(spark, sf)
    live = ix.index_read(spark, path)
    return live.groupBy("session_id").agg(F.count("*").alias("chunks"), F.max("generation").alias("generation"))


@query(
    "index_delete",
    f"""with {CHUNKS_SQL} select session_id, source, count(*) as chunks from ck
    where not (source = 'fr' and session_id = 'src1') and session_id != 'src2' and source != 'de' and chunk_index != 3 group by all""",
)
def _(spark, sf):
    path = built_index(spark, sf)
    ix.index_delete(spark, path, {"source": "fr", "session_id": "src1", "document_id": None})
    ix.index_delete_by_session(spark, path, "src2")
    ix.index_delete_by_source(spark, path, "de")
    ix.index_delete_by_ids(spark, path, ix.index_read(spark, path).filter("chunk_index = 3"))
    return ix.index_read(spark, path).groupBy("session_id", "source").agg(F.count("*").alias("chunks"))


@query("index_clear", f"with {CHUNKS_SQL} select count(*) as chunks, 3 as generation from ck")
def _(spark, sf):
    """Filled, cleared and filled again: only the last fill counts."""
    path = built_index(spark, sf)
    ix.index_clear(spark, path)
    ix.index_append(paragraph_chunks(spark, sf), path)
    return ix.index_read(spark, path).agg(F.count("*").alias("chunks"), F.max("generation").alias("generation"))


@query("index_count", f"with {CHUNKS_SQL} select count(*) as chunks from ck")
def _(spark, sf):
    return ix.index_read(spark, built_index(spark, sf)).agg(F.count("*").alias("chunks"))


@query("list_sources", "select distinct case when source = 'src3' then 'older ' || lang else source end as source from documents")
def _(spark, sf):
    index = table(spark, sf, "documents").select(
        F.when(F.col("source") != "src3", F.col("source")).alias("source"), F.concat(F.lit("older "), "lang").alias("source_file")
    )
    return ix.list_sources(index)


@query(
    "list_session_documents",
    f"""with {CHUNKS_SQL}, x as (select session_id, case when doc_id % 5 = 0 then '' else doc_id::varchar end as document_id, source, chunk_index,
      case when chunk_index = 0 then '' else 'plan ' || chunk_index end as chunk_plan_reason, n_chars as uploaded_at, doc_id from ck),
    y as (select *, coalesce(nullif(document_id, ''), source) as d from x)
    select session_id, d as document_id, count(*) as chunks, count(*) as indexed,
      arg_min(chunk_plan_reason, chunk_index * 100000 + doc_id) filter (where chunk_plan_reason != '') as chunk_plan_reason from y group by all""",
)
def _(spark, sf):
    chunks = paragraph_chunks(spark, sf).select(
        "session_id", "document_id", "source", "chunk_index",
        F.when(F.col("chunk_index") == 0, "").otherwise(F.concat(F.lit("plan "), F.col("chunk_index").cast("string"))).alias("chunk_plan_reason"),
        F.col("n_chars").alias("uploaded_at"), "doc_id",
    )
    marked = chunks.withColumn("document_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("document_id")))
    listed = ix.list_session_documents(marked)
    return listed.select("session_id", "document_id", "chunks", "indexed", "chunk_plan_reason")


@query("append_json_log", f"with {QUEUE_SQL} select query_id, array_to_string(reasons, ',') as reasons from qu")
def _(spark, sf):
    path = scratch_dir(spark, "log")
    rows = queue(spark, sf).select("query_id", F.array_join("trigger_reasons", ",").alias("reasons"))
    logs.append_json_log(rows.filter("query_id % 2 = 0"), path)
    logs.append_json_log(rows.filter("query_id % 2 = 1"), path)
    return spark.read.schema("query_id long, reasons string").json(path)


@query("write_comparison_csv", COMPARISON_TABLE_SQL)
def _(spark, sf):
    path = scratch_dir(spark, "summary")
    written = logs.write_comparison_csv(runs(spark, sf), path)
    read = spark.read.schema(written.schema).option("header", True).csv(path)
    return read.na.fill("")
