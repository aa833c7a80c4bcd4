from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from catalog import stores
from corpusmill.plans.ingest import ingest
from corpusmill.sources import files as fs
from corpusmill.sources import index as ix
from corpusmill.streaming.ingest import stream_ingest

TABLES = "/root/testdata/sf0.001"


def test_text_files_are_bounded_and_whole(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    path = stores.text_folder(spark, TABLES)
    lines = spark.read.text(f"{path}/folder=*").groupBy(F.input_file_name().alias("file")).count().collect()
    whole = docs.agg(F.sum(F.size(F.split("text", "\r\n|\r|\n")))).first()[0]
    assert sum(r["count"] for r in lines) == whole
    rows = spark.read.option("lineSep", "\0").text(f"{path}/folder=*").count()
    assert rows == len(lines) > docs.select("source").distinct().count()


def test_error_branch_runs(spark):
    """Every supported file has one row, empty.txt too."""
    loaded = __spark_entry__.queries()["load_with_errors"](spark, TABLES).filter("file_type <> '.txt' or status = 'error' or chars < 20").collect()
    found = sorted((r.file_type, r.status, r.error or "") for r in loaded)
    assert found == [
        (".csv", "ok", ""), (".docx", "error", "binary format, decoded outside"), (".md", "ok", ""), (".pdf", "error", "binary format, decoded outside"),
        (".txt", "error", "no text"), (".txt", "error", "no text"), (".txt", "ok", ""),
    ]


def test_files_of_zero_bytes_have_a_status(spark, tmp_path):
    for name, content in {"a b+c%20é.txt": b"", "e.md": b"", "full.txt": b"x", "picture.png": b"", "sub/deep.csv": b"", "sub/t.txt": b"y"}.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(content)
    found = sorted((r.source, r.status) for r in fs.load_with_errors(spark, str(tmp_path), recursive=True).collect())
    assert found == [("a b+c%20é.txt", "error"), ("deep.csv", "error"), ("e.md", "error"), ("full.txt", "ok"), ("t.txt", "ok")]
    assert len([r for r in fs.load_with_errors(spark, str(tmp_path)).collect()]) == 3


def documents_stream(spark, folder):
    schema = "doc_id long, text string, session_id string, source string, file_type string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_batch_that_failed_is_neither_doubled_nor_lost(spark, tmp_path, monkeypatch):
    folder, path, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    schema = "doc_id long, text string, session_id string, source string, file_type string"
    for part in range(3):
        rows = [(10 * part + i, f"Text {part} {i}.", f"s{i % 2}", "a.txt", ".txt") for i in range(4)]
        spark.createDataFrame([*rows, (1, "again", "s0", "a.txt", ".txt")], schema).coalesce(1).write.mode("append").parquet(folder)
    record, calls = ix._record, []

    def failing(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost between the data and the record")
        record(*args)

    monkeypatch.setattr(ix, "_record", failing)
    with pytest.raises(Exception, match="lost between"):
        stream_ingest(documents_stream(spark, folder), path, checkpoint, "recursive").awaitTermination()
    assert ix.index_read(spark, path).select("document_id").distinct().count() < 12
    monkeypatch.setattr(ix, "_record", record)

    def whole():
        found = Counter(r.document_id for r in ix.index_read(spark, path).collect())
        assert len(found) == 12 and set(found.values()) == {1}

    stream_ingest(documents_stream(spark, folder), path, checkpoint, "recursive").awaitTermination()
    whole()
    # lost after the record, before the stream noted the batch as done
    generation, last = ix.index_generation(spark, path), tmp_path / "checkpoint" / "commits"
    for name in ("2", ".2.crc"):
        (last / name).rename(tmp_path / f"gone{name}")
    stream_ingest(documents_stream(spark, folder), path, checkpoint, "recursive").awaitTermination()
    whole()
    assert ix.index_generation(spark, path) == generation


def test_stream_ingest_has_two_chunks_of_every_document_as_its_sql(spark, tmp_path):
    """Blank lines within a text, a text of blanks and an empty one too; without a text there is no document."""
    texts = ["Plain.", "One.\n\nTwo.\n \t\nThree.", "", " \n\n", "\n  \nLast.", None]
    rows = [(i, text, "en", f"src{i % 2}", len(text or "")) for i, text in enumerate(texts)]
    rows += [(10, "No source.", "en", None, 10), (11, "Empty source.", "en", "", 13)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = connection.sql(__spark_entry__.oracle_sql()["stream_ingest"]).fetchall()
    found = __spark_entry__.queries()["stream_ingest"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected) == [(str(i), 2) for i in (0, 1, 11, 2, 3, 4)]


@pytest.mark.parametrize("strategy", ["recursive", "paragraph"])
def test_documents_without_an_id_are_kept_and_not_added_again(spark, tmp_path, strategy):
    folder, path = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id long, text string, session_id string, source string, file_type string"
    rows = [(None, "First.", "s0", "a.txt", ".txt"), (None, "Second.", "s0", "a.txt", ".txt"), (7, "Third.", "s0", "a.txt", ".txt")]
    spark.createDataFrame(rows, schema).write.parquet(folder)
    for delivery in ("first", "second"):
        stream_ingest(documents_stream(spark, folder), path, str(tmp_path / delivery), strategy).awaitTermination()
    found = ix.index_read(spark, path)
    assert dict(found.dtypes)["doc_id"] == "bigint"
    assert sorted((r.text, r.doc_id, r.document_id, r.chunk_index) for r in found.collect()) == [
        ("First.", None, None, 0), ("Second.", None, None, 0), ("Third.", 7, "7", 0)
    ]
    assert found.select("chunk_id").distinct().count() == 3


def test_an_index_without_document_keys_takes_new_documents(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id long, text string, session_id string, source string, file_type string"
    old = spark.createDataFrame([(1, "Old.", "s0", "a.txt", ".txt")], schema)
    ingest(old, path)
    old.union(spark.createDataFrame([(None, "New.", "s0", "a.txt", ".txt"), (2, "New too.", "s0", "a.txt", ".txt")], schema)).write.parquet(folder)
    for delivery in ("first", "second"):
        stream_ingest(documents_stream(spark, folder), path, str(tmp_path / delivery), "recursive").awaitTermination()
    found = ix.index_read(spark, path).collect()
    assert sorted((r.text, r.document_id) for r in found) == [("New too.", "2"), ("New.", None), ("Old.", "1")]
