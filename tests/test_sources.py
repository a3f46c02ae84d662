"""Files, Word documents, stores and decisions about models' answers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import adapters, documents, tables
from inkstrata.sources import docx, files, store

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def word_file() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {W}><w:body><w:p><w:r><w:rPr><w:highlight w:val="yellow"/></w:rPr><w:t>Hello</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>here</w:t></w:r></w:hyperlink></w:p><w:p><w:ins w:author="Ann"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:author="Bob"><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body></w:document>')
        z.writestr("word/comments.xml", f'<w:comments {W}><w:comment w:author="Cy"><w:p><w:r><w:t>why?</w:t></w:r></w:p></w:comment></w:comments>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="http://x.org"/></Relationships>')
    return out.getvalue()


def test_word_documents(spark):
    rows = spark.createDataFrame([(1, bytearray(word_file())), (2, bytearray(b"no zip")), (3, None)], "doc_id long, content binary")
    got = docx.read_annotations(rows).collect()
    assert {(r.kind, r.author, r.text, r.target) for r in got if r.doc_id == 1} == {("paragraph", None, "Hellohere", None), ("paragraph", None, "newold", None), ("comment", "Cy", "why?", None), ("link", None, "here", "http://x.org"), ("insertion", "Ann", "new", None), ("deletion", "Bob", "old", None), ("highlight", None, "Hello", "yellow")}
    assert all(r.error for r in got if r.doc_id > 1) and len([r for r in got if r.doc_id > 1]) == 2


def test_kinds_and_decoding(spark):
    df = spark.createDataFrame([("a/B.PDF",), ("c.eml",), ("d",), ("e.xyz",)], "p string")
    assert [tuple(r) for r in df.select(files.mime_of(F.col("p")), files.kind_of(F.col("p"))).collect()] == [("application/pdf", "pdf"), ("message/rfc822", "email"), (None, "unknown"), (None, "unknown")]
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xef\xbb\xbfx"),), (bytearray(b"\xe9t\xe9"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(files.decoded(F.col("b"))).collect()] == ["é", "x", "été", None]


def test_store_keeps_the_latest(spark, tmp_path):
    schema = "doc_id long, status string, needs_review boolean"
    store.save(spark.createDataFrame([(1, "pending", True), (2, "pending", False)], schema), str(tmp_path / "s"), 1)
    store.save(spark.createDataFrame([(1, "approved", True)], schema), str(tmp_path / "s"), 2)
    store.save(spark.createDataFrame([(1, "approved", True)], schema), str(tmp_path / "s"), 2)
    now = store.load(spark, str(tmp_path / "s"))
    assert {r.doc_id: r.status for r in now.collect()} == {1: "approved", 2: "pending"}
    assert [r.doc_id for r in store.by_status(now, "pending").collect()] == [2] and store.by_status(now, "pending_review").count() == 0
    with pytest.raises(ValueError):
        store.by_status(now, "lost")


def test_log_history(spark, tmp_path):
    rows = spark.createDataFrame([(i, ("a" if i % 2 else "b",), i / 10) for i in range(6)], "time int, tags struct<team: string>, score double")
    store.append_log(rows.where("time < 3"), str(tmp_path / "log"))
    store.append_log(rows.where("time >= 3"), str(tmp_path / "log"))
    assert [r.time for r in store.history(spark, str(tmp_path / "log"), last=2, tags={"team": "a"}).collect()] == [3, 5]
    assert store.history(spark, str(tmp_path / "log")).count() == 6


def test_weak_pages(spark):
    df = spark.createDataFrame([("short", 1, False), ("long enough to be a page of text", 1, False), ("long enough to be a page of text", 0, False), ("long enough to be a page of text", 1, True), ("\uf001" * 30, 1, False)], "t string, n int, i boolean")
    assert [r[0] for r in df.select(documents.is_weak(F.col("t"), F.col("n"), F.col("i"))).collect()] == [True, False, True, True, True]


def test_headers_span_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1, 1, "", False, True), (0, 1, 1, 2, "Year", True, False), (1, 0, 2, 1, "Sales", False, True), (1, 1, 1, 1, "5", False, False), (2, 2, 1, 1, "6", False, False), (3, 1, 1, 1, "7", False, False)], "row int, col int, row_span int, col_span int, text string, col_header boolean, row_header boolean").withColumn("t", F.lit(1))
    assert {r.text: (r.col_headers, r.row_headers) for r in tables.resolve_headers(cells, ["t"]).collect()} == {"5": (["Year"], ["Sales"]), "6": (["Year"], ["Sales"]), "7": (["Year"], [])}


def test_decisions(spark):
    answers = spark.createDataFrame([(1, "invoice", 0.9, None), (2, "invoice", 0.4, None), (3, "poem", 0.9, None), (4, None, None, "down")], "doc_id long, name string, confidence double, error string")
    assert {r.doc_id: (r.workflow, r.reason) for r in adapters.decide_workflow(answers, ["invoice"]).collect()} == {1: ("invoice", None), 2: (None, "little confidence"), 3: (None, "not registered"), 4: (None, "error: down")}
    pages = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page int")
    out = adapters.split_sections(spark.createDataFrame([(1, '{"a": [1, 0, 7]}'), (2, "not json")], "doc_id long, output string"), pages).collect()
    assert [tuple(r) for r in out] == [(1, "a", [0, 1], [7])]
