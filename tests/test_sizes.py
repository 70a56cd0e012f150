"""Steps that grow with the input: whole chains, failures that show, batches and shuffles that stay small."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.operators import emit, layout, model, reading
from foliant.operators.folds import fold
from foliant.plans import registry
from foliant.sources import detect, legacy, pdf
from foliant.sources.scan import pdf_spans, readable
from foliant.sources.zips import Members

from test_plans import plan  # isort: skip


def test_style_chains_of_any_length_end_at_their_definition(spark):
    chain = [(i, i - 1 if i else None, True if i == 0 else None) for i in range(70)]
    circle = [(100, 101, None), (101, 102, None), (102, 100, None), (103, 102, None), (104, 999, None)]
    styles = spark.createDataFrame([*chain, *circle], "style_id int, parent int, bold boolean")
    found = {r.style_id: r.bold for r in model.inherited(styles, "bold").collect()}
    assert all(found[i] is True for i in range(70))
    assert [found[i] for i in range(100, 105)] == [None] * 5 and len(found) == 75


def test_a_pdf_that_cannot_be_read_shows(spark):
    rows = spark.createDataFrame([(1, bytearray(b"%PDF-1.4 trailer << /Encrypt 1 0 R >>")), (2, None)], "doc_id long, content binary")
    found = {r.doc_id: r.error for r in pdf_spans(rows).collect()}
    assert "encrypted" in found[1] and found[2]
    with pytest.raises(Exception, match="document 1: .*encrypted"):
        readable(pdf_spans(rows.where("doc_id = 1"))).collect()


def test_members_of_archives_as_zipfile_reads_them():
    def make(comment=b"", lead=b"", method=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.writestr("a/é.xml", "x" * 500)
            z.writestr("b", b"")
            z.comment = comment
        return lead + out.getvalue()

    for data in (make(), make(b"note"), make(lead=b"lead"), make(method=zipfile.ZIP_STORED)):
        m = Members(data)
        assert m.sizes == {"a/é.xml": 500, "b": 0} and m.read("a/é.xml") == b"x" * 500 and m.read("b") == b""
    broken = bytearray(make(method=zipfile.ZIP_STORED))
    broken[60] ^= 1
    with pytest.raises(zipfile.BadZipFile):
        Members(bytes(broken)).read("a/é.xml")
    with pytest.raises(zipfile.BadZipFile):
        Members(b"PK\x03\x04 no archive")


def test_sheet_records_are_read_as_far_as_needed():
    stream = struct.pack("<HH", 0x809, 2) + b"ab" + struct.pack("<HH", 0xFC, 1) + b"c" + struct.pack("<HH", 0x3C, 1) + b"d" + b"\0" * 4000
    found = legacy.records(stream)
    assert next(found) == (0x809, b"ab", []) and next(found) == (0xFC, b"cd", [1])


def test_long_strings_and_comments_of_pdf_content():
    raw = b"(" + b"a\\(b)" * 1 + b" % no comment\n(x\\101\\\r\ny) [1 .5 -2.] <4142> /A#42 true"
    lexer = pdf.Lexer(raw)
    assert [lexer.next() for _ in range(6)] == [b"a(b", b"xAy", [1, 0.5, -2.0], b"AB", "AB", True]


def test_detection_in_python_is_the_native_one(spark):
    heads = [b"{\\rtf1", b"junk %PDF", b"x" * 1021 + b"%PDF", b"x" * 1020 + b"%PDF", b"PK\x03\x04x", b"\xd0\xcf\x11\xe0x", b"", b"%PD"]
    rows = [(i, p, bytearray(h)) for i, (p, h) in enumerate((p, h) for p in ("a.MD", "b.tar.docx", "c", "d.x/y") for h in heads)] + [(99, "n.docx", None)]
    df = spark.createDataFrame(rows, "k int, path string, content binary")
    for r in df.withColumn("f", detect.detect(F.col("path"), F.col("content"))).collect():
        assert r.f == detect.format_of(r.path, None if r.content is None else bytes(r.content)), r


def test_groups_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("int(sqrt(id)) as g", "id", "-id as v")
        found = {r.g: (r.n, r.first) for r in fold(rows, ["g"], ["v"], ["id"], lambda x: [(len(x), x[0]["id"])], "n int, first long").collect()}
        assert found == {g: (2 * g + 1, g * g + 2 * g) for g in range(10)}
        spans = spark.range(60).selectExpr("id % 2 as doc_id", "0 as page", "int(id / 2) as span_idx", "'w' as text", "double(id % 3) as x", "700 - 10.0D * int(id / 12) as y")
        lines = layout.baseline_lines(spans).groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.countDistinct("y").alias("ys")).collect()
        assert sorted((r.doc_id, r.line, r.n, r.ys) for r in lines) == [(d, i, 6, 1) for d in range(2) for i in range(5)]
        pages = spans.selectExpr("doc_id", "page", "span_idx", "text", "x * 10 as x", "y + (span_idx % 7) as y", "1.0D as width", "1.0D as font_size")
        ranks = reading.page_order(pages).groupBy("doc_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
        assert all(r.r == list(range(30)) for r in ranks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["word_gaps", "page_text", "merged_spans", "font_audit", "stream_coherence", "page_order", "spans_box", "sheet_columns"])
def test_only_texts_and_items_are_shuffled(spark, sf, name):
    assert plan(registry.queries()[name](spark, sf)).count("Exchange") == 2  # one, in the tree and in its details


def test_records_with_two_headers(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a", True), (1, 1, 0, "b", True), (1, 2, 0, "v", False), (1, 2, 1, "w", False), (2, 0, 0, "v", False)], "doc_id int, row int, col int, text string, is_header boolean")
    assert [tuple(r) for r in emit.records(cells, ["a", "b"]).collect()] == [(1, 2, "v", "v")]


def test_scripts_without_spaces_at_the_ends_of_their_ranges(spark):
    points = sorted({p + d for r in layout._NON_SPACING for p in r for d in (-1, 0, 1)} | {0x41, 0xE9, 0x1F600})
    rows = spark.createDataFrame([(p, chr(p)) for p in points] + [(0, "")], "p int, c string")
    found = {r.p: r.n for r in rows.select("p", layout.non_spacing(F.col("c")).alias("n")).collect()}
    assert found == {p: any(a <= p <= b for a, b in layout._NON_SPACING) for p in [0, *points]}
