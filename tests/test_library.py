"""Scans of every format, functions on edge values, layout, tables, hooks, streaming and the registry."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from foliant.functions import sheets, text
from foliant.operators import chunking, diagnostics, emit, hooks, layout, tables
from foliant.operators.corpus import Corpus
from foliant.plans import registry
from foliant.sources import detect, markdown, pdf
from foliant.sources.scan import parse_bytes, pdf_spans, scan, scan_bytes

sys.path.insert(0, os.path.dirname(__file__))
import builders  # noqa: E402


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, f"f{i}" + (".md" if k == "MD" else ".bin"), bytearray(make())) for i, (k, make) in enumerate(builders.ALL.items())]
    return spark.createDataFrame([*rows, (90, "x.bin", bytearray(b"hello world")), (91, "b.pdf", bytearray(b"%PDF-1.4 /Encrypt trailer << /Encrypt 1 0 R >>")), (92, "n.docx", None)], "doc_id long, path string, content binary")


@pytest.fixture(scope="module")
def parsed(files):
    return {r.doc_id: r for r in scan_bytes(files).collect()}


@pytest.mark.parametrize("i, kind", list(enumerate(builders.ALL)))
def test_every_format_has_the_tokens(parsed, i, kind):
    r = parsed[i]
    assert r.error is None and r.format == kind
    whole = "\n".join(b.text for b in r.blocks)
    assert all(t in whole for t in builders.TOKENS), whole


def test_failures_are_rows(parsed):
    assert "detect" in parsed[90].error and parsed[90].blocks == []
    assert parsed[91].is_encrypted and parsed[91].format == "PDF"
    assert parsed[92].error is not None


def test_structure(parsed):
    kinds = list(builders.ALL)
    word = parsed[kinds.index("DOCX")]
    assert [(b.kind, b.level) for b in word.blocks][:2] == [("heading", 2), ("paragraph", None)]
    assert word.metadata["title"] == "Cross-Format Test Title" and word.metadata["author"] == "Test Author"
    for k in ("DOCX", "PPTX", "ODT", "ODP", "RTF", "MD", "DOC"):
        assert [list(r) for b in parsed[kinds.index(k)].blocks if b.kind == "table" for r in b.rows] == builders.ROWS, k
    sheet = next(b for b in parsed[kinds.index("XLSX")].blocks if b.kind == "table")
    assert list(sheet.rows[-1]) == ["2024-03-15", "12%", "TRUE"] and sheet.rows[3][1] == "28"
    rich = "\n".join(b.text for b in parsed[kinds.index("RTF")].blocks)
    assert "café €" in rich
    md = parsed[kinds.index("MD")]
    assert {"heading", "paragraph", "table", "list_item", "code", "thematic_break"} <= {b.kind for b in md.blocks}


def test_corpus(spark, files, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, make in builders.ALL.items():
        (folder / f"a.{k.lower()}").write_bytes(make())
    (folder / ".hidden.md").write_bytes(b"# no")
    corpus = Corpus(scan(spark, str(folder)))
    assert corpus.count() == 12
    assert corpus.tables().where("text = 'Paris'").count() >= 7
    assert corpus.filter(F.col("format") == "MD").count() == 1
    assert corpus.filter(lambda r: r.format == "PDF" or 1 / 0).count() == 1
    assert "Acme" in corpus.filter(F.col("format") == "MD").text()
    with pytest.raises(TypeError):
        len(corpus)
    assert corpus.chunks("heading").count() > 0
    with pytest.raises(ValueError):
        corpus.chunks("nothing")
    corpus.to_jsonl(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 12
    bad = Corpus(scan_bytes(spark.createDataFrame([(1, "x", bytearray(b"?"))], "doc_id long, path string, content binary")))
    assert bad.filter(F.lit(False)).count() == 1
    with pytest.raises(Exception, match="detect"):
        bad.fail_fast().docs.collect()


def test_detection(spark):
    cases = {b"{\\rtf1": "RTF", b"x" * 1020 + b"%PDF": "PDF", b"x" * 1021 + b"%PDF": None, b"hello world": None, builders.docx(): "DOCX", builders.odp(): "ODP", builders.xls(): "XLS"}
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    got = {r.i: r.f for r in df.select("i", detect.from_bytes(F.col("c")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert detect.formats(spark).count() == 12


def test_sheet_functions(spark):
    df = spark.createDataFrame([("A1",), ("AA100",), ("XFD1048576",), ("A0",), ("1A",), ("",), ("XFE1",)], "r string")
    got = [(x.c.row, x.c.col) if x.c else None for x in df.select(sheets.cell_ref(F.col("r")).alias("c")).collect()]
    assert got == [(0, 0), (99, 26), (1048575, 16383), None, None, None, None]
    dates = {(1.0, False): "1900-01-01", (59.0, False): "1900-02-28", (60.0, False): "1900-02-29", (61.0, False): "1900-03-01", (45366.0, False): "2024-03-15", (0.5, False): "0.5", (0.0, True): "1904-01-01", (1.5, False): "1900-01-01T12:00:00", (-1.0, False): "-1"}
    df = spark.createDataFrame([(s, e, w) for (s, e), w in dates.items()], "s double, e boolean, w string")
    assert df.where(~sheets.serial_to_iso(F.col("s"), F.col("e")).eqNullSafe(F.col("w"))).collect() == []
    shown = {"1.50": "1.5", "2.0": "2", "1e3": "1e3", "x.y": "x.y", "0.1": "0.1", "-0.0": "0"}
    df = spark.createDataFrame(list(shown.items()), "v string, w string")
    assert df.where(sheets.number_display(F.col("v")) != F.col("w")).collect() == []
    names = spark.createDataFrame([(0, 0, "A1"), (99, 26, "AA100"), (0, 701, "ZZ1"), (0, 702, "AAA1"), (1048575, 16383, "XFD1048576")], "r int, c int, w string")
    assert names.where(sheets.cell_name(F.col("r"), F.col("c")) != F.col("w")).collect() == []


def test_text_functions(spark):
    df = spark.createDataFrame([("a. b",), ("a.b",), ("Wait?! Go",), ("one.\u00a0two",)], "t string")
    assert [r.s for r in df.select(text.sentences(F.col("t")).alias("s")).collect()] == [["a.", "b"], ["a.b"], ["Wait?!", "Go"], ["one.\u00a0two"]]
    assert text.parse_pages("1,3,5-7") == [0, 2, 4, 5, 6] and text.parse_pages("2,2") == [1]
    for bad in ("0", "5-3", ""):
        with pytest.raises(ValueError):
            text.parse_pages(bad)
    assert [text.parse_size(x) for x in ("256mb", "1GB", "10kb", "7")] == [256 << 20, 1 << 30, 10 << 10, 7]
    pages = spark.createDataFrame([(0,), (5,), (6,), (100,)], "n int").select(text.sampled_pages(F.col("n")).alias("p")).collect()
    assert [r.p for r in pages] == [[], [0, 1, 2, 3, 4], [0, 2, 3, 4, 5], [0, 49, 50, 51, 99]]


def test_size_chunks_and_paths(spark):
    blocks = spark.createDataFrame([(1, i, "paragraph", None, "x" * n, 0) for i, n in enumerate([4, 4, 15, 3])], "doc_id long, ord int, kind string, level int, text string, page int")
    got = chunking.by_size(blocks, 10).orderBy("chunk_index").collect()
    assert [(len(r.text), r.oversize) for r in got] == [(9, False), (15, False), (3, False)]
    heads = spark.createDataFrame([(1, 0, "heading", 1, "A", 0), (1, 1, "heading", 3, "C", 0), (1, 2, "heading", 2, "B", 0)], "doc_id long, ord int, kind string, level int, text string, page int")
    assert [r.path for r in chunking.heading_paths(heads).orderBy("ord").collect()] == [["A"], ["A", "", "C"], ["A", "B"]]


def test_layout(spark):
    schema = "doc_id long, page int, span_idx int, text string, x double, y double, width double, font_size double, font_name string, is_invisible boolean, space_width double"
    rows = [("hello", 0.0, 100.0, 20.0, 4.0), ("world", 22.1, 100.5, 20.0, None), ("next", 0.0, 80.0, 20.0, None), ("fused", 22.0, 80.0, 9.0, 4.0)]
    spans = spark.createDataFrame([(1, 0, i, t, x, y, w, 10.0, "F", False, s) for i, (t, x, y, w, s) in enumerate(rows)], schema)
    lines = layout.baseline_lines(spans)
    assert sorted(r["count"] for r in lines.groupBy("line").count().collect()) == [2, 2]
    text_of = [r.text for r in layout.line_text(lines).orderBy("line").collect()]
    assert text_of == ["hello world", "nextfused"]
    assert layout.stream_lines(spans).select("line").distinct().count() == 2
    levels = spark.createDataFrame([(12.0,), (12.1,), (15.1,), (18.1,)], "s double").select(layout.heading_level(F.col("s"), F.lit(10.0)).alias("l")).collect()
    assert [r.l for r in levels] == [0, 3, 2, 1]


def test_ruled_table(spark):
    seg = [(1, 0, 0.0, y, 100.0, y) for y in (0.0, 20.0, 40.0)] + [(1, 0, x, 0.0, x, 40.0) for x in (0.0, 50.0, 100.0)]
    lines = tables.merged_lines(tables.ruled_lines(spark.createDataFrame(seg, "doc_id long, page int, x1 double, y1 double, x2 double, y2 double")))
    cells = tables.grids(lines)
    assert cells.count() == 4 and tables.crossings(lines).count() == 9
    spans = spark.createDataFrame([(1, 0, 0, "a", 10.0, 25.0, 5.0, 10.0), (1, 0, 1, "b", 60.0, 5.0, 5.0, 10.0), (1, 0, 2, "c", 75.0, 5.0, 5.0, 10.0)], "doc_id long, page int, span_idx int, text string, x double, y double, width double, font_size double")
    got = {(r.row, r.col): r.text for r in tables.filled(cells, spans).collect()}
    assert got == {(0, 0): "a", (0, 1): "", (1, 0): "", (1, 1): "b c"}
    q = tables.quality(tables.filled(cells, spans).withColumn("is_header", F.lit(False))).first()
    assert q.non_empty_cells == 2 and q.cell_occupancy == 0.5


def test_pdf_spans(spark):
    df = spark.createDataFrame([(1, bytearray(builders.pdf())), (2, bytearray(builders.pdf(False)))], "doc_id long, content binary")
    spans = pdf_spans(df)
    assert spans.where("doc_id = 1").count() == spans.where("doc_id = 2").count() == 5
    assert spans.where("text = 'Test Document' and y = 720 and x = 72").count() == 2
    import zlib

    raw = bytes(range(256)) * 3
    assert pdf.inflate(zlib.compress(raw)[:-8])[:100] == raw[:100]
    assert pdf.run_length(b"\x02abc\xfed\x80") == b"abcddd"
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_hooks(spark, tmp_path):
    script = tmp_path / "hook.py"
    script.write_text(
        "import sys, json\nprint(json.dumps({'protocol': 'hook', 'capabilities': ['annotate', 'ocr']}), flush=True)\n"
        "for line in sys.stdin:\n    r = json.loads(line)\n    print('bad' if r['page'] >= 3 else json.dumps({'spans': [{'text': r['text'].upper(), 'x': 1, 'y': 2, 'width': 3, 'height': 4}], 'labels': {'a.b-c_1': 'x', 'a b': 'y'}}), flush=True)\n"
    )
    pages = spark.createDataFrame([(1, p, f"t{p}") for p in range(8)], "doc_id long, page int, text string").coalesce(1)
    with pytest.raises(PermissionError):
        hooks.run_hook(pages, hooks.Hook([sys.executable, str(script)]))
    got = hooks.run_hook(pages, hooks.Hook([sys.executable, str(script)], timeout=20), allow=True).cache()
    assert [r.reply is not None for r in got.orderBy("page").collect()] == [True] * 3 + [False] * 5
    assert [r.y for r in hooks.reply_spans(got, 100.0).collect()] == [94.0] * 3
    assert {r.key for r in hooks.reply_properties(got).collect()} == {"label.a.b-c_1"}
    assert hooks.parse_handshake("hi")[0] == "none" and hooks.parse_handshake('{"protocol": "x"}')[0] == "wrong_protocol"
    assert hooks.phase_of(["annotate", "ocr"]) == "ocr" and not hooks.valid_key("a b") and not hooks.valid_key("x" * 257)


def test_streaming(spark, tmp_path):
    from foliant.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_bytes(builders.markdown())
    for n in (1, 2):
        ingest.write_stream(ingest.parsed_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (folder / "b.rtf").write_bytes(builders.rtf())


def test_markdown_edges(spark):
    df = spark.createDataFrame([("|---|:-:|",), ("---",), ("||",), ("a | b",)], "l string")
    assert [r.s for r in df.select(markdown.is_separator(F.col("l")).alias("s")).collect()] == [True, False, False, False]
    got = parse_bytes(b"Title\n===\n\ntext `a*b*` *it* &amp; <http://x.y>\n\n1. one\n   - deep\n2. two\n\n```\nopen", "MD")
    assert [(b["kind"], b["level"]) for b in got.blocks][:2] == [("heading", 1), ("paragraph", None)]
    assert got.blocks[1]["text"] == "text a*b* it & http://x.y" and got.warnings[0]["kind"] == "UnclosedFence"


def test_warnings_cap(spark):
    w = spark.createDataFrame([(1, i, "k", "warning", "m", 0) for i in range(5)], "doc_id long, ord long, kind string, level string, message string, page int")
    assert diagnostics.capped(w, 3).count() == 4


def test_emit(spark):
    runs = spark.createDataFrame([(1, 0, i, t, (b, False, False)) for i, (t, b) in enumerate([("a", True), ("b", True), ("c", False)])], "doc_id long, block_id long, ord int, text string, style struct<bold:boolean,italic:boolean,strikethrough:boolean>")
    assert emit.inline_markdown(runs).first().text == "**ab**c"
    cells = spark.createDataFrame([(1, 0, 0, 0, "a|b"), (1, 0, 0, 1, "<c>"), (1, 1, 0, 0, "x"), (1, 1, 0, 1, "y")], "doc_id long, table_id int, row int, col int, text string")
    got = {r.table_id: r.markdown for r in emit.table_markdown(cells).collect()}
    assert got[0].startswith("<table>") and "&lt;c&gt;" in got[0] and got[1] == "| x | y |\n| --- | --- |"


def test_registry_matches_oracles(spark, sf):
    import __spark_entry__ as entry

    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50
    assert set(queries) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    row = json.loads(emit.document_json(queries and spark.createDataFrame([(1, 0, "paragraph", None, "x", None)], "doc_id long, ord int, kind string, level int, text string, page int")).first().json)
    assert row["version"] == 1


def test_corpus_configuration_and_callbacks(spark):
    import asyncio

    from foliant.operators.model import Layers
    from foliant.plans import files

    lines = [f"line number {i} of the text" for i in range(100)]
    rows = [(1, "a.bin", bytearray(files.pdf(lines, "t"))), (2, "b.bin", bytearray(files.docx(lines, "t")))]
    data = spark.createDataFrame(rows, "doc_id long, path string, content binary")
    whole = Corpus(scan_bytes(data))
    early, late = Corpus(scan_bytes(data, pages="2", layers=Layers.batch())), whole.with_config(pages="2", layers=Layers.batch())
    shown = lambda c: sorted((r.doc_id, r.kind, r.text) for r in c.blocks().collect())
    assert shown(early) == shown(late) and early.docs.where("doc_id = 1").first().page_count == 3
    assert {r.kind for r in late.blocks().collect()} == {"paragraph", "list_item", "table", "header"}
    assert whole.submit(lambda c: c.count()).result() == 2

    async def paths():
        return [row.path async for row in whole.stream()]

    assert asyncio.run(paths()) == ["a.bin", "b.bin"]
    assert whole.filter(lambda r: r.page_count == 3, columns=["page_count"]).count() == 1
    seen = []
    assert whole.on_warnings(seen.append) == len(seen)
    warnings = spark.createDataFrame([(1, "info"), (1, "error"), (2, "error")], "doc_id long, level string")
    same, counts = diagnostics.tee(warnings, "levels")
    assert same.count() == 3 and counts.get == {"n": 3, "info": 1, "warning": 0, "error": 2}


def test_model_operations(spark):
    from foliant.operators import model

    styles = spark.createDataFrame([("a", None, True), ("b", "a", None), ("c", "b", None), ("d", "c", False), ("x", "y", None), ("y", "x", None)], "style_id string, parent string, bold boolean")
    assert {r.style_id: r.bold for r in model.inherited(styles, "bold").collect()} == {"a": True, "b": True, "c": True, "d": False, "x": None, "y": None}
    sizes = spark.createDataFrame([("12pt",), (" 1.5in ",), ("2 cm",), ("10mm",), ("7",), ("ptpt",), (None,), ("-3pt",)], "v string")
    assert [r.p if r.p is None else round(r.p, 4) for r in sizes.select(model.length_points(F.col("v")).alias("p")).collect()] == [12.0, 108.0, None, 28.3465, None, None, None, -3.0]
    assert model.page_bundles(spark.createDataFrame([], "doc_id long, ord int, kind string, text string, page int")).count() == 0
    names = {r.name: r for r in model.features(spark).collect()}
    assert names["scan-pdf"].enabled and names["library-numpy"].kind == "build"
