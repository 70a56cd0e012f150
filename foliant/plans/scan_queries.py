"""Queries of the file scans: documents and orders written as files of each format, scanned, and compared with what was written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import layout
from foliant.operators.corpus import Corpus
from foliant.operators.model import Layers
from foliant.plans import files
from foliant.plans.adapters import dealt, table
from foliant.plans.registry import query
from foliant.sources.scan import pdf_spans, readable, scan_bytes

# ---------------------------------------------------------------- files


def _written(rows: DataFrame, write: Callable[[dict], bytes]) -> DataFrame:
    """(doc_id, ...) -> (doc_id, path, content): a file for each row, a few rows at a time."""
    names = ["doc_id", "path", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [write(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(["file.bin"] * len(made)), pa.array(made, pa.binary())], names=names)

    return rows.mapInArrow(run, "doc_id long, path string, content binary")


def _lines(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> DataFrame:
    """The lines of each document that have a letter or digit, with single spaces."""
    line = lambda x: F.trim(F.regexp_replace(x, r"[\x00-\x20\x7F]+", " "))
    plain = (lambda x: F.regexp_replace(line(x), r"[^\x20-\x7E]", "?")) if ascii_only else line
    lines = F.filter(F.transform(F.split("text", "\n"), plain), lambda x: x.rlike("[A-Za-z0-9]"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines.alias("lines"))


def document_files(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    write = files.DOCUMENTS[fmt]
    return _written(_lines(spark, sf_dir, fmt == "PDF"), lambda r: write(list(r["lines"]), f"Document {r['doc_id']}"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("day"), "l_linestatus", F.col("l_quantity").cast("int").alias("quantity"), F.round(F.col("l_discount") * 100).cast("int").alias("percent"))
    rows = dealt(items.select(F.col("l_orderkey").alias("doc_id"), item.alias("item")), "doc_id", items)
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def order_files(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    write = files.SHEETS[fmt]
    return _written(_orders(spark, sf_dir), lambda r: write([(x["l_linestatus"], x["quantity"], x["percent"], x["day"]) for x in r["items"]], f"Order {r['doc_id']}"))


def _blocks(docs: DataFrame) -> DataFrame:
    blocks = docs.where("error is null").select("doc_id", F.posexplode("blocks").alias("ord", "b"))
    value = lambda c, none: F.coalesce(F.col(f"b.{c}"), F.lit(none)).alias(c)
    return blocks.select("doc_id", "ord", "b.kind", value("level", 0), "b.text", value("page", -1), value("url", ""))


# ---------------------------------------------------------------- what was written, in SQL


def _sql_lines(ascii_only: bool = False) -> str:
    text = r"trim(regexp_replace(line, '[\x00-\x20\x7F]+', ' ', 'g'))"
    if ascii_only:
        text = rf"regexp_replace({text}, '[^\x20-\x7E]', '?', 'g')"
    return f"""
    fraw AS (SELECT doc_id, no, {text} AS text FROM (SELECT doc_id, generate_subscripts(x, 1) AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
    fl AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INT AS i, text, length(text) - length(replace(text, ' ', '')) < 3 AS heading FROM fraw WHERE regexp_matches(text, '[A-Za-z0-9]')),
    ft AS (SELECT doc_id, string_agg(i::VARCHAR || chr(9) || text, chr(10) ORDER BY i) AS text, max(i) AS last FROM fl WHERE i % 5 = 0 GROUP BY doc_id),
    fn AS (SELECT doc_id, max(i) AS last FROM fl GROUP BY doc_id)"""


def _sql_blocks(parts: str, ascii_only: bool = False) -> str:
    """``parts``: rows of (doc_id, place, kind, level, text, page, url); blocks follow from the order of places."""
    return f"""WITH {_sql_lines(ascii_only)},
    parts AS ({parts})
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS ord, kind, coalesce(level, 0)::INT AS level, text, coalesce(page, -1)::INT AS page, coalesce(url, '') AS url FROM parts"""


_KIND = "CASE WHEN heading THEN 'heading' ELSE 'paragraph' END"
_LIST_KIND = "CASE WHEN heading THEN 'heading' WHEN i % 7 = 0 THEN 'list_item' ELSE 'paragraph' END"
_LEVEL = "CASE WHEN heading THEN i % 3 + 1 END"
_TABLE = "SELECT doc_id, 1000000000, 'table', NULL, text{}, NULL, NULL FROM ft"

_FLOW = {
    "DOCX": f"""SELECT doc_id, 2 * i AS place, {_LIST_KIND} AS kind, {_LEVEL} AS level, text, NULL AS page, NULL AS url FROM fl
      UNION ALL SELECT doc_id, 2 * i + 1, 'link', NULL, text, NULL, '{files.LINK}' FROM fl WHERE i % 11 = 3
      UNION ALL {_TABLE.format(" || chr(10) || 'end' || chr(9)")}
      UNION ALL SELECT doc_id, 1000000001, 'header', NULL, 'Document ' || doc_id, NULL, NULL FROM documents WHERE text IS NOT NULL""",
    "ODT": f"""SELECT doc_id, 2 * i AS place, {_LIST_KIND} AS kind, {_LEVEL} AS level, text, NULL AS page, NULL AS url FROM fl
      UNION ALL SELECT doc_id, 2 * i + 1, 'link', NULL, text, NULL, '{files.LINK}' FROM fl WHERE i % 11 = 3 AND NOT heading
      UNION ALL {_TABLE.format("")}""",
    "RTF": f"""SELECT doc_id, i AS place, {_KIND} AS kind, {_LEVEL} AS level, text, NULL AS page, NULL AS url FROM fl
      UNION ALL {_TABLE.format("")}""",
    "DOC": f"""SELECT doc_id, i AS place, 'paragraph' AS kind, NULL AS level, text, NULL AS page, NULL AS url FROM fl
      UNION ALL {_TABLE.format("")}""",
    "PPT": f"""SELECT doc_id, i AS place, {_KIND} AS kind, CASE WHEN heading THEN 1 END AS level, text, i // {files.SLIDE_LINES} AS page, NULL AS url FROM fl""",
    "PDF": f"""SELECT doc_id, i AS place, 'paragraph' AS kind, NULL AS level, text, i // {files.PAGE_LINES} AS page, NULL AS url FROM fl""",
    "ODP": f"""SELECT doc_id, i AS place, {_KIND} AS kind, CASE WHEN heading THEN 1 END AS level, text, i // {files.SLIDE_LINES} AS page, NULL AS url FROM fl
      UNION ALL SELECT ft.doc_id, 1000000000, 'table', NULL, text, fn.last // {files.SLIDE_LINES}, NULL FROM ft JOIN fn ON fn.doc_id = ft.doc_id""",
    "PPTX": f"""SELECT doc_id, 100 * (i // {files.SLIDE_LINES}) + i % {files.SLIDE_LINES} AS place, {_KIND} AS kind, CASE WHEN heading THEN 1 END AS level, text, i // {files.SLIDE_LINES} AS page, NULL AS url FROM fl
      UNION ALL SELECT ft.doc_id, 100 * (fn.last // {files.SLIDE_LINES}) + 50, 'table', NULL, text, fn.last // {files.SLIDE_LINES}, NULL FROM ft JOIN fn ON fn.doc_id = ft.doc_id
      UNION ALL SELECT DISTINCT doc_id, 100 * (i // {files.SLIDE_LINES}) + 99, 'note', NULL, 'note ' || i // {files.SLIDE_LINES}, i // {files.SLIDE_LINES}, NULL FROM fl""",
}

_ITEMS = """items AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate::DATE))::INT AS r, l_linestatus AS status, l_quantity::INT AS q, round(l_discount * 100)::INT AS pct, l_shipdate::DATE AS d FROM lineitem)"""


def _sql_cells(total: bool) -> str:
    more = """UNION ALL SELECT doc_id, max(r) + 1, c, CASE c WHEN 0 THEN 'total' WHEN 1 THEN sum(q)::VARCHAR WHEN 2 THEN 'TRUE' ELSE '' END FROM items, (VALUES (0), (1), (2), (3)) AS v(c) GROUP BY doc_id, c""" if total else ""
    return f"""WITH {_ITEMS}
    SELECT doc_id, 'Order ' || doc_id AS sheet, r::INT AS row, c::INT AS col, text FROM (
      SELECT DISTINCT doc_id, 0 AS r, c, t AS text FROM items, (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(files.HEADER))}) AS h(c, t)
      UNION ALL SELECT doc_id, r, 0, status FROM items
      UNION ALL SELECT doc_id, r, 1, q::VARCHAR FROM items
      UNION ALL SELECT doc_id, r, 2, pct::VARCHAR || '%' FROM items
      UNION ALL SELECT doc_id, r, 3, d::VARCHAR FROM items {more})"""


# ---------------------------------------------------------------- queries


def _register_documents(fmt: str) -> None:
    @query(f"scan_{fmt.lower()}", _sql_blocks(_FLOW[fmt], fmt == "PDF"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _blocks(scan_bytes(document_files(spark, sf_dir, fmt)))


def _register_sheets(fmt: str) -> None:
    @query(f"scan_{fmt.lower()}", _sql_cells(fmt == "XLSX"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = scan_bytes(order_files(spark, sf_dir, fmt)).where("error is null")
        name = F.filter("blocks", lambda b: b["kind"] == "heading")[0]["text"]
        rows = docs.select("doc_id", name.alias("sheet"), F.posexplode(F.filter("blocks", lambda b: b["kind"] == "table")[0]["rows"]).alias("row", "cells"))
        return rows.select("doc_id", "sheet", "row", F.posexplode("cells").alias("col", "text"))


for _fmt in files.DOCUMENTS:
    _register_documents(_fmt)
for _fmt in files.SHEETS:
    _register_sheets(_fmt)


@query(
    "scan_formats",
    """WITH f(k, format) AS (VALUES (0, 'DOCX'), (1, 'ODT'), (2, 'RTF'), (3, 'DOC'), (4, 'PPTX'), (5, 'ODP'), (6, 'PPT'), (7, 'PDF')),
    n AS (SELECT doc_id, greatest(1, count(t)) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE regexp_matches(t, '[A-Za-z0-9]') GROUP BY doc_id)
    SELECT d.doc_id, format, CASE WHEN k IN (4, 5, 6) THEN greatest(1, (coalesce(lines, 0) + 7) // 8) WHEN k = 7 THEN greatest(1, (coalesce(lines, 0) + 39) // 40) ELSE 1 END::INT AS page_count,
      CASE WHEN k IN (0, 1, 2, 4, 5) THEN 'Document ' || d.doc_id END AS title, false AS is_encrypted, NULL::VARCHAR AS error
    FROM documents d JOIN f ON f.k = d.doc_id % 8 LEFT JOIN n ON n.doc_id = d.doc_id WHERE d.text IS NOT NULL""",
)
def scan_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of mixed files: formats found from the bytes alone, page counts and titles."""
    writers = list(files.DOCUMENTS.values())
    rows = _lines(spark, sf_dir)

    def write(r: dict) -> bytes:
        k = r["doc_id"] % len(writers)
        lines = [x.encode("ascii", "replace").decode() for x in r["lines"]] if writers[k] is files.pdf else list(r["lines"])
        return writers[k](lines, f"Document {r['doc_id']}")

    docs = scan_bytes(_written(rows, write))
    title = F.when(F.col("format").isin("DOCX", "ODT", "RTF", "PPTX", "ODP"), F.col("metadata")["title"])
    return docs.select("doc_id", "format", "page_count", title.alias("title"), "is_encrypted", "error")


@query(
    "corpus_tables",
    f"""WITH {_ITEMS}, n AS (SELECT doc_id, max(r) AS n, sum(q) AS q FROM items GROUP BY doc_id)
    SELECT doc_id, n + 2 AS n_rows, 4 * (n + 2) AS n_cells, q::BIGINT AS quantity FROM n""",
)
def corpus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a corpus of workbooks, summed from their cells."""
    cells = Corpus(scan_bytes(order_files(spark, sf_dir, "XLSX"))).tables()
    quantity = F.when((F.col("col") == 1) & F.col("text").rlike("^[0-9]+$"), F.col("text").cast("long"))
    rows = cells.groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.sum(quantity).alias("q"))
    # the last row is the total, which is left out of the sum
    last = F.coalesce(F.max_by("q", "row"), F.lit(0))
    return rows.groupBy("doc_id").agg((F.max("row") + 1).cast("int").alias("n_rows"), F.sum("n").cast("int").alias("n_cells"), (F.sum("q") - last).alias("quantity"))


@query("scan_page_range", _sql_blocks(_FLOW["PDF"] + " WHERE i // 40 IN (0, 2)", True))
def scan_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 1 and 3 of PDF files; the content of other pages is not decoded."""
    return _blocks(scan_bytes(document_files(spark, sf_dir, "PDF"), pages="1,3"))


@query("scan_layers", _sql_blocks(f"SELECT * FROM ({_FLOW['DOCX']}) WHERE kind NOT IN ('link', 'note')"))
def scan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the layers of links and notes."""
    return _blocks(scan_bytes(document_files(spark, sf_dir, "DOCX"), layers=Layers.content_only()))


@query(
    "pdf_page_text",
    f"""WITH {_sql_lines(True)} SELECT doc_id, (i // {files.PAGE_LINES})::INT AS page, string_agg(text, chr(10) ORDER BY i) AS text FROM fl GROUP BY doc_id, i // {files.PAGE_LINES}""",
)
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned spans of PDF files, clustered by baseline and joined to the text of each page."""
    spans = readable(pdf_spans(document_files(spark, sf_dir, "PDF"))).withColumn("space_width", F.lit(None).cast("double"))
    return layout.page_text(layout.line_text(layout.baseline_lines(spans))).select("doc_id", "page", "text")


@query("scan_failures", "SELECT doc_id, doc_id % 4 AS k, true AS failed, doc_id % 4 = 3 AS is_encrypted FROM documents WHERE text IS NOT NULL")
def scan_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files are rows with an error: cut archives, unknown bytes, cut compound files and encrypted PDFs."""
    rows = _lines(spark, sf_dir)

    def write(r: dict) -> bytes:
        k, lines = r["doc_id"] % 4, list(r["lines"])
        if k == 0:
            whole = files.docx(lines, "cut")
            return whole[: len(whole) // 2]
        if k == 1:
            return b"?" + "\n".join(lines).encode()
        if k == 2:
            return files.doc(lines, "cut")[:700]
        return files.pdf([], "locked").replace(b"trailer\n<<", b"trailer\n<< /Encrypt 1 0 R")

    docs = scan_bytes(_written(rows, write))
    return docs.select("doc_id", (F.col("doc_id") % 4).alias("k"), F.col("error").isNotNull().alias("failed"), "is_encrypted")
