"""The scan: files or tables of bytes to parsed documents, one Arrow batch at a time.

Detection and parsers run in one ``mapInArrow``, a file at a time, and return a row
for each file in batches of a few files, with ``error`` set where a file could not be read, so one bad file never ends
a job. Catalyst sees everything after the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant.functions.text import parse_pages
from foliant.operators import layout
from foliant.operators.model import Layers
from foliant.sources import detect, legacy, markdown, odf, ooxml, pdf, rtf
from foliant.sources.model import DOCUMENT, Parsed


#: Files, bytes of files and spans after which a worker sends what it has.
MOST_FILES, MOST_BYTES, MOST_SPANS = 64, 4 << 20, 5000


def _pdf(data: bytes, wanted: frozenset[int] | None = None) -> Parsed:
    """Lines of a PDF as paragraphs, by baseline and x; the DataFrame path is ``pdf_spans`` and ``layout``."""
    out = Parsed()
    rows, out.page_count = pdf.spans_and_pages(data, wanted)
    pages: dict[int, list] = {}
    for r in rows:
        if not r[8]:
            pages.setdefault(r[0], []).append(r)
    for page, items in sorted(pages.items()):
        lines: list[list] = []
        for r in sorted(items, key=lambda s: (-s[4], s[3])):
            if lines and abs(lines[-1][0][4] - r[4]) <= layout.BASELINE_TOLERANCE:
                lines[-1].append(r)
            else:
                lines.append([r])
        for line in lines:
            text, end = "", None
            for r in sorted(line, key=lambda s: s[3]):
                text += (" " if end is not None and r[3] - end > 0.15 * max(r[6], 1.0) and not text.endswith(" ") else "") + r[2]
                end = r[3] + r[5]
            if text.strip():
                out.add("paragraph", text.strip(), page=page)
    return out


PARSERS = {"PDF": _pdf, "DOCX": ooxml.docx, "XLSX": ooxml.xlsx, "PPTX": ooxml.pptx, "DOC": legacy.doc, "XLS": legacy.xls, "PPT": legacy.ppt, "ODT": odf.odf, "ODS": odf.odf, "ODP": odf.odf, "RTF": rtf.rtf, "MD": markdown.parse}


def parse_bytes(data: bytes, fmt: str | None, pages: frozenset[int] | None = None, kinds_out: tuple[str, ...] = ()) -> Parsed:
    """One document from memory; ``fmt`` as ``detect`` names it.

    ``pages`` (from 0): blocks of other pages are left out, and those pages of a PDF are not
    decoded; blocks without a page stay. Blocks of ``kinds_out`` are left out.
    """
    if fmt not in PARSERS:
        raise ValueError("unable to detect format")
    out = _pdf(data, pages) if fmt == "PDF" else PARSERS[fmt](data)
    if pages is not None or kinds_out:
        out.blocks = [b for b in out.blocks if b["kind"] not in kinds_out and (pages is None or b["page"] is None or b["page"] in pages)]
    return out


def scan_bytes(rows: DataFrame, pages: str | None = None, layers: Layers | None = None) -> DataFrame:
    """(doc_id, path, content) -> parsed documents. Small batches keep few large files in memory at once.

    ``pages`` is a page range like "1,3,5-10"; pages and layers are left out before blocks leave the parser.
    """
    wanted = None if pages is None else frozenset(parse_pages(pages))
    kinds_out = layers.kinds_left_out if layers else ()
    schema = to_arrow_schema(StructType.fromDDL(DOCUMENT))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held = [], 0
            for doc_id, path, content in zip(*[batch.column(c) for c in ("doc_id", "path", "content")], strict=True):
                doc_id, path, content = doc_id.as_py(), path.as_py(), content.as_py()
                data, fmt, error, parsed = content if content is not None else b"", None, None, Parsed()
                try:
                    fmt = detect.format_of(path, content)
                    parsed = parse_bytes(data, fmt, wanted, kinds_out)
                except Exception as e:  # noqa: BLE001  any failure of a parser is that file's error
                    error = f"{type(e).__name__}: {e}"
                done.append((doc_id, path, fmt, len(data), parsed.page_count, parsed.blocks, list(parsed.metadata.items()), parsed.warnings, parsed.is_encrypted or "encrypted" in (error or ""), error))
                held += len(data)
                if len(done) >= MOST_FILES or held >= MOST_BYTES:
                    yield _batch(done, schema)
                    done, held = [], 0
            if done:
                yield _batch(done, schema)

    return rows.select("doc_id", "path", "content").mapInArrow(parse, DOCUMENT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def scan(spark: SparkSession, path: str | list[str], most_bytes: int | None = None, pages: str | None = None, layers: Layers | None = None) -> DataFrame:
    """Files of a folder tree as parsed documents; the id is a hash of the path."""
    files = detect.scan_files(spark, path, most_bytes)
    return scan_bytes(files.select(F.xxhash64("path").alias("doc_id"), "path", "content"), pages, layers)


def pdf_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, content) of PDF files -> positioned spans for ``foliant.operators.layout``.

    A file that cannot be read is one row with ``error`` and no span.
    """
    ddl = f"doc_id long, {pdf.SPANS}, error string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    none = (None,) * (len(schema) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple] = []
            for doc_id, content in zip(batch.column("doc_id"), batch.column("content"), strict=True):
                doc_id, content = doc_id.as_py(), content.as_py()
                try:
                    if content is None:
                        raise ValueError("no content")
                    done += [(doc_id, *s, None) for s in pdf.spans(content)]
                except Exception as e:  # noqa: BLE001  any failure of the parser is that file's error
                    done.append((doc_id, *none, f"{type(e).__name__}: {e}"))
                if len(done) >= MOST_SPANS:
                    yield _batch(done, schema)
                    done = []
            if done:
                yield _batch(done, schema)

    return rows.select("doc_id", "content").mapInArrow(run, ddl)


def readable(spans: DataFrame) -> DataFrame:
    """Spans without ``error``; at the first file that could not be read the job fails and names it."""
    failed = F.raise_error(F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(": "), F.col("error")))
    return spans.where(F.when(F.col("error").isNull(), True).otherwise(failed.cast("boolean"))).drop("error")
