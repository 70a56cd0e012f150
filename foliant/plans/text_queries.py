"""Queries of text, sheet, detection and diagnostic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import sheets as S
from foliant.functions import text as T
from foliant.operators import diagnostics as D
from foliant.plans.adapters import EVENT_WARNINGS, LINE_BLOCKS, ORDER_CELLS, WORD_SPANS, event_warnings, line_blocks, order_cells, table, word_spans
from foliant.plans.registry import query
from foliant.sources import detect

# ---------------------------------------------------------------- text


@query(
    "text_normalise",
    """SELECT doc_id, length(t) AS n_before, length(nfc_normalize(replace(t, chr(173), ''))) AS n_after, md5(nfc_normalize(replace(t, chr(173), ''))) AS normal_md5
       FROM (SELECT doc_id, replace(replace(text, 'é', 'e' || chr(769)), 'th', 't' || chr(173) || 'h') AS t FROM documents)""",
)
def text_normalise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = F.replace(F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301")), F.lit("th"), F.lit("t\u00adh"))
    docs = docs.select("doc_id", t.alias("t")).withColumn("norm", T.normalised(F.col("t")))
    return docs.select("doc_id", F.char_length("t").cast("long").alias("n_before"), F.char_length("norm").cast("long").alias("n_after"), F.md5("norm").alias("normal_md5"))


@query(
    "block_preview",
    f"""WITH {LINE_BLOCKS.lstrip()}
    SELECT doc_id, ord, CASE WHEN length(text) > 40 THEN text[1:40] || '…' ELSE text END AS preview,
           len(list_filter(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> ''))::INT AS n_words,
           replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, regexp_replace(text, '[\\t\\n\\r]', ' ', 'g') AS tsv FROM blocks""",
)
def block_preview(spark, sf_dir):
    t = F.col("text")
    return line_blocks(spark, sf_dir).select("doc_id", "ord", T.preview(t).alias("preview"), T.n_words(t).cast("int").alias("n_words"), T.html_escaped(t).alias("html"), T.tsv_cell(t).alias("tsv"))


@query(
    "document_text",
    f"""WITH {LINE_BLOCKS.lstrip()}
    SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (kind = 'heading') AS n_headings, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS text_md5 FROM blocks GROUP BY doc_id""",
)
def document_text(spark, sf_dir):
    from foliant.operators.corpus import document_text

    blocks = line_blocks(spark, sf_dir)
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "heading").alias("n_headings"))
    return counts.join(document_text(blocks), "doc_id").select("doc_id", "n_blocks", "n_headings", F.md5("text").alias("text_md5"))


@query(
    "page_spec",
    r"""SELECT c_custkey AS doc_id, spec, list_sort(list_distinct(flatten(list_transform(string_split(spec, ','), lambda p:
          generate_series(string_split(p, '-')[1]::INT - 1, coalesce(string_split(p, '-')[2], string_split(p, '-')[1])::INT - 1)))))::INT[] AS pages
       FROM (SELECT c_custkey, (c_custkey % 5 + 1) || ',' || (c_custkey % 7 + 1) || '-' || (c_custkey % 7 + 4) AS spec FROM customer)""",
)
def page_spec(spark, sf_dir):
    k = F.col("c_custkey")
    spec = F.concat((k % 5 + 1).cast("string"), F.lit(","), (k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 4).cast("string"))
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), spec.alias("spec"))
    return rows.withColumn("pages", T.pages_of_spec(F.col("spec")))


@query(
    "page_sampling",
    """SELECT doc_id, n, CASE WHEN n <= 5 THEN generate_series(0, n - 1)::INT[] ELSE list_sort(list_distinct([0, n // 2 - 1, n // 2, n // 2 + 1, n - 1]))::INT[] END AS pages
       FROM (SELECT conv_id AS doc_id, count(*)::INT AS n FROM conversations GROUP BY conv_id)""",
)
def page_sampling(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    return n.withColumn("pages", T.sampled_pages(F.col("n")))


# ---------------------------------------------------------------- sheets


@query(
    "cell_references",
    """SELECT l_orderkey AS doc_id, l_linenumber::INT AS ln, ref, CASE WHEN c <= 16384 THEN r - 1 END AS row, CASE WHEN c <= 16384 THEN c - 1 END AS col
       FROM (SELECT *, ((CASE WHEN l3 <> '' THEN (ascii(l3) - 64) * 676 ELSE 0 END) + (ascii(l2) - 64) * 26 + ascii(l1) - 64)::INT AS c FROM (
         SELECT l_orderkey, l_linenumber, (l_orderkey % 1000 + 1)::INT AS r, CASE WHEN l_partkey % 3 = 0 THEN chr((65 + l_suppkey % 26)::INT) ELSE '' END AS l3,
                chr((65 + l_partkey % 26)::INT) AS l2, chr((65 + l_linenumber)::INT) AS l1, l3 || l2 || l1 || r AS ref FROM lineitem))""",
)
def cell_references(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    letter = lambda c: F.char((F.lit(65) + c).cast("long"))
    ref = F.concat(F.when(F.col("l_partkey") % 3 == 0, letter(F.col("l_suppkey") % 26)).otherwise(""), letter(F.col("l_partkey") % 26), letter(F.col("l_linenumber")), (F.col("l_orderkey") % 1000 + 1).cast("string"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("ln"), ref.alias("ref"))
    return rows.withColumn("cell", S.cell_ref(F.col("ref"))).select("doc_id", "ln", "ref", "cell.row", "cell.col")


@query(
    "serial_dates",
    """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber::INT AS ln, (date_diff('day', DATE '1899-12-30', l_shipdate::DATE))::INT AS d, (l_partkey % 96) AS q, l_suppkey % 2 = 0 AS e FROM lineitem),
       t AS (SELECT *, (CASE WHEN e THEN (DATE '1904-01-01' + d::INT)::VARCHAR ELSE (DATE '1899-12-30' + d::INT)::VARCHAR END) AS dt, (q * 900)::INT AS sec FROM s)
       SELECT doc_id, ln, CASE WHEN q > 0 THEN dt || 'T' || lpad((sec // 3600)::VARCHAR, 2, '0') || ':' || lpad((sec % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') ELSE dt END AS iso FROM t""",
)
def serial_dates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    serial = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date")) + (F.col("l_partkey") % 96) / 96.0
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("ln"), S.serial_to_iso(serial, F.col("l_suppkey") % 2 == 0).alias("iso"))


@query(
    "number_display",
    """SELECT l_orderkey AS doc_id, l_linenumber::INT AS ln, raw, CASE WHEN NOT contains(raw, '.') THEN raw ELSE rtrim(rtrim(raw, '0'), '.') END AS shown,
              len(regexp_replace(regexp_extract(regexp_extract(code, '^([^%]*)%', 1), '\\.([^.]*)$', 1), '[^0#]', '', 'g'))::INT AS places
       FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 1000)::VARCHAR || '.' || lpad((l_suppkey % 100)::VARCHAR, 2, '0') ELSE l_partkey::VARCHAR END AS raw,
                    (['0%', '0.0%', '#.##%', '0', '0.00'])[(l_partkey % 5 + 1)::INT] AS code FROM lineitem)""",
)
def number_display(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat((F.col("l_partkey") % 1000).cast("string"), F.lit("."), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"))).otherwise(F.col("l_partkey").cast("string"))
    code = F.element_at(F.array(*[F.lit(c) for c in ("0%", "0.0%", "#.##%", "0", "0.00")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("ln"), raw.alias("raw"), code.alias("code"))
    return rows.select("doc_id", "ln", "raw", S.number_display(F.col("raw")).alias("shown"), S.percent_places(F.col("code")).cast("int").alias("places"))


@query(
    "tables_tsv",
    f"""WITH {ORDER_CELLS.lstrip()},
    r AS (SELECT doc_id, row, string_agg(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g'), chr(9) ORDER BY col) AS line, count(*) AS n FROM cells GROUP BY doc_id, row)
    SELECT doc_id, '# Table 1 (page ?, ' || max(n) || ' columns, ' || count(*) || ' rows)' AS title, md5(string_agg(line, chr(10) ORDER BY row)) AS body_md5 FROM r GROUP BY doc_id""",
)
def tables_tsv(spark, sf_dir):
    from foliant.operators.emit import tables_tsv

    cells = order_cells(spark, sf_dir).withColumns({"table_id": F.lit(0), "page": F.lit(None).cast("int"), "ord": F.lit(0)})
    return tables_tsv(cells).select("doc_id", "title", F.md5("body").alias("body_md5"))


@query(
    "sheet_columns",
    f"""WITH {ORDER_CELLS.lstrip()}
    SELECT b.doc_id, b.row, max(CASE WHEN h.text = 'status' THEN b.text END) AS status, max(CASE WHEN h.text = 'quantity' THEN b.text END) AS quantity,
           max(CASE WHEN h.text = 'discount' THEN b.text END) AS discount, max(CASE WHEN h.text = 'shipped' THEN b.text END) AS shipped
    FROM cells b JOIN cells h ON h.doc_id = b.doc_id AND h.col = b.col AND h.is_header WHERE NOT b.is_header GROUP BY b.doc_id, b.row""",
)
def sheet_columns(spark, sf_dir):
    from foliant.operators.emit import records

    return records(order_cells(spark, sf_dir), ["status", "quantity", "discount", "shipped"])


@query(
    "table_quality",
    f"""WITH {ORDER_CELLS.lstrip()},
    r AS (SELECT doc_id, row, is_header, count(*) AS n, count(*) FILTER (trim(text) <> '') AS filled FROM cells GROUP BY doc_id, row, is_header)
    SELECT doc_id, sum(filled)::BIGINT AS non_empty_cells, sum(filled) / sum(n) AS cell_occupancy, (count(*) FILTER (filled >= 2)) / count(*) AS multi_column_rows, count(*) FILTER (NOT is_header) AS data_rows FROM r GROUP BY doc_id""",
)
def table_quality(spark, sf_dir):
    from foliant.operators.tables import quality

    cells = order_cells(spark, sf_dir).withColumn("table_id", F.lit(0))
    return quality(cells).select("doc_id", "non_empty_cells", "cell_occupancy", "multi_column_rows", "data_rows")


# ---------------------------------------------------------------- detection


@query(
    "detect_formats",
    """WITH c AS (SELECT page_id, 'f' || page_id || (['.pdf', '.docx', '.md', '.txt', '.markdown', '.XLS'])[(page_id % 6 + 1)::INT] AS path,
                         (CASE page_id % 5 WHEN 0 THEN '{\\rtf1' WHEN 1 THEN 'junk %PDF-1.4' WHEN 2 THEN repeat('x', 1021) || '%PDF' ELSE '' END) || url AS content FROM pages)
       SELECT page_id, path, coalesce(CASE WHEN starts_with(content, '{\\rtf') THEN 'RTF' WHEN contains(content[1:1024], '%PDF') THEN 'PDF' END,
              CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'DOCX' WHEN 'md' THEN 'MD' WHEN 'markdown' THEN 'MD' WHEN 'xls' THEN 'XLS' END) AS format FROM c""",
)
def detect_formats(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    path = F.concat(F.lit("f"), k.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".docx", ".md", ".txt", ".markdown", ".XLS")]), (k % 6 + 1).cast("int")))
    lead = F.when(k % 5 == 0, "{\\rtf1").when(k % 5 == 1, "junk %PDF-1.4").when(k % 5 == 2, "x" * 1021 + "%PDF").otherwise("")
    rows = p.select("page_id", path.alias("path"), F.encode(F.concat(lead, F.col("url")), "UTF-8").alias("content"))
    return rows.select("page_id", "path", detect.detect(F.col("path"), F.col("content")).alias("format"))


@query(
    "format_capabilities",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', '{e}', '{m}', {str(p).lower()}, {str(r).lower()}, true)" for n, e, m, p, r in detect.FORMATS)
    + ") AS f(format, extension, mime, has_pages, can_render, has_tables)",
)
def format_capabilities(spark, sf_dir):
    return detect.formats(spark)


@query(
    "image_filters",
    """WITH c AS (SELECT page_id, (['89504E470D0A1A0A', '474946383961', 'FFD8FFE0', '49492A00', '424D', 'D7CDC69A', 'FF4FFF51', '00'])[(page_id % 8 + 1)::INT] || repeat('00', 40) AS h FROM pages)
       SELECT page_id, CASE WHEN starts_with(h, '89504E47') THEN 'png' WHEN starts_with(h, '47494638') THEN 'gif' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, 'FF4FFF51') THEN 'jpeg2000'
              WHEN starts_with(h, '49492A00') THEN 'tiff' WHEN starts_with(h, 'D7CD') THEN 'wmf' WHEN starts_with(h, '424D') THEN 'bmp' ELSE 'raw' END AS filter FROM c""",
)
def image_filters(spark, sf_dir):
    heads = ["89504E470D0A1A0A", "474946383961", "FFD8FFE0", "49492A00", "424D", "D7CDC69A", "FF4FFF51", "00"]
    content = F.unhex(F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 8 + 1).cast("int")), F.lit("00" * 40)))
    return table(spark, sf_dir, "pages").select("page_id", detect.image_filter(content).alias("filter"))


# ---------------------------------------------------------------- diagnostics

_W = EVENT_WARNINGS.lstrip()
CAP = 5


@query(
    "warnings_capped",
    f"""WITH {_W}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM warnings)
    SELECT doc_id, ord, kind, level, message, page FROM n WHERE i <= {CAP}
    UNION ALL SELECT doc_id, max(ord) + 1, 'WarningLimit', 'warning', 'warning limit reached: ' || (count(*) - {CAP}) || ' more', NULL FROM warnings GROUP BY doc_id HAVING count(*) > {CAP}""",
)
def warnings_capped(spark, sf_dir):
    return D.capped(event_warnings(spark, sf_dir), CAP)


@query("warnings_distinct", f"WITH {_W} SELECT doc_id, level, kind, message, min(ord) AS ord, count(*) AS times FROM warnings WHERE level <> 'info' GROUP BY ALL")
def warnings_distinct(spark, sf_dir):
    return D.distinct_messages(event_warnings(spark, sf_dir)).select("doc_id", "level", "kind", "message", "ord", "times")


_CODE = """CASE WHEN contains(m, 'no such file') OR contains(m, 'not found') OR contains(m, 'does not exist') THEN 'E_FILE_NOT_FOUND' WHEN contains(m, 'permission denied') THEN 'E_PERMISSION_DENIED'
    WHEN contains(m, 'unknown format') OR contains(m, 'unsupported format') OR contains(m, 'unable to detect format') THEN 'E_FORMAT_UNSUPPORTED' WHEN contains(m, 'encrypt') OR contains(m, 'password') THEN 'E_ENCRYPTION_REQUIRED'
    WHEN contains(m, 'invalid') AND contains(m, 'page range') THEN 'E_INVALID_ARGUMENT' WHEN contains(m, 'parse') OR contains(m, 'malformed') OR contains(m, 'xref') THEN 'E_PARSE_ERROR' ELSE 'E_EXTRACTION_FAILED' END"""
_RANKED = f"c AS (SELECT *, {_CODE} AS code FROM (SELECT *, lower(message) AS m FROM warnings)), s AS (SELECT *, CASE WHEN code IN ('E_FILE_NOT_FOUND', 'E_PERMISSION_DENIED') THEN 3 WHEN code = 'E_ENCRYPTION_REQUIRED' THEN 2 ELSE 1 END AS severity FROM c)"


@query("errors_classified", f"WITH {_W}, {_RANKED} SELECT code, severity, count(*) AS n FROM s GROUP BY ALL")
def errors_classified(spark, sf_dir):
    return D.classified(event_warnings(spark, sf_dir)).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("worst_errors", f"WITH {_W}, {_RANKED} SELECT doc_id, max_by(code, severity * 1000000000000 - ord) AS code, max(severity) AS severity FROM s GROUP BY doc_id")
def worst_errors(spark, sf_dir):
    return D.worst(event_warnings(spark, sf_dir))


@query(
    "font_audit",
    f"""WITH {WORD_SPANS.lstrip()}
    SELECT doc_id, font_name, count(*) AS n_spans, list_sort(list(DISTINCT page + 1))::INT[] AS pages, min_by(text[1:20], page * 1000000 + span_idx) AS sample FROM spans GROUP BY doc_id, font_name""",
)
def font_audit(spark, sf_dir):
    return D.font_audit(word_spans(spark, sf_dir))


@query(
    "inspect_probe",
    f"""WITH {WORD_SPANS.lstrip()}, p AS (SELECT doc_id, page, count(*) AS w FROM spans GROUP BY doc_id, page)
    SELECT doc_id, true AS has_text, false AS likely_scanned, sum(w)::BIGINT AS n_words, count(*) AS n_pages, count(*) FILTER (w < 10) AS ocr_pages FROM p GROUP BY doc_id""",
)
def inspect_probe(spark, sf_dir):
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "text"))), lambda x: x["text"]), " ")
    pages = word_spans(spark, sf_dir).groupBy("doc_id", "page").agg(words.alias("text"), F.lit(1).alias("n_images"))
    ocr = pages.groupBy("doc_id").agg(F.count_if(D.needs_ocr(F.col("text"))).alias("ocr_pages"))
    return D.inspect(pages).join(ocr, "doc_id").select("doc_id", "has_text", "likely_scanned", F.col("n_words").cast("long").alias("n_words"), "n_pages", "ocr_pages")


@query(
    "missing_glyphs",
    f"""WITH {WORD_SPANS.lstrip()}, ch AS (SELECT doc_id, font_name, unnest(string_split(text, '')) AS c FROM spans)
    SELECT doc_id, font_name, unicode(c)::INT AS codepoint, count(*) AS n FROM ch WHERE c <> '' AND unicode(c) > 255 GROUP BY ALL""",
)
def missing_glyphs(spark, sf_dir):
    return D.missing_glyphs(word_spans(spark, sf_dir), F.col("codepoint") <= 255)


@query(
    "hyperlink_registry",
    """SELECT doc_id, url, min(ord) AS ord FROM (SELECT page_id % 50 AS doc_id, page_id AS ord, regexp_replace(url, '[0-9]+', 'N', 'g') AS url FROM pages) GROUP BY doc_id, url""",
)
def hyperlink_registry(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("doc_id"), F.col("page_id").alias("ord"), F.regexp_replace("url", "[0-9]+", "N").alias("url"))
    return D.hyperlinks(links).select("doc_id", "url", "ord")


@query(
    "footnote_definitions",
    """WITH n AS (SELECT conv_id AS doc_id, turn AS ord, role AS label FROM conversations), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) > 1 AS dup FROM n),
       k AS (SELECT *, sum(CASE WHEN dup THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM d)
       SELECT doc_id, ord, label, CASE WHEN dup THEN 'duplicate' WHEN nth > 1 THEN 'limit' ELSE 'added' END AS status FROM k""",
)
def footnote_definitions(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("label"))
    return D.first_definitions(notes, cap=1)
