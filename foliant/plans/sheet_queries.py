"""Queries of merged regions, table filters, spans in cells, replies of hooks and other small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import sheets as S
from foliant.operators import chunking, emit, hooks, tables
from foliant.plans.adapters import LINE_BLOCKS, ORDER_CELLS, line_blocks, order_cells, table
from foliant.plans.layout_queries import _BOX, _NTH, _boxes
from foliant.plans.registry import query
from foliant.sources import markdown as M

_C = ORDER_CELLS.lstrip()


def _cells(spark, sf_dir):
    return order_cells(spark, sf_dir).withColumn("table_id", F.lit(0))


@query(
    "merged_cells",
    f"""WITH {_C}, m AS (SELECT DISTINCT doc_id FROM cells WHERE doc_id % 3 = 0)
    SELECT c.doc_id, c.row, c.col, c.text, CASE WHEN m.doc_id IS NOT NULL AND c.row = 1 AND c.col = 0 THEN 2 ELSE 1 END AS row_span, CASE WHEN m.doc_id IS NOT NULL AND c.row = 1 AND c.col = 0 THEN 2 ELSE 1 END AS col_span
    FROM cells c LEFT JOIN m ON m.doc_id = c.doc_id WHERE NOT (m.doc_id IS NOT NULL AND c.row BETWEEN 1 AND 2 AND c.col BETWEEN 0 AND 1 AND NOT (c.row = 1 AND c.col = 0))""",
)
def merged_cells(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    merges = cells.where("doc_id % 3 = 0").select("doc_id", "table_id").distinct().select("doc_id", "table_id", F.lit(1).alias("row_lo"), F.lit(2).alias("row_hi"), F.lit(0).alias("col_lo"), F.lit(1).alias("col_hi"))
    return tables.covered_by_merges(cells, merges).select("doc_id", "row", "col", "text", "row_span", "col_span")


@query(
    "dense_rows",
    f"""WITH {_C}, k AS (SELECT * FROM cells WHERE col = 0 OR (doc_id + row) % 2 = 0), r AS (SELECT DISTINCT doc_id, row FROM k), w AS (SELECT doc_id, max(col) AS w FROM k GROUP BY doc_id),
    l AS (SELECT doc_id, max(row) AS l FROM k WHERE trim(text) <> '' GROUP BY doc_id)
    SELECT r.doc_id, r.row, g.col::INT AS col, coalesce(k.text, '') AS text FROM r JOIN w USING (doc_id) JOIN l USING (doc_id), LATERAL (SELECT unnest(generate_series(0, w.w)) AS col) g LEFT JOIN k ON k.doc_id = r.doc_id AND k.row = r.row AND k.col = g.col WHERE r.row <= l.l""",
)
def dense_rows(spark, sf_dir):
    cells = _cells(spark, sf_dir).where("col = 0 or (doc_id + row) % 2 = 0")
    return tables.dense(cells).select("doc_id", "row", "col", "text")


@query(
    "empty_rows_columns",
    f"""WITH {_C}, k AS (SELECT doc_id, row, col, CASE WHEN (doc_id + row) % 4 = 0 OR (doc_id + col) % 5 = 0 THEN '' ELSE text END AS text FROM cells),
    r AS (SELECT doc_id, row, row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS nr FROM (SELECT doc_id, row FROM k GROUP BY doc_id, row HAVING max(trim(text)) <> '')),
    c AS (SELECT doc_id, col, row_number() OVER (PARTITION BY doc_id ORDER BY col) - 1 AS nc FROM (SELECT doc_id, col FROM k GROUP BY doc_id, col HAVING max(trim(text)) <> ''))
    SELECT k.doc_id, nr::INT AS row, nc::INT AS col, text FROM k JOIN r ON r.doc_id = k.doc_id AND r.row = k.row JOIN c ON c.doc_id = k.doc_id AND c.col = k.col""",
)
def empty_rows_columns(spark, sf_dir):
    text = F.when(((F.col("doc_id") + F.col("row")) % 4 == 0) | ((F.col("doc_id") + F.col("col")) % 5 == 0), "").otherwise(F.col("text"))
    cells = _cells(spark, sf_dir).withColumn("text", text)
    return tables.without_empty(cells).select("doc_id", "row", "col", "text")


@query(
    "header_detection",
    f"""WITH {_C}, k AS (SELECT *, CASE WHEN row = 0 AND (doc_id % 2 = 0 OR col < 2) THEN 'Arial-Bold' ELSE 'Arial' END AS font FROM cells),
    b AS (SELECT doc_id, bool_and(regexp_matches(font, '[Bb]old')) AS b FROM k WHERE row = 0 AND trim(text) <> '' GROUP BY doc_id)
    SELECT k.doc_id, row, col, row = 0 AND coalesce(b, false) AS is_header FROM k LEFT JOIN b ON b.doc_id = k.doc_id""",
)
def header_detection(spark, sf_dir):
    font = F.when((F.col("row") == 0) & ((F.col("doc_id") % 2 == 0) | (F.col("col") < 2)), "Arial-Bold").otherwise("Arial")
    return tables.header_rows(_cells(spark, sf_dir).withColumn("font_name", font)).select("doc_id", "row", "col", "is_header")


@query(
    "phantom_tables",
    f"""WITH {_C}, k AS (SELECT *, CASE WHEN doc_id % 4 = 0 AND col > 0 THEN '' ELSE text END AS t FROM cells),
    r AS (SELECT doc_id, row, count(*) AS n, count(*) FILTER (trim(t) <> '') AS f FROM k GROUP BY doc_id, row),
    q AS (SELECT doc_id, sum(f)::BIGINT AS non_empty_cells, sum(f) / sum(n) AS occ, (count(*) FILTER (f >= 2)) / count(*) AS multi, count(*) - 1 AS data_rows, count(*) AS n_rows FROM r GROUP BY doc_id)
    SELECT doc_id, non_empty_cells, data_rows FROM q WHERE 200.0 * n_rows * 12 >= 484704 * 0.005 AND non_empty_cells > 0 AND occ >= 0.2 AND CASE WHEN doc_id % 2 = 0 THEN multi >= 0.3 AND data_rows >= 3 ELSE true END AND least(0.5 * non_empty_cells / (4.0 * n_rows), 1) >= 0.03""",
)
def phantom_tables(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") % 4 == 0) & (F.col("col") > 0), "").otherwise(F.col("text")))
    c, r = F.col("col"), F.col("row")
    boxed = cells.withColumns({"x_min": c * 50.0, "x_max": (c + 1) * 50.0, "y_min": r * 12.0, "y_max": (r + 1) * 12.0})
    rows = tables.quality(cells).join(tables.text_density(boxed), ["doc_id", "table_id"]).withColumn("method", F.when(F.col("doc_id") % 2 == 0, "text").otherwise("ruled"))
    return tables.without_phantoms(rows, 612.0 * 792.0).select("doc_id", "non_empty_cells", "data_rows")


@query(
    "dominated_tables",
    f"""WITH t AS (SELECT l_orderkey AS doc_id, {_NTH} AS table_id, {_BOX} AS b FROM lineitem), l AS (SELECT * FROM t WHERE table_id = 1), c AS (SELECT * FROM t WHERE table_id > 1),
    o AS (SELECT c.doc_id, c.table_id, greatest(least(c.b.x_max, l.b.x_max) - greatest(c.b.x_min, l.b.x_min), 0) * greatest(least(c.b.y_max, l.b.y_max) - greatest(c.b.y_min, l.b.y_min), 0) AS i,
                 (c.b.x_max - c.b.x_min) * (c.b.y_max - c.b.y_min) AS ca, (l.b.x_max - l.b.x_min) * (l.b.y_max - l.b.y_min) AS la FROM c JOIN l ON l.doc_id = c.doc_id)
    SELECT doc_id, table_id::INT AS table_id FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = c.doc_id AND o.table_id = c.table_id AND (i / (ca + la - i) > 0.5 OR i / ca > 0.5))""",
)
def dominated_tables(spark, sf_dir):
    t = _boxes(spark, sf_dir)
    return tables.without_dominated(t.where("table_id = 1"), t.where("table_id > 1")).select("doc_id", "table_id")


@query(
    "box_unions",
    f"""WITH t AS (SELECT l_orderkey AS doc_id, {_NTH} AS table_id, {_BOX} AS b FROM lineitem), n AS (SELECT *, doc_id % 10 = 0 AND table_id = 1 AS gone FROM t)
    SELECT doc_id, CASE WHEN NOT bool_or(gone) THEN min(b.x_min) END AS x_min, CASE WHEN NOT bool_or(gone) THEN max(b.y_max) END AS y_max, count(*) FILTER (b.x_min <= 20 AND b.x_max >= 20 AND b.y_min <= 20 AND b.y_max >= 20) AS holds,
           count(*) FILTER (b.x_min <= 20 AND b.x_max > 20 AND b.y_min <= 20 AND b.y_max > 20) AS holds_open FROM n GROUP BY doc_id""",
)
def box_unions(spark, sf_dir):
    t = _boxes(spark, sf_dir)
    b, at = F.col("b"), F.lit(20.0)
    rows = t.withColumns({"bbox": F.when(~((F.col("doc_id") % 10 == 0) & (F.col("table_id") == 1)), b), "h": G.contains_point(b, at, at), "o": G.contains_half_open(b, at, at)})
    out = rows.groupBy("doc_id").agg(chunking.merged_box().alias("u"), F.count_if("h").alias("holds"), F.count_if("o").alias("holds_open"))
    return out.select("doc_id", "u.x_min", "u.y_max", "holds", "holds_open")


@query(
    "spans_in_cells",
    f"""WITH c AS (SELECT l_orderkey AS doc_id, {_NTH} AS col, {_BOX} AS b FROM lineitem),
    s AS (SELECT l_orderkey AS doc_id, {_NTH} AS span_idx, 't' || l_partkey AS t, (l_suppkey % 60)::DOUBLE AS x, (l_partkey % 60)::DOUBLE AS y FROM lineitem),
    h AS (SELECT c.doc_id, c.col, s.span_idx, t, x, y, row_number() OVER (PARTITION BY s.doc_id, s.span_idx ORDER BY c.col) AS n FROM c JOIN s ON s.doc_id = c.doc_id WHERE x + 2 BETWEEN b.x_min AND b.x_max AND y BETWEEN b.y_min AND b.y_max)
    SELECT doc_id, col::INT AS col, count(*) AS n_spans FROM h WHERE n = 1 GROUP BY doc_id, col""",
)
def spans_in_cells(spark, sf_dir):
    from pyspark.sql import Window

    t = _boxes(spark, sf_dir).select("doc_id", "page", F.lit(0).alias("table_id"), F.lit(0).alias("row"), F.col("table_id").alias("col"), "b.*")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.row_number().over(w).alias("span_idx"), F.lit("t ").alias("text"), (F.col("l_suppkey") % 60).cast("double").alias("x"), (F.col("l_partkey") % 60).cast("double").alias("y"), F.lit(4.0).alias("width"), F.lit(10.0).alias("font_size"))
    filled = tables.filled(t, spans).where("text <> ''")
    n = F.char_length(F.regexp_replace("text", "[^t]", ""))
    return filled.select("doc_id", "col", n.cast("long").alias("n_spans"))


@query(
    "colours_and_units",
    """SELECT p_partkey, ('0x' || substr(h, 1, 2))::INT AS r, ('0x' || substr(h, 3, 2))::INT AS g, ('0x' || substr(h, 5, 2))::INT AS b, p_size / 20.0 AS points
       FROM (SELECT *, lpad(printf('%X', (p_partkey * 7919) % 16777216), 6, '0') AS h FROM part)""",
)
def colours_and_units(spark, sf_dir):
    h = F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), h)).otherwise(F.concat(F.lit("FF"), h))
    rows = table(spark, sf_dir, "part").select("p_partkey", S.hex_colour(text).alias("c"), S.twips_to_points(F.col("p_size")).alias("points"))
    return rows.select("p_partkey", "c.r", "c.g", "c.b", "points")


@query(
    "hook_replies",
    """SELECT conv_id AS doc_id, turn::INT AS page, upper(role) AS text, 792.0 - (turn * 10.0) - 12.0 AS y, 'label.role' AS key, role AS value FROM conversations""",
)
def hook_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    span = F.struct(F.upper("role").alias("text"), F.lit(1.0).alias("x"), (F.col("turn") * 10.0).alias("y"), F.lit(5.0).alias("width"), F.lit(12.0).alias("height"))
    reply = F.to_json(F.struct(F.array(span).alias("spans"), F.create_map(F.lit("role"), F.col("role"), F.lit("not valid"), F.lit("x")).alias("labels")))
    replies = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), reply.alias("reply"))
    return hooks.reply_spans(replies, 792.0).join(hooks.reply_properties(replies), ["doc_id", "page"]).select("doc_id", "page", "text", "y", "key", "value")


@query(
    "document_json",
    f"""WITH {LINE_BLOCKS.lstrip()} SELECT doc_id, 1 AS version, count(*) AS n_blocks, max_by(text, ord) AS last_text FROM blocks GROUP BY doc_id""",
)
def document_json(spark, sf_dir):
    docs = emit.document_json(line_blocks(spark, sf_dir))
    shape = F.from_json("json", "struct<version:int,content:array<struct<text:string>>>")
    return docs.select("doc_id", shape["version"].alias("version"), F.size(shape["content"]).cast("long").alias("n_blocks"), F.element_at(shape["content"], -1)["text"].alias("last_text"))


@query(
    "inline_markdown",
    """WITH w AS (SELECT doc_id, generate_subscripts(x, 1)::INT - 1 AS ord, unnest(x) AS t FROM (SELECT doc_id, string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' ') AS x FROM documents)),
       s AS (SELECT *, ord // 50 AS block_id, (ord // 3) % 2 = 0 AS b FROM w), g AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY doc_id, block_id ORDER BY ord) = b THEN 0 ELSE 1 END AS n FROM s),
       r AS (SELECT doc_id, block_id, b, run, min(ord) AS ord, string_agg(t, '' ORDER BY ord) AS t FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, block_id ORDER BY ord) AS run FROM g) GROUP BY ALL)
       SELECT doc_id, block_id::BIGINT AS block_id, md5(string_agg(CASE WHEN b THEN '**' || t || '**' ELSE t END, '' ORDER BY ord)) AS text_md5 FROM r GROUP BY doc_id, block_id""",
)
def inline_markdown(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "[ \n]+", " "), " ")).alias("ord", "text"))
    no = F.lit(False)
    style = F.struct((F.floor(F.col("ord") / 3) % 2 == 0).alias("bold"), no.alias("italic"), no.alias("strikethrough"))
    runs = words.select("doc_id", F.floor(F.col("ord") / 50).alias("block_id"), "ord", "text", style.alias("style"))
    return emit.inline_markdown(runs).select("doc_id", "block_id", F.md5("text").alias("text_md5"))


@query(
    "table_markdown",
    f"""WITH {_C}, k AS (SELECT doc_id, row, col, CASE WHEN doc_id % 3 = 0 AND col = 0 THEN text || '|<' ELSE text END AS t FROM cells),
    r AS (SELECT doc_id, row, string_agg(t, ' | ' ORDER BY col) AS p, string_agg('<td>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>', '' ORDER BY col) AS h, count(*) AS n FROM k GROUP BY doc_id, row)
    SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN '<table>' || chr(10) || string_agg('<tr>' || h || '</tr>', chr(10) ORDER BY row) || chr(10) || '</table>'
           ELSE string_agg('| ' || p || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat(' --- |', n::INT) ELSE '' END, chr(10) ORDER BY row) END) AS markdown_md5 FROM r GROUP BY doc_id""",
)
def table_markdown(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") % 3 == 0) & (F.col("col") == 0), F.concat(F.col("text"), F.lit("|<"))).otherwise(F.col("text")))
    return emit.table_markdown(cells).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query(
    "page_blocks",
    f"""WITH {LINE_BLOCKS.lstrip()}, l AS (SELECT doc_id, max(page) AS last FROM blocks GROUP BY doc_id)
    SELECT b.doc_id, ord, text FROM blocks b JOIN l ON l.doc_id = b.doc_id WHERE page = last""",
)
def page_blocks(spark, sf_dir):
    from foliant.operators.corpus import last_page

    return last_page(line_blocks(spark, sf_dir), -1).select("doc_id", "ord", "text")


@query(
    "setext_and_separators",
    f"""WITH {LINE_BLOCKS.lstrip()}, k AS (SELECT doc_id, ord, CASE ord % 3 WHEN 1 THEN '====' WHEN 2 THEN '| --- | :-: |' ELSE 'x ' || text END AS line FROM blocks), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS nxt FROM k)
    SELECT doc_id, ord, CASE WHEN ord % 3 = 0 AND nxt = '====' AND NOT regexp_matches(line, '\\|\\s*$') THEN 1 END AS level, ord % 3 = 2 AS separator FROM n""",
)
def setext_and_separators(spark, sf_dir):
    from pyspark.sql import Window

    line = F.when(F.col("ord") % 3 == 1, "====").when(F.col("ord") % 3 == 2, "| --- | :-: |").otherwise(F.concat(F.lit("x "), F.col("text")))
    rows = line_blocks(spark, sf_dir).select("doc_id", "ord", line.alias("line"))
    rows = rows.withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("ord")))
    return rows.select("doc_id", "ord", M.setext_level(F.col("line"), F.col("nxt")).alias("level"), M.is_separator(F.col("line")).alias("separator"))
