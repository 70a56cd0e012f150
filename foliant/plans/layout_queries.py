"""Queries of reading order, tables and emitters over synthetic spans, lines and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.operators import emit, layout, tables
from foliant.plans.adapters import LINE_BLOCKS, WORD_SPANS, dealt, line_blocks, table, word_spans
from foliant.plans.registry import query

_S = WORD_SPANS.lstrip()

_LINES = f"""{_S},
    g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, span_idx) - y > 2 AS gap FROM spans),
    ln AS (SELECT *, (sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, span_idx))::INT AS line FROM g)"""


@query(
    "stream_coherence",
    f"""WITH {_S},
    m AS (SELECT doc_id, page, list_sort(list(font_size))[(count(*) // 2 + 1)::INT] AS median FROM spans GROUP BY doc_id, page),
    c AS (SELECT s.*, x + greatest(width, 0) / 2 AS cx, median FROM spans s JOIN m ON m.doc_id = s.doc_id AND m.page = s.page),
    g AS (SELECT *, cx - lag(cx) OVER (PARTITION BY doc_id, page ORDER BY cx, span_idx) > 2 * median AS gap FROM c),
    i AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY cx, span_idx) AS island FROM g),
    d AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page, island ORDER BY span_idx) AS py FROM i),
    k AS (SELECT doc_id, page, island, count(*) AS k, coalesce(count(*) FILTER (py IS NOT NULL AND y <= py)::DOUBLE / nullif(count(py), 0), 1.0) AS score FROM d GROUP BY ALL)
    SELECT doc_id, page, round(sum(score * k) / sum(k), 9) AS coherence, sum(k)::BIGINT AS n_spans FROM k GROUP BY doc_id, page""",
)
def stream_coherence(spark, sf_dir):
    return layout.coherence(word_spans(spark, sf_dir)).select("doc_id", "page", F.round("coherence", 9).alias("coherence"), "n_spans")


_GAPS = f"""{_LINES},
    n AS (SELECT *, lag(text) OVER w AS pt, lag(width) OVER w AS pw, lag(x) OVER w AS px, lag(font_size) OVER w AS ps, lag(space_width) OVER w AS psp FROM ln WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x, span_idx)),
    q AS (SELECT *, x - (px + pw) AS gap2, (ps + font_size) / 2 AS size, (CASE WHEN length(pt) > 0 AND pw > 0 THEN pw / length(pt) ELSE ps END + CASE WHEN length(text) > 0 AND width > 0 THEN width / length(text) ELSE font_size END) / 2 AS cw, coalesce(psp, space_width) AS known FROM n),
    sp AS (SELECT *, coalesce(CASE WHEN gap2 <= 0 OR size <= 0 THEN false WHEN known IS NOT NULL THEN gap2 > known * 0.5 WHEN gap2 / greatest(size, cw) < 0.03 THEN false WHEN gap2 / greatest(size, cw) > 0.15 THEN true
               ELSE gap2 > cw / CASE WHEN cw / greatest(size, cw) * 1000 < 300 THEN 2.0 WHEN cw / greatest(size, cw) * 1000 < 500 THEN 4.0 WHEN cw / greatest(size, cw) * 1000 < 700 THEN 5.0 ELSE 6.0 END END, false) AS space_before FROM q)"""


@query("word_gaps", f"WITH {_GAPS} SELECT doc_id, page, line, span_idx, gap2 AS gap, space_before FROM sp")
def word_gaps(spark, sf_dir):
    return layout.word_gaps(layout.native_lines(word_spans(spark, sf_dir))).select("doc_id", "page", "line", "span_idx", "gap", "space_before")


@query("baseline_clusters", f"WITH {_LINES} SELECT doc_id, page, line, count(*) AS n_spans, max(y) AS y FROM ln GROUP BY ALL")
def baseline_clusters(spark, sf_dir):
    spans = word_spans(spark, sf_dir).select("doc_id", "page", "span_idx", "x", "y")
    return layout.baseline_lines(spans).groupBy("doc_id", "page", "line").agg(F.count("*").alias("n_spans"), F.max("y").alias("y"))


@query(
    "stream_lines",
    f"""WITH {WORD_SPANS}, g AS (SELECT doc_id, page, y, count(*) AS n_spans, min(span_idx) AS k FROM spans GROUP BY doc_id, page, y)
    SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1)::INT AS line, n_spans, y FROM g""",
)
def stream_lines(spark, sf_dir):
    spans = word_spans(spark, sf_dir).select("doc_id", "page", "span_idx", "y")
    return layout.stream_lines(spans).groupBy("doc_id", "page", "line").agg(F.count("*").alias("n_spans"), F.max("y").alias("y"))


@query(
    "page_text",
    f"""WITH {_GAPS.replace("FROM ln WINDOW", "FROM ln WHERE NOT is_invisible WINDOW")},
    t AS (SELECT doc_id, page, line, string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY x, span_idx) AS text FROM sp GROUP BY ALL)
    SELECT doc_id, page, md5(string_agg(text, chr(10) ORDER BY line)) AS text_md5, count(*) AS n_lines FROM t GROUP BY doc_id, page""",
)
def page_text(spark, sf_dir):
    lines = layout.line_text(layout.native_lines(word_spans(spark, sf_dir)))
    return layout.page_text(lines).select("doc_id", "page", F.md5("text").alias("text_md5"), "n_lines")


@query(
    "merged_spans",
    f"""WITH {_GAPS},
    r AS (SELECT *, lag(font_name) OVER w = font_name AND abs(ps - font_size) < 0.1 AND CASE WHEN gap2 < 0 THEN -gap2 < CASE WHEN length(pt) > 0 AND pw > 0 THEN pw / length(pt) ELSE ps END * 0.5 ELSE NOT space_before END AS same
          FROM sp WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x, span_idx)),
    k AS (SELECT *, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, line ORDER BY x, span_idx) AS run FROM r)
    SELECT doc_id, page, line, run::BIGINT AS run, string_agg(text, '' ORDER BY x, span_idx) AS text, min(x) AS x, max(x + width) - min(x) AS width FROM k GROUP BY doc_id, page, line, run""",
)
def merged_spans(spark, sf_dir):
    return layout.merged_spans(layout.native_lines(word_spans(spark, sf_dir))).select("doc_id", "page", "line", "run", "text", "x", "width")


_DOM = """dom AS (SELECT doc_id, max_by(t, n * 100000 - t) / 10.0::DOUBLE AS dominant FROM (SELECT doc_id, round(font_size * 10)::INT AS t, count(*) AS n FROM spans WHERE NOT is_invisible AND font_size >= 0.5 GROUP BY ALL) GROUP BY doc_id)"""


@query(
    "heading_inference",
    f"""WITH {_LINES}, {_DOM},
    l AS (SELECT doc_id, page, line, avg(font_size) AS s FROM ln WHERE NOT is_invisible GROUP BY ALL)
    SELECT doc_id, page, line, dominant, CASE WHEN s > dominant * 1.8 THEN 1 WHEN s > dominant * 1.5 THEN 2 WHEN s > dominant * 1.2 THEN 3 ELSE 0 END AS level FROM l JOIN dom USING (doc_id)""",
)
def heading_inference(spark, sf_dir):
    spans = word_spans(spark, sf_dir)
    lines = layout.line_text(layout.native_lines(spans)).join(layout.dominant_size(spans), "doc_id")
    return lines.select("doc_id", "page", "line", "dominant", layout.heading_level(F.col("avg_size"), F.col("dominant")).alias("level"))


@query(
    "spans_to_blocks",
    f"""WITH {_GAPS.replace("FROM ln WINDOW", "FROM ln WHERE NOT is_invisible WINDOW")}, {_DOM},
    t AS (SELECT doc_id, page, line, string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY x, span_idx) AS text, max(y) AS y, avg(font_size) AS s FROM sp GROUP BY ALL),
    v AS (SELECT *, CASE WHEN s > dominant * 1.8 THEN 1 WHEN s > dominant * 1.5 THEN 2 WHEN s > dominant * 1.2 THEN 3 ELSE 0 END AS lv FROM t JOIN dom USING (doc_id))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y DESC, line) - 1)::INT AS ord, CASE WHEN lv > 0 THEN 'heading' ELSE 'paragraph' END AS kind, nullif(lv, 0) AS level, text, page FROM v""",
)
def spans_to_blocks(spark, sf_dir):
    spans = word_spans(spark, sf_dir)
    return layout.pages_to_blocks(spans, layout.line_text(layout.native_lines(spans)))


@query(
    "vertical_gaps",
    f"""WITH {_LINES}, l AS (SELECT doc_id, page, line, max(y) AS y FROM ln WHERE NOT is_invisible GROUP BY ALL),
    d AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC, line) - y > 10 AS g FROM l)
    SELECT doc_id, page, line, (sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y DESC, line))::INT AS section FROM d""",
)
def vertical_gaps(spark, sf_dir):
    lines = layout.line_text(layout.native_lines(word_spans(spark, sf_dir)))
    return layout.vertical_gaps(lines, 10.0).select("doc_id", "page", "line", "section")


@query(
    "column_cuts",
    f"""WITH {_S}, e AS (SELECT DISTINCT doc_id, page, x FROM spans), g AS (SELECT *, lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS l FROM e),
    r AS (SELECT doc_id, page, y, min(x) AS lo, max(x) AS hi FROM spans GROUP BY ALL), n AS (SELECT doc_id, page, count(*) AS n FROM r GROUP BY ALL),
    b AS (SELECT g.doc_id, g.page, g.l, g.x AS rgt, sum(CASE WHEN lo <= l AND hi >= x THEN 1 ELSE 0 END) / max(n) AS share FROM g JOIN r USING (doc_id, page) JOIN n USING (doc_id, page) WHERE g.x - g.l >= 15 GROUP BY g.doc_id, g.page, g.l, g.x)
    SELECT doc_id, page, l AS "left", rgt AS "right", share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY (rgt - l) * share DESC, l) AS k FROM b WHERE share >= 0.3) WHERE k = 1""",
)
def column_cuts(spark, sf_dir):
    return layout.columns_cut(word_spans(spark, sf_dir))


@query("spans_box", f"WITH {_S} SELECT doc_id, page, min(x) AS x_min, min(y) AS y_min, max(x + width) AS x_max, max(y + font_size) AS y_max FROM spans GROUP BY ALL")
def spans_box(spark, sf_dir):
    return layout.spans_box(word_spans(spark, sf_dir))


# ---------------------------------------------------------------- boxes and lines from orders

_BOX = "{'x_min': (l_partkey % 50)::DOUBLE, 'y_min': (l_suppkey % 40)::DOUBLE, 'x_max': (l_partkey % 50 + l_quantity)::DOUBLE, 'y_max': (l_suppkey % 40 + l_linenumber * 9)::DOUBLE}"
_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"


def _boxes(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    d = lambda c: c.cast("double")
    b = G.box(d(F.col("l_partkey") % 50), d(F.col("l_suppkey") % 40), d(F.col("l_partkey") % 50 + F.col("l_quantity")), d(F.col("l_suppkey") % 40 + F.col("l_linenumber") * 9))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("table_id"), b.alias("b"), F.lit(0).alias("page"))


@query(
    "box_overlaps",
    f"""WITH t AS (SELECT l_orderkey AS doc_id, {_NTH} AS table_id, {_BOX} AS b FROM lineitem),
    p AS (SELECT t.doc_id, t.table_id AS a_id, u.table_id AS b_id, t.b AS a, u.b AS c,
                 greatest(least(t.b.x_max, u.b.x_max) - greatest(t.b.x_min, u.b.x_min), 0) * greatest(least(t.b.y_max, u.b.y_max) - greatest(t.b.y_min, u.b.y_min), 0) AS i FROM t JOIN t u ON u.doc_id = t.doc_id AND t.table_id < u.table_id)
    SELECT doc_id, a_id::INT AS a_id, b_id::INT AS b_id, i AS inter, round(CASE WHEN aa + ac - i > 0 THEN i / (aa + ac - i) ELSE 0 END, 9) AS iou,
           a.x_min <= c.x_max AND c.x_min <= a.x_max AND a.y_min <= c.y_max AND c.y_min <= a.y_max AS touches
    FROM (SELECT *, (a.x_max - a.x_min) * (a.y_max - a.y_min) AS aa, (c.x_max - c.x_min) * (c.y_max - c.y_min) AS ac FROM p)""",
)
def box_overlaps(spark, sf_dir):
    t = _boxes(spark, sf_dir)
    u = t.select("doc_id", F.col("table_id").alias("b_id"), F.col("b").alias("c"))
    p = t.join(u, "doc_id").where("table_id < b_id")
    b, c = F.col("b"), F.col("c")
    return p.select("doc_id", F.col("table_id").alias("a_id"), "b_id", G.intersection_area(b, c).alias("inter"), F.round(G.iou(b, c), 9).alias("iou"), G.intersects(b, c).alias("touches"))


_SEG = """seg AS (SELECT l_orderkey AS doc_id, 0 AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS axis, (l_partkey % 12 * 30)::DOUBLE AS "at", (l_suppkey % 10 * 12)::DOUBLE AS lo, (l_suppkey % 10 * 12 + l_quantity * 4 + 6)::DOUBLE AS hi FROM lineitem),
    o AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, page, axis, "at" ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, axis, "at" ORDER BY lo, hi) AS run FROM o),
    mg AS (SELECT doc_id, page, axis, "at", min(lo) AS lo, max(hi) AS hi FROM n GROUP BY doc_id, page, axis, "at", run)"""


def _segments(spark, sf_dir):
    h = F.col("l_linenumber") % 2 == 0
    at, lo = (F.col("l_partkey") % 12 * 30).cast("double"), (F.col("l_suppkey") % 10 * 12).cast("double")
    hi = (F.col("l_suppkey") % 10 * 12 + F.col("l_quantity") * 4 + 6).cast("double")
    items = table(spark, sf_dir, "lineitem")
    items = dealt(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey", items)
    rows = items.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.when(h, lo).otherwise(at).alias("x1"), F.when(h, at).otherwise(lo).alias("y1"), F.when(h, hi).otherwise(at).alias("x2"), F.when(h, at).otherwise(hi).alias("y2"))
    return tables.merged_lines(tables.ruled_lines(rows))


@query("ruled_lines", f"WITH {_SEG} SELECT * FROM mg")
def ruled_lines(spark, sf_dir):
    return _segments(spark, sf_dir).select("doc_id", "page", "axis", "at", "lo", "hi")


@query(
    "line_crossings",
    f"""WITH {_SEG} SELECT DISTINCT h.doc_id, h.page, v."at" AS x, h."at" AS y FROM mg h JOIN mg v ON v.doc_id = h.doc_id AND v.page = h.page
    WHERE h.axis = 'h' AND v.axis = 'v' AND v."at" BETWEEN h.lo - 3 AND h.hi + 3 AND h."at" BETWEEN v.lo - 3 AND v.hi + 3""",
)
def line_crossings(spark, sf_dir):
    return tables.crossings(_segments(spark, sf_dir))


@query("lattice_cells")
def lattice_cells(spark, sf_dir):
    return tables.grids(_segments(spark, sf_dir))


# ---------------------------------------------------------------- emitters

_MD = "CASE WHEN kind = 'heading' THEN repeat('#', level) || ' ' || text ELSE text END"


@query(
    "emit_text",
    f"""WITH {LINE_BLOCKS.lstrip()}, p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) AS pk FROM blocks)
    SELECT doc_id, md5(string_agg(CASE WHEN pk IS NOT NULL AND NOT (pk = 'paragraph' AND kind = 'paragraph') THEN chr(10) ELSE '' END || {_MD} || chr(10), '' ORDER BY ord)) AS text_md5 FROM p GROUP BY doc_id""",
)
def emit_text(spark, sf_dir):
    return emit.plain_text(line_blocks(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@query("emit_markdown", f"WITH {LINE_BLOCKS.lstrip()} SELECT doc_id, md5(string_agg({_MD}, chr(10) || chr(10) ORDER BY ord)) AS markdown_md5 FROM blocks GROUP BY doc_id")
def emit_markdown(spark, sf_dir):
    return emit.markdown(line_blocks(spark, sf_dir)).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query(
    "emit_markdown_anchors",
    f"""WITH {LINE_BLOCKS.lstrip()} SELECT doc_id, md5(string_agg(coalesce('<!-- page=' || (page + 1) || ' node=' || ord || ' -->' || chr(10), '') || {_MD}, chr(10) || chr(10) ORDER BY ord)) AS markdown_md5 FROM blocks GROUP BY doc_id""",
)
def emit_markdown_anchors(spark, sf_dir):
    return emit.markdown(line_blocks(spark, sf_dir), anchors=True).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query(
    "emit_json_lines",
    f"""WITH {LINE_BLOCKS.lstrip()}
    SELECT doc_id, 0 AS rank, 0 AS ord, 'header' AS record, NULL AS type, NULL::BIGINT AS blocks FROM documents
    UNION ALL SELECT doc_id, 1, ord, 'block', kind, NULL FROM blocks
    UNION ALL SELECT doc_id, 2, 0, 'footer', NULL, count(*) FROM blocks GROUP BY doc_id""",
)
def emit_json_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("MD").alias("format"))
    lines = emit.json_lines(docs, line_blocks(spark, sf_dir))
    return lines.select("doc_id", "rank", "ord", F.get_json_object("line", "$.record").alias("record"), F.get_json_object("line", "$.type").alias("type"), F.get_json_object("line", "$.blocks").cast("long").alias("blocks"))


# ---------------------------------------------------------------- folds without SQL


_COHERENCE = """med AS (SELECT doc_id, page, list_sort(list(font_size))[(count(*) // 2 + 1)::INT] AS size FROM {0} GROUP BY doc_id, page),
    cx AS (SELECT s.*, s.x + greatest(s.width, 0) / 2 AS cx, size FROM {0} s JOIN med ON med.doc_id = s.doc_id AND med.page = s.page),
    isl AS (SELECT *, sum(CASE WHEN cx - before > 2 * size THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY cx, span_idx) AS island FROM (SELECT *, lag(cx) OVER (PARTITION BY doc_id, page ORDER BY cx, span_idx) AS before FROM cx)),
    dn AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page, island ORDER BY span_idx) AS up FROM isl),
    sc AS (SELECT doc_id, page, island, count(*) AS n, coalesce(sum(CASE WHEN y <= up THEN 1.0::DOUBLE ELSE 0 END) FILTER (up IS NOT NULL) / count(up), 1.0) AS score FROM dn GROUP BY doc_id, page, island),
    coh AS (SELECT doc_id, page, sum(score * n) / sum(n) AS coherence FROM sc GROUP BY doc_id, page)"""


def _shuffled(spark, sf_dir):
    """Pages of two columns whose spans come in no order."""
    spans = word_spans(spark, sf_dir).where("doc_id % 4 = 0 and span_idx < 100003")
    return spans.withColumns({"x": F.when(F.col("x") >= 650, F.col("x") + 100).otherwise(F.col("x")), "span_idx": (F.col("span_idx").cast("long") * 7919 % 100003).cast("int")})


@query(
    "column_order",
    f"""WITH {WORD_SPANS}, sh AS (SELECT doc_id, page, (span_idx::BIGINT * 7919 % 100003)::INT AS span_idx, text, CASE WHEN x >= 650 THEN x + 100 ELSE x END AS x, y, width, font_size FROM spans WHERE doc_id % 4 = 0 AND span_idx < 100003),
    {_COHERENCE.format("sh")},
    st AS (SELECT doc_id, page, count(*) AS n, count(DISTINCT y) AS n_rows, count(DISTINCT CASE WHEN x < 700 THEN y END) AS l_rows, count(DISTINCT CASE WHEN x >= 700 THEN y END) AS r_rows, count(*) FILTER (x < 700) AS l_words, count(*) FILTER (x >= 700) AS r_words FROM sh GROUP BY doc_id, page),
    k AS (SELECT st.doc_id, st.page, coherence, n >= 4 AND r_rows > 0 AND r_rows >= 0.3 * n_rows AND l_words >= 4 * l_rows AND r_words >= 4 * r_rows AS cut FROM st JOIN coh ON coh.doc_id = st.doc_id AND coh.page = st.page),
    o AS (SELECT sh.doc_id, sh.page, span_idx, coherence, CASE WHEN coherence <= 0.75 AND cut AND x >= 700 THEN 1 ELSE 0 END AS part, x, y FROM sh JOIN k ON k.doc_id = sh.doc_id AND k.page = sh.page)
    SELECT doc_id, page, span_idx, part, CASE WHEN coherence > 0.75 THEN span_idx ELSE row_number() OVER (PARTITION BY doc_id, page ORDER BY part, y DESC, x, span_idx) - 1 END::INT AS rank FROM o""",
)
def column_order(spark, sf_dir):
    """Left column first, then the right one, where stream order says nothing."""
    from foliant.operators.reading import page_order

    return page_order(_shuffled(spark, sf_dir))


@query("page_order", f"""WITH {WORD_SPANS}, {_COHERENCE.format("spans")} SELECT s.doc_id, s.page, span_idx, 0 AS part, span_idx AS rank FROM spans s JOIN coh ON coh.doc_id = s.doc_id AND coh.page = s.page WHERE coherence > 0.75""")
def page_order(spark, sf_dir):
    from foliant.operators.reading import page_order

    return page_order(word_spans(spark, sf_dir))


@query(
    "text_tables",
    f"""WITH {WORD_SPANS}, p AS (SELECT doc_id, page, list_sort(list(font_size))[(count(*) // 2 + 1)::INT] AS size, count(DISTINCT y) AS n_rows, max(x + width) AS edge FROM spans GROUP BY doc_id, page),
    r AS (SELECT doc_id, page, y, count(*) AS k, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) - 1 AS row FROM spans GROUP BY doc_id, page, y),
    c AS (SELECT *, row_number() OVER w - 1 AS col, lead(x) OVER w AS next FROM (SELECT s.doc_id, s.page, x FROM spans s JOIN p ON p.doc_id = s.doc_id AND p.page = s.page GROUP BY s.doc_id, s.page, x, n_rows HAVING count(*) >= greatest(2, n_rows // 2)) WINDOW w AS (PARTITION BY doc_id, page ORDER BY x)),
    t AS (SELECT p.doc_id, p.page, size, edge FROM p WHERE n_rows >= 3 AND (SELECT count(*) FROM c WHERE c.doc_id = p.doc_id AND c.page = p.page) >= 2 AND (SELECT count(*) FROM r WHERE r.doc_id = p.doc_id AND r.page = p.page AND k >= 2) >= 0.4 * n_rows)
    SELECT t.doc_id, t.page, 0 AS table_id, r.row::INT AS row, c.col::INT AS col, coalesce(s.text, '') AS text, c.x AS x_min, r.y - 0.5 * size AS y_min, coalesce(c.next, edge) AS x_max, r.y + size AS y_max
    FROM t JOIN r ON r.doc_id = t.doc_id AND r.page = t.page JOIN c ON c.doc_id = t.doc_id AND c.page = t.page LEFT JOIN spans s ON s.doc_id = t.doc_id AND s.page = t.page AND s.y = r.y AND s.x = c.x""",
)
def text_tables(spark, sf_dir):
    from foliant.operators.reading import text_tables

    return text_tables(word_spans(spark, sf_dir))
