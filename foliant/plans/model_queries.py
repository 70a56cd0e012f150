"""Queries of the document model: overlays, page breaks, lists, styles, layers, output modes and page diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import layout, model, tables
from foliant.plans.adapters import LINE_BLOCKS, WORD_SPANS, line_blocks, table, word_spans
from foliant.plans.registry import query

_OVERLAY = "o AS (SELECT doc_id, ord AS node_id, 'align-' || (ord % 4) AS value FROM blocks WHERE ord % 3 = 0)"


def _overlay(blocks):
    return blocks.where(F.col("ord") % 3 == 0).select("doc_id", F.col("ord").alias("node_id"), F.concat(F.lit("align-"), F.col("ord") % 4).alias("value"))


@query("overlay_iteration", f"WITH {LINE_BLOCKS}, {_OVERLAY} SELECT doc_id, node_id, value FROM o")
def overlay_iteration(spark, sf_dir):
    overlay = _overlay(line_blocks(spark, sf_dir))
    return model.overlay_values(overlay.unionByName(overlay))


@query("overlay_lookup", f"WITH {LINE_BLOCKS}, {_OVERLAY} SELECT blocks.doc_id, ord, text, value AS alignment FROM blocks LEFT JOIN o ON o.doc_id = blocks.doc_id AND o.node_id = ord")
def overlay_lookup(spark, sf_dir):
    blocks = line_blocks(spark, sf_dir)
    return model.with_overlay(blocks.select("doc_id", "ord", "text"), _overlay(blocks), "alignment")


@query("annotated_blocks", f"WITH {LINE_BLOCKS} SELECT doc_id, ord, kind FROM blocks WHERE ord % 3 = 0")
def annotated_blocks(spark, sf_dir):
    blocks = line_blocks(spark, sf_dir)
    return model.with_node_in(blocks.select("doc_id", "ord", "kind"), _overlay(blocks))


@query(
    "page_breaks",
    f"""WITH {LINE_BLOCKS}, p AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks),
    a AS (SELECT doc_id, ord, 1 AS part, kind, text, page FROM blocks UNION ALL
          SELECT doc_id, ord, 0, 'page_break', '', page FROM p WHERE page IS NOT NULL AND ord > 0 AND page <> coalesce(before, 0))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, part) - 1)::INT AS place, kind, text, coalesce(page, -1)::INT AS page FROM a""",
)
def page_breaks(spark, sf_dir):
    return model.with_page_breaks(line_blocks(spark, sf_dir)).withColumn("page", F.coalesce("page", F.lit(-1)))


_ITEMS = "i AS (SELECT doc_id, ord, CASE WHEN ord % 7 < 5 THEN 'n' || (ord // 3 % 4) END AS num_id, ord % 2 AS ilvl FROM blocks)"


@query(
    "list_groups",
    f"""WITH {LINE_BLOCKS}, {_ITEMS},
    n AS (SELECT *, sum(CASE WHEN num_id IS NOT NULL AND num_id IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS list_no FROM (SELECT *, lag(num_id) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM i))
    SELECT doc_id, list_no::INT AS list_no, any_value(num_id) AS num_id, min(ord)::INT AS first_ord, count(*) AS n_items FROM n WHERE num_id IS NOT NULL GROUP BY doc_id, list_no""",
)
def list_groups(spark, sf_dir):
    items = _items(line_blocks(spark, sf_dir))
    return model.lists(items).groupBy("doc_id", "list_no").agg(F.first("num_id").alias("num_id"), F.min("ord").cast("int").alias("first_ord"), F.count("*").alias("n_items"))


def _items(blocks):
    number = F.concat(F.lit("n"), (F.floor(F.col("ord") / 3) % 4).cast("int"))
    return blocks.select("doc_id", "ord", F.when(F.col("ord") % 7 < 5, number).alias("num_id"), (F.col("ord") % 2).alias("ilvl"))


_LEVELS = [("n0", 0, "decimal", 1), ("n0", 1, "lowerLetter", 3), ("n1", 0, "bullet", 1), ("n1", 1, "none", 1), ("n2", 0, "decimal", 5)]
_OVERRIDES = [("n0", 0, "bullet", None), ("n1", 1, None, 7), ("n2", 1, "upperRoman", 2)]


def _values(rows):
    return ", ".join("({})".format(", ".join("NULL" if x is None else repr(x) for x in r)) for r in rows)


@query(
    "list_numbering",
    f"""WITH {LINE_BLOCKS}, {_ITEMS}, l(num_id, ilvl, fmt, start) AS (VALUES {_values(_LEVELS)}), v(num_id, ilvl, fmt, start) AS (VALUES {_values(_OVERRIDES)})
    SELECT doc_id, ord, coalesce((coalesce(v.fmt, l.fmt) NOT IN ('bullet', 'none'))::VARCHAR, 'none') AS ordered, coalesce(v.start, l.start, 1)::BIGINT AS start
    FROM i LEFT JOIN l ON l.num_id = i.num_id AND l.ilvl = i.ilvl LEFT JOIN v ON v.num_id = i.num_id AND v.ilvl = i.ilvl WHERE i.num_id IS NOT NULL""",
)
def list_numbering(spark, sf_dir):
    schema = "num_id string, ilvl int, fmt string, start long"
    items = _items(line_blocks(spark, sf_dir)).where("num_id is not null")
    return model.numbered(items, F.broadcast(spark.createDataFrame(_LEVELS, schema)), F.broadcast(spark.createDataFrame(_OVERRIDES, schema))).select("doc_id", "ord", F.coalesce(F.col("ordered").cast("string"), F.lit("none")).alias("ordered"), "start")


_STYLES = "s AS (SELECT c_custkey AS style_id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 = 0 END AS bold FROM customer)"


@query(
    "style_inheritance",
    f"""WITH RECURSIVE {_STYLES}, r AS (SELECT style_id, parent, bold FROM s UNION ALL SELECT r.style_id, s.parent, s.bold FROM r JOIN s ON s.style_id = r.parent WHERE r.bold IS NULL)
    SELECT style_id, coalesce(bool_or(bold)::VARCHAR, 'unset') AS bold FROM r GROUP BY style_id""",
)
def style_inheritance(spark, sf_dir):
    key = F.col("c_custkey")
    styles = table(spark, sf_dir, "customer").select(key.alias("style_id"), F.when(key > 1, F.floor(key / 2)).alias("parent"), F.when(key % 5 == 0, key % 2 == 0).alias("bold")).distinct()
    return model.inherited(styles, "bold").select("style_id", F.coalesce(F.col("bold").cast("string"), F.lit("unset")).alias("bold"))


@query(
    "length_units",
    """WITH v AS (SELECT p_partkey, ' ' || p_size || ([ '.5pt', 'cm', 'in', 'mm ', 'px', 'x cm' ])[(p_partkey % 6 + 1)::INT] AS length, p_partkey % 6 AS k, p_size FROM part)
    SELECT p_partkey, length, CASE k WHEN 0 THEN p_size + 0.5::DOUBLE WHEN 1 THEN p_size * 28.3465::DOUBLE WHEN 2 THEN p_size * 72.0::DOUBLE WHEN 3 THEN p_size * 2.83465::DOUBLE END AS points FROM v""",
)
def length_units(spark, sf_dir):
    units = F.array(*[F.lit(x) for x in (".5pt", "cm", "in", "mm ", "px", "x cm")])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_size", F.element_at(units, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("length"))
    return rows.withColumn("points", model.length_points(F.col("length")))


_MODES = "k AS (SELECT event_id, event_id % 16 AS f, ([NULL, 'json', 'text', 'markdown', 'tsv'])[(event_id % 5 + 1)::INT] AS explicit FROM events)"


@query(
    "output_modes",
    f"""WITH {_MODES}, m AS (SELECT *, list_filter([CASE WHEN f & 1 = 1 THEN 'json' END, CASE WHEN f & 2 = 2 THEN 'jsonl' END, CASE WHEN f & 4 = 4 THEN 'tsv' END, CASE WHEN f & 8 = 8 THEN 'markdown' END], lambda x: x IS NOT NULL) AS flags FROM k),
    n AS (SELECT *, MAP {{'json': '-j/--json', 'jsonl': '-J/--jsonl', 'tsv': '-t/--tables', 'markdown': '-m/--markdown'}} AS names FROM m),
    e AS (SELECT event_id, explicit, flags, CASE WHEN len(flags) >= 2 THEN 'conflicting output shortcuts: ' || names[flags[1]] || ' and ' || names[flags[2]] || ' -- pick one'
          WHEN len(flags) = 1 AND explicit <> flags[1] THEN names[flags[1]] || ' conflicts with --out ' || explicit END AS error FROM n)
    SELECT event_id, CASE WHEN error IS NULL THEN coalesce(explicit, flags[1], 'text') END AS mode, error FROM e""",
)
def output_modes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = F.col("event_id") % 16
    explicit = F.element_at(F.array(F.lit(None).cast("string"), *[F.lit(x) for x in ("json", "text", "markdown", "tsv")]), (F.col("event_id") % 5 + 1).cast("int"))
    mode, error = model.output_mode(explicit, **{m: f.bitwiseAND(F.lit(1 << i)) != 0 for i, (m, _) in enumerate(model.FLAGS)})
    return e.select("event_id", mode.alias("mode"), error.alias("error"))


@query(
    "page_bundles",
    f"""WITH {LINE_BLOCKS}, k AS (SELECT doc_id, ord, coalesce(page, 0) AS page, text, CASE WHEN ord % 6 = 5 THEN 'table' WHEN ord % 11 = 4 THEN 'image' ELSE kind END AS kind FROM blocks)
    SELECT doc_id, page, coalesce(string_agg(CASE WHEN kind NOT IN ('table', 'image') THEN text END, chr(10) ORDER BY ord), '') AS lines, count(CASE WHEN kind = 'table' THEN 1 END)::INT AS n_tables FROM k GROUP BY doc_id, page""",
)
def page_bundles(spark, sf_dir):
    kind = F.when(F.col("ord") % 6 == 5, "table").when(F.col("ord") % 11 == 4, "image").otherwise(F.col("kind"))
    bundles = model.page_bundles(line_blocks(spark, sf_dir).withColumn("kind", kind), model.PRESETS["batch"])
    return bundles.select("doc_id", "page", F.array_join("lines", "\n").alias("lines"), F.size("tables").alias("n_tables"))


@query(
    "layer_presets",
    f"""WITH {LINE_BLOCKS}, k AS (SELECT doc_id, ord, (['paragraph', 'table', 'image', 'link', 'note'])[(ord % 5 + 1)::INT] AS kind FROM blocks)
    SELECT doc_id, count(*) FILTER (kind NOT IN ('image', 'link', 'note'))::INT AS batch, count(*) FILTER (kind NOT IN ('link', 'note'))::INT AS content_only, count(*)::INT AS agent FROM k GROUP BY doc_id""",
)
def layer_presets(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("paragraph", "table", "image", "link", "note")])
    block = F.struct(F.element_at(kinds, (F.col("ord") % 5 + 1).cast("int")).alias("kind"))
    docs = line_blocks(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(block).alias("blocks"))
    for name in ("batch", "content_only", "agent"):
        docs = docs.withColumn(name, F.size(model.shown(F.col("blocks"), model.PRESETS[name])))
    return docs.drop("blocks")


@query(
    "full_width_lines",
    f"""WITH {WORD_SPANS}, h AS (SELECT *, greatest(width, 0) AS w FROM spans),
    p AS (SELECT doc_id, page, count(*) AS n, max(x + w) - min(x) AS content, list_sort(list(w) FILTER (w > 0)) AS ws FROM h GROUP BY doc_id, page),
    c AS (SELECT doc_id, page, CASE WHEN len(ws) >= 3 THEN greatest(1.3 * ws[(len(ws) // 2 + 1)::INT], 0.5 * content) ELSE 0.8 * content END AS cutoff FROM p WHERE n >= 3 AND content > 0),
    l AS (SELECT doc_id, page, y, max(x + w) - min(x) AS extent, list_sort(list(x)) AS xs FROM h GROUP BY doc_id, page, y),
    g AS (SELECT *, list_sort(list_transform(generate_series(1, len(xs) - 1), lambda i: xs[i + 1] - xs[i])) AS gaps FROM l)
    SELECT g.doc_id, g.page, g.y, extent > cutoff AND NOT (len(gaps) > 0 AND list_max(gaps) > 15 AND (len(gaps) <= 2 OR list_max(gaps) > 3 * gaps[(len(gaps) // 2 + 1)::INT])) AS full_width
    FROM g JOIN c ON c.doc_id = g.doc_id AND c.page = g.page""",
)
def full_width_lines(spark, sf_dir):
    lines = layout.full_width(layout.native_lines(word_spans(spark, sf_dir)))
    return lines.select("doc_id", "page", "y", "full_width")


@query(
    "reinserted_lines",
    f"""WITH {WORD_SPANS}, l AS (SELECT doc_id, page, y, min(span_idx) AS k FROM spans GROUP BY doc_id, page, y),
    m AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS pos FROM l WHERE y::INT % 3 <> 0),
    f AS (SELECT * FROM l WHERE y::INT % 3 = 0),
    n AS (SELECT doc_id, page, count(*) AS n FROM m GROUP BY doc_id, page),
    a AS (SELECT f.doc_id, f.page, f.y, coalesce(min(m.pos), any_value(coalesce(n.n, 0))) AS pos FROM f LEFT JOIN m ON m.doc_id = f.doc_id AND m.page = f.page AND m.y <= f.y LEFT JOIN n ON n.doc_id = f.doc_id AND n.page = f.page GROUP BY f.doc_id, f.page, f.y),
    b AS (SELECT doc_id, page, y, pos, 0 AS own FROM a UNION ALL SELECT doc_id, page, y, pos, 1 FROM m)
    SELECT doc_id, page, y, (row_number() OVER (PARTITION BY doc_id, page ORDER BY pos, own, y DESC) - 1)::INT AS place FROM b""",
)
def reinserted_lines(spark, sf_dir):
    from pyspark.sql import Window

    lines = word_spans(spark, sf_dir).groupBy("doc_id", "page", "y").agg(F.min("span_idx").alias("k"))
    masked = F.col("y").cast("decimal(20,0)").cast("int") % 3 == 0
    order = Window.partitionBy("doc_id", "page").orderBy("k")
    main = lines.where(~masked).withColumn("pos", F.row_number().over(order) - 1)
    return layout.reinserted(main.select("doc_id", "page", "y", "pos"), lines.where(masked).select("doc_id", "page", "y")).select("doc_id", "page", "y", "place")


@query(
    "tier_diagnostics",
    f"""WITH {WORD_SPANS}, m AS (SELECT doc_id, page, list_sort(list(font_size))[(count(*) // 2 + 1)::INT] AS med FROM spans GROUP BY doc_id, page),
    c AS (SELECT s.doc_id, s.page, span_idx, y, x + greatest(width, 0) / 2 AS cx, med FROM spans s JOIN m ON m.doc_id = s.doc_id AND m.page = s.page),
    i AS (SELECT *, sum(CASE WHEN cx - p > 2 * med THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY cx, span_idx) AS island FROM (SELECT *, lag(cx) OVER (PARTITION BY doc_id, page ORDER BY cx, span_idx) AS p FROM c)),
    d AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page, island ORDER BY span_idx) AS up FROM i),
    k AS (SELECT doc_id, page, island, count(*) AS n, coalesce(sum(CASE WHEN y <= up THEN 1.0::DOUBLE ELSE 0 END) FILTER (up IS NOT NULL) / count(up), 1.0) AS score FROM d GROUP BY doc_id, page, island),
    t AS (SELECT doc_id, page, sum(score * n) / sum(n) AS coherence, sum(n)::BIGINT AS n_spans FROM k GROUP BY doc_id, page)
    SELECT doc_id, page, n_spans, CASE WHEN coherence > 0.75 THEN 1 ELSE 2 END AS tier, round(coherence, 6) AS coherence FROM t""",
)
def tier_diagnostics(spark, sf_dir):
    return layout.tiers(word_spans(spark, sf_dir)).select("doc_id", "page", "n_spans", "tier", F.round("coherence", 6).alias("coherence"))


@query("feature_report")
def feature_report(spark, sf_dir):
    return model.features(spark)


@query(
    "split_table_rows",
    f"""WITH {WORD_SPANS}, b AS (SELECT DISTINCT doc_id, page, 0 AS table_id, floor((760 - y) / 40)::INT AS row FROM spans),
    r AS (SELECT *, 0.0::DOUBLE AS x_min, 720.0::DOUBLE - 40 * row AS y_min, 2000.0::DOUBLE AS x_max, 760.0::DOUBLE - 40 * row AS y_max FROM b),
    h AS (SELECT r.doc_id, r.page, r.table_id, r.row, s.y, s.font_size FROM r JOIN spans s ON s.doc_id = r.doc_id AND s.page = r.page AND s.y BETWEEN y_min AND y_max AND s.x + s.width / 2 BETWEEN x_min AND x_max),
    z AS (SELECT doc_id, page, table_id, row, greatest(2.0, 0.6 * list_sort(list(font_size))[(count(*) // 2 + 1)::INT]) AS gap FROM h GROUP BY ALL),
    y AS (SELECT DISTINCT h.doc_id, h.page, h.table_id, h.row, y FROM h),
    c AS (SELECT doc_id, page, table_id, row, y, count(*) AS n FROM h GROUP BY ALL),
    l AS (SELECT c.*, CASE WHEN lag(c.y) OVER (PARTITION BY c.doc_id, c.page, c.table_id, c.row ORDER BY c.y DESC) - c.y > gap THEN 1 ELSE 0 END AS new FROM c JOIN z ON z.doc_id = c.doc_id AND z.page = c.page AND z.row = c.row),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, table_id, row ORDER BY y DESC) AS sub FROM l),
    m AS (SELECT doc_id, page, table_id, row, sub, sum(y * n) / sum(n) AS mean FROM g GROUP BY ALL),
    e AS (SELECT *, (lag(mean) OVER w + mean) / 2 AS up, (lead(mean) OVER w + mean) / 2 AS low FROM m WINDOW w AS (PARTITION BY doc_id, page, table_id, row ORDER BY sub))
    SELECT r.doc_id, r.page, r.table_id, r.row, coalesce(e.sub, 0)::INT AS sub, round(coalesce(low, y_min), 6) AS y_min, round(coalesce(up, y_max), 6) AS y_max
    FROM r LEFT JOIN e ON e.doc_id = r.doc_id AND e.page = r.page AND e.row = r.row""",
)
def split_table_rows(spark, sf_dir):
    spans = word_spans(spark, sf_dir)
    row = F.floor((760 - F.col("y")) / 40).cast("int")
    rows = spans.select("doc_id", "page", F.lit(0).alias("table_id"), row.alias("row")).distinct()
    rows = rows.withColumns({"x_min": F.lit(0.0), "y_min": 720.0 - 40 * F.col("row"), "x_max": F.lit(2000.0), "y_max": 760.0 - 40 * F.col("row")})
    return tables.split_rows(rows, spans).select("doc_id", "page", "table_id", "row", "sub", F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max"))
