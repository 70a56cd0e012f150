"""Table detection from ruled lines and spans, table quality and filters.

Joins are by (doc_id, page), so the theta conditions (crossings, points in boxes) only meet
rows of one page. Connected grids and greedy text tables are folds over one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.geometry import area, containment, iou
from foliant.operators.folds import fold

#: Tolerances in points and thresholds of filters. Fixed values.
SNAP = 3.0
JOIN_GAP = 6.0
MIN_LINE = 5.0
EDGE = 36.0
MIN_AREA_SHARE = 0.005
MIN_OCCUPANCY = 0.20
MIN_MULTI_COLUMN = 0.30
MIN_DENSITY = 0.03
MIN_TEXT_ROWS = 3
OVERLAP = 0.5


def ruled_lines(segments: DataFrame) -> DataFrame:
    """Horizontal and vertical lines of at least 5 points: axis, snapped place, start and end."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    axis = F.when((dy <= SNAP) & (dx >= MIN_LINE), "h").when((dx <= SNAP) & (dy >= MIN_LINE), "v")
    rows = segments.withColumn("axis", axis).where("axis is not null")
    h = F.col("axis") == "h"
    at = F.round(F.when(h, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2) / SNAP) * SNAP
    return rows.select("doc_id", "page", "axis", at.alias("at"), F.when(h, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("lo"), F.when(h, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("hi"))


def merged_lines(lines: DataFrame, gap: float = JOIN_GAP) -> DataFrame:
    """Collinear lines that overlap or lie within ``gap`` become one: islands over the running end."""
    w = Window.partitionBy("doc_id", "page", "axis", "at").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("_new", (reach.isNull() | (F.col("lo") > reach + gap)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy("doc_id", "page", "axis", "at", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def crossings(lines: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """Points where a horizontal and a vertical line of a page meet, within the tolerance on both axes."""
    h = lines.where("axis = 'h'").select("doc_id", "page", F.col("at").alias("y"), F.col("lo").alias("x1"), F.col("hi").alias("x2"))
    v = lines.where("axis = 'v'").select("doc_id", "page", F.col("at").alias("x"), F.col("lo").alias("y1"), F.col("hi").alias("y2"))
    meet = (F.col("x") >= F.col("x1") - tolerance) & (F.col("x") <= F.col("x2") + tolerance) & (F.col("y") >= F.col("y1") - tolerance) & (F.col("y") <= F.col("y2") + tolerance)
    return h.join(v, ["doc_id", "page"]).where(meet).select("doc_id", "page", "x", "y").distinct()


def grids(lines: DataFrame) -> DataFrame:
    """Cells of ruled tables: crossings linked along drawn lines form components; each with two xs and two ys is a table.

    A fold over the lines of a page. Cells carry spans over missing interior lines, and the
    table its box and whether it may go on at the page's edges.
    """
    out = "table_id int, row int, col int, row_span int, col_span int, x_min double, y_min double, x_max double, y_max double"

    def cells(rows: list) -> list[tuple]:
        hs = [(r["at"], r["lo"], r["hi"]) for r in rows if r["axis"] == "h"]
        vs = [(r["at"], r["lo"], r["hi"]) for r in rows if r["axis"] == "v"]
        points = sorted({(x, y) for y, x1, x2 in hs for x, y1, y2 in vs if x1 - SNAP <= x <= x2 + SNAP and y1 - SNAP <= y <= y2 + SNAP})
        parent = {p: p for p in points}

        def root(p):
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        def drawn(lines, at, lo, hi):
            return any(abs(a - at) <= SNAP and b - SNAP <= lo and hi <= c + SNAP for a, b, c in lines)

        for key, lines in ((1, hs), (0, vs)):
            by: dict[float, list] = {}
            for p in points:
                by.setdefault(p[key], []).append(p)
            for at, row in by.items():
                row.sort()
                for p, q in zip(row, row[1:], strict=False):
                    if drawn(lines, at, p[1 - key], q[1 - key]):
                        parent[root(p)] = root(q)
        groups: dict[tuple, list] = {}
        for p in points:
            groups.setdefault(root(p), []).append(p)
        tables = []
        for members in groups.values():
            xs, ys = sorted({p[0] for p in members}), sorted({p[1] for p in members}, reverse=True)
            if len(xs) >= 2 and len(ys) >= 2:
                tables.append((-ys[0], xs[0], xs, ys))
        found = []
        for t, (_, _, xs, ys) in enumerate(sorted(tables)):
            taken = set()
            for r in range(len(ys) - 1):
                for c in range(len(xs) - 1):
                    if (r, c) in taken:
                        continue
                    mid_y = (ys[r] + ys[r + 1]) / 2
                    edges = drawn(hs, ys[r], xs[c], xs[c + 1]) or drawn(hs, ys[r + 1], xs[c], xs[c + 1]) or drawn(vs, xs[c], ys[r + 1], ys[r]) or drawn(vs, xs[c + 1], ys[r + 1], ys[r])
                    if not edges:
                        continue
                    cs = 1
                    while c + cs < len(xs) - 1 and not drawn(vs, xs[c + cs], mid_y, mid_y):
                        cs += 1
                    rs = 1
                    while r + rs < len(ys) - 1 and not any(drawn(hs, ys[r + rs], (xs[c + k] + xs[c + k + 1]) / 2, (xs[c + k] + xs[c + k + 1]) / 2) for k in range(cs)):
                        rs += 1
                    taken.update((r + i, c + j) for i in range(rs) for j in range(cs))
                    found.append((t, r, c, rs, cs, xs[c], ys[r + rs], xs[c + cs], ys[r]))
        return found

    return fold(lines, ["doc_id", "page"], ["axis", "at", "lo", "hi"], [], cells, out)


def filled(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells with text: a span belongs to the first cell (row-major) whose closed box holds its x-centre and baseline.

    Lines of a cell break where the baseline moves by more than half the size; a space stands
    for a gap above 0.15 of the size.
    """
    s = spans.select("doc_id", "page", "span_idx", F.col("text").alias("t"), "x", "y", "width", "font_size")
    cx = F.col("x") + F.col("width") / 2
    inside = (cx >= F.col("x_min")) & (cx <= F.col("x_max")) & (F.col("y") >= F.col("y_min")) & (F.col("y") <= F.col("y_max"))
    hits = cells.join(s, ["doc_id", "page"]).where(inside)
    first = Window.partitionBy("doc_id", "page", "span_idx").orderBy("table_id", "row", "col")
    hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    by_y = Window.partitionBy("doc_id", "page", "table_id", "row", "col").orderBy(F.desc("y"), "x", "span_idx")
    step = F.lag("y").over(by_y) - F.col("y") > F.col("font_size") * 0.5
    hits = hits.withColumn("_line", F.sum(F.coalesce(step, F.lit(False)).cast("int")).over(by_y))
    in_line = Window.partitionBy("doc_id", "page", "table_id", "row", "col", "_line").orderBy("x", "span_idx")
    gap = F.col("x") - (F.lag("x").over(in_line) + F.lag("width").over(in_line))
    hits = hits.withColumn("_t", F.when(gap > F.col("font_size") * 0.15, F.concat(F.lit(" "), F.col("t"))).otherwise(F.col("t")))
    keys = ["doc_id", "page", "table_id", "row", "col"]
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "span_idx", F.col("_t").alias("t")))), lambda v: v["t"]), "")
    lines = hits.groupBy(*keys, "_line").agg(line.alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "l"))), lambda v: v["l"]), "\n")
    texts = lines.groupBy(*keys).agg(text.alias("text"))
    return cells.join(texts, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def quality(cells: DataFrame) -> DataFrame:
    """Occupancy, share of rows with two filled cells, data rows: two levels of grouping."""
    full = (F.trim("text") != "").cast("int")
    rows = cells.groupBy("doc_id", "table_id", "row", "is_header").agg(F.count("*").alias("n"), F.sum(full).alias("filled"))
    return rows.groupBy("doc_id", "table_id").agg(
        F.sum("filled").alias("non_empty_cells"),
        (F.sum("filled") / F.sum("n")).alias("cell_occupancy"),
        (F.count_if(F.col("filled") >= 2) / F.count("*")).alias("multi_column_rows"),
        F.count_if(~F.col("is_header")).alias("data_rows"),
        F.count("*").alias("n_rows"),
        F.max("n").alias("n_cols"),
    )


def text_density(cells: DataFrame) -> DataFrame:
    """Half the area of filled cells over the table's area, at most 1. Needs cell boxes."""
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    whole = (F.max("x_max") - F.min("x_min")) * (F.max("y_max") - F.min("y_min"))
    text = F.sum(F.when(F.trim("text") != "", w * h * 0.5).otherwise(0.0))
    return cells.groupBy("doc_id", "table_id").agg(F.when(whole > 0, F.least(text / whole, F.lit(1.0))).otherwise(0.0).alias("text_density"), whole.alias("area"))


def without_phantoms(tables: DataFrame, page_area: float) -> DataFrame:
    """Tables that are large, full and dense enough. ``tables`` has quality, density, area and method."""
    ruled, aligned = F.col("method") == "ruled", F.col("method") == "text"
    bad = (
        (F.col("area") < page_area * MIN_AREA_SHARE)
        | (F.col("non_empty_cells") == 0)
        | (ruled & (F.col("n_cols") < 2) & (F.col("n_rows") < 3))
        | (ruled & (F.col("n_rows") < 4) & (F.col("n_cols") < 4) & (F.col("non_empty_cells") < 4))
        | (F.col("cell_occupancy") < MIN_OCCUPANCY)
        | (aligned & (F.col("multi_column_rows") < MIN_MULTI_COLUMN))
        | (aligned & (F.col("data_rows") < MIN_TEXT_ROWS))
        | (F.col("text_density") < MIN_DENSITY)
    )
    return tables.where(~bad)


def without_dominated(lattice: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (box ``b``) that no lattice table (box ``b``) overlaps or contains by more than half."""
    l, c = lattice.select("doc_id", "page", F.col("b").alias("lb")), candidates
    over = (iou(F.col("b"), F.col("lb")) > OVERLAP) | (containment(F.col("b"), F.col("lb")) > OVERLAP)
    gone = c.join(l, ["doc_id", "page"]).where(over).select("doc_id", "page", "table_id").distinct()
    return c.join(gone, ["doc_id", "page", "table_id"], "left_anti")


def without_empty(cells: DataFrame) -> DataFrame:
    """Rows and columns in which no cell has text go; the rest is numbered anew."""
    keys = ["doc_id", "table_id"]
    full = F.max((F.trim("text") != "").cast("int"))
    rows = cells.groupBy(*keys, "row").agg(full.alias("f")).where("f = 1").select(*keys, "row", (F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1).alias("_r"))
    cols = cells.groupBy(*keys, "col").agg(full.alias("f")).where("f = 1").select(*keys, "col", (F.row_number().over(Window.partitionBy(*keys).orderBy("col")) - 1).alias("_c"))
    out = cells.join(rows, [*keys, "row"]).join(cols, [*keys, "col"])
    return out.withColumns({"row": F.col("_r").cast("int"), "col": F.col("_c").cast("int")}).drop("_r", "_c").select(*cells.columns)


def header_rows(cells: DataFrame) -> DataFrame:
    """Adds ``is_header``: the first row, if all its filled cells are bold."""
    bold = F.bool_and(F.when((F.col("row") == 0) & (F.trim("text") != ""), F.col("font_name").rlike("[Bb]old"))).over(Window.partitionBy("doc_id", "table_id"))
    return cells.withColumn("is_header", (F.col("row") == 0) & F.coalesce(bold, F.lit(False)))


def covered_by_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells without those that a merged region covers; its anchor carries the spans."""
    region = merges.withColumn("row", F.explode(F.sequence("row_lo", "row_hi"))).withColumn("col", F.explode(F.sequence("col_lo", "col_hi")))
    inner = region.where("row <> row_lo or col <> col_lo").select("doc_id", "table_id", "row", "col").distinct()
    anchors = merges.select("doc_id", "table_id", F.col("row_lo").alias("row"), F.col("col_lo").alias("col"), (F.col("row_hi") - F.col("row_lo") + 1).alias("_rs"), (F.col("col_hi") - F.col("col_lo") + 1).alias("_cs"))
    out = cells.join(inner, ["doc_id", "table_id", "row", "col"], "left_anti").join(anchors, ["doc_id", "table_id", "row", "col"], "left")
    return out.withColumns({"row_span": F.coalesce("_rs", F.lit(1)), "col_span": F.coalesce("_cs", F.lit(1))}).drop("_rs", "_cs")


def dense(cells: DataFrame) -> DataFrame:
    """Every row with data gets all columns up to the widest; trailing rows without text go."""
    keys = ["doc_id", "table_id"]
    last = cells.where(F.trim("text") != "").groupBy(*keys).agg(F.max("row").alias("last"))
    width = cells.groupBy(*keys).agg(F.max("col").alias("width"))
    rows = cells.select(*keys, "row").distinct().join(last, keys).where("row <= last").join(width, keys)
    grid = rows.select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("width"))).alias("col"))
    return grid.join(cells, [*keys, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def continuation(tables: DataFrame, page_height: float) -> DataFrame:
    """Adds whether a table may go on from the page before or to the next: its box is near the edge."""
    return tables.withColumns({"from_previous": page_height - F.col("b.y_max") <= EDGE, "to_next": F.col("b.y_min") <= EDGE})


def boxed(cells: DataFrame) -> DataFrame:
    """One row for each table with its box as ``b``."""
    b = F.struct(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))
    return cells.groupBy("doc_id", "page", "table_id").agg(b.alias("b")).withColumn("area", area(F.col("b")))


def split_rows(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of tables (doc_id, page, table_id, row and a box) that hold several baselines, split between them.

    Spans count whose x-centre and baseline are in the row's closed box; baselines further
    apart than 0.6 median sizes, and 2 points at least, are rows of their own, with borders
    midway between their means. Rows of mostly rotated text are not split.
    """
    page, box = ["doc_id", "page"], ["x_min", "y_min", "x_max", "y_max"]
    rotation = F.abs(F.col("rotation")) > 45 if "rotation" in spans.columns else F.lit(False)
    marks = spans.where(F.trim("text") != "").select(*page, (F.col("x") + F.col("width") / 2).alias("_cx"), F.col("y").cast("double").alias("_y"), F.col("font_size").cast("double").alias("_size"), rotation.alias("_turned")).where("_cx is not null and _y is not null")
    boxes = rows.select(*page, "table_id", "row", *[F.col(c).cast("double").alias(c) for c in box])
    both = boxes.unionByName(marks, allowMissingColumns=True).withColumn("_mark", F.col("_cx").isNotNull())

    def split(items: list) -> list[tuple]:
        # the page's rows come before its marks, and these from top to bottom
        at = next((i for i, x in enumerate(items) if x["_mark"]), len(items))
        marks = [(x["_cx"], x["_y"], x["_size"], x["_turned"]) for x in items[at:]]
        out = []
        for r in items[:at]:
            x1, y1, x2, y2 = (r[c] for c in box)
            hits = [m for m in marks if x1 <= m[0] <= x2 and y1 <= m[1] <= y2]
            groups: list[list[float]] = []
            turned, sizes = [m[3] for m in hits if m[3] is not None], sorted(m[2] for m in hits if m[2] is not None)
            if turned and 2 * sum(turned) <= len(turned):
                least = max(0.6 * sizes[len(sizes) // 2], 2.0) if sizes else 2.0
                for _, y, _, _ in hits:
                    if groups and groups[-1][-1] - y <= least:
                        groups[-1].append(y)
                    else:
                        groups.append([y])
            means = [sum(g) / len(g) for g in groups] or [0.0]
            for i, mean in enumerate(means):
                top = (means[i - 1] + mean) / 2 if i else y2
                bottom = (means[i + 1] + mean) / 2 if i + 1 < len(means) else y1
                out.append((r["table_id"], r["row"], i, x1, bottom, x2, top))
        return out

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("table_id", "row")}
    out = f"table_id {kinds['table_id']}, row {kinds['row']}, sub int, x_min double, y_min double, x_max double, y_max double"
    both = both.withColumn("_down", -F.col("_y"))
    return fold(both, page, ["_mark", "_down"], ["table_id", "row", *box, "_cx", "_y", "_size", "_turned"], split, out)
