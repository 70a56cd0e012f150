"""Reading order: spans to lines to text.

Steps whose result depends only on neighbours in a given order are windows (word gaps,
coherence, islands); clustering that depends on what was clustered before is a fold over the
spans of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.folds import numbered

#: Thresholds of reading order. Fixed values.
BASELINE_TOLERANCE = 2.0
SAME_WORD_MAX = 0.03
WORD_BREAK_MIN = 0.15
ACTIVE_LINES = 5
COHERENCE_MIN = 0.75
ROTATED_ABOVE = 5.0
FULL_WIDTH_SPANS = 1.3
FULL_WIDTH_SHARE = 0.5
FULL_WIDTH_FEW = 0.8
GUTTER = 15.0


def upper_median(values: Column) -> Column:
    """sorted[n / 2]: of two middle values the larger."""
    return F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


#: A little over a half: the share whose discrete percentile is the upper median.
_UPPER_HALF = 0.5 + 1e-9


def with_coherence(spans: DataFrame) -> DataFrame:
    """Adds ``coherence`` of its page to each span, and ``island``, the number of its column on the page: windows over pages in two orders, without joins."""
    page = Window.partitionBy("doc_id", "page")
    by_x, column = page.orderBy("_cx", "span_idx"), Window.partitionBy("doc_id", "page", "island")
    rows = spans.withColumn("_cx", F.col("x") + F.greatest(F.col("width"), F.lit(0.0)) / 2)
    rows = rows.withColumn("_step", F.col("_cx") - F.lag("_cx").over(by_x))
    rows = rows.withColumn("_median", F.expr(f"percentile_disc({_UPPER_HALF}) WITHIN GROUP (ORDER BY font_size)").over(page))
    rows = rows.withColumn("island", F.sum(F.coalesce(F.col("_step") > 2 * F.col("_median"), F.lit(False)).cast("int")).over(by_x))
    up = F.lag("y").over(column.orderBy("span_idx"))
    rows = rows.withColumns({"_ok": F.when(up.isNotNull(), (F.col("y") <= up).cast("double")), "_nth": F.row_number().over(column.orderBy("span_idx"))})
    rows = rows.withColumns({"_k": F.count("*").over(column), "_score": F.coalesce(F.sum("_ok").over(column) / F.count("_ok").over(column), F.lit(1.0))})
    whole = F.sum(F.when(F.col("_nth") == 1, F.col("_score") * F.col("_k"))).over(page) / F.count("*").over(page)
    return rows.withColumn("coherence", whole).drop("_cx", "_step", "_median", "_ok", "_nth", "_k", "_score")


def coherence(spans: DataFrame) -> DataFrame:
    """Per page: how far stream order runs down each column.

    Column clusters are islands of x-centres with gaps above twice the median size; a span
    belongs to its island, whose mean centre is the nearest; each column scores its share
    of pairs that do not go up, weighted by its spans.
    """
    rows = with_coherence(spans.select("doc_id", "page", "span_idx", "x", "y", "width", "font_size"))
    return rows.groupBy("doc_id", "page").agg(F.max("coherence").alias("coherence"), F.count("*").alias("n_spans"))


def orientation(rotation: Column, is_vertical: Column) -> Column:
    return F.when(is_vertical, "vertical").when(F.abs(rotation) > ROTATED_ABOVE, "rotated").otherwise("horizontal")


def char_width(text: Column, width: Column, font_size: Column) -> Column:
    n = F.char_length(text)
    return F.when((n > 0) & (width > 0), width / n).otherwise(font_size)


_NON_SPACING = [(0x2E80, 0x2FDF), (0x3000, 0x30FF), (0x3100, 0x312F), (0x3130, 0x318F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2FA1F)]
_NON_SPACING_CLASS = "^[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _NON_SPACING) + "]"


def non_spacing(char: Column) -> Column:
    """Ideographs, kana, hangul and full-width forms, which have no spaces between words.

    One comparison decides for most characters; twelve ranges for each of two characters made
    the code of a stage too long for the JVM to compile.
    """
    return (F.ascii(char) >= _NON_SPACING[0][0]) & F.rlike(char, F.lit(_NON_SPACING_CLASS))


def word_gaps(spans: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``gap`` and ``space_before`` to the spans of lines: one ladder of thresholds over the left neighbour."""
    w = Window.partitionBy("doc_id", "page", line).orderBy("x", "span_idx")
    prev = lambda c: F.lag(c).over(w)
    # of the text before only its length and the kind of its last character are used
    rows = spans.withColumns({"_n": F.char_length("text"), "_last": non_spacing(F.right("text", F.lit(1)))})
    rows = rows.withColumns({"_pn": prev("_n"), "_pl": prev("_last"), "_pw": prev("width"), "_px": prev("x"), "_ps": prev("font_size"), "_psp": prev("space_width")})
    gap = F.col("x") - (F.col("_px") + F.col("_pw"))
    size = (F.col("_ps") + F.col("font_size")) / 2
    wide = lambda n, width, font: F.when((F.col(n) > 0) & (F.col(width) > 0), F.col(width) / F.col(n)).otherwise(F.col(font))  # noqa: E731  see char_width
    cw = (wide("_pn", "_pw", "_ps") + wide("_n", "width", "font_size")) / 2
    eff = F.greatest(size, cw)
    share, per_mille = gap / eff, cw / eff * 1000
    divisor = F.when(per_mille < 300, 2.0).when(per_mille < 500, 4.0).when(per_mille < 700, 5.0).otherwise(6.0)
    known = F.coalesce(F.col("_psp"), F.col("space_width"))
    ladder = F.when((gap <= 0) | (size <= 0), False).when(known.isNotNull(), gap > known * 0.5).when(share < SAME_WORD_MAX, False).when(share > WORD_BREAK_MIN, True).otherwise(gap > cw / divisor)
    scripts = ~(F.col("_pl") & non_spacing(F.left(F.col("text"), F.lit(1))))
    rows = rows.withColumns({"gap": gap, "space_before": F.coalesce(ladder & scripts, F.lit(False))})
    return rows.drop("_n", "_last", "_pn", "_pl", "_pw", "_px", "_ps", "_psp")


def baseline_lines(spans: DataFrame, tolerance: float = BASELINE_TOLERANCE) -> DataFrame:
    """Adds ``line``: each span joins the first line whose first baseline is within the tolerance.

    The order of spans is top-down by baseline; as lines are seeded by their first span,
    this is a fold over the spans of a page.
    """

    def lines(ys: list[float]) -> list[int]:
        seeds: list[float] = []
        out = []
        for y in ys:
            # seeds fall from top to bottom, so only the last ones can be within reach
            hit = next((i for i in range(max(0, len(seeds) - 3), len(seeds)) if abs(seeds[i] - y) <= tolerance), None)
            if hit is None:
                seeds.append(y)
                hit = len(seeds) - 1
            out.append(hit)
        return out

    return numbered(spans.withColumn("_down", -F.col("y")), ["doc_id", "page"], ["_down", "x", "span_idx"], ["y"], lines, "line").drop("_down")


def stream_lines(spans: DataFrame, tolerance: float = BASELINE_TOLERANCE, active: int = ACTIVE_LINES) -> DataFrame:
    """Adds ``line`` in stream order: up to five lines stay open, each at the running mean of its baselines.

    A span joins the open line of nearest age whose mean is within the tolerance; when a sixth
    line would open, the oldest closes. Lines are numbered in the order in which they close.
    """

    def lines(ys: list[float]) -> list[int]:
        open_: list[list] = []  # [mean, count, members]
        closed: list[list[int]] = []
        for i, y in enumerate(ys):
            line = next((x for x in open_ if abs(x[0] - y) <= tolerance), None)
            if line is None:
                if len(open_) >= active:
                    closed.append(open_.pop(0)[2])
                open_.append([y, 1, [i]])
            else:
                line[0] += (y - line[0]) / (line[1] + 1)
                line[1] += 1
                line[2].append(i)
        out = [0] * len(ys)
        for k, members in enumerate(closed + [x[2] for x in open_]):
            for i in members:
                out[i] = k
        return out

    return numbered(spans, ["doc_id", "page"], ["span_idx"], ["y"], lines, "line")


def native_lines(spans: DataFrame, tolerance: float = BASELINE_TOLERANCE) -> DataFrame:
    """Adds ``line`` from gaps between neighbouring baselines: the native form, equal to ``baseline_lines`` where baselines do not drift."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x", "span_idx")
    gap = F.lag("y").over(w) - F.col("y") > tolerance
    return spans.withColumn("line", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w).cast("int"))


def line_text(spans: DataFrame) -> DataFrame:
    """One row for each line: text with word spaces, baseline, mean size, invisible spans left out."""
    rows = word_gaps(spans.where("not is_invisible")).withColumn("_t", F.when(F.col("space_before"), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "span_idx", F.col("_t").alias("t")))), lambda s: s["t"]), "")
    return rows.groupBy("doc_id", "page", "line").agg(text.alias("text"), F.max("y").alias("y"), F.avg("font_size").alias("avg_size"), F.count("*").alias("n_spans"))


def page_text(lines: DataFrame) -> DataFrame:
    """Lines of a page joined by line ends, and how many they are."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("doc_id", "page").agg(text.alias("text"), F.count("*").alias("n_lines"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """Neighbours of a line with one font, near sizes and no word gap become one span: gaps and islands."""
    rows = word_gaps(spans)
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x", "span_idx")
    same = (F.lag("font_name").over(w) == F.col("font_name")) & (F.abs(F.lag("font_size").over(w) - F.col("font_size")) < 0.1)
    cw = char_width(F.lag("text").over(w), F.lag("width").over(w), F.lag("font_size").over(w))
    near = F.when(F.col("gap") < 0, -F.col("gap") < cw * 0.5).otherwise(~F.col("space_before"))
    rows = rows.withColumn("_new", (~F.coalesce(same & near, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "span_idx", "text"))), lambda s: s["text"]), "")
    return rows.groupBy("doc_id", "page", "line", "run").agg(text.alias("text"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.first("font_name").alias("font_name"), F.max("font_size").alias("font_size"), F.max("y").alias("y"))


def dominant_size(spans: DataFrame) -> DataFrame:
    """Per document: the most frequent size in tenths (of equal counts the smallest), 12 if there is none."""
    tenths = F.when(~F.col("is_invisible") & (F.col("font_size") >= 0.5), F.round(F.col("font_size") * 10).cast("int"))
    seen = spans.groupBy("doc_id", tenths.alias("tenths")).count()
    by = F.when(F.col("tenths").isNotNull(), F.struct("count", (-F.col("tenths")).alias("t")))
    return seen.groupBy("doc_id").agg(F.coalesce(F.max_by("tenths", by) / 10.0, F.lit(12.0)).alias("dominant"))


def heading_level(size: Column, dominant: Column) -> Column:
    """Strictly above 1.8, 1.5 and 1.2 times the dominant size: levels 1, 2, 3; else 0."""
    return F.when(dominant <= 0, 0).when(size > dominant * 1.8, 1).when(size > dominant * 1.5, 2).when(size > dominant * 1.2, 3).otherwise(0)


def pages_to_blocks(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines as blocks in reading order: a heading or a paragraph for each line that has text."""
    rows = lines.join(dominant_size(spans), "doc_id").where(F.trim("text") != "")
    level = heading_level(F.col("avg_size"), F.col("dominant"))
    w = Window.partitionBy("doc_id").orderBy("page", F.desc("y"), "line")
    return rows.select("doc_id", (F.row_number().over(w) - 1).cast("int").alias("ord"), F.when(level > 0, "heading").otherwise("paragraph").alias("kind"), F.when(level > 0, level).alias("level"), "text", "page")


def vertical_gaps(lines: DataFrame, min_gap: float) -> DataFrame:
    """Adds ``section``: a new one where the baseline falls by more than ``min_gap``."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "line")
    drop = F.lag("y").over(w) - F.col("y") > min_gap
    return lines.withColumn("section", F.sum(F.coalesce(drop, F.lit(False)).cast("int")).over(w).cast("int"))


def spans_box(spans: DataFrame) -> DataFrame:
    """The box around the spans of each page."""
    return spans.groupBy("doc_id", "page").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max(F.col("x") + F.col("width")).alias("x_max"), F.max(F.col("y") + F.col("font_size")).alias("y_max"))


def full_width(spans: DataFrame) -> DataFrame:
    """The lines (column ``line``) of pages of three spans or more, and whether each is a full-width one.

    A full-width line is wider than half the content and 1.3 times the median span, and its
    left edges have no gap that stands out, as between two columns.
    """
    spans = spans.withColumn("_w", F.greatest("width", F.lit(0.0)))
    edge = F.col("x") + F.col("_w")
    widths = F.collect_list(F.when(F.col("_w") > 0, F.col("_w")))
    page = spans.groupBy("doc_id", "page").agg(F.count("*").alias("n"), (F.max(edge) - F.min("x")).alias("content"), widths.alias("widths"))
    cutoff = F.when(F.size("widths") >= 3, F.greatest(FULL_WIDTH_SPANS * upper_median(F.col("widths")), FULL_WIDTH_SHARE * F.col("content"))).otherwise(FULL_WIDTH_FEW * F.col("content"))
    page = page.where("n >= 3 and content > 0").select("doc_id", "page", cutoff.alias("cutoff"))
    lines = spans.groupBy("doc_id", "page", "line").agg(F.max("y").alias("y"), (F.max(edge) - F.min("x")).alias("extent"), F.sort_array(F.collect_list("x")).alias("xs"))
    gaps = F.zip_with(F.slice("xs", F.lit(2), F.size("xs")), F.slice("xs", F.lit(1), F.size("xs") - 1), lambda b, a: b - a)
    lines = lines.withColumn("gaps", F.when(F.size("xs") > 1, gaps).otherwise(F.array().cast("array<double>")))
    top = F.array_max("gaps")
    apart = (F.size("gaps") > 0) & (top > GUTTER) & ((F.size("gaps") <= 2) | (top > 3 * upper_median(F.col("gaps"))))
    return lines.join(page, ["doc_id", "page"]).select("doc_id", "page", "line", "y", ((F.col("extent") > F.col("cutoff")) & ~F.coalesce(apart, F.lit(False))).alias("full_width"))


def reinserted(main: DataFrame, masked: DataFrame) -> DataFrame:
    """Places of ordered lines (doc_id, page, y, pos) and of full-width lines among them: each before the first line that is not above it.

    The lines keep their order, which need not run down the page.
    """
    key = ["doc_id", "page"]
    ends = main.groupBy(*key).agg(F.max("pos").alias("last"))
    below = main.select(*key, F.col("y").alias("_y"), "pos")
    found = masked.join(below, key, "left").groupBy(*key, "y").agg(F.min(F.when(F.col("_y") <= F.col("y"), F.col("pos"))).alias("pos"))
    found = found.join(ends, key, "left").select(*key, "y", F.coalesce("pos", F.col("last") + 1, F.lit(0)).alias("pos"), F.lit(0).alias("own"))
    rows = found.unionByName(main.select(*key, "y", "pos", F.lit(1).alias("own")))
    order = Window.partitionBy(*key).orderBy("pos", "own", F.desc("y"))
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def tiers(spans: DataFrame, threshold: float = COHERENCE_MIN) -> DataFrame:
    """One row for each page: its coherence, and whether its lines come in stream order (1) or from cuts (2)."""
    return coherence(spans).withColumn("tier", F.when(F.col("coherence") > threshold, 1).otherwise(2))


def columns_cut(spans: DataFrame, least: float = 15.0, support: float = 0.3) -> DataFrame:
    """The best vertical cut of each page: the widest gap between left edges that baselines on both sides support.

    Candidates are gaps of sorted distinct left edges; support is the share of baselines with
    spans on either side, found by an equi-join on the page and a range on x.
    """
    edges = spans.select("doc_id", "page", "x").distinct()
    w = Window.partitionBy("doc_id", "page").orderBy("x")
    gaps = edges.withColumn("left", F.lag("x").over(w)).where(F.col("x") - F.col("left") >= least).select("doc_id", "page", "left", F.col("x").alias("right"))
    rows = spans.groupBy("doc_id", "page", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    n = rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    both = gaps.join(rows, ["doc_id", "page"]).groupBy("doc_id", "page", "left", "right").agg(F.sum(((F.col("lo") <= F.col("left")) & (F.col("hi") >= F.col("right"))).cast("int")).alias("k"))
    both = both.join(n, ["doc_id", "page"]).withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= support)
    score = F.struct(((F.col("right") - F.col("left")) * F.col("share")).alias("score"), (-F.col("left")).alias("l"))
    best = both.groupBy("doc_id", "page").agg(F.max_by(F.struct("left", "right", "share"), score).alias("b"))
    return best.select("doc_id", "page", "b.*")


def in_structure_order(spans: DataFrame, ranks: DataFrame) -> DataFrame:
    """Tagged spans by their place in the structure tree, others after them in stream order."""
    return spans.join(ranks, ["doc_id", "page", "mcid"], "left").withColumn("order_key", F.struct(F.col("rank").isNull(), F.coalesce("rank", F.lit(0)), "span_idx"))
