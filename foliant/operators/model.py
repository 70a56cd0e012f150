"""Operations on the document model: overlays, page breaks, lists and numbering, styles, layers and output modes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.lineage import materialise

#: Number formats that make a list without numbers. Fixed values.
UNNUMBERED = ("bullet", "none")

# ---------------------------------------------------------------- overlays: (doc_id, node_id, value) beside the blocks


def overlay_values(overlay: DataFrame) -> DataFrame:
    """All (doc_id, node_id, value) pairs, each node once (its last value by order of values)."""
    return overlay.where("value is not null").groupBy("doc_id", "node_id").agg(F.max("value").alias("value"))


def with_overlay(blocks: DataFrame, overlay: DataFrame, name: str) -> DataFrame:
    """Blocks (node id ``ord``) with the overlay's value under ``name``, null where it has none."""
    side = overlay_values(overlay).select("doc_id", F.col("node_id").alias("ord"), F.col("value").alias(name))
    return blocks.join(side, ["doc_id", "ord"], "left")


def with_node_in(blocks: DataFrame, overlay: DataFrame) -> DataFrame:
    """The blocks at which an overlay has anything."""
    return blocks.join(overlay.select("doc_id", F.col("node_id").alias("ord")), ["doc_id", "ord"], "left_semi")


# ---------------------------------------------------------------- structure


def with_page_breaks(blocks: DataFrame) -> DataFrame:
    """Blocks with a ``page_break`` before the first block of each page but the first; a block without a page stays on the page before."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("page", ignorenulls=True).over(before)
    breaks = F.col("page").isNotNull() & (F.count("*").over(before) > 0) & ~F.col("page").eqNullSafe(F.coalesce(last, F.lit(0)))
    row = lambda kind, text: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"))
    own = row(F.col("kind"), F.col("text"))
    both = F.when(breaks, F.array(row("page_break", F.lit("")), own)).otherwise(F.array(own))
    out = blocks.withColumn("_both", both).select("doc_id", "ord", "page", F.posexplode("_both").alias("part", "b"))
    place = Window.partitionBy("doc_id").orderBy("ord", "part")
    return out.select("doc_id", (F.row_number().over(place) - 1).cast("int").alias("place"), "b.kind", "b.text", "page")


def lists(items: DataFrame) -> DataFrame:
    """Adds ``list_no`` to the items (doc_id, ord, num_id): neighbours by ``ord`` with one num_id form one list; rows without a num_id end it and go."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    new = F.col("num_id").isNotNull() & ~F.col("num_id").eqNullSafe(F.lag("num_id").over(w))
    return items.withColumn("list_no", F.sum(new.cast("int")).over(w).cast("int")).where("num_id is not null")


def numbered(items: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds ``ordered`` and ``start`` to items (num_id, ilvl): an override of the list counts first, then the level of its abstract list.

    ``levels``: num_id, ilvl, fmt, start; ``overrides``: num_id, ilvl, fmt and start, either of
    which may be null. Without a definition the kind is null and the start 1.
    """
    over = overrides.select("num_id", "ilvl", F.col("fmt").alias("_ofmt"), F.col("start").alias("_ostart"))
    base = levels.select("num_id", "ilvl", F.col("fmt").alias("_fmt"), F.col("start").alias("_start"))
    out = items.join(base, ["num_id", "ilvl"], "left").join(over, ["num_id", "ilvl"], "left")
    fmt = F.coalesce("_ofmt", "_fmt")
    out = out.withColumns({"ordered": ~fmt.isin(*UNNUMBERED), "start": F.coalesce("_ostart", "_start", F.lit(1).cast("long"))})
    return out.drop("_fmt", "_start", "_ofmt", "_ostart")


def inherited(styles: DataFrame, prop: str) -> DataFrame:
    """(style_id, parent, prop) -> (style_id, prop): the value of the nearest ancestor that defines it, by pointer doubling.

    Chains are followed to their ends however long they are: each round doubles the links that
    are covered, and only styles without a value yet take part. A path visits each of these once
    at most, which bounds the rounds; what is open then hangs on a circle and stays undefined.
    """
    open_ = F.col(prop).isNull() & F.col("parent").isNotNull()
    now = materialise(styles.select("style_id", "parent", prop))
    left = now.where(open_).count()
    for _ in range(left.bit_length()):
        up = now.select(F.col("style_id").alias("parent"), F.col("parent").alias("_next"), F.col(prop).alias("_value"))
        step = now.where(open_).join(up, "parent", "left").select("style_id", F.when(F.col("_value").isNull(), F.col("_next")).alias("parent"), F.col("_value").alias(prop))
        now = materialise(now.where(~open_).unionByName(step))
        if not now.where(open_).limit(1).count():
            break
    return now.select("style_id", prop)


def length_points(value: Column) -> Column:
    """A length with its unit (pt, cm, in, mm) in points; null for anything else."""
    unit = F.regexp_extract(value, r"^\s*(.*?)\s*(pt|cm|in|mm)\s*$", 2)
    number = F.regexp_extract(value, r"^\s*(.*?)(pt|cm|in|mm)\s*$", 1)
    per = F.when(unit == "pt", 1.0).when(unit == "cm", 28.3465).when(unit == "in", 72.0).when(unit == "mm", 2.83465)
    return F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number.try_cast("double") * per)


# ---------------------------------------------------------------- layers


@dataclass(frozen=True)
class Layers:
    """Which parts of documents a scan returns."""

    presentation: bool = True
    relationships: bool = True
    interactions: bool = True
    tables: bool = True
    images: bool = True
    fonts: bool = False

    @classmethod
    def content_only(cls) -> Layers:
        return cls(presentation=False, relationships=False, interactions=False)

    @classmethod
    def batch(cls) -> Layers:
        return replace(cls.content_only(), images=False)

    @classmethod
    def agent(cls) -> Layers:
        return cls()

    @classmethod
    def ocr(cls) -> Layers:
        return cls(fonts=True)

    @property
    def kinds_left_out(self) -> tuple[str, ...]:
        parts = {"table": self.tables, "image": self.images, "link": self.relationships, "note": self.interactions}
        return tuple(k for k, on in parts.items() if not on)


PRESETS = {"default": Layers(), "agent": Layers.agent(), "batch": Layers.batch(), "content_only": Layers.content_only(), "ocr": Layers.ocr()}


def shown(blocks: Column, layers: Layers) -> Column:
    """An array of blocks without those of layers that are off."""
    off = layers.kinds_left_out
    return F.filter(blocks, lambda b: ~b["kind"].isin(*off)) if off else blocks


def projected(docs: DataFrame, layers: Layers) -> DataFrame:
    """Documents without the blocks of layers that are off."""
    return docs.withColumn("blocks", shown(F.col("blocks"), layers))


def page_bundles(blocks: DataFrame, layers: Layers = PRESETS["default"]) -> DataFrame:
    """A row for each page: its text lines, and its tables and images where these layers are on."""
    one = F.struct("ord", "text")
    of = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, one))), lambda x: x["text"])
    kind = F.col("kind")
    cols = [of(~kind.isin("table", "image")).alias("lines")]
    if layers.tables:
        cols.append(of(kind == "table").alias("tables"))
    if layers.images:
        cols.append(of(kind == "image").alias("images"))
    return blocks.groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(*cols)


# ---------------------------------------------------------------- output


#: Short flags, the mode that each stands for, and its names. Fixed values.
FLAGS = [("json", "-j/--json"), ("jsonl", "-J/--jsonl"), ("tsv", "-t/--tables"), ("markdown", "-m/--markdown")]


def output_mode(explicit: Column, **flags: Column) -> tuple[Column, Column]:
    """(mode, error): an explicit mode or one short flag, text by default; a flag that differs from the mode and two flags are errors."""
    on = F.filter(F.array(*[F.when(flags[m], F.lit(m)) for m, _ in FLAGS]), lambda x: x.isNotNull())
    names = F.create_map(*[F.lit(x) for pair in FLAGS for x in pair])
    first, second = F.get(on, F.lit(0)), F.get(on, F.lit(1))
    name = lambda m: F.try_element_at(names, F.coalesce(m, F.lit("")))
    clash = F.concat(name(first), F.lit(" conflicts with --out "), explicit)
    two = F.concat(F.lit("conflicting output shortcuts: "), name(first), F.lit(" and "), name(second), F.lit(" -- pick one"))
    error = F.when(second.isNotNull(), two).when(first.isNotNull() & (explicit != first), clash)
    return F.when(error.isNull(), F.coalesce(explicit, first, F.lit("text"))), error


def features(spark: SparkSession) -> DataFrame:
    """What this build has and how the session is set: (name, kind, enabled)."""
    from importlib.util import find_spec

    from foliant.sources.scan import PARSERS  # the scan itself uses layers

    rows = [(f"scan-{k.lower()}", "build", True) for k in sorted(PARSERS)]
    rows += [(f"library-{m}", "build", find_spec(m) is not None) for m in ("pyarrow", "pandas", "numpy")]
    conf = ["spark.sql.adaptive.enabled", "spark.sql.execution.arrow.pyspark.enabled", "spark.python.worker.reuse"]
    rows += [(c, "runtime", spark.conf.get(c, "false") == "true") for c in conf]
    return spark.createDataFrame(rows, "name string, kind string, enabled boolean")
