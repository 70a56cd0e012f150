"""Chunking of block tables, in the two families that differ in joiners, lengths and headings.

Input: blocks (doc_id, ord, kind, level, text, page). Output: one row for each chunk with
doc_id, chunk_index (from 0), text and what its strategy knows. Strategies whose boundaries do
not depend on the chunk so far are window expressions. The greedy ones cannot be windows
("start anew when full" depends on where the last chunk began): they fold each document's
array of block lengths, a hundred documents at a time, to chunk numbers; texts stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import is_blank, sentences


def _so_far():
    return Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)


def _joined(text: str, sep: str) -> Column:
    """Texts of a group in block order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(text).alias("t")))), lambda x: x["t"]), sep)


def _numbered(chunks: DataFrame, order: str) -> DataFrame:
    return chunks.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1).cast("int")).drop(order)


# ------------------------------------------------------------------ emitter family


def by_page(blocks: DataFrame) -> DataFrame:
    """Runs of blocks on one page: a page break or another page ends a run; blocks without a page join it."""
    known = F.last("page", ignorenulls=True).over(_before())
    change = (F.col("kind") == "page_break") | (F.col("page").isNotNull() & known.isNotNull() & (F.col("page") != known))
    runs = blocks.withColumn("run", F.sum(change.cast("int")).over(_so_far())).withColumn("so_far", F.last("page", ignorenulls=True).over(_so_far()))
    runs = runs.where("kind <> 'page_break'").groupBy("doc_id", "run").agg(_joined("text", "\n").alias("text"), F.max_by("so_far", "ord").alias("page"))
    return _numbered(runs.where(~is_blank(F.col("text"))), "run").select("doc_id", "chunk_index", "text", "page")


def heading_paths(blocks: DataFrame, deepest: int = 6) -> DataFrame:
    """Adds ``path`` to headings: the labels above it and its own; levels that are skipped are empty.

    The entry of depth d is the last earlier heading of a level up to d, if that level is d.
    """
    out = blocks
    entries = []
    for d in range(1, deepest):
        seen = F.last(F.when((F.col("kind") == "heading") & (F.col("level") <= d), F.struct("level", "text")), ignorenulls=True).over(_before())
        out = out.withColumn(f"_d{d}", F.when(seen["level"] == d, seen["text"]).otherwise(F.lit("")))
        entries.append(F.col(f"_d{d}"))
    path = F.concat(F.slice(F.array(*[F.coalesce(e, F.lit("")) for e in entries]), F.lit(1), F.greatest(F.col("level") - 1, F.lit(0))), F.array("text"))
    return out.withColumn("path", F.when(F.col("kind") == "heading", path)).drop(*[f"_d{d}" for d in range(1, deepest)])


def by_heading(blocks: DataFrame, top_only: bool = False) -> DataFrame:
    """A heading (``top_only``: of level 1) ends a chunk and goes to heading_path, not to the text."""
    cut = (F.col("kind") == "heading") & ((F.col("level") == 1) if top_only else F.lit(True))
    if top_only:
        marked = blocks.withColumn("path", F.when(cut, F.array("text")))
    else:
        marked = heading_paths(blocks)
    marked = marked.withColumns({"part": F.sum(cut.cast("int")).over(_so_far()), "cut": cut})
    body = F.when(~F.col("cut") & ~is_blank(F.col("text")), F.col("text"))
    marked = marked.withColumn("body", body).withColumn("body_page", F.when(~F.col("cut"), F.col("page")))
    chunks = marked.groupBy("doc_id", "part").agg(
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"].isNotNull()), lambda x: x["body"]), "\n").alias("text"),
        F.coalesce(F.max(F.when(F.col("cut"), F.col("path"))), F.array().cast("array<string>")).alias("heading_path"),
        F.min("body_page").alias("page_lo"),
        F.max("body_page").alias("page_hi"),
    )
    return _numbered(chunks.where(~is_blank(F.col("text"))), "part").select("doc_id", "chunk_index", "text", "heading_path", "page_lo", "page_hi")


def by_section(blocks: DataFrame) -> DataFrame:
    """Boundaries at headings of level 1 only; deeper headings stay in the text."""
    return by_heading(blocks, top_only=True)


def heading_citation(heading_path: Column, page_lo: Column, page_hi: Column) -> Column:
    """JSON with heading_path, and page_range if pages are known."""
    return F.to_json(F.struct(heading_path.alias("heading_path"), F.when(page_lo.isNotNull(), F.array(page_lo, page_hi)).alias("page_range")))


def page_citation(page: Column) -> Column:
    return F.to_json(F.struct(page.alias("page")))


def _pack(lengths: list[int], target: int) -> tuple[list[int], list[bool]]:
    """Chunk of each block under greedy packing with one separator; a block over the target is alone only from an empty buffer."""
    number, size, ids, over = 0, 0, [], []
    for n in lengths:
        if size and size + 1 + n > target:
            number, size = number + 1, 0
            ids.append(number)
            over.append(False)
            size = n
        elif not size and n > target:
            ids.append(number)
            over.append(True)
            number += 1
        else:
            ids.append(number)
            over.append(False)
            size += n + (1 if size else 0)
    return ids, over


def _folded(blocks: DataFrame, fold, extra: list[str]) -> DataFrame:
    """Adds the chunk number of each block: arrays of lengths go to ``fold`` a document at a time, as plain rows.

    Plain rows go to a worker by the hundred; an Arrow batch would hold 10,000 documents.
    """

    @F.udf("array<struct<chunk:int,over:boolean>>", useArrow=False)
    def run(rows: list) -> list[tuple[int, bool]]:
        return list(zip(*fold(rows), strict=True))

    item = F.sort_array(F.collect_list(F.struct("ord", *extra, "text", "page")))
    docs = blocks.groupBy("doc_id").agg(item.alias("items"))
    docs = docs.withColumn("folds", run(F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in ["ord", *extra]]))))
    return docs.select("doc_id", F.explode(F.arrays_zip("items", "folds")).alias("z")).select("doc_id", "z.items.*", "z.folds.*")


def by_size(blocks: DataFrame, target: int) -> DataFrame:
    """Whole blocks packed up to ``target`` characters; blank blocks are skipped."""
    target = max(1, target)
    rows = blocks.where(~is_blank(F.col("text"))).withColumn("n", F.char_length("text"))
    packed = _folded(rows, lambda xs: _pack([x["n"] for x in xs], target), ["n"])
    chunks = packed.groupBy("doc_id", "chunk").agg(_joined("text", "\n").alias("text"), F.max("over").alias("oversize"), F.min("page").alias("page_lo"), F.max("page").alias("page_hi"))
    return chunks.select("doc_id", F.col("chunk").alias("chunk_index"), "text", "oversize", "page_lo", "page_hi")


# ------------------------------------------------------------------ library family


def _provenance(page: str = "page") -> Column:
    """The page if all blocks have the same, else null."""
    return F.when((F.count(page) == F.count(F.lit(1))) & (F.min(page) == F.max(page)), F.min(page))


def merged_box(box: str = "bbox") -> Column:
    """Union of boxes; null if any block has none."""
    b = F.col(box)
    union = F.struct(F.min(b["x_min"]).alias("x_min"), F.min(b["y_min"]).alias("y_min"), F.max(b["x_max"]).alias("x_max"), F.max(b["y_max"]).alias("y_max"))
    return F.when(F.count(b) == F.count(F.lit(1)), union)


def _finish(parts: DataFrame, key: str, sep: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord"))), lambda x: x["ord"])
    out = parts.groupBy("doc_id", key).agg(_joined("text", sep).alias("text"), ids.alias("block_ids"), _provenance().alias("page"), F.min("ord").alias("_first"))
    return _numbered(out.drop(key), "_first").select("doc_id", "chunk_index", "text", "block_ids", "page")


def buckets_by_page(blocks: DataFrame) -> DataFrame:
    """One chunk for each distinct page, in the order of first blocks; blocks without a page share one."""
    return _finish(blocks.where("text <> ''").withColumn("_key", F.coalesce(F.col("page"), F.lit(-1))), "_key", "\n\n")


def _segments(rows: list, size: int, starts, capped) -> tuple[list[int], list[bool]]:
    """Chunk numbers when some blocks start a chunk and a cap on bytes (two for each joint) closes one."""
    number, total, ids = -1, 0, []
    for x in rows:
        full = size > 0 and capped(x) and total + 2 + x["n"] > size
        if number < 0 or starts(x) or full:
            number, total = number + 1, x["n"]
        else:
            total += 2 + x["n"]
        ids.append(number)
    return ids, [False] * len(ids)


def _segmented(blocks: DataFrame, size: int, starts, capped) -> DataFrame:
    rows = blocks.where("text <> ''").withColumn("n", F.octet_length("text"))
    return _finish(_folded(rows, lambda xs: _segments(xs, size, starts, capped), ["n", "kind", "level"]), "chunk", "\n\n")


def segments_by_heading(blocks: DataFrame, size: int = 0) -> DataFrame:
    """A heading starts a chunk and is its first block."""
    return _segmented(blocks, size, lambda x: x["kind"] == "heading", lambda x: True)


def segments_by_section(blocks: DataFrame, size: int = 0) -> DataFrame:
    """The same for headings of level 1."""
    return _segmented(blocks, size, lambda x: x["kind"] == "heading" and x["level"] == 1, lambda x: True)


def segments_semantic(blocks: DataFrame, size: int = 0) -> DataFrame:
    """Paragraphs are packed under the cap; other blocks never close a chunk."""
    return _segmented(blocks, size, lambda x: False, lambda x: x["kind"] == "paragraph")


def _pack_sentences(rows: list, size: int) -> tuple[list[int], list[bool]]:
    number, total, ids = 0, 0, []
    for x in rows:
        if size and total and total + 1 + x["n"] > size:
            number, total = number + 1, 0
        total += x["n"] + (1 if total else 0)
        ids.append(number)
    return ids, [False] * len(ids)


def sentences_by_size(blocks: DataFrame, size: int = 0) -> DataFrame:
    """Sentences across blocks packed under a cap on bytes, joined by a space; block ids once for each chunk."""
    rows = blocks.where("text <> ''").select("doc_id", "ord", "page", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    rows = rows.withColumn("s", F.trim("s")).where("s <> ''").select("doc_id", F.struct("ord", "pos").alias("ord"), F.col("s").alias("text"), "page", F.octet_length("s").alias("n"))
    packed = _folded(rows, lambda xs: _pack_sentences(xs, size), ["n"])
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x["ord"]))
    out = packed.groupBy("doc_id", "chunk").agg(_joined("text", " ").alias("text"), ids.alias("block_ids"), _provenance().alias("page"))
    return out.select("doc_id", F.col("chunk").alias("chunk_index"), "text", "block_ids", "page")


_FAMILY = {"page": lambda b, n: buckets_by_page(b), "heading": segments_by_heading, "section": segments_by_section, "size": sentences_by_size, "semantic": segments_semantic}


def chunks(blocks: DataFrame, by: str, size: int = 0) -> DataFrame:
    """The library family by name."""
    if by not in _FAMILY:
        raise ValueError(f"by must be one of {', '.join(sorted(_FAMILY))}, not {by!r}")
    return _FAMILY[by](blocks, size)
