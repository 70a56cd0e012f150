"""Emitters: text, Markdown, TSV and JSON lines, one row for each document, table or record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import html_escaped, tsv_cell


def _ordered(value: Column, sep: str, *order: str) -> Column:
    """Values of a group joined in an order."""
    items = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.array_join(F.transform(items, lambda x: x["_v"]), sep)


def tables_tsv(cells: DataFrame) -> DataFrame:
    """One row for each table: its title line and its rows. Tables are numbered in document order."""
    rows = cells.groupBy("doc_id", "table_id", "page", "ord", "row").agg(_ordered(tsv_cell(F.col("text")), "\t", "col").alias("line"), F.count("*").alias("n"))
    tables = rows.groupBy("doc_id", "table_id", "page", "ord").agg(_ordered(F.col("line"), "\n", "row").alias("body"), F.max("n").alias("cols"), F.count("*").alias("rows"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "table_id"))
    page = F.coalesce((F.col("page") + 1).cast("string"), F.lit("?"))
    title = F.format_string("# Table %d (page %s, %d columns, %d rows)", number, page, F.col("cols"), F.col("rows"))
    return tables.select("doc_id", "table_id", title.alias("title"), "body")


def records(cells: DataFrame, labels: list[str]) -> DataFrame:
    """Data rows with the header's labels as columns. Labels are given, so the plan needs no extra pass."""
    w = Window.partitionBy("doc_id", "col")
    body = cells.withColumn("_labels", F.collect_set(F.when(F.col("is_header"), F.col("text"))).over(w)).where(~F.col("is_header") & (F.size("_labels") > 0))
    return body.groupBy("doc_id", "row").agg(*[F.max(F.when(F.array_contains("_labels", x), F.col("text"))).alias(x) for x in labels])


def block_line(kind: Column, level: Column, text: Column) -> Column:
    """A block as text: # for headings, fences for code, rules for breaks."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), text))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "list_item", F.concat(F.lit("- "), text))
        .when(kind == "thematic_break", F.lit("---"))
        .when(kind == "image", F.concat(F.lit("[Image: "), text, F.lit("]")))
        .otherwise(text)
    )


def plain_text(blocks: DataFrame) -> DataFrame:
    """Blocks joined by line ends, with a blank line between unless both neighbours are paragraphs."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.lag("kind").over(w)
    blank = before.isNotNull() & ~((before == "paragraph") & (F.col("kind") == "paragraph"))
    line = F.concat(F.when(blank, "\n").otherwise(""), block_line(F.col("kind"), F.col("level"), F.col("text")), F.lit("\n"))
    return blocks.withColumn("_line", line).groupBy("doc_id").agg(_ordered(F.col("_line"), "", "ord").alias("text"))


def markdown(blocks: DataFrame, anchors: bool = False) -> DataFrame:
    """Blocks as Markdown, a blank line between. With ``anchors`` a comment with page and node stands before blocks whose page is known."""
    body = block_line(F.col("kind"), F.col("level"), F.col("text"))
    if anchors:
        mark = F.concat(F.lit("<!-- page="), (F.col("page") + 1).cast("string"), F.lit(" node="), F.col("ord").cast("string"), F.lit(" -->\n"))
        body = F.concat(F.coalesce(mark, F.lit("")), body)
    return blocks.groupBy("doc_id").agg(_ordered(body, "\n\n", "ord").alias("markdown"))


def table_markdown(cells: DataFrame) -> DataFrame:
    """Tables as pipe rows, or as HTML where a cell has a pipe or a line end."""
    hard = F.bool_or(F.contains("text", F.lit("|")) | F.contains("text", F.lit("\n")))
    kind = cells.groupBy("doc_id", "table_id").agg(hard.alias("html"))
    rows = cells.groupBy("doc_id", "table_id", "row").agg(_ordered(F.col("text"), " | ", "col").alias("pipe"), _ordered(F.concat(F.lit("<td>"), html_escaped(F.col("text")), F.lit("</td>")), "", "col").alias("tds"), F.count("*").alias("n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n").cast("int")))
    line = F.concat(F.lit("| "), F.col("pipe"), F.lit(" |"), F.when(F.col("row") == 0, F.concat(F.lit("\n"), rule)).otherwise(""))
    out = rows.withColumns({"_p": line, "_h": F.concat(F.lit("<tr>"), F.col("tds"), F.lit("</tr>"))}).groupBy("doc_id", "table_id").agg(_ordered(F.col("_p"), "\n", "row").alias("pipe"), _ordered(F.col("_h"), "\n", "row").alias("rows"))
    out = out.join(kind, ["doc_id", "table_id"])
    return out.select("doc_id", "table_id", F.when(F.col("html"), F.concat(F.lit("<table>\n"), F.col("rows"), F.lit("\n</table>"))).otherwise(F.col("pipe")).alias("markdown"))


def merged_runs(inlines: DataFrame) -> DataFrame:
    """Neighbouring runs of one style become one: gaps and islands over the style struct."""
    w = Window.partitionBy("doc_id", "block_id").orderBy("ord")
    new = (~F.lag("style").over(w).eqNullSafe(F.col("style"))).cast("int")
    rows = inlines.withColumn("_run", F.sum(new).over(w))
    return rows.groupBy("doc_id", "block_id", "_run", "style").agg(F.min("ord").alias("ord"), _ordered(F.col("text"), "", "ord").alias("text")).drop("_run")


def styled(style: Column, text: Column) -> Column:
    """Text between the Markdown markers of its style."""
    mark = F.when(style["bold"] & style["italic"], "***").when(style["bold"], "**").when(style["italic"], "*").otherwise("")
    out = F.concat(mark, text, mark)
    return F.when(style["strikethrough"], F.concat(F.lit("~~"), out, F.lit("~~"))).otherwise(out)


def inline_markdown(inlines: DataFrame) -> DataFrame:
    """Each block's runs, merged and marked, as one text."""
    return merged_runs(inlines).groupBy("doc_id", "block_id").agg(_ordered(styled(F.col("style"), F.col("text")), "", "ord").alias("text"))


def json_lines(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Header, block and footer records of each document as JSON lines, in order by (doc_id, rank, ord)."""
    head = docs.select("doc_id", F.lit(0).alias("rank"), F.lit(0).alias("ord"), F.to_json(F.struct(F.lit("header").alias("record"), F.lit(1).alias("version"), "format")).alias("line"))
    body = blocks.select("doc_id", F.lit(1).alias("rank"), "ord", F.to_json(F.struct(F.lit("block").alias("record"), F.col("kind").alias("type"), "level", "page", "text")).alias("line"))
    tail = blocks.groupBy("doc_id").agg(F.count("*").alias("n"))
    tail = docs.select("doc_id").join(tail, "doc_id", "left").select("doc_id", F.lit(2).alias("rank"), F.lit(0).alias("ord"), F.to_json(F.struct(F.lit("footer").alias("record"), F.coalesce("n", F.lit(0)).alias("blocks"))).alias("line"))
    return head.unionByName(body).unionByName(tail)


def document_json(blocks: DataFrame) -> DataFrame:
    """Each document as one JSON text: version and content."""
    item = F.struct("ord", "kind", "level", "text", "page")
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("content"))
    return docs.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), "content")).alias("json"))


def first_references(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """Footnotes that are referred to and defined, once each, in the order of first references."""
    first = refs.groupBy("doc_id", "label").agg(F.min("ord").alias("ord"))
    return first.join(notes.select("doc_id", "label", "text"), ["doc_id", "label"])


def write_lines(lines: DataFrame, path: str) -> None:
    """JSON lines as text files, sorted within their documents."""
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "rank", "ord").select("line").write.text(path)
