"""Diagnostics: caps, de-duplication, error classes, probes and font audits, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foliant.functions.text import error_code, n_words, severity


def capped(warnings: DataFrame, cap: int = 1000) -> DataFrame:
    """The first ``cap`` warnings of each document, and one sentinel row where more were there."""
    numbered = warnings.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    kept = numbered.where(F.col("_n") <= cap).drop("_n")
    over = warnings.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ord").alias("last")).where(F.col("n") > cap)
    text = F.concat(F.lit("warning limit reached: "), (F.col("n") - cap).cast("string"), F.lit(" more"))
    values = {"doc_id": F.col("doc_id"), "ord": F.col("last") + 1, "kind": F.lit("WarningLimit"), "level": F.lit("warning"), "message": text}
    sentinel = over.select(*[values.get(c, F.lit(None)).cast(warnings.schema[c].dataType).alias(c) for c in warnings.columns])
    return kept.unionByName(sentinel)


def tee(warnings: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The warnings, and an observation of their counts by level that is filled by whatever action runs on them."""
    seen = Observation(name)
    level = lambda x: F.count_if(F.col("level") == x).alias(x)
    return warnings.observe(seen, F.count(F.lit(1)).alias("n"), level("info"), level("warning"), level("error")), seen


def distinct_messages(warnings: DataFrame, with_info: bool = False) -> DataFrame:
    """The first of each (document, level, kind, message); info rows only if asked for."""
    rows = warnings if with_info else warnings.where("level <> 'info'")
    return rows.groupBy("doc_id", "level", "kind", "message").agg(F.min("ord").alias("ord"), F.count("*").alias("times"))


def classified(warnings: DataFrame) -> DataFrame:
    return warnings.withColumn("code", error_code(F.col("message"))).withColumn("severity", severity(F.col("code")))


def worst(warnings: DataFrame) -> DataFrame:
    """The code of highest severity of each document; of equal ones the earliest."""
    best = F.max_by("code", F.struct("severity", (-F.col("ord")).alias("first")))
    return classified(warnings).groupBy("doc_id").agg(best.alias("code"), F.max("severity").alias("severity"))


def needs_ocr(text: Column, least_words: int = 10, forced: bool = False) -> Column:
    """Pages with at least ten words are not sent to OCR unless forced."""
    return F.lit(True) if forced else n_words(text) < least_words


def font_audit(spans: DataFrame) -> DataFrame:
    """Per font: spans, distinct pages (from 1), and the first 20 characters of its first span."""
    first = F.min_by(F.substring("text", 1, 20), F.struct("page", "span_idx"))
    return spans.groupBy("doc_id", "font_name").agg(F.count("*").alias("n_spans"), F.array_sort(F.collect_set((F.col("page") + 1).cast("int"))).alias("pages"), first.alias("sample"))


def exact_ratio(spans: DataFrame) -> DataFrame:
    """Share of spans whose font was resolved exactly, per document."""
    exact = F.avg(F.when(F.col("resolution_kind") == "exact", 1.0).otherwise(0.0))
    return spans.groupBy("doc_id").agg(exact.alias("exact_ratio"))


def missing_glyphs(spans: DataFrame, known: Column) -> DataFrame:
    """Code points that ``known`` does not cover, most frequent first: count, then font, then code point."""
    chars = spans.select("doc_id", "font_name", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    chars = chars.withColumn("codepoint", F.ascii("ch")).where(~known)
    return chars.groupBy("doc_id", "font_name", "codepoint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "font_name", "codepoint")


def inspect(pages: DataFrame) -> DataFrame:
    """Per document: has text, is likely scanned (images without text on most pages), words, pages."""
    text = n_words(F.col("text")) > 0
    scanned = F.avg(F.when(~text & (F.col("n_images") > 0), 1.0).otherwise(0.0)) > 0.5
    return pages.groupBy("doc_id").agg(F.bool_or(text).alias("has_text"), scanned.alias("likely_scanned"), F.sum(n_words(F.col("text"))).alias("n_words"), F.count("*").alias("n_pages"))


def hyperlinks(links: DataFrame, cap: int = 50_000) -> DataFrame:
    """Distinct URLs of each document in first-seen order, up to the cap."""
    first = links.groupBy("doc_id", "url").agg(F.min("ord").alias("ord"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("n") <= cap)


def first_definitions(notes: DataFrame, cap: int = 10_000) -> DataFrame:
    """Of notes with one label the first counts; status tells added, duplicate or over the cap."""
    by_label = Window.partitionBy("doc_id", "label").orderBy("ord")
    marked = notes.withColumn("dup", F.row_number().over(by_label) > 1)
    nth = F.sum((~F.col("dup")).cast("int")).over(Window.partitionBy("doc_id").orderBy("ord"))
    return marked.withColumn("status", F.when(F.col("dup"), "duplicate").when(nth > cap, "limit").otherwise("added")).drop("dup")
