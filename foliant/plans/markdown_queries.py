"""Queries of Markdown line classes, links and the block parser."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans.adapters import table
from foliant.plans.registry import query
from foliant.sources import markdown as M
from foliant.sources.scan import scan_bytes

#: Rewrites documents so that every line class occurs.
_LEADS = ["# ", "- ", "> ", "```", "1. ", "| ", "    ", "", "---", "[ref]: http://x.y/"]


def _marked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), ((F.col("doc_id") + F.col("line_no")) % len(_LEADS) + 1).cast("int"))
    return docs.withColumn("line", F.when(lead == "---", lead).when(lead == "```", F.concat(lead, F.lit("sql"))).otherwise(F.concat(lead, "line")))


_MARKED = """d AS (SELECT doc_id, generate_subscripts(x, 1)::INT - 1 AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    e AS (SELECT *, ([{}])[((doc_id + line_no) % {} + 1)::INT] AS lead FROM d),
    m AS (SELECT doc_id, line_no, CASE WHEN lead = '---' THEN lead WHEN lead = '```' THEN lead || 'sql' ELSE lead || line END AS line FROM e)""".format(", ".join(f"'{x}'" for x in _LEADS), len(_LEADS))


@query(
    "markdown_lines",
    f"""WITH {_MARKED}
    SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\\s*$') THEN 'blank' WHEN regexp_matches(line, '^\\s*#{{1,6}}([ \\t].*)?$') THEN 'atx_heading'
      WHEN regexp_matches(line, '^\\s*((-\\s*){{3,}}|(\\*\\s*){{3,}}|(_\\s*){{3,}})$') THEN 'thematic_break' WHEN regexp_matches(line, '^ {{0,3}}(```[^`]*|~~~.*)$') THEN 'fence'
      WHEN starts_with(line, '    ') AND NOT starts_with(trim(line), '>') AND NOT regexp_matches(trim(line), '^([-*+]([ \\t]|$)|[0-9]{{1,9}}[.)]( |$))') THEN 'indented_code'
      WHEN regexp_matches(line, '^\\s*>') THEN 'quote' WHEN regexp_matches(line, '^\\s*([-*+]([ \\t]|$)|[0-9]{{1,9}}[.)]( |$))') THEN 'list_item'
      WHEN regexp_matches(line, '^\\s*\\[[^\\]]+\\]:\\s*\\S') THEN 'link_definition' WHEN regexp_matches(line, '^\\s*\\||\\|\\s*$') THEN 'pipe_row' ELSE 'text' END AS class FROM m""",
)
def markdown_lines(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", "line_no", M.line_class(F.col("line")).alias("class"))


@query(
    "markdown_headings",
    f"""WITH {_MARKED} SELECT doc_id, line_no, length(regexp_extract(line, '^\\s*(#{{1,6}})', 1))::INT AS level, rtrim(regexp_replace(trim(regexp_extract(line, '^\\s*#{{1,6}}(.*)$', 1)), '#+$', '')) AS text
    FROM m WHERE regexp_matches(line, '^\\s*#{{1,6}}([ \\t].*)?$')""",
)
def markdown_headings(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("h", M.heading_of(F.col("line"))).where("h is not null")
    return rows.select("doc_id", "line_no", F.col("h.level").cast("int").alias("level"), "h.text")


@query("link_definitions", f"WITH {_MARKED} SELECT doc_id, 'ref' AS label, max_by(regexp_extract(line, '\\]:\\s*([^\\s>]+)', 1), line_no) AS url FROM m WHERE starts_with(line, '[ref]:') GROUP BY doc_id")
def link_definitions(spark, sf_dir):
    lines = _marked(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return M.link_definitions(lines.groupBy("doc_id").agg(text.alias("text")))


@query("parsed_documents")
def parsed_documents(spark, sf_dir):
    """The scan over tables of bytes: documents as Markdown files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("doc.md").alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = scan_bytes(docs)
    return out.select("doc_id", "format", "byte_len", "page_count", F.size("blocks").alias("n_blocks"), F.size("warnings").alias("n_warnings"), "error")


@query(
    "corpus_filter",
    """SELECT doc_id, 'MD' AS format, strlen(text)::BIGINT AS byte_len FROM documents WHERE strlen(text) > 2000""",
)
def corpus_filter(spark, sf_dir):
    from foliant.operators.corpus import Corpus

    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("doc.md").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return Corpus(scan_bytes(docs)).filter(F.col("byte_len") > 2000).docs.select("doc_id", "format", "byte_len")
