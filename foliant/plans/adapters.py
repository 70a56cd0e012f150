"""The driver's tables as the inputs of the document operators, in Spark and in SQL.

Each adapter is a deterministic projection; the SQL text is a common table expression of the
same name and columns for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files for each partition of ``dealt``.
DEAL_BYTES = 4 << 20


def dealt(rows: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """Rows by the hash of a key, in partitions that hold about ``DEAL_BYTES`` of the source's files each.

    What follows (words, cells) is many times larger than the rows, and is grouped by the key
    and more columns, so it stays where it is: only the rows are shuffled. The number of
    partitions goes with the input, and is not changed by the size of the rows on the way.
    """
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-size // DEAL_BYTES)), key)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: up to three words make a heading; five lines a page, every eighth line has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    spaces = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    out = docs.withColumn("kind", F.when(spaces < 3, "heading").otherwise("paragraph"))
    return out.select(
        "doc_id",
        "ord",
        "kind",
        F.when(F.col("kind") == "heading", F.col("ord") % 3 + 1).cast("int").alias("level"),
        "text",
        F.when(F.col("ord") % 8 != 7, F.floor(F.col("ord") / 5)).cast("int").alias("page"),
    )


LINE_BLOCKS = """
    raw AS (SELECT doc_id, generate_subscripts(x, 1)::INT - 1 AS ord, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    blocks AS (SELECT doc_id, ord, kind, CASE WHEN kind = 'heading' THEN (ord % 3 + 1)::INT END AS level, text,
                      CASE WHEN ord % 8 <> 7 THEN (ord // 5)::INT END AS page
               FROM (SELECT *, CASE WHEN length(text) - length(replace(text, ' ', '')) < 3 THEN 'heading' ELSE 'paragraph' END AS kind FROM raw))"""


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as spans: six words a line, 40 lines a page, a right column for odd lines of every fourth document.

    All positions are whole numbers or halves, so sums are the same in any order.
    """
    docs = table(spark, sf_dir, "documents")
    docs = dealt(docs.select("doc_id", "text"), "doc_id", docs)
    words = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "[ \n]+", " "), " ")).alias("idx", "text")).where("text <> ''")
    line, at = F.floor(F.col("idx") / 6).cast("int"), (F.col("idx") % 6).cast("int")
    words = words.withColumns({"line": line, "at": at, "big": line % 10 == 0})
    size = F.when(F.col("big"), 16.0).otherwise(10.0)
    shift = F.when((F.col("doc_id") % 4 == 0) & (F.col("line") % 2 == 1), 600.0).otherwise(0.0)
    return words.select(
        "doc_id",
        F.floor(F.col("line") / 40).cast("int").alias("page"),
        F.col("idx").cast("int").alias("span_idx"),
        "text",
        (F.lit(50.0) + F.col("at") * 75.0 + shift).alias("x"),
        (F.lit(760.0) - F.floor((F.col("line") % 40) / 2) * 14.0 - F.when((F.col("doc_id") % 4 == 0), 0.0).otherwise((F.col("line") % 2) * 7.0)).alias("y"),
        F.least(F.char_length("text") * 5.5, F.lit(74.5)).alias("width"),
        size.alias("font_size"),
        F.when(F.col("big"), "Times-Bold").otherwise("Times").alias("font_name"),
        (F.col("idx") % 97 == 96).alias("is_invisible"),
        F.when(F.col("idx") % 5 == 0, 3.0).alias("space_width"),
    )


WORD_SPANS = """
    sraw AS (SELECT doc_id, generate_subscripts(x, 1)::INT - 1 AS idx, unnest(x) AS text
             FROM (SELECT doc_id, string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' ') AS x FROM documents)),
    sline AS (SELECT *, idx // 6 AS line, idx % 6 AS a, (idx // 6) % 10 = 0 AS big FROM sraw WHERE text <> ''),
    spans AS (SELECT doc_id, (line // 40)::INT AS page, idx AS span_idx, text,
                     50.0::DOUBLE + a * 75.0::DOUBLE + CASE WHEN doc_id % 4 = 0 AND line % 2 = 1 THEN 600.0::DOUBLE ELSE 0.0::DOUBLE END AS x,
                     760.0::DOUBLE - ((line % 40) // 2) * 14.0::DOUBLE - CASE WHEN doc_id % 4 = 0 THEN 0.0::DOUBLE ELSE (line % 2) * 7.0::DOUBLE END AS y,
                     least(length(text) * 5.5::DOUBLE, 74.5::DOUBLE) AS width,
                     CASE WHEN big THEN 16.0::DOUBLE ELSE 10.0::DOUBLE END AS font_size,
                     CASE WHEN big THEN 'Times-Bold' ELSE 'Times' END AS font_name,
                     idx % 97 = 96 AS is_invisible, CASE WHEN idx % 5 = 0 THEN 3.0::DOUBLE END AS space_width
              FROM sline)"""


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets: a header row, then a row of four cells for each line item."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    lines = table(spark, sf_dir, "lineitem")
    lines = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_linestatus", "l_quantity", "l_discount"), "l_orderkey", lines)
    items = lines.select(F.col("l_orderkey").alias("doc_id"), nth.alias("row"), "l_linestatus", F.col("l_quantity").cast("int").alias("q"), (F.col("l_discount") * 100).cast("int").alias("pct"), F.col("l_shipdate").cast("date").alias("d"))
    cell = lambda r, c, t: F.struct(r.alias("row"), F.lit(c).alias("col"), t.alias("text"))
    row = F.col("row")
    body = F.array(cell(row, 0, F.col("l_linestatus")), cell(row, 1, F.when(F.col("q") % 7 != 0, F.col("q").cast("string")).otherwise("")), cell(row, 2, F.concat(F.col("pct").cast("string"), F.lit("%"))), cell(row, 3, F.col("d").cast("string")))
    head = F.array(*[cell(F.lit(0), c, F.lit(t)) for c, t in enumerate(("status", "quantity", "discount", "shipped"))])
    # the header comes with the first item, so nothing is joined and the sheet stays in its task
    cells = items.select("doc_id", F.explode(F.when(row == 1, F.concat(head, body)).otherwise(body)).alias("c"))
    return cells.select("doc_id", "c.row", "c.col", "c.text", (F.col("c.row") == 0).alias("is_header"))


ORDER_CELLS = """
    items AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))::INT AS row, l_linestatus, l_quantity::INT AS q, (l_discount * 100)::INT AS pct, l_shipdate::DATE AS d FROM lineitem),
    cells AS (
      SELECT doc_id, 0 AS row, c AS col, t AS text, true AS is_header FROM (SELECT DISTINCT doc_id FROM items), (VALUES (0, 'status'), (1, 'quantity'), (2, 'discount'), (3, 'shipped')) AS h(c, t)
      UNION ALL SELECT doc_id, row, 0, l_linestatus, false FROM items
      UNION ALL SELECT doc_id, row, 1, CASE WHEN q % 7 <> 0 THEN q::VARCHAR ELSE '' END, false FROM items
      UNION ALL SELECT doc_id, row, 2, pct::VARCHAR || '%', false FROM items
      UNION ALL SELECT doc_id, row, 3, d::VARCHAR, false FROM items)"""


def event_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics: a user is a document, in the order of event ids."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 3 == 0, "info").otherwise("warning")
    message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), level.alias("level"), message.alias("message"), (F.col("event_id") % 5).cast("int").alias("page"))


#: Messages that the diagnostics of ``event_warnings`` take in turn.
MESSAGES = ["No such file or directory", "file is encrypted", "Permission denied (os error 13)", "unsupported format", "Malformed xref table", "invalid page range 5-3", "font missing", "password needed", "cannot parse stream"]

EVENT_WARNINGS = """
    warnings AS (SELECT user_id AS doc_id, event_id AS ord, event_type AS kind,
                        CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'info' ELSE 'warning' END AS level,
                        ([{}])[(event_id % {} + 1)::INT] AS message, (event_id % 5)::INT AS page FROM events)""".format(", ".join(f"'{m}'" for m in MESSAGES), len(MESSAGES))
