"""Queries of the chunking operators over lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import sentences
from foliant.operators import chunking as C
from foliant.plans.adapters import LINE_BLOCKS, line_blocks
from foliant.plans.registry import query

SIZE = 600


def _digest(df, *extra):
    """Chunk texts are compared by length and hash."""
    return df.select("doc_id", "chunk_index", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), *extra)


_DIGEST = "doc_id, chunk_index, length(text)::BIGINT AS n_chars, md5(text) AS text_md5"

_SIZE_SQL = f"""
    WITH RECURSIVE {LINE_BLOCKS.lstrip()},
    b AS (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM blocks WHERE trim(text) <> ''),
    f AS (SELECT doc_id, i, 0 AS chunk, n > {SIZE} AS over, CASE WHEN n > {SIZE} THEN 0 ELSE n END AS size, CASE WHEN n > {SIZE} THEN 1 ELSE 0 END AS nxt FROM b WHERE i = 1
          UNION ALL
          SELECT b.doc_id, b.i,
                 CASE WHEN f.size > 0 AND f.size + 1 + b.n > {SIZE} THEN f.nxt + 1 ELSE f.nxt END,
                 f.size = 0 AND b.n > {SIZE},
                 CASE WHEN f.size > 0 AND f.size + 1 + b.n > {SIZE} THEN b.n WHEN f.size = 0 AND b.n > {SIZE} THEN 0 WHEN f.size > 0 THEN f.size + 1 + b.n ELSE b.n END,
                 CASE WHEN f.size > 0 AND f.size + 1 + b.n > {SIZE} THEN f.nxt + 1 WHEN f.size = 0 AND b.n > {SIZE} THEN f.nxt + 1 ELSE f.nxt END
          FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1),
    c AS (SELECT b.doc_id, f.chunk::INT AS chunk_index, string_agg(b.text, chr(10) ORDER BY b.ord) AS text, bool_or(f.over) AS oversize, min(b.page) AS page_lo, max(b.page) AS page_hi
          FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i GROUP BY b.doc_id, f.chunk)
    SELECT {_DIGEST}, oversize, page_lo, page_hi FROM c"""


@query("chunks_by_size", _SIZE_SQL)
def chunks_by_size(spark, sf_dir):
    return _digest(C.by_size(line_blocks(spark, sf_dir), SIZE), "oversize", "page_lo", "page_hi")


@query(
    "chunks_by_page",
    f"""WITH {LINE_BLOCKS.lstrip()},
    k AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
                 last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM blocks),
    r AS (SELECT *, sum(CASE WHEN page IS NOT NULL AND known IS NOT NULL AND page <> known THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM k),
    c AS (SELECT doc_id, run, string_agg(text, chr(10) ORDER BY ord) AS text, max_by(so_far, ord) AS page FROM r GROUP BY doc_id, run),
    n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::INT AS chunk_index, text, page FROM c WHERE trim(text, ' ' || chr(10)) <> '')
    SELECT {_DIGEST}, '{{"page":' || page || '}}' AS citation FROM n""",
)
def chunks_by_page(spark, sf_dir):
    return _digest(C.by_page(line_blocks(spark, sf_dir)), C.page_citation(F.col("page")).alias("citation"))


_PATH_SQL = "list_concat(" + "list_slice([" + ", ".join(f"coalesce(d{d}, '')" for d in range(1, 6)) + "], 1, level - 1), [text])"


def _heading_sql(cut: str, path: str, prelude: str) -> str:
    return f"""WITH {LINE_BLOCKS.lstrip()}, {prelude}
    m AS (SELECT *, {cut} AS cut, sum(CASE WHEN {cut} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS part FROM h),
    c AS (SELECT doc_id, part, string_agg(CASE WHEN NOT cut AND trim(text) <> '' THEN text END, chr(10) ORDER BY ord) AS text,
                 coalesce(max(CASE WHEN cut THEN {path} END), []::VARCHAR[]) AS heading_path,
                 min(CASE WHEN NOT cut THEN page END) AS page_lo, max(CASE WHEN NOT cut THEN page END) AS page_hi FROM m GROUP BY doc_id, part),
    n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS chunk_index FROM c WHERE text IS NOT NULL)
    SELECT {_DIGEST}, heading_path, page_lo, page_hi FROM n"""


_PATHS = (
    "h AS (SELECT *, "
    + ", ".join(
        f"CASE WHEN last_value(CASE WHEN kind = 'heading' AND level <= {d} THEN level END IGNORE NULLS) OVER w = {d} THEN last_value(CASE WHEN kind = 'heading' AND level <= {d} THEN text END IGNORE NULLS) OVER w END AS d{d}"
        for d in range(1, 6)
    )
    + " FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),"
)


@query("chunks_by_heading", _heading_sql("kind = 'heading'", _PATH_SQL, _PATHS))
def chunks_by_heading(spark, sf_dir):
    return _digest(C.by_heading(line_blocks(spark, sf_dir)), "heading_path", "page_lo", "page_hi")


@query("chunks_by_section", _heading_sql("kind = 'heading' AND level = 1", "[text]", "h AS (SELECT * FROM blocks),"))
def chunks_by_section(spark, sf_dir):
    return _digest(C.by_section(line_blocks(spark, sf_dir)), "heading_path", "page_lo", "page_hi")


_PROV = "CASE WHEN count(page) = count(*) AND min(page) = max(page) THEN min(page) END AS page"


@query(
    "library_chunks_by_page",
    f"""WITH {LINE_BLOCKS.lstrip()},
    c AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, list(ord ORDER BY ord) AS block_ids, {_PROV}, min(ord) AS f FROM blocks WHERE text <> '' GROUP BY doc_id, coalesce(page, -1)),
    n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1)::INT AS chunk_index FROM c)
    SELECT {_DIGEST}, block_ids, page FROM n""",
)
def library_chunks_by_page(spark, sf_dir):
    return _digest(C.chunks(line_blocks(spark, sf_dir), "page"), "block_ids", "page")


def _segment_sql(starts: str, capped: str) -> str:
    full = f"({capped} AND f.total + 2 + b.n > {SIZE})"
    return f"""
    WITH RECURSIVE {LINE_BLOCKS.lstrip()},
    b AS (SELECT *, strlen(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM blocks WHERE text <> ''),
    f AS (SELECT doc_id, i, 0 AS chunk, n AS total FROM b WHERE i = 1
          UNION ALL
          SELECT b.doc_id, b.i, CASE WHEN {starts} OR {full} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN {starts} OR {full} THEN b.n ELSE f.total + 2 + b.n END
          FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1),
    c AS (SELECT b.doc_id, f.chunk::INT AS chunk_index, string_agg(b.text, chr(10) || chr(10) ORDER BY b.ord) AS text, list(b.ord ORDER BY b.ord) AS block_ids, {_PROV.replace("page", "b.page").replace("AS b.page", "AS page")}
          FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i GROUP BY b.doc_id, f.chunk)
    SELECT {_DIGEST}, block_ids, page FROM c"""


@query("library_chunks_by_heading", _segment_sql("b.kind = 'heading'", "true"))
def library_chunks_by_heading(spark, sf_dir):
    return _digest(C.chunks(line_blocks(spark, sf_dir), "heading", SIZE), "block_ids", "page")


@query("library_chunks_by_section", _segment_sql("(b.kind = 'heading' AND b.level = 1)", "true"))
def library_chunks_by_section(spark, sf_dir):
    return _digest(C.chunks(line_blocks(spark, sf_dir), "section", SIZE), "block_ids", "page")


@query("library_chunks_semantic", _segment_sql("false", "b.kind = 'paragraph'"))
def library_chunks_semantic(spark, sf_dir):
    return _digest(C.chunks(line_blocks(spark, sf_dir), "semantic", SIZE), "block_ids", "page")


_SENT = r"""s AS (SELECT doc_id, ord, page, generate_subscripts(x, 1) AS pos, unnest(x) AS s
                   FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?]+)[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') AS x FROM blocks WHERE text <> ''))"""


@query(
    "library_chunks_by_size",
    f"""
    WITH RECURSIVE {LINE_BLOCKS.lstrip()}, {_SENT},
    b AS (SELECT doc_id, ord, page, trim(s) AS t, strlen(trim(s)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord, pos) AS i FROM s WHERE trim(s) <> ''),
    f AS (SELECT doc_id, i, 0 AS chunk, n AS total FROM b WHERE i = 1
          UNION ALL
          SELECT b.doc_id, b.i, CASE WHEN f.total + 1 + b.n > {SIZE} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.total + 1 + b.n > {SIZE} THEN b.n ELSE f.total + 1 + b.n END
          FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1),
    c AS (SELECT b.doc_id, f.chunk::INT AS chunk_index, string_agg(b.t, ' ' ORDER BY b.i) AS text, list_sort(list(DISTINCT b.ord)) AS block_ids, {_PROV.replace("page", "b.page").replace("AS b.page", "AS page")}
          FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i GROUP BY b.doc_id, f.chunk)
    SELECT {_DIGEST}, block_ids, page FROM c""",
)
def library_chunks_by_size(spark, sf_dir):
    return _digest(C.chunks(line_blocks(spark, sf_dir), "size", SIZE), "block_ids", "page")


@query("sentence_split", rf"""WITH {LINE_BLOCKS.lstrip()}, {_SENT} SELECT doc_id, ord, (pos - 1)::INT AS pos, s AS sentence FROM s""")
def sentence_split(spark, sf_dir):
    return line_blocks(spark, sf_dir).where("text <> ''").select("doc_id", "ord", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "heading_citations",
    f"""WITH {LINE_BLOCKS.lstrip()}, {_PATHS.rstrip(",")}
    SELECT doc_id, ord, '{{"heading_path":' || to_json({_PATH_SQL}) || '}}' AS citation FROM h WHERE kind = 'heading'""",
)
def heading_citations(spark, sf_dir):
    headings = C.heading_paths(line_blocks(spark, sf_dir)).where("kind = 'heading'")
    return headings.select("doc_id", "ord", C.heading_citation(F.col("path"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("citation"))


