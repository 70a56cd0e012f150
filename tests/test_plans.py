"""Plans: filters and columns reach the scan, and no query crosses rows without a key."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from foliant.plans import registry
from foliant.sources import detect


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["chunks_by_page", "word_gaps", "table_quality", "font_audit", "worst_errors", "line_crossings", "markdown_lines", "emit_markdown"])
def test_no_cartesian_and_few_columns(spark, sf, name):
    text = plan(registry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not any("n_chars" in line or "source" in line for line in text.splitlines() if line.startswith("ReadSchema"))


@pytest.mark.parametrize("name", ["chunks_by_page", "word_gaps", "merged_spans", "table_quality", "tables_tsv", "warnings_capped", "worst_errors", "emit_json_lines", "column_cuts"])
def test_native_queries_have_no_python(spark, sf, name):
    text = plan(registry.queries()[name](spark, sf))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_size_limit_is_pushed_down(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# a")
    (tmp_path / "b.md").write_bytes(b"#" * 100)
    files = detect.scan_files(spark, str(tmp_path), most_bytes=10)
    assert "LessThanOrEqual(length,10)" in plan(files)
    assert files.select("path").count() == 1


def test_every_query_has_its_sql_columns(spark, sf):
    oracles = registry.oracle_sql()
    assert {"lattice_cells", "parsed_documents", "feature_report"} >= set(registry.queries()) - set(oracles)
    assert registry.queries()["page_text"](spark, sf).where(F.col("n_lines") < 1).count() == 0
