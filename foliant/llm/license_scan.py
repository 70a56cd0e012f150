"""License scans by canonical digests, with DataFrame operations only.

A text is brought to a canonical form (lines with a copyright notice dropped, lower case,
punctuation and white space to single spaces, equivalent spellings made one), digested with
SHA-256, and hash-joined with the digests of known texts. The known table is ``KNOWN`` or any
table of licence texts (``digests_of``); it is broadcast if its rows are few. Whole texts are looked up, and each
line and each paragraph of several lines as a text of its own, for notices that stand inside documents.

Defined results: null text has a null digest and no licence; a text whose canonical form is
empty has no licence; repeated rows are scanned one by one; of several known texts with one
digest the first licence by name counts; rows with equal doc_ids share their line matches;
extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents
from foliant.llm.known_licenses import EQUIVALENT, KNOWN

#: A line with one of these is a copyright line. Fixed values, as are the next two.
_COPYRIGHT = r"copyright \(c\)|copyright ©|copyright [0-9]|\(c\) [0-9]|© [0-9]|all rights reserved"
#: A line that begins so is one, too, unless it speaks of copyright in the words of licences.
_BEGINS = r"^[ \t*#/;.-]*copyright "
_SPOKEN = r"notice|holder|owner|permission|license|licence| law"
#: Each copyright line has one of these; texts without any are not searched.
_MARKS = ["copyright", "(c)", "©", "all rights reserved"]
#: Known tables of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000


def _has(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def canonical(text: Column) -> Column:
    """The canonical form; words are between single spaces, none at the ends."""
    low = F.lower(text)
    stays = lambda x: ~(x.rlike(_COPYRIGHT) | (x.rlike(_BEGINS) & ~x.rlike(_SPOKEN)))  # noqa: E731
    t = F.when(_has(low, _MARKS), F.array_join(F.filter(F.split(low, "\n"), stays), "\n")).otherwise(low)
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.btrim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(digest, license): one row for each known canonical text."""
    return digests_of(spark.createDataFrame(KNOWN if known is None else known, "license string, kind string, text string"))


def digests_of(texts: DataFrame) -> DataFrame:
    """A table of licence texts (license, text) as the known table, for instance one read from files."""
    rows = texts.where(canonical(F.col("text")) != "")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def stems_of(texts: list[str]) -> list[str]:
    """Few words of which each text has one, whatever its spelling; a line without any has the canonical form of no text."""
    changed = {w for pair in EQUIVALENT for side in pair for w in side.split()}
    marked = lambda x: any(m in x for m in _MARKS)  # noqa: E731
    words = [set(re.findall("[a-z]{5,}", " ".join(x for x in t.lower().split("\n") if not marked(x)) or t.lower())) - changed for t in texts]
    if any(not w for w in words):
        return []
    out: list[str] = []
    while words:
        counts = Counter(w for ws in words for w in ws)
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        out.append(best)
        words = [ws for ws in words if best not in ws]
    return out


def scan(docs: DataFrame, known: DataFrame, stems: list[str] | None = None) -> DataFrame:
    """Per document: digest of the whole text, its licence, and how many lines and paragraphs of several lines are known, with their licences.

    ``stems``: words of which each known text has one (see ``stems_of``); lines and
    paragraphs without any are not digested. None or empty: all are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(True).alias("line"), x.alias("t")))
    blocks = F.transform(F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda x: F.contains(x, F.lit("\n"))), lambda x: F.struct(F.lit(False).alias("line"), x.alias("t")))
    parts = docs.select("doc_id", F.explode(F.concat(lines, blocks)).alias("p")).select("doc_id", "p.line", "p.t")
    if stems:
        parts = parts.where(_has(F.lower("t"), stems))
    parts = parts.select("doc_id", "line", digest(F.col("t")).alias("digest")).join(table, "digest")
    names = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("license")))), ",")  # noqa: E731
    found = parts.groupBy("doc_id").agg(F.count_if("line").alias("n"), names(F.col("line")).alias("line_licenses"), F.count_if(~F.col("line")).alias("m"), names(~F.col("line")).alias("block_licenses"))
    whole = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    out = whole.join(found, "doc_id", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "digest", "license", F.coalesce("n", none).alias("n_license_lines"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("m", none).alias("n_license_blocks"), F.coalesce("block_licenses", F.lit("")).alias("block_licenses"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), known_digests(spark), stems_of([x[2] for x in KNOWN]))


def _canonical_sql(text: str) -> str:
    t = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda x: NOT (regexp_matches(x, '{_COPYRIGHT}') OR (regexp_matches(x, '{_BEGINS}') AND NOT regexp_matches(x, '{_SPOKEN}')))), chr(10))"
    t = f"' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in EQUIVALENT:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def oracle_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(x[0], x[2].replace("'", "''")) for x in KNOWN)
    return rf"""
    WITH k AS (SELECT digest, min(license) AS license FROM (
           SELECT license, {_canonical_sql("text")} AS c, sha256({_canonical_sql("text")}) AS digest FROM (VALUES {rows}) AS v(license, text)) WHERE c <> '' GROUP BY digest),
    l AS (SELECT doc_id, true AS line, unnest(string_split(text, chr(10))) AS t FROM documents
          UNION ALL SELECT doc_id, false, unnest(list_filter(string_split_regex(text, '
[ 	]*
'), lambda x: contains(x, chr(10)))) FROM documents),
    f AS (SELECT doc_id, count(*) FILTER (line) AS n, array_to_string(list_sort(list_distinct(list(license) FILTER (line))), ',') AS line_licenses,
                 count(*) FILTER (NOT line) AS m, array_to_string(list_sort(list_distinct(list(license) FILTER (NOT line))), ',') AS block_licenses
          FROM (SELECT doc_id, line, sha256({_canonical_sql("t")}) AS digest FROM l) x JOIN k USING (digest) GROUP BY doc_id),
    w AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
    SELECT w.doc_id, w.digest, k.license, coalesce(f.n, 0)::BIGINT AS n_license_lines, coalesce(f.line_licenses, '') AS line_licenses,
           coalesce(f.m, 0)::BIGINT AS n_license_blocks, coalesce(f.block_licenses, '') AS block_licenses
    FROM w LEFT JOIN k ON k.digest = w.digest LEFT JOIN f ON f.doc_id = w.doc_id
    """
