"""Quality rules: a threshold table compiled into one projection of native expressions.

Each rule is (name, metric, comparison, threshold); a document fails a rule when the
comparison holds. Metrics are ratios of counts over the whole text. No user function, no
shuffle: one pass over the rows, whatever their number.

Defined results: null and empty texts have 0 words and fail the base rules; a text without
words has ratio 0 everywhere and no stop word ratio; repeated rows are judged one by one;
extra columns are left out of the query and kept by ``with_verdict``, those named like a
result under their name with ``_input`` added; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import WS_CHARS, documents, fresh, words_col

#: Frequent words of languages in Latin script. Fixed values.
STOP_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so said".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son elle ou".split(),
    "de": "der die und das von zu mit den ist sich auf dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como pero sus le ha si fue este".split(),
}
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

SYMBOLS = "#*$%&|<>"

#: (name, metric, comparison, threshold). A document is dropped when any holds.
RULES: list[tuple[str, str, str, float]] = [
    ("mean_word_short", "mean_word_length", "<", 2.0),
    ("mean_word_long", "mean_word_length", ">", 16.0),
    ("symbols", "symbol_ratio", ">", 0.1),
    ("stop_words", "stop_word_ratio", "<", 0.02),
    ("bullets", "bullet_line_ratio", ">", 0.9),
    ("ellipses", "ellipsis_line_ratio", ">", 0.6),
    ("dup_lines", "dup_line_ratio", ">", 0.6),
]


def _lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")


def _repeats(pairs: Column) -> Column:
    """Sorted positions of the windows whose hash is found twice or more, from sorted (hash, position) pairs.

    ``pairs`` must be a column of its own, as it is read again for each element.
    """
    last = F.size(pairs) - 1

    def hit(x: Column, k: Column) -> Column:
        before = F.coalesce(x["h"] == F.get(pairs, k - 1)["h"], F.lit(False))
        after = F.coalesce((k < last) & (x["h"] == F.get(pairs, k + 1)["h"]), F.lit(False))
        return before | after

    return F.array_sort(F.transform(F.filter(pairs, hit), lambda x: x["i"]))


def _covered(places: Column, width: int) -> Column:
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p + width - acc["end"])).cast("long").alias("n"), (p + width).cast("int").alias("end")),
        lambda acc: acc["n"],
    )


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_length", "symbol_ratio", "stop_word_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "dup_line_ratio"]


def _room(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the columns that are named like ``names`` under new names, with ``_input`` added."""
    for c in df.columns:
        if c.lower() in names:
            df = df.withColumnRenamed(c, fresh([*df.columns, *names], f"{c}_input"))
    return df


def metrics(df: DataFrame, text: str = "text", width: int = 8) -> DataFrame:
    """Adds ``METRICS``, the counts and ratios that rules may name. ``width`` is the window of n_repeat_words.

    The stop word ratio is that of the language whose stop words are the largest part of the
    words; it is null, so that no rule on it holds, for texts without words and those whose
    word characters are not mostly a to z, as the lists say nothing about other scripts.
    """
    if text.lower() in METRICS:
        raise ValueError(f"the text column must not be named like a metric: {text}")
    df = _room(df, METRICS)
    given = df.columns
    w, lines, win, pairs, dup, common, ascii_ = (fresh(given, x) for x in ("_w", "_lines", "_win", "_pairs", "_dup", "_common", "_ascii"))
    t = F.coalesce(F.col(text), F.lit(""))
    every = sorted({x for words in STOP_WORDS.values() for x in words})
    df = df.withColumn(w, words_col(F.col(text))).withColumn(lines, _lines(t))
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.char_length(F.translate(t, WS_CHARS, "")).cast("long"),
            "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            ascii_: F.char_length(t) - F.char_length(F.translate(t, ASCII_LETTERS, "")),
            common: F.filter(F.split(F.lower(F.array_join(w, " ")), " "), lambda x: x.isin(every)),
            win: F.when(F.size(w) > width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(F.col(w), i, width)))).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # only texts with a repeated window are sorted; the pairs become a column before they are compared
    sorted_pairs = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(pairs, F.when(F.size(F.array_distinct(win)) < F.size(win), sorted_pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn(dup, _repeats(F.col(pairs)))
    df = df.withColumn("n_repeat_words", _covered(F.col(dup), width))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n_lines = F.size(lines)
    count = lambda test: F.size(F.filter(lines, test))
    hits = lambda words: F.size(F.filter(common, lambda x: x.isin(words)))
    stops = F.greatest(*map(hits, STOP_WORDS.values()))
    df = df.withColumns(
        {
            "mean_word_length": ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("word_chars")),
            "stop_word_ratio": F.when((F.col("n_words") > 0) & (2 * F.col(ascii_) > F.col("word_chars")), stops / F.col("n_words")),
            "bullet_line_ratio": ratio(count(lambda x: F.ltrim(x).rlike("^[-*•]")), n_lines),
            "ellipsis_line_ratio": ratio(count(lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$")), n_lines),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), n_lines),
        }
    )
    return df.select(*given, *METRICS)


def compile_rules(rules: list[tuple[str, str, str, float]]) -> Column:
    """The threshold table as one array column of the names of the rules that a row fails."""
    tests = {"<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v}
    return F.array_compact(F.array(*[F.when(tests[op](F.col(metric), F.lit(value)), F.lit(name)) for name, metric, op, value in rules]))


def with_verdict(df: DataFrame, rules: list[tuple[str, str, str, float]] | None = None, text: str = "text") -> DataFrame:
    """Adds the metrics, base_failed, failed_rules and kept."""
    df = metrics(_room(df, ["base_failed", "failed_rules", "kept"]), text)
    base = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    df = df.withColumn("base_failed", base).withColumn("failed_rules", compile_rules(RULES if rules is None else rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(documents(spark, sf_dir).select("doc_id", "text")).select(*COLUMNS)


def oracle_sql() -> str:
    hits = "greatest(" + ", ".join("len(list_filter(lw, lambda x: x IN ({})))".format(", ".join(f"'{w}'" for w in words)) for words in STOP_WORDS.values()) + ")"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_transform(ws, lambda x: lower(x)) AS lw FROM (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)),
    win AS (SELECT doc_id, u.i AS i, array_to_string(ws[u.i : u.i + 7], ' ') AS k
            FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i) WHERE len(ws) >= 8),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, unnest(generate_series(0, 7)) AS v(j) GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
                 length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
                 coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
                 {hits} AS n_stop, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_ascii,
                 len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS bullets,
                 len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS dots
          FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (
             (CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END) < 2
             OR (CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END) > 16
             OR (CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END) > 0.1
             OR (n_words > 0 AND 2 * n_ascii > word_chars AND n_stop / n_words < 0.02)
             OR (CASE WHEN n_lines > 0 THEN bullets / n_lines ELSE 0 END) > 0.9
             OR (CASE WHEN n_lines > 0 THEN dots / n_lines ELSE 0 END) > 0.6
             OR (CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END) > 0.6) AS kept
    FROM b
    """
