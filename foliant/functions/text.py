"""Column functions over text. All are native expressions but ``nfc``, which Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ASCII, as sentence ends look for it.
ASCII_SPACE = " \t\n\f\r"


def is_blank(text: Column) -> Column:
    """True if nothing but Unicode white space is left."""
    return ~text.rlike(r"[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def sentences(text: Column) -> Column:
    """Splits after a run of . ! ? that ASCII white space follows; the run stays, the white space goes."""
    marked = F.regexp_replace(text, r"([.!?]+)[ \t\n\f\r]+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def soft_hyphens_removed(text: Column) -> Column:
    return F.replace(text, F.lit("\u00ad"), F.lit(""))


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalised(text: Column) -> Column:
    """Document text: NFC without soft hyphens. Pure ASCII never reaches Python's normaliser twice."""
    nfc = F.pandas_udf(_nfc, "string")
    return F.when(text.rlike(r"[^\x00-\x7F]"), nfc(soft_hyphens_removed(text))).otherwise(text)


def preview(text: Column, width: int = 40) -> Column:
    """The first ``width`` characters, with an ellipsis if there are more."""
    return F.when(F.char_length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def tsv_cell(text: Column) -> Column:
    """Tabs and line ends become spaces, so a cell cannot break its row."""
    return F.regexp_replace(text, "[\t\n\r]", " ")


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def n_words(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\n\f\r]+")))


#: Rules in order: (code, any of these substrings) or, with +, all of them. Fixed values.
ERROR_RULES = [
    ("E_FILE_NOT_FOUND", ["no such file", "not found", "does not exist"]),
    ("E_PERMISSION_DENIED", ["permission denied"]),
    ("E_FORMAT_UNSUPPORTED", ["unknown format", "unsupported format", "unable to detect format"]),
    ("E_ENCRYPTION_REQUIRED", ["encrypt", "password"]),
    ("E_INVALID_ARGUMENT", ["invalid+page range"]),
    ("E_PARSE_ERROR", ["parse", "malformed", "xref"]),
]
DEFAULT_ERROR = "E_EXTRACTION_FAILED"
#: Severity of the codes that stand above 1. Fixed values.
SEVERITY = {"E_FILE_NOT_FOUND": 3, "E_PERMISSION_DENIED": 3, "E_ENCRYPTION_REQUIRED": 2}


def error_code(message: Column) -> Column:
    """The first rule whose substrings the lower-cased message has."""
    low, out = F.lower(message), None
    for code, parts in ERROR_RULES:
        test = F.lit(False)
        for part in parts:
            hit = F.lit(True)
            for piece in part.split("+"):
                hit = hit & F.contains(low, F.lit(piece))
            test = test | hit
        out = F.when(test, code) if out is None else out.when(test, code)
    return out.otherwise(DEFAULT_ERROR)


def severity(code: Column) -> Column:
    out = F.lit(1)
    for name, rank in SEVERITY.items():
        out = F.when(code == name, F.lit(rank)).otherwise(out)
    return out


def parse_size(text: str) -> int:
    """'256mb', '1gb', '10kb' or bytes, in any case."""
    t = text.strip().lower()
    for unit, factor in (("gb", 1 << 30), ("mb", 1 << 20), ("kb", 1 << 10), ("b", 1)):
        if t.endswith(unit):
            t = t[: -len(unit)].strip()
            break
    else:
        factor = 1
    if not t.isdigit():
        raise ValueError(f"not a size: {text!r}")
    return int(t) * factor


def parse_pages(spec: str, most: int = 1_000_000) -> list[int]:
    """'1,3,5-10' as sorted distinct pages from 0; page numbers in the text are from 1."""
    pages: set[int] = set()
    for part in spec.split(","):
        first, dash, last = part.strip().partition("-")
        if not first.strip().isdigit() or (dash and not last.strip().isdigit()):
            raise ValueError(f"not a page range: {spec!r}")
        low, high = int(first), int(last) if dash else int(first)
        if low < 1 or high < low or high - low >= most:
            raise ValueError(f"not a page range: {spec!r}")
        pages.update(range(low - 1, high))
    return sorted(pages)


def pages_of_spec(spec: Column) -> Column:
    """The same over a column of well-formed page specifications."""
    parts = F.transform(F.split(spec, ","), lambda p: F.split(F.trim(p), "-"))
    ranges = F.transform(parts, lambda p: F.sequence(F.get(p, F.lit(0)).cast("int") - 1, F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0))).cast("int") - 1))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def sampled_pages(page_count: Column) -> Column:
    """Up to five pages: all; else the first, the three in the middle and the last."""
    n = page_count.cast("int")
    mid = F.floor(n / 2).cast("int")
    some = F.array_sort(F.array_distinct(F.array(F.lit(0), mid - 1, mid, mid + 1, n - 1)))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= 5, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(some)
