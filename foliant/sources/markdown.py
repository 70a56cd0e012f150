"""Markdown: native line classes, and a block parser for the scan."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.model import Parsed

#: Line classes in the order of tests, as patterns over a line. Fixed values.
LINE_CLASSES: list[tuple[str, str]] = [
    ("blank", r"^\s*$"),
    ("atx_heading", r"^\s*#{1,6}([ \t].*)?$"),
    ("thematic_break", r"^\s*(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"),
    ("fence", r"^ {0,3}(?:```[^`]*|~~~.*)$"),
    ("indented_code", r"^(?:\t| {4})(?!\s*(?:>|[-*+](?:[ \t]|$)|[0-9]{1,9}[.)](?: |$)))"),
    ("quote", r"^\s*>"),
    ("list_item", r"^\s*(?:[-*+](?:[ \t]|$)|[0-9]{1,9}[.)](?: |$))"),
    ("link_definition", r"^\s*\[[^\]]+\]:\s*\S"),
    ("pipe_row", r"^\s*\||\|\s*$"),
]


def line_class(line: Column) -> Column:
    """The class of a Markdown line: the first pattern that it matches, else text."""
    out = None
    for name, pattern in LINE_CLASSES:
        test = line.rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("text")


def heading_of(line: Column) -> Column:
    """(level, text) of an ATX heading line; a closing run of # goes."""
    marks = F.length(F.regexp_extract(line, r"^\s*(#{1,6})", 1))
    body = F.regexp_extract(line, r"^\s*#{1,6}(.*)$", 1)
    text = F.regexp_replace(F.trim(F.regexp_replace(F.trim(body), "#+$", "")), r"\s+$", "")
    return F.when(line.rlike(LINE_CLASSES[1][1]), F.struct(marks.alias("level"), text.alias("text")))


def setext_level(line: Column, after: Column) -> Column:
    """The level that an underline of = or - gives to the text line before it."""
    return F.when((line_class(line) == "text") & after.rlike(r"^\s*=+\s*$"), 1).when((line_class(line) == "text") & after.rlike(r"^\s*-+\s*$"), 2)


def is_separator(line: Column) -> Column:
    """The row of dashes under a pipe table's header."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|+", ""), r"\|+$", "")
    return F.contains(line, F.lit("|")) & inner.rlike(r"^[ \t]*(:*-+:*)?[ \t]*(\|[ \t]*(:*-+:*)?[ \t]*)*$") & F.contains(inner, F.lit("-"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, line_no, line, class)."""
    out = docs.select("doc_id", F.posexplode(F.split(F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")).alias("line_no", "line"))
    return out.withColumn("class", line_class(F.col("line")))


def link_definitions(docs: DataFrame) -> DataFrame:
    """Labels (lower-cased) and URLs; the last definition of a label counts."""
    pattern = r"^[\s>*+-]*\[([^\]]+)\]:\s*<?([^\s>]+)"
    rows = lines(docs).where(F.col("line").rlike(pattern))
    rows = rows.select("doc_id", "line_no", F.lower(F.regexp_extract("line", pattern, 1)).alias("label"), F.regexp_extract("line", pattern, 2).alias("url"))
    return rows.groupBy("doc_id", "label").agg(F.max_by("url", "line_no").alias("url"))


def inline_links(text: Column) -> Column:
    """URLs of inline links and autolinks, in order; an address in angle brackets gets mailto:."""
    found = F.regexp_extract_all(text, F.lit(r"\]\(<?([^)\s>]+)|<([a-zA-Z][a-zA-Z0-9+.-]*:[^>\s]+)>"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\]\(<?", ""), "^<|>$", ""))


_LIST = re.compile(r"^(\s*)(?:([-*+])|([0-9]{1,9})([.)]))(?:[ \t]+(.*)|$)")


def split_row(row: str) -> list[str]:
    """Cells of a pipe row; pipes in code spans or after a backslash do not split."""
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    cells, cell, code, skip = [], "", False, False
    for ch in row:
        if skip:
            cell, skip = cell + (ch if ch == "|" else "\\" + ch), False
        elif ch == "\\":
            skip = True
        elif ch == "`":
            code, cell = not code, cell + ch
        elif ch == "|" and not code:
            cells.append(cell.strip())
            cell = ""
        else:
            cell += ch
    return [*cells, cell.strip()]


_SEPARATOR = re.compile(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$")


def plain(text: str, links: dict[str, str] | None = None) -> str:
    """Inline Markdown as text: markers go, links and images keep their text, entities are resolved."""
    spans: list[str] = []

    def keep(m: re.Match) -> str:
        body = m[2]
        spans.append(body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body)
        return f"\0{len(spans) - 1}\0"

    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", keep, text, flags=re.S)
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[([^\]]+)\]\[([^\]]*)\]", r"\1", text)
    text = re.sub(r"<([a-zA-Z][a-zA-Z0-9+.-]*:[^>\s]+|[^\s@<>]+@[^\s@<>]+)>", r"\1", text)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        text = re.sub(rf"(?<!\\){mark}(?=\S)(.+?)(?<=\S)(?<!\\){mark}", r"\1", text, flags=re.S)
    text = re.sub(r"(?<![\w\\])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text, flags=re.S)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", html.unescape(text))
    return re.sub("\0([0-9]+)\0", lambda m: spans[int(m[1])], text)


def parse(data: bytes) -> Parsed:
    """Markdown bytes to blocks: headings, paragraphs, lists, quotes, code, tables, breaks."""
    out = Parsed()
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("utf-8", "replace")
        out.warn("InvalidEncoding", "invalid UTF-8 was replaced")
    _blocks(out, text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 0)
    return out


def _blocks(out: Parsed, lines: list[str], depth: int) -> None:
    para: list[str] = []

    def close() -> None:
        if para:
            text = "\n".join(x.strip() for x in para)
            para.clear()
            image = re.fullmatch(r"!\[([^\]]*)\]\(<?([^)\s>]+)[^)]*\)", text)
            if image:
                out.add("image", image[1], page=0, depth=depth, url=image[2])
            elif plain(text).strip():
                out.add("paragraph", plain(text), page=0, depth=depth)

    i = 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        fence = re.match(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*$", line)
        if not bare:
            close()
        elif fence:
            close()
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[j])), None)
            if end is None:
                out.warn("UnclosedFence", "a code fence is not closed")
                end = len(lines)
            out.add("code", "\n".join(lines[i + 1 : end]), page=0, depth=depth)
            i = end
        elif re.match(LINE_CLASSES[1][1], line):
            close()
            marks = re.match(r"#{1,6}", bare)[0]
            text = plain(bare[len(marks) :].strip().rstrip("#").rstrip())
            if text:
                out.add("heading", text, level=len(marks), page=0, depth=depth)
        elif para and re.fullmatch(r"=+|-+", bare):
            text, level = plain("\n".join(x.strip() for x in para)), 1 if bare[0] == "=" else 2
            para.clear()
            out.add("heading", text, level=level, page=0, depth=depth)
        elif re.match(LINE_CLASSES[2][1], line):
            close()
            out.add("thematic_break", page=0, depth=depth)
        elif not para and re.match(LINE_CLASSES[4][1], line):
            body = []
            while i < len(lines) and (re.match(LINE_CLASSES[4][1], lines[i]) or (not lines[i].strip() and body)):
                body.append(re.sub(r"^(?:\t| {4})", "", lines[i]))
                i += 1
            out.add("code", "\n".join(body).rstrip("\n"), page=0, depth=depth)
            continue
        elif bare.startswith(">") and depth < 32:
            close()
            body = []
            while i < len(lines) and lines[i].strip().startswith(">"):
                body.append(re.sub(r"^\s*> ?", "", lines[i]))
                i += 1
            _blocks(out, body, depth + 1)
            continue
        elif _LIST.match(line) and depth < 32:
            close()
            while i < len(lines) and (m := _LIST.match(lines[i])):
                body = [m[5] or ""]
                indent = len(m[1]) + 1
                i += 1
                while i < len(lines) and lines[i].strip() and (len(lines[i]) - len(lines[i].lstrip()) >= indent + 1 or not _LIST.match(lines[i])) and not re.match(LINE_CLASSES[1][1], lines[i]):
                    body.append(lines[i].strip() if not _LIST.match(lines[i].strip()) else lines[i].lstrip())
                    i += 1
                nested = next((k for k, x in enumerate(body[1:], 1) if _LIST.match(x)), len(body))
                out.add("list_item", plain(" ".join(body[:nested])), page=0, depth=depth, level=int(m[3]) if m[3] else None)
                if nested < len(body):
                    _blocks(out, body[nested:], depth + 1)
                while i + 1 < len(lines) and not lines[i].strip() and _LIST.match(lines[i + 1]):
                    i += 1
            continue
        elif re.match(LINE_CLASSES[7][1], line):
            close()
        elif "|" in bare and i + 1 < len(lines) and "|" in lines[i + 1] and _SEPARATOR.match(lines[i + 1].strip()):
            close()
            width = len(split_row(lines[i + 1]))
            rows = [split_row(line)]
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append(split_row(lines[i]))
                i += 1
            out.table([[plain(c) for c in (r + [""] * width)[:width]] for r in rows], page=0, depth=depth)
            continue
        else:
            para.append(line)
        i += 1
    close()
