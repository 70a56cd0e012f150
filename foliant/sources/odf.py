"""ODT, ODS and ODP bytes to blocks."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from foliant.sources.model import Parsed
from foliant.sources.ooxml import Archive, attr, child, tag

#: Repeats of rows and columns that are expanded at most.
MOST_REPEAT = 10_000


def _text(e: ET.Element) -> str:
    out = [e.text or ""]
    for x in e:
        name = tag(x)
        if name == "s":
            out.append(" " * int(attr(x, "c") or 1))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in ("note", "annotation"):
            out.append(_text(x))
        out.append(x.tail or "")
    return "".join(out)


def _rows(table: ET.Element) -> list[list[str]]:
    rows: list[list[str]] = []

    def walk(e: ET.Element) -> None:
        for x in e:
            if tag(x) in ("table-header-rows", "table-rows", "table-row-group"):
                walk(x)
            elif tag(x) == "table-row":
                row: list[str] = []
                for cell in x:
                    if tag(cell) in ("table-cell", "covered-table-cell"):
                        paras = [_text(p) for p in cell if tag(p) in ("p", "h")]
                        text = "\n".join(paras) if paras else attr(cell, "value") or attr(cell, "date-value") or ""
                        n = int(attr(cell, "number-columns-repeated") or 1)
                        row += [text] * (min(n, MOST_REPEAT) if text else min(n, 64))
                while row and not row[-1]:
                    row.pop()
                n = int(attr(x, "number-rows-repeated") or 1)
                rows.extend([list(row) for _ in range(min(n, MOST_REPEAT) if row else min(n, 1))])

    walk(table)
    while rows and not rows[-1]:
        rows.pop()
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def odf(data: bytes) -> Parsed:
    archive, out = Archive(data), Parsed()
    root = archive.xml("content.xml")
    if root is None:
        raise ValueError("parse error: no content.xml")
    body = child(root, "body")
    kind = next(iter(body), None) if body is not None else None
    if kind is None:
        return out

    def walk(e: ET.Element, page: int | None, depth: int) -> None:
        for x in e:
            name = tag(x)
            if name == "h":
                out.add("heading", _text(x), level=min(int(attr(x, "outline-level") or 1), 6), page=page, depth=depth)
            elif name == "p" and _text(x).strip():
                out.add("list_item" if depth else "paragraph", _text(x), page=page, depth=depth)
                for link in (a for a in x.iter() if tag(a) == "a" and attr(a, "href")):
                    out.add("link", _text(link), page=page, url=attr(link, "href"))
            elif name == "list":
                for item in x:
                    walk(item, page, depth + 1)
            elif name == "table":
                out.table(_rows(x), page=page, depth=depth)
            elif name in ("section", "frame", "text-box", "custom-shape", "g", "notes"):
                walk(x, page, depth)

    if tag(kind) == "spreadsheet":
        sheets = [t for t in kind if tag(t) == "table"]
        for page, sheet in enumerate(sheets):
            out.add("heading", attr(sheet, "name") or f"Sheet{page + 1}", level=1, page=page)
            if rows := _rows(sheet):
                out.table(rows, page=page)
        out.page_count = max(1, len(sheets))
    elif tag(kind) == "presentation":
        pages = [p for p in kind if tag(p) == "page"]
        for page, slide in enumerate(pages):
            walk(slide, page, 0)
        out.page_count = max(1, len(pages))
    else:
        walk(kind, None, 0)
    meta = archive.xml("meta.xml")
    for e in meta.iter() if meta is not None else []:
        if e.text and e.text.strip() and tag(e) in ("title", "creator", "initial-creator", "subject", "description", "keyword", "creation-date", "date", "language"):
            out.metadata[{"creator": "author"}.get(tag(e), tag(e))] = e.text.strip()
    return out
