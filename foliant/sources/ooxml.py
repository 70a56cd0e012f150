"""DOCX, XLSX and PPTX bytes to blocks, with the standard library's ZIP and XML readers."""

from __future__ import annotations

import posixpath
import re
from datetime import date, timedelta
from functools import lru_cache
from xml.etree import ElementTree as ET

from foliant.functions.sheets import BUILTIN_FORMATS
from foliant.sources.model import Parsed
from foliant.sources.zips import Members

#: Bytes that one member and all members of an archive may have unpacked.
MOST_MEMBER, MOST_TOTAL = 256 << 20, 1 << 30


#: Members up to so many bytes are parsed once for equal bytes: parts like styles and relationships are the same in many files.
MOST_SHARED = 8192


def _root(raw: bytes, name: str) -> ET.Element:
    if b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return ET.fromstring(raw)


@lru_cache(512)
def _shared_root(raw: bytes, name: str) -> ET.Element:
    """A parsed part; nothing changes its elements."""
    return _root(raw, name)


@lru_cache(512)
def _shared_relations(raw: bytes, name: str, folder: str) -> dict[str, tuple[str, str, bool]]:
    return _relations(_root(raw, name), folder)


def _relations(root: ET.Element | None, folder: str) -> dict[str, tuple[str, str, bool]]:
    out = {}
    for r in root if root is not None else []:
        external = r.get("TargetMode") == "External"
        target = r.get("Target", "")
        if not external:
            target = posixpath.normpath(posixpath.join(folder, target)) if not target.startswith("/") else target[1:]
        out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target, external)
    return out


class Archive:
    """Members of a ZIP file within a budget; missing or broken members are None."""

    def __init__(self, data: bytes):
        self.zip = Members(data)
        self.left = MOST_TOTAL

    def read(self, name: str) -> bytes | None:
        name = name.lstrip("/")
        size = self.zip.sizes.get(name)
        if size is None:
            return None
        if size > MOST_MEMBER or size > self.left:
            raise ValueError(f"{name} is too large")
        self.left -= size
        return self.zip.read(name)

    def xml(self, name: str, shared: bool = False) -> ET.Element | None:
        """``shared``: a part that many files have in common."""
        raw = self.read(name)
        if raw is None:
            return None
        return _shared_root(raw, name) if shared and len(raw) <= MOST_SHARED else _root(raw, name)

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id -> (type, target, external) of a part's relationships; internal targets are whole paths."""
        folder, base = posixpath.split(part)
        name = f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels"
        raw = self.read(name)
        if raw is None:
            return {}
        return _shared_relations(raw, name, folder) if len(raw) <= MOST_SHARED else _relations(_root(raw, name), folder)


def tag(e: ET.Element) -> str:
    t = e.tag
    return t[t.rfind("}") + 1 :] if isinstance(t, str) else ""


def attr(e: ET.Element, name: str) -> str | None:
    for k, v in e.attrib.items():
        if k == name or k[k.rfind("}") + 1 :] == name:
            return v
    return None


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if e is None:
            return None
        for c in e:
            if tag(c) == name:
                e = c
                break
        else:
            e = None
    return e


def core_properties(archive: Archive, out: Parsed) -> None:
    """Title, creator and the other core properties."""
    root = archive.xml("docProps/core.xml")
    for e in root if root is not None else []:
        if e.text and e.text.strip():
            out.metadata[{"creator": "author"}.get(tag(e), tag(e))] = e.text.strip()


# ------------------------------------------------------------------ word processing


def _run_text(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        t = x.tag
        name = t[t.rfind("}") + 1 :] if isinstance(t, str) else ""
        if name == "t":
            out.append(x.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


class _Styles:
    """Heading level of a style: its outline level, else its name, else that of the style it is based on."""

    def __init__(self, root: ET.Element | None):
        self.styles = {attr(s, "styleId"): s for s in (root if root is not None else []) if tag(s) == "style"}
        self.known: dict[str | None, int] = {}

    def level(self, style: str | None) -> int:
        if style not in self.known:
            self.known[style] = self._level(style)
        return self.known[style]

    def _level(self, style: str | None, depth: int = 0) -> int:
        s = self.styles.get(style)
        if s is None or depth > 10:
            m = re.fullmatch(r"[Hh]eading ?([1-9])", style or "")
            return min(int(m[1]), 6) if m else 0
        outline = child(s, "pPr", "outlineLvl")
        if outline is not None and (attr(outline, "val") or "").isdigit():
            n = int(attr(outline, "val")) + 1
            return n if n <= 6 else 0
        based = child(s, "basedOn")
        if based is not None and (n := self._level(attr(based, "val"), depth + 1)):
            return n
        m = re.fullmatch(r"heading ([1-9])", (attr(child(s, "name"), "val") or "").lower()) if child(s, "name") is not None else None
        return min(int(m[1]), 6) if m else 0


def _docx_table(e: ET.Element) -> list[list[str]]:
    rows = []
    for tr in (x for x in e if tag(x) == "tr"):
        row = []
        for tc in (x for x in tr if tag(x) == "tc"):
            merge = child(tc, "tcPr", "vMerge")
            go_on = merge is not None and attr(merge, "val") in (None, "continue")
            text = "\n".join(_run_text(p) for p in tc.iter() if tag(p) == "p")
            row.append("" if go_on else text)
            span = child(tc, "tcPr", "gridSpan")
            row += [""] * (int(attr(span, "val") or 1) - 1 if span is not None else 0)
        rows.append(row)
    return rows


def docx(data: bytes) -> Parsed:
    archive, out = Archive(data), Parsed()
    main = next((t for k, t, _ in archive.relations("").values() if k == "officeDocument"), "word/document.xml")
    root = archive.xml(main)
    if root is None:
        raise ValueError("parse error: no main document part")
    relations = archive.relations(main)
    styles = _Styles(archive.xml(next((t for k, t, _ in relations.values() if k == "styles"), "word/styles.xml"), shared=True))

    def walk(body: ET.Element) -> None:
        for e in body:
            name = tag(e)
            if name == "p":
                text = _run_text(e)
                style = child(e, "pPr", "pStyle")
                level = styles.level(attr(style, "val")) if style is not None else 0
                if text.strip():
                    if level:
                        out.add("heading", text, level=level)
                    elif child(e, "pPr", "numPr") is not None:
                        out.add("list_item", text)
                    else:
                        out.add("paragraph", text)
                for link in (x for x in e.iter() if tag(x) == "hyperlink"):
                    kind = relations.get(attr(link, "id") or "")
                    if kind and kind[2]:
                        out.add("link", _run_text(link), url=kind[1])
            elif name == "tbl":
                out.table(_docx_table(e))
            elif name in ("sdt", "sdtContent", "smartTag", "ins"):
                walk(e)

    body = child(root, "body")
    walk(body if body is not None else root)
    for kind, target, _ in relations.values():
        if kind in ("header", "footer", "footnotes", "endnotes"):
            part = archive.xml(target)
            for p in part.iter() if part is not None else []:
                if tag(p) == "p" and _run_text(p).strip():
                    out.add(kind.rstrip("s"), _run_text(p), depth=1)
    core_properties(archive, out)
    return out


# ------------------------------------------------------------------ sheets


def serial_iso(serial: float, epoch_1904: bool) -> str:
    """The date text of a serial number; the day 1900-02-29 exists in the files."""
    day, part = int(serial // 1), serial - serial // 1
    if serial < 0 or (not epoch_1904 and day < 1):
        return shown(serial)
    if epoch_1904:
        text = (date(1904, 1, 1) + timedelta(day)).isoformat()
    elif day == 60:
        text = "1900-02-29"
    else:
        text = (date(1899, 12, 31) + timedelta(day - (day > 60))).isoformat()
    if part > 1e-10:
        s = min(int(part * 86400 + 0.5), 86399)
        text += f"T{s // 3600:02}:{s % 3600 // 60:02}:{s % 60:02}"
    return text


def shown(x: float) -> str:
    if x == int(x) and abs(x) < 2**63:
        return str(int(x))
    text = repr(x)
    return f"{x:.340f}".rstrip("0") if "e-" in text else f"{x:f}" if "e" in text else text


def is_date_code(code: str) -> bool:
    bare = re.sub(r'"[^"]*"', "", re.sub(r"\[[^\]]*\]", "", code)).lower()
    return bool(re.search("yy|dd|hh|ss|mm|(?<![a-z])[dh](?![a-z])", bare))


def format_number(value: str, fmt: int | None, code: str | None, epoch_1904: bool) -> str:
    """The display text of a number under a format."""
    try:
        x = float(value)
    except ValueError:
        return value
    if fmt is not None:
        if 14 <= fmt <= 22 or 45 <= fmt <= 47 or (code and fmt >= 164 and is_date_code(code)):
            return serial_iso(x, epoch_1904)
        if fmt in (9, 10) or (code and "%" in code):
            places = 0 if fmt == 9 else 2 if fmt == 10 else len(re.sub("[^0#]", "", (code or "").split("%")[0].rpartition(".")[2])) if "." in (code or "").split("%")[0] else 0
            return f"{x * 100:.{places}f}%"
    return value if "." not in value else shown(x)


@lru_cache(20_000)
def column_of(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell_attributes(cell: ET.Element) -> tuple[str | None, str | None, str | None]:
    """Reference, type and style of a cell in one pass; of equal local names the first counts."""
    ref = kind = style = None
    for k, v in cell.attrib.items():
        k = k[k.rfind("}") + 1 :]
        if k == "r" and ref is None:
            ref = v
        elif k == "t" and kind is None:
            kind = v
        elif k == "s" and style is None:
            style = v
    return ref, kind, style


def xlsx(data: bytes) -> Parsed:
    archive, out = Archive(data), Parsed()
    main = next((t for k, t, _ in archive.relations("").values() if k == "officeDocument"), "xl/workbook.xml")
    book = archive.xml(main)
    if book is None:
        raise ValueError("parse error: no workbook part")
    relations = archive.relations(main)
    part = lambda kind, name: archive.xml(next((t for k, t, _ in relations.values() if k == kind), name), shared=True)
    strings_root = part("sharedStrings", "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in (strings_root if strings_root is not None else [])]
    style_root = part("styles", "xl/styles.xml")
    codes = {int(attr(n, "numFmtId")): attr(n, "formatCode") or "" for n in (style_root.iter() if style_root is not None else []) if tag(n) == "numFmt"}
    xfs = child(style_root, "cellXfs")
    formats = [int(attr(x, "numFmtId") or 0) for x in (xfs if xfs is not None else [])]
    props = child(book, "workbookPr")
    epoch = props is not None and attr(props, "date1904") in ("1", "true")
    sheets = child(book, "sheets")
    for page, sheet in enumerate(sheets if sheets is not None else []):
        kind = relations.get(attr(sheet, "id") or "")
        root = archive.xml(kind[1]) if kind else None
        grid: dict[int, dict[int, str]] = {}
        merges, hits = [], []
        for x in root.iter() if root is not None else []:
            t = x.tag
            if isinstance(t, str) and t.endswith(("mergeCell", "hyperlink")):
                if tag(x) == "mergeCell":
                    merges.append(attr(x, "ref") or "")
                elif tag(x) == "hyperlink":
                    hits.append(x)
        rows = child(root, "sheetData")
        for r, row in enumerate(rows if rows is not None else []):
            r = int(attr(row, "r") or r + 1) - 1
            for c, cell in enumerate(x for x in row if tag(x) == "c"):
                ref, t, xf = _cell_attributes(cell)
                c = column_of(ref) if ref else c
                value = ""
                for v in cell:
                    if tag(v) == "v":
                        value = v.text or ""
                        break
                if t == "s":
                    at = int(value) if value.isdigit() else -1
                    if not 0 <= at < len(strings):
                        out.warn("SharedString", f"shared string {value} is missing")
                    text = strings[at] if 0 <= at < len(strings) else ""
                elif t == "b":
                    text = "TRUE" if value in ("1", "true") else "FALSE"
                elif t == "inlineStr":
                    text = "".join(x.text or "" for x in cell.iter() if tag(x) == "t")
                elif t in ("str", "e") or not value:
                    text = value
                else:
                    style = int(xf or -1)
                    fmt = formats[style] if 0 <= style < len(formats) else None
                    text = format_number(value, fmt, codes.get(fmt, BUILTIN_FORMATS.get(fmt)), epoch)
                grid.setdefault(r, {})[c] = text
        for m in merges:
            a, _, b = m.partition(":")
            ra, rb = int(re.sub("[^0-9]", "", a) or 0) - 1, int(re.sub("[^0-9]", "", b) or 0) - 1
            for r in range(ra, min(rb, ra + 100_000) + 1):
                for c in [c for c in grid.get(r, {}) if column_of(a) <= c <= column_of(b) and (r, c) != (ra, column_of(a))]:
                    grid[r][c] = ""
        rows_out = [[grid[r].get(c, "") for c in range(max(max(g) for g in grid.values()) + 1)] for r in sorted(grid)] if grid else []
        while rows_out and not any(x.strip() for x in rows_out[-1]):
            rows_out.pop()
        out.add("heading", attr(sheet, "name") or f"Sheet{page + 1}", level=1, page=page)
        if rows_out:
            out.table(rows_out, page=page)
        for hit in hits:
            link = archive.relations(kind[1]).get(attr(hit, "id") or "") if kind else None
            if link and link[2]:
                out.add("link", attr(hit, "ref") or "", page=page, url=link[1])
    out.page_count = max(1, len(sheets) if sheets is not None else 0)
    core_properties(archive, out)
    return out


# ------------------------------------------------------------------ slides


def pptx(data: bytes) -> Parsed:
    archive, out = Archive(data), Parsed()
    main = next((t for k, t, _ in archive.relations("").values() if k == "officeDocument"), "ppt/presentation.xml")
    root = archive.xml(main)
    if root is None:
        raise ValueError("parse error: no presentation part")
    relations = archive.relations(main)
    ids = child(root, "sldIdLst")
    slides = [relations.get(s.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "")) for s in (ids if ids is not None else [])]

    def paragraphs(body: ET.Element, page: int, kind: str) -> None:
        for p in (x for x in body.iter() if tag(x) == "p"):
            text = "".join((x.text or "") if tag(x) == "t" else "\n" for x in p.iter() if tag(x) in ("t", "br"))
            if text.strip():
                out.add(kind, text, level=1 if kind == "heading" else None, page=page)

    for page, slide in enumerate(slides):
        tree = archive.xml(slide[1]) if slide else None
        for shape in (x for x in (tree.iter() if tree is not None else []) if tag(x) in ("sp", "tbl")):
            if tag(shape) == "tbl":
                rows = [["\n".join("".join(t.text or "" for t in p.iter() if tag(t) == "t") for p in tc.iter() if tag(p) == "p") for tc in tr if tag(tc) == "tc"] for tr in shape if tag(tr) == "tr"]
                out.table(rows, page=page)
                continue
            place = next((x for x in shape.iter() if tag(x) == "ph"), None)
            title = place is not None and attr(place, "type") in ("title", "ctrTitle")
            paragraphs(shape, page, "heading" if title else "paragraph")
        for kind, target, _ in archive.relations(slide[1]).values() if slide else []:
            if kind == "notesSlide" and (notes := archive.xml(target)) is not None:
                for shape in (x for x in notes.iter() if tag(x) == "sp"):
                    place = next((x for x in shape.iter() if tag(x) == "ph"), None)
                    if place is not None and attr(place, "type") == "body":
                        paragraphs(shape, page, "note")
    out.page_count = max(1, len(slides))
    core_properties(archive, out)
    return out
