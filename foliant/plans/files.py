"""Files of each format written from rows, as inputs for the scan queries.

Each writer takes the lines of a document (or the rows of an order) and returns the bytes of
one file, with the same content rules for all formats: a line of up to three words is a
heading of level ``ord % 3 + 1``, every seventh other line is a list item, every eleventh
line is a link, and every fifth line is a row of a table at the end.
"""

from __future__ import annotations

import struct
import zlib
from datetime import date
from functools import lru_cache
from xml.sax.saxutils import escape

SLIDE_LINES = 8
PAGE_LINES = 40
LINK = "http://example.org/a"
HEADER = ["status", "quantity", "discount", "shipped"]
_REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/{}/2006/main"


def is_heading(line: str) -> bool:
    return line.count(" ") < 3


def table_rows(lines: list[str]) -> list[list[str]]:
    return [[str(i), x] for i, x in enumerate(lines) if i % 5 == 0]


def _deflated(body: bytes) -> tuple[int, bytes]:
    z = zlib.compressobj(-1, zlib.DEFLATED, -15)
    return zlib.crc32(body), z.compress(body) + z.flush()


#: Parts that are the same in many files are packed once.
_deflated_once = lru_cache(256)(_deflated)


def _zip(parts: dict[str, str]) -> bytes:
    """The bytes that ``zipfile`` writes for these members, without its objects for each of them."""
    out, index, at = [], [], 0
    for name, text in parts.items():
        label, body = name.encode(), text.encode()
        crc, packed = (_deflated_once if len(body) <= 1024 else _deflated)(body)
        sizes = struct.pack("<LLLHH", crc, len(packed), len(body), len(label), 0)
        head = b"PK\x03\x04" + struct.pack("<5H", 20, 0, 8, 0, 33) + sizes + label
        out += [head, packed]
        index.append(b"PK\x01\x02" + struct.pack("<6H", 0x0314, 20, 0, 8, 0, 33) + sizes + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + label)
        at += len(head) + len(packed)
    central = b"".join(index)
    return b"".join([*out, central, struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(index), len(index), len(central), at, 0)])


def _rels(*links: tuple[str, str, str], external: tuple[str, str] | None = None) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in links)
    if external:
        body += f'<Relationship Id="{external[0]}" Type="{_OFFICE}/hyperlink" Target="{external[1]}" TargetMode="External"/>'
    return f'<Relationships xmlns="{_REL_NS}">{body}</Relationships>'


def _core(title: str) -> str:
    return f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>{escape(title)}</dc:title></cp:coreProperties>'


def docx(lines: list[str], title: str) -> bytes:
    w = f'xmlns:w="{_MAIN.format("wordprocessingml")}" xmlns:r="{_OFFICE}"'

    def run(text: str) -> str:
        head, space, rest = text.partition(" ")
        return f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{escape(head + space)}</w:t></w:r><w:r><w:t xml:space="preserve">{escape(rest)}</w:t></w:r>'

    body = []
    for i, x in enumerate(lines):
        props = f'<w:pPr><w:pStyle w:val="H{i % 3 + 1}"/></w:pPr>' if is_heading(x) else '<w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr>' if i % 7 == 0 else ""
        inner = f'<w:hyperlink r:id="link">{run(x)}</w:hyperlink>' if i % 11 == 3 else run(x)
        body.append(f"<w:p>{props}{inner}</w:p>")
    cell = lambda x, more="": f"<w:tc>{more}<w:p>{run(x)}</w:p></w:tc>"
    if rows := table_rows(lines):
        body.append("<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in rows) + f'<w:tr>{cell("end", "<w:tcPr><w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/></w:tcPr>")}</w:tr></w:tbl>')
    outline = lambda n: f'<w:pPr><w:outlineLvl w:val="{n}"/></w:pPr>'
    style = lambda i, more: f'<w:style w:styleId="{i}">{more}</w:style>'
    styles = style("H1", outline(0)) + style("H2", '<w:name w:val="heading 2"/>') + style("Base", '<w:name w:val="heading 3"/>') + style("H3", '<w:name w:val="own"/><w:basedOn w:val="Base"/>')
    return _zip(
        {
            "[Content_Types].xml": '<Types xmlns="t"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
            "_rels/.rels": _rels(("r", "officeDocument", "word/document.xml")),
            "word/_rels/document.xml.rels": _rels(("s", "styles", "styles.xml"), ("h", "header", "header1.xml"), external=("link", LINK)),
            "word/document.xml": f"<w:document {w}><w:body>{''.join(body)}</w:body></w:document>",
            "word/styles.xml": f"<w:styles {w}>{styles}</w:styles>",
            "word/header1.xml": f"<w:hdr {w}><w:p>{run(title)}</w:p></w:hdr>",
            "docProps/core.xml": _core(title),
        }
    )


def _odf(kind: str, body: str, title: str) -> bytes:
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:draw="d" xmlns:xlink="x"'
    return _zip(
        {
            "mimetype": f"application/vnd.oasis.opendocument.{kind}",
            "content.xml": f"<office:document-content {ns}><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>",
            "meta.xml": f'<office:document-meta xmlns:office="o" xmlns:dc="d"><office:meta><dc:title>{escape(title)}</dc:title></office:meta></office:document-meta>',
        }
    )


def _odf_table(rows: list[list[str]]) -> str:
    cell = lambda x: f"<table:table-cell><text:p>{escape(x)}</text:p></table:table-cell>"
    return '<table:table table:name="T">' + "".join(f"<table:table-row>{''.join(map(cell, r))}</table:table-row>" for r in rows) + "</table:table>"


def odt(lines: list[str], title: str) -> bytes:
    body = []
    for i, x in enumerate(lines):
        inner = f'<text:a xlink:href="{LINK}">{escape(x)}</text:a>' if i % 11 == 3 else f"<text:span>{escape(x[:3])}</text:span>{escape(x[3:])}"
        if is_heading(x):
            body.append(f'<text:h text:outline-level="{i % 3 + 1}">{inner}</text:h>')
        elif i % 7 == 0:
            body.append(f"<text:list><text:list-item><text:p>{inner}</text:p></text:list-item></text:list>")
        else:
            body.append(f"<text:p>{inner}</text:p>")
    rows = table_rows(lines)
    return _odf("text", "".join(body) + (_odf_table(rows) if rows else ""), title)


def odp(lines: list[str], title: str) -> bytes:
    pages = []
    for at in range(0, len(lines), SLIDE_LINES):
        part = "".join(f"<text:h>{escape(x)}</text:h>" if is_heading(x) else f"<text:p>{escape(x)}</text:p>" for x in lines[at : at + SLIDE_LINES])
        last = _odf_table(table_rows(lines)) if at + SLIDE_LINES >= len(lines) else ""
        pages.append(f"<draw:page><draw:frame><draw:text-box>{part}</draw:text-box></draw:frame>{last}</draw:page>")
    return _odf("presentation", "".join(pages), title)


def pptx(lines: list[str], title: str) -> bytes:
    ns = f'xmlns:p="{_MAIN.format("presentationml")}" xmlns:a="{_MAIN.format("drawingml")}" xmlns:r="{_OFFICE}"'
    text = lambda x: f"<p:txBody><a:p><a:r><a:t>{escape(x[:5])}</a:t></a:r><a:r><a:t>{escape(x[5:])}</a:t></a:r></a:p></p:txBody>"
    shape = lambda x, place: f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr>{text(x)}</p:sp>"
    starts = range(0, len(lines), SLIDE_LINES)
    parts = {
        "[Content_Types].xml": '<Types xmlns="t"><Override PartName="/ppt/presentation.xml" ContentType="application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"/></Types>',
        "_rels/.rels": _rels(("r", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="s{k}"/>' for k in range(len(starts))) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _rels(*[(f"s{k}", "slide", f"slides/slide{k}.xml") for k in range(len(starts))]),
        "docProps/core.xml": _core(title),
    }
    for k, at in enumerate(starts):
        shapes = "".join(shape(x, '<p:ph type="title"/>' if is_heading(x) else "") for x in lines[at : at + SLIDE_LINES])
        if at + SLIDE_LINES >= len(lines):
            cell = lambda x: f"<a:tc><a:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></a:txBody></a:tc>"
            shapes += "<p:graphicFrame><a:tbl>" + "".join(f"<a:tr>{cell(a)}{cell(b)}</a:tr>" for a, b in table_rows(lines)) + "</a:tbl></p:graphicFrame>"
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = _rels(("n", "notesSlide", f"../notesSlides/n{k}.xml"))
        note = shape(f"note {k}", '<p:ph type="body"/>')
        parts[f"ppt/notesSlides/n{k}.xml"] = f"<p:notes {ns}><p:cSld><p:spTree>{note}</p:spTree></p:cSld></p:notes>"
    return _zip(parts)


def rtf(lines: list[str], title: str) -> bytes:
    def text(x: str) -> str:
        units = struct.unpack(f"<{len(x.encode('utf-16-le')) // 2}h", x.encode("utf-16-le"))
        return "".join(f"\\u{u}?" if not 0 <= u < 128 else "\\" + chr(u) if chr(u) in "\\{}" else chr(u) for u in units)

    body = "".join((f"\\pard\\outlinelevel{i % 3} " if is_heading(x) else "\\pard ") + text(x) + "\\par\n" for i, x in enumerate(lines))
    rows = "".join("\\trowd " + "".join(f"\\intbl {text(c)}\\cell " for c in r) + "\\row\n" for r in table_rows(lines))
    head = "{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0\\fcharset0 Arial;}}{\\info{\\title " + text(title) + "}}"
    return (head + body + "\\pard " + rows + "}").encode("ascii")


def pdf(lines: list[str], title: str) -> bytes:
    """ASCII lines, PAGE_LINES on a page; content streams take turns in their filters."""
    starts = range(0, max(1, len(lines)), PAGE_LINES)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(starts))), len(starts)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for k, at in enumerate(starts):
        shown = [x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for x in lines[at : at + PAGE_LINES]]
        raw = ("BT /F1 10 Tf 14 TL 40 740 Td " + " ".join(f"({x}) Tj T*" for x in shown) + " ET").encode("latin-1")
        name, data = [(b"/Filter /FlateDecode ", zlib.compress(raw)), (b"/Filter /ASCIIHexDecode ", raw.hex().encode() + b">"), (b"", raw)][k % 3]
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k))
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), name, data))
    info = len(objects) + 1
    objects.append(b"<< /Title (%s) >>" % title.encode("latin-1"))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, o)
    xref = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"trailer\n<< /Root 1 0 R /Info %d 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF" % (info, len(objects) + 1, xref)


def cfb(streams: dict[str, bytes]) -> bytes:
    """A compound file whose streams take whole sectors of 512 bytes, 4,096 bytes at least."""
    sector, end, free = 512, 0xFFFFFFFE, 0xFFFFFFFF
    body, chains, entries = bytearray(), [], [("Root Entry", 5, end, 0)]

    def place(data: bytes) -> int:
        first, n = len(body) // sector, -(-len(data) // sector)
        body.extend(data.ljust(n * sector, b"\0"))
        chains.extend([*range(first + 1, first + n), end])
        return first

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append((name, 2, place(data), len(data)))
    names = b""
    for name, kind, first, n in entries:
        raw = (name + "\0").encode("utf-16-le")
        names += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, n)
    directory = place(names)
    n_fat = 1
    while n_fat * 128 < len(chains) + n_fat:
        n_fat += 1
    at = len(body) // sector
    table = chains + [0xFFFFFFFD] * n_fat
    fat = struct.pack(f"<{len(table)}I", *table).ljust(n_fat * sector, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<9I", 0, n_fat, directory, 0, 4096, end, 0, end, 0)
    return head + struct.pack("<109I", *range(at, at + n_fat), *[free] * (109 - n_fat)) + bytes(body) + fat


def doc(lines: list[str], title: str) -> bytes:
    """Two pieces: the paragraphs in one byte a character where they fit, and the table in two."""
    first = "".join(f"{x}\r" for x in lines)
    second = "".join("".join(f"{c}\x07" for c in r) + "\x07" for r in table_rows(lines)) + "\r"
    word = bytearray(2048)
    try:
        raw, flag = first.encode("cp1252"), 0x40000000
    except UnicodeEncodeError:
        raw, flag = first.encode("utf-16-le"), 0
    units = lambda s: len(s.encode("utf-16-le")) // 2
    raw += b"\0" * (len(raw) % 2)
    a, b = units(first), units(second)
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 10, 0x0200)
    struct.pack_into("<I", word, 0x4C, a + b)
    plc = struct.pack("<III", 0, a, a + b) + struct.pack("<HIH", 0, 2048 * 2 | flag if flag else 2048, 0) + struct.pack("<HIH", 0, 2048 + len(raw), 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    return cfb({"WordDocument": bytes(word) + raw + second.encode("utf-16-le"), "1Table": clx})


def ppt(lines: list[str], title: str) -> bytes:
    atom = lambda kind, body, version=0: struct.pack("<HHI", version, kind, len(body)) + body

    def text(x: str) -> bytes:
        return atom(3999, struct.pack("<I", 0 if is_heading(x) else 1)) + (atom(4008, x.encode()) if x.isascii() else atom(4000, x.encode("utf-16-le")))

    slides = b"".join(atom(1011, b"\0" * 20) + b"".join(map(text, lines[at : at + SLIDE_LINES])) for at in range(0, len(lines), SLIDE_LINES))
    return cfb({"PowerPoint Document": atom(1000, atom(4080, slides, 15), 15)})


# ---------------------------------------------------------------- sheets: rows are (status, quantity, percent, day)


def _serial(day: date) -> int:
    return (day - date(1899, 12, 30)).days


def xlsx(rows: list[tuple[str, int, int, date]], name: str) -> bytes:
    """Shared and inline strings, numbers, percents and dates by style, a formula with its value, and a merged pair."""
    ns = f'xmlns="{_MAIN.format("spreadsheetml")}" xmlns:r="{_OFFICE}"'
    strings = [*HEADER, *sorted({r[0] for r in rows})]
    shared = lambda ref, x: f'<c r="{ref}" t="s"><v>{strings.index(x)}</v></c>'
    data = '<row r="1">' + "".join(shared(f"{c}1", x) for c, x in zip("ABCD", HEADER, strict=True)) + "</row>"
    for i, (status, quantity, percent, day) in enumerate(rows, 2):
        data += f'<row r="{i}">{shared(f"A{i}", status)}<c r="B{i}"><v>{quantity}.0</v></c><c r="C{i}" s="1"><v>{percent / 100}</v></c><c r="D{i}" s="2"><v>{_serial(day)}</v></c></row>'
    n = len(rows) + 2
    data += f'<row r="{n}"><c r="A{n}" t="inlineStr"><is><t>total</t></is></c><c r="B{n}"><f>SUM(B2:B{n - 1})</f><v>{sum(r[1] for r in rows)}</v></c><c r="C{n}" t="b"><v>1</v></c><c r="D{n}" t="inlineStr"><is><t>covered</t></is></c></row>'
    sheet = f'<worksheet {ns}><sheetData>{data}</sheetData><mergeCells><mergeCell ref="C{n}:D{n}"/></mergeCells></worksheet>'
    return _zip(
        {
            "[Content_Types].xml": '<Types xmlns="t"><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
            "_rels/.rels": _rels(("r", "officeDocument", "xl/workbook.xml")),
            "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "styles", "styles.xml"), ("r3", "sharedStrings", "sharedStrings.xml")),
            "xl/worksheets/sheet1.xml": sheet,
            "xl/sharedStrings.xml": f"<sst {ns}>" + "".join(f"<si><r><t>{escape(x[:1])}</t></r><r><t>{escape(x[1:])}</t></r></si>" for x in strings) + "</sst>",
            "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        }
    )


def ods(rows: list[tuple[str, int, int, date]], name: str) -> bytes:
    text = lambda x: f"<table:table-cell><text:p>{escape(x)}</text:p></table:table-cell>"
    body = f"<table:table-header-rows><table:table-row>{''.join(map(text, HEADER))}</table:table-row></table:table-header-rows>"
    for status, quantity, percent, day in rows:
        body += f'<table:table-row>{text(status)}<table:table-cell office:value-type="float" office:value="{quantity}"/>{text(f"{percent}%")}<table:table-cell office:value-type="date" office:date-value="{day.isoformat()}"/></table:table-row>'
    body += '<table:table-row table:number-rows-repeated="1000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row>'
    return _odf("spreadsheet", f'<table:table table:name="{escape(name)}">{body}</table:table>', name)


def xls(rows: list[tuple[str, int, int, date]], name: str) -> bytes:
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    strings = [*HEADER, *sorted({r[0] for r in rows})]
    uses = 4 + len(rows)
    sst = struct.pack("<II", uses, len(strings)) + b"".join(struct.pack("<HB", len(s), 0) + s.encode("latin-1") for s in strings)
    xf = lambda fmt: record(0xE0, struct.pack("<HH", 0, fmt) + b"\0" * 16)
    label = lambda r, c, s: record(0xFD, struct.pack("<HHHI", r, c, 0, strings.index(s)))
    cells = b"".join(label(0, c, x) for c, x in enumerate(HEADER))
    for i, (status, quantity, percent, day) in enumerate(rows, 1):
        cells += label(i, 0, status) + record(0x27E, struct.pack("<HHHI", i, 1, 0, quantity << 2 | 2))
        cells += record(0x27E, struct.pack("<HHHI", i, 2, 1, (percent << 2 | 3) & 0xFFFFFFFF)) + record(0x203, struct.pack("<HHHd", i, 3, 2, float(_serial(day))))
    bof, eof, raw = record(0x809, b"\0" * 16), record(0x0A, b""), name.encode("latin-1")
    rest = xf(0) + xf(9) + xf(14) + record(0xFC, sst) + eof
    start = len(bof) + 4 + 8 + len(raw) + len(rest)
    book = bof + record(0x85, struct.pack("<IBBBB", start, 0, 0, len(raw), 0) + raw) + rest
    return cfb({"Workbook": book + bof + cells + eof})


DOCUMENTS = {"DOCX": docx, "ODT": odt, "RTF": rtf, "DOC": doc, "PPTX": pptx, "ODP": odp, "PPT": ppt, "PDF": pdf}
SHEETS = {"XLSX": xlsx, "ODS": ods, "XLS": xls}
