"""Small files of each format, built in memory: a heading, a paragraph and a table with the same words."""

import io
import struct
import zipfile
import zlib

HEADING, PARAGRAPH = "Test Document", "Alice and Bob work at Acme Corp in London."
ROWS = [["Name", "Age", "City"], ["Alice", "28", "London"], ["Bob", "35", "Paris"]]
TOKENS = ["Test", "Document", "Alice", "Bob", "Acme", "London", "Paris", "28"]

_REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _types(kind: str) -> str:
    return f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/m.xml" ContentType="application/vnd.openxmlformats-officedocument.{kind}.main+xml"/></Types>'


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cells = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in ROWS)
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>{HEADING}</w:t></w:r></w:p><w:p><w:r><w:t>{PARAGRAPH}</w:t></w:r></w:p><w:tbl>{cells}</w:tbl></w:body></w:document>'
    styles = f'<w:styles {w}><w:style w:styleId="Base"><w:name w:val="heading 2"/></w:style><w:style w:styleId="H"><w:name w:val="mine"/><w:basedOn w:val="Base"/></w:style></w:styles>'
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>Cross-Format Test Title</dc:title><dc:creator>Test Author</dc:creator></cp:coreProperties>'
    return _zip({"[Content_Types].xml": _types("wordprocessingml.document"), "_rels/.rels": _REL.format(f'<Relationship Id="r" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/>'), "word/document.xml": body, "word/styles.xml": styles, "docProps/core.xml": core})


def xlsx() -> bytes:
    def cell(r: int, c: int, text: str) -> str:
        ref = f"{'ABC'[c]}{r + 1}"
        if text.isdigit():
            return f'<c r="{ref}" s="1"><v>{int(text)}.0</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'

    rows = [[HEADING, "", ""], [PARAGRAPH, "", ""], *ROWS]
    data = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, x) for c, x in enumerate(row) if x) + "</row>" for r, row in enumerate(rows))
    extra = '<row r="6"><c r="A6" s="2"><v>45366</v></c><c r="B6" s="3"><v>0.12</v></c><c r="C6" t="b"><v>1</v></c></row>'
    ns = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_OFFICE}"'
    styles = f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs></styleSheet>'
    return _zip(
        {
            "[Content_Types].xml": _types("spreadsheetml.sheet"),
            "_rels/.rels": _REL.format(f'<Relationship Id="r" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>'),
            "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _REL.format(f'<Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/>'),
            "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{data}{extra}</sheetData></worksheet>",
            "xl/styles.xml": styles,
        }
    )


def pptx() -> bytes:
    ns = f'xmlns:p="http://p" xmlns:a="http://a" xmlns:r="{_OFFICE}"'
    cells = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in ROWS)
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld {ns}><p:cSld><p:spTree>{shape("<p:ph type=" + chr(34) + "title" + chr(34) + "/>", HEADING)}{shape("", PARAGRAPH)}<p:graphicFrame><a:tbl>{cells}</a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>'
    return _zip(
        {
            "[Content_Types].xml": _types("presentationml.presentation"),
            "_rels/.rels": _REL.format(f'<Relationship Id="r" Type="{_OFFICE}/officeDocument" Target="ppt/presentation.xml"/>'),
            "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": _REL.format(f'<Relationship Id="rId1" Type="{_OFFICE}/slide" Target="slides/slide1.xml"/>'),
            "ppt/slides/slide1.xml": slide,
        }
    )


def _odf(kind: str, body: str) -> bytes:
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:draw="d"'
    mime = {"text": "text", "spreadsheet": "spreadsheet", "presentation": "presentation"}[kind]
    return _zip({"mimetype": f"application/vnd.oasis.opendocument.{mime}", "content.xml": f"<office:document-content {ns}><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>"})


def _odf_table() -> str:
    return '<table:table table:name="T">' + "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{c}</text:p></table:table-cell>" for c in r) + "</table:table-row>" for r in ROWS) + "</table:table>"


def odt() -> bytes:
    return _odf("text", f'<text:h text:outline-level="1">{HEADING}</text:h><text:p>{PARAGRAPH}</text:p>{_odf_table()}')


def ods() -> bytes:
    rows = "".join(f"<table:table-row><table:table-cell><text:p>{x}</text:p></table:table-cell></table:table-row>" for x in (HEADING, PARAGRAPH))
    return _odf("spreadsheet", _odf_table().replace('<table:table table:name="T">', f'<table:table table:name="T">{rows}'))


def odp() -> bytes:
    return _odf("presentation", f"<draw:page><draw:frame><draw:text-box><text:h>{HEADING}</text:h><text:p>{PARAGRAPH}</text:p></draw:text-box></draw:frame>{_odf_table()}</draw:page>")


def rtf() -> bytes:
    rows = "".join("\\trowd " + "".join(f"\\intbl {c}\\cell " for c in r) + "\\row\n" for r in ROWS)
    return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0\\fcharset0 Arial;}}{\\info{\\title T}{\\author A}}\\pard\\outlinelevel0 " + HEADING + "\\par\\pard " + PARAGRAPH + " caf\\'e9 \\u8364?\\par\n" + rows + "}").encode("latin-1")


def markdown() -> bytes:
    table = "\n".join("| " + " | ".join(r) + " |" for r in [ROWS[0], ["---"] * 3, *ROWS[1:]])
    return f"# {HEADING}\n\n**Alice** and Bob work at [Acme Corp](http://a.b) in London.\n\n{table}\n\n- one\n- two\n\n```py\nx = 1\n```\n\n---\n> quoted\n".encode()


def pdf(compress: bool = True) -> bytes:
    lines = [HEADING, PARAGRAPH, *(" ".join(r) for r in ROWS)]
    content = "BT /F1 12 Tf 14 TL 72 720 Td " + " ".join(f"({x}) Tj T*" for x in lines) + " ET"
    raw = zlib.compress(content.encode()) if compress else content.encode()
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d %s>>\nstream\n" % (len(raw), b"/Filter /FlateDecode " if compress else b"") + raw + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return out + b"trailer\n<< /Root 1 0 R /Size 6 >>\n%%EOF"


def cfb(streams: dict[str, bytes]) -> bytes:
    """A compound file with the streams in whole sectors (each at least 4,096 bytes long)."""
    size, body, fat, entries = 512, b"", [], []
    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        n, first = -(-len(data) // size), len(body) // size
        body += data.ljust(n * size, b"\0")
        fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        entries.append((name, 2, first, len(data)))
    directory = b""
    for name, kind, first, n in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        raw = (name + "\0").encode("utf-16-le")
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, n)
    dir_at, n_dir = len(body) // size, -(-len(directory) // size)
    body += directory.ljust(n_dir * size, b"\0")
    fat += [*range(dir_at + 1, dir_at + n_dir), 0xFFFFFFFE]
    n_fat = -(-(len(fat) + 1) // 128) if (len(fat) + 1) % 128 else (len(fat) + 1) // 128
    fat_at = len(body) // size
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * size, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, n_fat, dir_at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *[fat_at + i for i in range(n_fat)], *[0xFFFFFFFF] * (109 - n_fat)) + body + table


def xls() -> bytes:
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    strings = [HEADING, PARAGRAPH, *(c for r in ROWS for c in r if not c.isdigit())]
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s), 0) + s.encode("latin-1") for s in strings)
    cells = b""
    for r, row in enumerate([[HEADING], [PARAGRAPH], *ROWS]):
        for c, text in enumerate(row):
            if text.isdigit():
                cells += record(0x27E, struct.pack("<HHHI", r, c, 0, int(text) << 2 | 2))
            else:
                cells += record(0xFD, struct.pack("<HHHI", r, c, 0, strings.index(text)))
    bof, eof = record(0x809, b"\0" * 16), record(0x0A, b"")
    name = b"One"
    start = len(bof) + 4 + 8 + len(name) + len(record(0xFC, sst)) + len(eof)
    book = bof + record(0x85, struct.pack("<IBBBB", start, 0, 0, len(name), 0) + name) + record(0xFC, sst) + eof
    return cfb({"Workbook": book + bof + cells + eof})


def doc() -> bytes:
    text = f"{HEADING}\r{PARAGRAPH}\r" + "".join("".join(f"{c}\x07" for c in r) + "\x07" for r in ROWS) + "\r"
    word = bytearray(2048)
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 10, 0x0200)
    struct.pack_into("<I", word, 0x4C, len(text))
    plc = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 2048 * 2 | 0x40000000, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    return cfb({"WordDocument": bytes(word) + text.encode("cp1252"), "1Table": clx})


def ppt() -> bytes:
    atom = lambda kind, body, version=0: struct.pack("<HHI", version, kind, len(body)) + body
    text = lambda kind, s: atom(3999, struct.pack("<I", kind)) + atom(4000, s.encode("utf-16-le"))
    slide = atom(1011, b"\0" * 20) + text(0, HEADING) + text(1, PARAGRAPH + "\r" + "\r".join(" ".join(r) for r in ROWS))
    return cfb({"PowerPoint Document": atom(1000, atom(4080, slide, 15), 15)})


ALL = {"PDF": pdf, "DOCX": docx, "XLSX": xlsx, "PPTX": pptx, "DOC": doc, "XLS": xls, "PPT": ppt, "ODT": odt, "ODS": ods, "ODP": odp, "RTF": rtf, "MD": markdown}
