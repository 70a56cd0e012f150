"""DOC, XLS and PPT bytes to blocks: piece tables, BIFF8 records, slide text records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from foliant.functions.sheets import BUILTIN_FORMATS
from foliant.sources.cfb import CompoundFile
from foliant.sources.model import Parsed
from foliant.sources.ooxml import format_number, shown


_RECORD = struct.Struct("<HH")


def doc(data: bytes) -> Parsed:
    """Text by the piece table; field codes go, cell marks make tables."""
    cfb, out = CompoundFile(data), Parsed()
    word = cfb.read("WordDocument")
    if len(word) < 0x1AA or struct.unpack_from("<H", word)[0] != 0xA5EC:
        raise ValueError("parse error: no word document header")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x0100:
        out.is_encrypted = True
        raise ValueError("document is encrypted")
    table = cfb.read("1Table" if flags & 0x0200 else "0Table")
    n_text = struct.unpack_from("<I", word, 0x4C)[0]
    at, size = struct.unpack_from("<II", word, 0x1A2)
    clx, text, pos = table[at : at + size], [], 0
    while pos + 5 <= len(clx) and clx[pos] == 1:  # property runs stand before the pieces
        pos += 3 + struct.unpack_from("<H", clx, pos + 1)[0]
    if pos + 5 > len(clx) or clx[pos] != 2:
        raise ValueError("parse error: no piece table")
    plc = clx[pos + 5 : pos + 5 + struct.unpack_from("<I", clx, pos + 1)[0]]
    n = (len(plc) - 4) // 12
    starts = struct.unpack_from(f"<{n + 1}I", plc)
    for i in range(n):
        fc = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0]
        chars = max(0, min(starts[i + 1], n_text) - starts[i])
        if fc & 0x40000000:
            a = (fc & 0x3FFFFFFF) // 2
            text.append(word[a : a + chars].decode("cp1252", "replace"))
        else:
            text.append(word[fc : fc + 2 * chars].decode("utf-16-le", "replace"))
    whole = re.sub("\x13[^\x13\x14\x15]*\x14([^\x13\x15]*)\x15", r"\1", "".join(text))
    whole = re.sub("\x13[^\x15]*\x15", "", whole)
    # cells end in \x07; an empty cell after the last of a row ends the row
    out_rows: list[list[str]] = []
    for para in re.split("[\r\x0c]", whole):
        cells = para.split("\x07")
        if len(cells) > 1:
            line: list[str] = []
            for c in cells[:-1]:
                if c == "" and line:
                    out_rows.append(line)
                    line = []
                else:
                    line.append(c)
            if line:
                out_rows.append(line)
            para = cells[-1]
        if para.strip("\x00\x01\x02\x08 "):
            if out_rows:
                width = max(map(len, out_rows))
                out.table([r + [""] * (width - len(r)) for r in out_rows])
                out_rows = []
            out.add("paragraph", para.replace("\x0b", "\n").strip("\x00\x01\x02\x08"))
    if out_rows:
        width = max(map(len, out_rows))
        out.table([r + [""] * (width - len(r)) for r in out_rows])
    return out


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes, list[int]]]:
    """BIFF records from a place on, with their CONTINUE parts joined, and where each part began; read as far as they are asked for."""
    held: tuple[int, bytes, list[int]] | None = None
    while at + 4 <= len(stream):
        kind, n = _RECORD.unpack_from(stream, at)
        body = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0x3C and held is not None:
            parts, cuts = [held[1], body], [*held[2], len(held[1])]
            while at + 4 <= len(stream):
                kind, n = _RECORD.unpack_from(stream, at)
                if kind != 0x3C:
                    break
                cuts.append(sum(map(len, parts)))
                parts.append(stream[at + 4 : at + 4 + n])
                at += 4 + n
            held = (held[0], b"".join(parts), cuts)
            continue
        if held is not None:
            yield held
        held = (kind, body, [])
    if held is not None:
        yield held


def shared_strings(body: bytes, cuts: list[int]) -> list[str]:
    """The shared string table; characters go on with a new width flag after each cut."""
    n, at, out, marks = struct.unpack_from("<I", body, 4)[0], 8, [], set(cuts)
    while len(out) < n and at + 3 <= len(body):
        chars, flag = struct.unpack_from("<HB", body, at)
        at += 3
        runs = struct.unpack_from("<H", body, at)[0] if flag & 8 else 0
        at += 2 if flag & 8 else 0
        extra = struct.unpack_from("<I", body, at)[0] if flag & 4 else 0
        at += 4 if flag & 4 else 0
        text, wide = [], flag & 1
        while chars > 0 and at < len(body):
            if at in marks and text:
                wide = body[at] & 1
                at += 1
            stop = min((c for c in marks if c > at), default=len(body))
            k = min(chars, max(1, (stop - at) // (2 if wide else 1)))
            piece = body[at : at + k * (2 if wide else 1)]
            text.append(piece.decode("utf-16-le" if wide else "latin-1", "replace"))
            at += len(piece)
            chars -= k
        at += 4 * runs + extra
        out.append("".join(text))
    return out


def rk_number(raw: int) -> float:
    """A packed number: an integer or the upper bits of a double, perhaps times a hundred."""
    x = float((raw - (1 << 32) if raw & 0x80000000 else raw) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return x / 100 if raw & 1 else x


def xls(data: bytes) -> Parsed:
    cfb, out = CompoundFile(data), Parsed()
    stream = cfb.read("Workbook" if "Workbook" in cfb.entries else "Book")
    strings: list[str] = []
    sheets: list[tuple[int, str]] = []
    codes: dict[int, str] = {}
    xfs: list[int] = []
    epoch = False
    for kind, body, cuts in records(stream):
        if kind == 0x2F:
            out.is_encrypted = True
            raise ValueError("workbook is encrypted")
        if kind == 0x85 and len(body) > 8:
            n, wide = body[6], body[7] & 1
            sheets.append((struct.unpack_from("<I", body)[0], body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")))
        elif kind == 0xFC:
            strings = shared_strings(body, cuts)
        elif kind == 0x22:
            epoch = body[:2] == b"\x01\x00"
        elif kind == 0xE0:
            xfs.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x41E:
            fmt, n, wide = struct.unpack_from("<HHB", body)
            codes[fmt] = body[5 : 5 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
        elif kind == 0x0A:
            break

    def number(x: float, xf: int) -> str:
        fmt = xfs[xf] if xf < len(xfs) else None
        return format_number(shown(x), fmt, codes.get(fmt, BUILTIN_FORMATS.get(fmt)), epoch)

    for page, (offset, name) in enumerate(sheets):
        grid: dict[int, dict[int, str]] = {}
        pending = None
        for kind, body, _ in records(stream, offset):
            if kind == 0x0A:
                break
            if kind == 0x207 and pending:
                n, wide = struct.unpack_from("<HB", body)
                grid.setdefault(pending[0], {})[pending[1]] = body[3 : 3 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
                continue
            if len(body) < 6 or kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x204):
                continue
            r, c, xf = struct.unpack_from("<HHH", body)
            cells = grid.setdefault(r, {})
            if kind == 0xFD:
                i = struct.unpack_from("<I", body, 6)[0]
                cells[c] = strings[i] if i < len(strings) else ""
            elif kind == 0x203:
                cells[c] = number(struct.unpack_from("<d", body, 6)[0], xf)
            elif kind == 0x27E:
                cells[c] = number(rk_number(struct.unpack_from("<I", body, 6)[0]), xf)
            elif kind == 0xBD:
                for i in range((len(body) - 6) // 6):
                    xf, raw = struct.unpack_from("<HI", body, 4 + 6 * i)
                    cells[c + i] = number(rk_number(raw), xf)
            elif kind == 0x205:
                cells[c] = ("TRUE" if body[6] else "FALSE") if not body[7] else {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}.get(body[6], "#ERR!")
            elif kind == 0x204:
                n, wide = struct.unpack_from("<HB", body, 6)
                cells[c] = body[9 : 9 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            elif body[12:14] != b"\xff\xff":
                cells[c] = number(struct.unpack_from("<d", body, 6)[0], xf)
            elif body[6] == 0:
                pending = (r, c)
            elif body[6] == 1:
                cells[c] = "TRUE" if body[8] else "FALSE"
        out.add("heading", name, level=1, page=page)
        if grid:
            width = max((max(g) for g in grid.values() if g), default=-1) + 1
            out.table([[grid[r].get(c, "") for c in range(width)] for r in sorted(grid)], page=page)
    out.page_count = max(1, len(sheets))
    return out


def ppt(data: bytes) -> Parsed:
    """Text atoms of the document stream in order; titles become headings, slides pages."""
    cfb, out = CompoundFile(data), Parsed()
    stream = cfb.read("PowerPoint Document")
    page, kind = -1, 4

    def walk(at: int, end: int, depth: int) -> None:
        nonlocal page, kind
        while at + 8 <= end:
            version, record, n = struct.unpack_from("<HHI", stream, at)
            body = at + 8
            stop = min(body + n, end)
            if record == 1006 and version & 15 == 15 or record == 1011:
                page += 1
            if record == 3999 and stop - body >= 4:
                kind = struct.unpack_from("<I", stream, body)[0]
            elif record in (4000, 4008):
                text = stream[body:stop].decode("utf-16-le" if record == 4000 else "latin-1", "replace")
                for part in re.split("[\r]", text):
                    if part.strip():
                        title = kind in (0, 6)
                        out.add("heading" if title else "paragraph", part.replace("\x0b", "\n"), level=1 if title else None, page=max(page, 0))
            elif version & 15 == 15 and depth < 64:
                walk(body, stop, depth + 1)
            at = body + n

    walk(0, len(stream), 0)
    out.page_count = max(1, page + 1)
    return out
