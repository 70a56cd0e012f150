"""RTF bytes to blocks: a group stack, code pages, unicode escapes and table rows."""

from __future__ import annotations

import re

from foliant.sources.model import Parsed

#: Code pages of font charsets. Fixed values.
CHARSETS = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "gbk", 136: "cp950", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
#: Groups whose text is not document text. Fixed values.
SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "footerl", "footerr", "object", "themedata", "listtable", "listoverridetable", "rsidtbl", "generator", "xmlnstbl", "datastore", "latentstyles", "fldinst", "filetbl", "revtbl"}

_TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?[0-9]{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")


def rtf(data: bytes) -> Parsed:
    out = Parsed()
    state = {"silent": False, "charset": "cp1252", "uc": 1, "outline": 0, "field": None}
    stack: list[dict] = []
    fonts: dict[int, str] = {}
    default, text, raw, skip = "cp1252", [], bytearray(), 0
    row: list[str] = []
    rows: list[list[str]] = []
    font_no, in_fonts, info_key = 0, 0, None
    info: dict[str, list[str]] = {}

    def flush() -> None:
        if raw:
            text.append(raw.decode(state["charset"] or default, "replace"))
            raw.clear()

    def paragraph() -> None:
        flush()
        body = "".join(text)
        text.clear()
        if body.strip():
            end_table()
            if state["outline"]:
                out.add("heading", body, level=state["outline"])
            else:
                out.add("paragraph", body)

    def end_table() -> None:
        if rows:
            width = max(map(len, rows))
            out.table([r + [""] * (width - len(r)) for r in rows])
            rows.clear()

    at = data.find(b"{\\rtf")
    if at < 0:
        raise ValueError("parse error: no RTF header")
    pos = at
    while pos < len(data):
        m = _TOKEN.match(data, pos)
        if not m:
            pos += 1
            continue
        pos = m.end()
        word, number, hexa, sign, brace, plain = m.groups()
        n = int(number) if number else None
        if brace == b"{":
            flush()
            if len(stack) < 512:
                stack.append(dict(state) | {"info": info_key})
        elif brace == b"}":
            flush()
            if not stack:
                break
            state = stack.pop()
            info_key = state.get("info")
            in_fonts = in_fonts if in_fonts <= len(stack) else 0
        elif word:
            w = word.decode()
            if w in SILENT:
                state["silent"] = True
                in_fonts = len(stack) if w == "fonttbl" else in_fonts
            elif w in ("title", "author", "subject", "keywords") and state["silent"]:
                info_key = w
            elif w == "ansicpg" and n:
                default = f"cp{n}" if n != 65001 else "utf-8"
                state["charset"] = default
            elif w == "f" and n is not None:
                flush()
                font_no = n
                if not in_fonts:
                    state["charset"] = fonts.get(n, default)
            elif w == "fcharset" and in_fonts and n in CHARSETS:
                fonts[font_no] = CHARSETS[n] if n else default
            elif w == "bin" and n and n > 0:
                pos += n
            elif w == "uc" and n is not None:
                state["uc"] = n
            elif w == "u" and n is not None and not state["silent"]:
                flush()
                code = n % 65536
                if 0xDC00 <= code < 0xE000 and text and 0xD800 <= ord(text[-1][-1]) < 0xDC00:
                    high = ord(text[-1][-1])
                    text[-1] = text[-1][:-1] + chr(0x10000 + (high - 0xD800 << 10) + code - 0xDC00)
                else:
                    text.append(chr(code))
                skip = state["uc"]
                continue
            elif state["silent"]:
                pass
            elif w in ("par", "sect", "page"):
                paragraph()
            elif w in ("line", "tab"):
                flush()
                text.append("\n" if w == "line" else "\t")
            elif w == "cell":
                flush()
                row.append("".join(text).strip())
                text.clear()
            elif w == "row":
                rows.append(row)
                row = []
            elif w == "pard":
                state["outline"] = 0
            elif w == "outlinelevel" and n is not None and n < 6:
                state["outline"] = n + 1
            elif w in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
                flush()
                text.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[w])
        elif sign:
            if sign == b"*":
                state["silent"] = True
            elif not state["silent"] and sign in b"{}\\":
                raw += sign
            elif not state["silent"] and sign == b"~":
                flush()
                text.append(" ")
            elif not state["silent"] and sign in (b"\n", b"\r"):
                paragraph()
        elif hexa or plain:
            part = bytes([int(hexa, 16)]) if hexa else plain
            if skip:
                cut = min(skip, len(part))
                part, skip = part[cut:], skip - cut
            if info_key and state["silent"]:
                info.setdefault(info_key, []).append(part.decode(default, "replace"))
            elif not state["silent"]:
                raw += part
        skip = 0 if brace or word else skip
    paragraph()
    end_table()
    out.metadata |= {k: "".join(v).strip() for k, v in info.items() if "".join(v).strip()}
    for b in out.blocks:  # lone halves of surrogate pairs
        b["text"] = b["text"].encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return out
