"""Media columns: payloads stored losslessly as baseline JPEG, and features read back from it.

A payload (bytes, padded with 0 to a positive multiple of 64) becomes the quantised
coefficients of a grey-scale baseline JPEG: 64 bytes are one 8 x 8 block, a byte is a signed
coefficient in zigzag order, the quantisation table is all ones, and every block is a
restart interval. Entropy coding is lossless, so the coefficients read back are the payload.
The blocks form a grid as square as can be; blocks after the payload are filler, and a
comment segment holds the payload's length.

Reading parses the markers, splits the scan at its restart markers and Huffman-decodes
restart intervals in lock step with numpy. Any baseline file with one scan of all its
components is read, whatever their sampling factors and tables; a file without restart
markers is one interval. Thumbnails take only the DC coefficient of each luminance block
(its mean); the feature holds the dimensions and a 64-bit average hash of the thumbnail.

Both steps are row-local maps over Arrow batches, cut to about 1 MB of payload at a time;
within a longer text, ``SLICE`` blocks are encoded or decoded at a time, so beyond the text
and its file memory is bounded by a slice.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal values;
repeated rows are stored one by one; extra columns are dropped; an empty table gives an
empty result; a file that cannot be read has null features; payloads above 65,535 x 65,535 samples (4 GB) raise an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, text_batches

#: Code lengths and symbols of the Huffman tables that are written. Categories of DC
#: differences share 4 bits; AC symbols without a zero run have 4 bits, others 9.
DC_SYMBOLS = list(range(12))
DC_LENGTHS = [4] * 12
AC_SYMBOLS = [0x00, *range(1, 9), 0xF0, *(r << 4 | s for r in range(1, 16) for s in range(1, 9))]
AC_LENGTHS = [4] * 9 + [9] * 121

MAX_SIDE = 65_535 // 8
#: Blocks that are encoded or decoded together.
SLICE = 1 << 14


def canonical(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of the canonical code; lengths ascend."""
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        while at < len(lengths) and lengths[at] == n:
            out[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def table_bytes(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    """The body of a DHT segment."""
    return bytes([kind, *(lengths.count(n) for n in range(1, 17)), *symbols])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _code_arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    value, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (code, n) in codes.items():
        value[symbol], bits[symbol] = code, n
    return value, bits


_DC = _code_arrays(canonical(DC_LENGTHS, DC_SYMBOLS))
_AC = _code_arrays(canonical(AC_LENGTHS, AC_SYMBOLS))
_CATEGORY = np.array([int(abs(v)).bit_length() for v in range(-128, 128)], np.int64)
_TABLES = _segment(0xDB, b"\0" + b"\x01" * 64) + _segment(0xC4, table_bytes(0x00, DC_LENGTHS, DC_SYMBOLS)) + _segment(0xC4, table_bytes(0x10, AC_LENGTHS, AC_SYMBOLS)) + _segment(0xDD, struct.pack(">H", 1))
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category of each value and its extra bits."""
    size = _CATEGORY[values + 128]
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def _scatter(out: np.ndarray, pos: np.ndarray, value: np.ndarray, bits: np.ndarray, width: int) -> None:
    """Adds codes of at most 8 * width - 7 bits at bit positions; codes never overlap."""
    word = value << (8 * width - (pos & 7) - bits)
    at = pos >> 3
    for b in range(width):
        out += np.bincount(at + b, weights=(word >> (8 * (width - 1 - b))) & 255, minlength=len(out))


def encode_blocks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-codes blocks (n, 64) of int8, each a restart interval; returns bytes and the end of each block."""
    n = len(blocks)
    v = blocks.astype(np.int64)
    bits = np.zeros((n, 64), np.int64)
    code = np.zeros((n, 64), np.int64)
    size, extra = _magnitude(v[:, 0])
    code[:, 0] = (_DC[0][size] << size) | extra
    bits[:, 0] = _DC[1][size] + size
    row, k = np.nonzero(v[:, 1:])
    k += 1
    values = v[row, k]
    run = np.empty(len(k), np.int64)
    if len(k):
        run[0] = k[0] - 1
        run[1:] = np.where(row[1:] == row[:-1], k[1:] - k[:-1] - 1, k[1:] - 1)
    size, extra = _magnitude(values)
    symbol = (run & 15) << 4 | size
    code[row, k] = (_AC[0][symbol] << size) | extra
    bits[row, k] = _AC[1][symbol] + size
    skips = run >> 4
    long = np.flatnonzero(skips)
    if len(long):  # up to three codes for 16 zeros each stand before the symbol
        zrl, zrl_bits = int(_AC[0][0xF0]), int(_AC[1][0xF0])
        for i in range(1, int(skips.max()) + 1):
            some = long[skips[long] >= i]
            r, c = row[some], k[some]
            code[r, c] |= zrl << bits[r, c]
            bits[r, c] += zrl_bits
    ends = np.cumsum(bits, axis=1)
    eob = v[:, 63] == 0
    total = ends[:, 63] + np.where(eob, _AC[1][0], 0)
    n_bytes = (total + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(n_bytes)])
    out = np.zeros(int(begin[-1]) + 8, np.float64)
    pos = (begin[:-1, None] * 8 + ends - bits).ravel()
    code, bits = code.ravel(), bits.ravel()
    some = np.flatnonzero(bits)
    far = bits[some] > 17
    _scatter(out, pos[some[~far]], code[some[~far]], bits[some[~far]], 3)
    if far.any():
        _scatter(out, pos[some[far]], code[some[far]], bits[some[far]], 7)
    _scatter(out, (begin[:-1] * 8 + ends[:, 63])[eob], np.full(int(eob.sum()), _AC[0][0]), np.full(int(eob.sum()), _AC[1][0]), 3)
    pad = n_bytes * 8 - total
    out[begin[1:] - 1] += (1 << pad) - 1
    return out[: int(begin[-1])].astype(np.uint8), begin[1:]


def grid(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of the block grid."""
    cols = min(MAX_SIDE, int(np.ceil(np.sqrt(n_blocks))))
    rows = -(-n_blocks // cols)
    if rows > MAX_SIDE:
        raise ValueError(f"a payload of {n_blocks} blocks does not fit one JPEG")
    return cols, rows


def scan_bytes(blocks: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of blocks, and where those of each block end: stuffed, with the restart marker of its ``number`` after each block but the ``last`` of a file."""
    body, ends = encode_blocks(blocks)
    # stuffing: a zero byte after each 0xFF
    extra = (body == 0xFF).astype(np.int64)
    marker = np.zeros(len(body), np.int64)
    marker[ends - 1] = np.where(last, 0, 2)
    size = 1 + extra + marker
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at] = body
    has = np.flatnonzero(~last)
    spot = at[ends[has] - 1] + 1 + extra[ends[has] - 1]
    out[spot] = 0xFF
    out[spot + 1] = 0xD0 + (number[has] & 7)
    return out, np.append(at, len(out))[ends]


def _head(cols: int, rows: int, n_blocks: int) -> bytes:
    return b"\xff\xd8" + _segment(0xFE, b"payload=%d" % (n_blocks * 64)) + _TABLES + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, cols * 8, 1) + bytes([1, 0x11, 0])) + _SCAN


def _encode_long(data: np.ndarray) -> bytes:
    n_blocks = max(1, -(-len(data) // 64))
    cols, rows = grid(n_blocks)
    parts = [_head(cols, rows, n_blocks)]
    for a in range(0, cols * rows, SLICE):
        b = min(a + SLICE, cols * rows)
        blocks = np.zeros((b - a) * 64, np.uint8)
        own = data[a * 64 : b * 64]
        blocks[: len(own)] = own
        number = np.arange(a, b)
        parts.append(scan_bytes(blocks.view(np.int8).reshape(-1, 64), number, number == cols * rows - 1)[0].tobytes())
    return b"".join([*parts, b"\xff\xd9"])


def encode_payloads(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """JPEG files that hold the payloads data[off[i]:off[i+1]], padded."""
    n_bytes = np.diff(off)
    if int(n_bytes.max(initial=0)) > 64 * SLICE:
        return [_encode_long(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    n_blocks = np.maximum(1, -(-n_bytes // 64))
    grids = [grid(int(n)) for n in n_blocks]
    filled = np.array([c * r for c, r in grids], np.int64)
    first = np.concatenate([[0], np.cumsum(filled)])
    blocks = np.zeros(int(first[-1]) * 64, np.uint8)
    shift = np.repeat(first[:-1] * 64 - off[:-1], n_bytes)
    blocks[np.arange(len(data)) + shift] = data
    number = np.arange(int(first[-1])) - np.repeat(first[:-1], filled)
    last = number == np.repeat(filled - 1, filled)
    out, ends = scan_bytes(blocks.view(np.int8).reshape(-1, 64), number, last)
    stop = ends[first[1:] - 1]
    begin = np.concatenate([[0], stop[:-1]])
    return [_head(cols, rows, int(n_blocks[i])) + out[begin[i] : stop[i]].tobytes() + b"\xff\xd9" for i, (cols, rows) in enumerate(grids)]


class Header:
    """The markers of one baseline file: dimensions, components, tables, restart interval and where the scan lies."""

    def __init__(self, file: bytes):
        self.payload, self.restart = None, 0
        quant: dict[int, int] = {}
        tables: dict[int, bytes] = {}
        frame: list[tuple[int, int, int, int]] = []
        if file[:2] != b"\xff\xd8":
            raise ValueError("no SOI marker")
        at = 2
        while True:
            while file[at : at + 2] == b"\xff\xff":  # fill bytes
                at += 1
            if at + 4 > len(file) or file[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, n = file[at + 1], struct.unpack_from(">H", file, at + 2)[0]
            body = file[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    size = 17 + sum(body[1:17])
                    tables[body[0]] = body[:size]
                    body = body[size:]
            elif marker == 0xC0:
                _, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline files are read")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE and body.startswith(b"payload="):
                self.payload = int(body[8:])
            elif marker == 0xDA:
                break
        if not frame or body[0] != len(frame) or [body[1 + 2 * i] for i in range(body[0])] != [c[0] for c in frame]:
            raise ValueError("only files with one scan of all components are read")
        self.scan, self.quant = at, quant.get(frame[0][3], 1)
        # the blocks of one MCU: component, and its tables; one component alone has MCUs of one block
        one = len(frame) == 1
        most_h, most_v = max(c[1] for c in frame), max(c[2] for c in frame)
        self.h, self.v = (1, 1) if one else (frame[0][1], frame[0][2])
        self.pattern = tuple((i, tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]) for i, c in enumerate(frame) for _ in range(1 if one else c[1] * c[2]))
        wide, high = (8, 8) if one else (8 * most_h, 8 * most_v)
        self.mcu_cols, self.mcu_rows = -(-self.width // wide), -(-self.height // high)
        self.cols = self.mcu_cols if one else -(-(-(-self.width * self.h // most_h)) // 8)
        self.rows = self.mcu_rows if one else -(-(-(-self.height * self.v // most_v)) // 8)
        self.n_mcus = self.mcu_cols * self.mcu_rows
        self.interval = self.restart or self.n_mcus


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that may come next; length 0 where no code fits."""
    if table not in _LOOKUPS:
        counts, symbols = table[1:17], list(table[17:])
        lengths = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
        symbol, bits = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for s, (code, n) in canonical(lengths, symbols).items():
            symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
            bits[code << (16 - n) : (code + 1) << (16 - n)] = n
        _LOOKUPS[table] = symbol, bits
    return _LOOKUPS[table]


def _take(words: np.ndarray, pos: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, value of its extra bits, and the position after both."""
    w = (words[pos >> 3] << (pos & 7)) & 0xFFFFFFFFFF
    symbol, bits = table[0][w >> 24], table[1][w >> 24]
    size = symbol & 15
    extra = ((w << bits) & 0xFFFFFFFFFF) >> (40 - size)
    value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
    return symbol, value, pos + bits + size


def decode_intervals(data: np.ndarray, start: np.ndarray, n_mcus: np.ndarray, pattern: tuple) -> np.ndarray:
    """Coefficients (blocks, 64) in zigzag order of restart intervals that begin at bytes ``start`` of unstuffed data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    n = len(data) + 1
    words = padded[:n] << 32 | padded[1 : n + 1] << 24 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 8 | padded[4 : n + 4]
    n_blocks = n_mcus * len(pattern)
    first = np.cumsum(n_blocks) - n_blocks
    out = np.zeros(int(n_blocks.sum()) * 64, np.int64)
    pos, before = start * 8, np.zeros((1 + max(c for c, _, _ in pattern), len(start)), np.int64)
    for j in range(int(n_blocks.max()) if len(n_blocks) else 0):
        live = np.flatnonzero(n_blocks > j)
        part, dc, ac = pattern[j % len(pattern)]
        dc_table, ac_table = _lookup(dc), _lookup(ac)
        base = (first[live] + j) * 64
        symbol, value, p = _take(words, pos[live], dc_table)
        before[part, live] += np.where(symbol & 15, value, 0)
        out[base] = before[part, live]
        k = np.zeros(len(live), np.int64)
        idx = np.arange(len(live))
        done = np.zeros(len(live), np.int64)
        while len(idx):
            if int(p.max()) > 8 * n:
                raise ValueError("the scan ends too early")
            symbol, value, p = _take(words, p, ac_table)
            size = symbol & 15
            k = k + (symbol >> 4) + 1
            put = (size > 0) & (k < 64)
            if put.all():
                out[base[idx] + k] = value
            else:
                out[base[idx[put]] + k[put]] = value[put]
            over = ((size == 0) & (symbol != 0xF0)) | (k >= 63)
            if over.any():
                done[idx[over]] = p[over]
                go = ~over
                idx, p, k = idx[go], p[go], k[go]
        pos[live] = done
    return out.reshape(-1, 64)


def _intervals(head: Header, file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The scan's bytes, where its intervals begin and end (markers left out), and the MCUs of each."""
    data = np.frombuffer(file, np.uint8)[head.scan :]
    ff = np.flatnonzero(data[:-1] == 0xFF)
    mark = ff[(data[ff + 1] != 0) & (data[ff + 1] != 0xFF)]
    restarts = mark[(data[mark + 1] & 0xF8) == 0xD0]
    over = mark[(data[mark + 1] & 0xF8) != 0xD0]
    end = int(over[0]) if len(over) else len(data)
    restarts = restarts[restarts < end]
    counts = np.minimum(head.interval, head.n_mcus - np.arange(0, head.n_mcus, head.interval))
    if len(counts) != len(restarts) + 1:
        raise ValueError("restart markers do not fit the dimensions")
    return data, np.concatenate([[0], restarts + 2]), np.append(restarts, end), counts


def _unstuffed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without the zeros that follow 0xFF, and how many stay before each place."""
    drop = np.zeros(len(data), bool)
    drop[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
    return data[~drop], np.cumsum(~drop) - ~drop


def decode_files(files: list[bytes]) -> list[tuple[Header, np.ndarray] | None]:
    """Header and coefficients (blocks, 64) of each file, or None where it cannot be read; slices of files with the same tables are decoded together."""
    out: list = [None] * len(files)
    groups: dict[tuple, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
    heads: dict[int, Header] = {}
    for i, file in enumerate(files):
        try:
            head = Header(file)
            data, begin, end, counts = _intervals(head, file)
        except (ValueError, KeyError, IndexError, struct.error):
            continue
        heads[i] = head
        # an interval is never cut; a slice has about SLICE blocks
        step = max(1, SLICE // (head.interval * len(head.pattern)))
        for a in range(0, len(begin), step):
            b = min(a + step, len(begin))
            groups.setdefault(head.pattern, []).append((i, data[begin[a] : end[b - 1]], begin[a:b] - begin[a], counts[a:b]))
    parts: dict[int, list[np.ndarray]] = {i: [] for i in heads}
    for pattern, slices in groups.items():
        at = 0
        while at < len(slices):
            held, blocks = [], 0
            while at < len(slices) and (not held or blocks + int(slices[at][3].sum()) * len(pattern) <= SLICE):
                held.append(slices[at])
                blocks += int(slices[at][3].sum()) * len(pattern)
                at += 1
            try:
                decoded = _decode_slices(held, pattern)
            except (ValueError, IndexError):  # one of them cannot be read: each on its own
                decoded = []
                for one in held:
                    try:
                        decoded += _decode_slices([one], pattern)
                    except (ValueError, IndexError):
                        decoded.append(None)
            for (i, *_), coefs in zip(held, decoded, strict=True):
                parts[i].append(coefs)
    for i, found in parts.items():
        if all(x is not None for x in found):
            out[i] = (heads[i], np.concatenate(found))
    return out


def _decode_slices(slices: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], pattern: tuple) -> list[np.ndarray]:
    raw = np.concatenate([s[1] for s in slices])
    base = np.cumsum([0, *[len(s[1]) for s in slices]])
    data, kept = _unstuffed(raw)
    start = np.append(kept, len(data))[np.concatenate([s[2] + b for s, b in zip(slices, base, strict=False)])]
    coefs = decode_intervals(data, start, np.concatenate([s[3] for s in slices]), pattern).astype(np.int16)
    cuts = np.cumsum([int(s[3].sum()) * len(pattern) for s in slices])[:-1]
    return np.split(coefs, cuts)


def luminance(head: Header, coefs: np.ndarray) -> np.ndarray:
    """DC coefficients of the first component, by rows and columns of its blocks."""
    n = head.h * head.v
    dc = coefs[:, 0].reshape(head.n_mcus, len(head.pattern))[:, :n].astype(np.int64)
    whole = dc.reshape(head.mcu_rows, head.mcu_cols, head.v, head.h).transpose(0, 2, 1, 3).reshape(head.mcu_rows * head.v, head.mcu_cols * head.h)
    return whole[: head.rows, : head.cols]


def thumbnail(head: Header, coefs: np.ndarray) -> np.ndarray:
    """Luminance of each block from its DC coefficient alone."""
    return np.clip(luminance(head, coefs) * head.quant // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: cells of an 8 x 8 sampling of the thumbnail above their mean."""
    rows, cols = thumb.shape
    cells = thumb[np.arange(8) * rows // 8][:, np.arange(8) * cols // 8].astype(np.int64).ravel()
    return np.packbits(cells * 64 > cells.sum()).tobytes().hex()


ENCODED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in text_batches(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(encode_payloads(data, off), pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in text_batches(batches, "media", 3 << 19):
        files = part.column("media").to_pylist()
        rows = []
        for file, found in zip(files, decode_files(files), strict=True):
            if found is None:
                rows.append((None, None, None, len(file), hashlib.sha256(file).hexdigest(), None))
                continue
            head, coefs = found
            payload = coefs.astype(np.int8).tobytes()[: head.payload]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), f"{head.width}x{head.height}:{average_hash(thumbnail(head, coefs))}"))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [f.split()[0] for f in FEATURES.split(", ")])


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode, ENCODED)


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back and computes dimensions, hashes and the thumbnail feature."""
    return media.mapInArrow(_read, FEATURES)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(documents(spark, sf_dir)))
