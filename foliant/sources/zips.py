"""Members of ZIP archives in memory: plain archives are read by their directory at once, all others with ``zipfile``.

Plain means one disk, no comment, no bytes before the archive, names once each, stored or
deflated members that do not overlap, and no ZIP64. Whatever does not look plain, and any
member whose sizes or checksum do not fit, goes through ``zipfile``, which decides what is an error.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

_END = struct.Struct("<4s4H2LH")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_HEAD = struct.Struct("<4s5H3L2H")


class Members:
    """``sizes`` maps the names of members to their unpacked sizes; ``read`` unpacks one."""

    def __init__(self, data: bytes):
        self.data, self._zip = data, None
        self._plain = _directory(data)
        self.sizes = {n: e[2] for n, e in self._plain.items()} if self._plain is not None else {i.filename: i.file_size for i in self._slow().infolist()}

    def _slow(self) -> zipfile.ZipFile:
        if self._zip is None:
            self._zip = zipfile.ZipFile(io.BytesIO(self.data))
        return self._zip

    def read(self, name: str) -> bytes:
        raw = self._fast(name) if self._plain is not None else None
        return raw if raw is not None else self._slow().read(name)

    def _fast(self, name: str) -> bytes | None:
        at, packed, size, crc, method, label, stop = self._plain[name]
        if at + 30 > stop:
            return None
        head = _HEAD.unpack_from(self.data, at)
        start = at + 30 + head[9] + head[10]
        if head[0] != b"PK\x03\x04" or start + packed > stop or self.data[at + 30 : at + 30 + head[9]] != label:
            return None
        raw = self.data[start : start + packed]
        if method:
            try:
                raw = zlib.decompressobj(-15).decompress(raw, size + 1)
            except zlib.error:
                return None
        return raw if len(raw) == size and zlib.crc32(raw) == crc else None


def _directory(data: bytes) -> dict[str, tuple] | None:
    """name -> (place, packed size, size, checksum, method, name as bytes, end of its room); None if the archive is not plain."""
    end = len(data) - 22
    if end < 0:
        return None
    sign, disk, first_disk, n_here, n, size, start, comment = _END.unpack_from(data, end)
    if sign != b"PK\x05\x06" or disk or first_disk or n_here != n or n == 0xFFFF or comment or start + size != end:
        return None
    out: dict[str, tuple] = {}
    at = start
    for _ in range(n):
        if at + 46 > end:
            return None
        e = _ENTRY.unpack_from(data, at)
        label = data[at + 46 : at + 46 + e[10]]
        if e[0] != b"PK\x01\x02" or e[2] & 0xFF > 45 or e[3] & ~0x806 or e[4] not in (0, 8) or max(e[8], e[9], e[16]) >= 0xFFFFFFFF or e[11] or b"\0" in label or b"\\" in label:
            return None
        try:
            name = label.decode("utf-8" if e[3] & 0x800 else "ascii")
        except UnicodeDecodeError:
            return None
        if name in out or e[4] == 0 and e[8] != e[9]:
            return None
        out[name] = (e[16], e[8], e[9], e[7], e[4], label)
        at += 46 + e[10] + e[11] + e[12]
    if at != end:
        return None
    places = sorted(x[0] for x in out.values())
    if len(set(places)) < n:
        return None
    after = dict(zip(places, [*places[1:], start], strict=True))
    return {k: (*x, after[x[0]]) for k, x in out.items()}
