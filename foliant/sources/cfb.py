"""Compound files: sector chains, the mini stream and the directory, from bytes in memory."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END = 0xFFFFFFFA  # sector numbers from here on are marks, not places


class CompoundFile:
    """``entries`` maps stream names to (first sector, size); ``read`` gives a stream's bytes."""

    def __init__(self, data: bytes, most_sectors: int = 4_000_000):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("odd sector sizes")
        self.size, self.most = 1 << shift, min(most_sectors, len(data) // (1 << shift) + 2)
        n_fat, dir_start, _, self.cutoff, mini_start, _, difat_start, _ = struct.unpack_from("<IIIIIIII", data, 44)
        difat = [x for x in struct.unpack_from("<109I", data, 76) if x < _END]
        seen = set()
        while difat_start < _END and difat_start not in seen:
            seen.add(difat_start)
            part = struct.unpack_from(f"<{self.size // 4}I", self._sector(difat_start).ljust(self.size, b"\xff"))
            difat += [x for x in part[:-1] if x < _END]
            difat_start = part[-1]
        fat = b"".join(self._sector(s) for s in difat[: max(n_fat, 1)])
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat[: len(fat) // 4 * 4])
        mini = self._chain(mini_start)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.entries: dict[str, tuple[int, int]] = {}
        directory, root = self._chain(dir_start), (0xFFFFFFFE, 0)
        for at in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, at + 64)
            start, size = struct.unpack_from("<II", directory, at + 116)
            name = directory[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = (start, size)
            elif kind == 2 and name:
                self.entries.setdefault(name, (start, size))
        self.mini_stream = self._chain(root[0])[: root[1]]

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        return self.data[at : at + self.size]

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < _END and start not in seen and len(seen) < self.most:
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start] if start < len(self.fat) else 0xFFFFFFFE
        return b"".join(out)

    def read(self, name: str) -> bytes:
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < _END and start not in seen:
            seen.add(start)
            out.append(self.mini_stream[start * 64 : start * 64 + 64])
            start = self.mini_fat[start] if start < len(self.mini_fat) else 0xFFFFFFFE
        return b"".join(out)[:size]
