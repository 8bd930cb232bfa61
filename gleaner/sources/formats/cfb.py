"""Compound files: the container of the older binary formats."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    """Streams by name, in whatever storage they lie."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.raw = raw
        self.size = 1 << struct.unpack_from("<H", raw, 30)[0]
        self.small = 1 << struct.unpack_from("<H", raw, 32)[0]
        (self.n_fat, self.first_dir) = struct.unpack_from("<I", raw, 44)[0], struct.unpack_from("<I", raw, 48)[0]
        self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIII", raw, 56)
        difat = list(struct.unpack_from("<109I", raw, 76))
        while first_difat not in (END, FREE) and n_difat > 0:
            block = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            difat += block[:-1]
            first_difat, n_difat = block[-1], n_difat - 1
        self.fat: list[int] = []
        for s in difat[: self.n_fat]:
            if s not in (END, FREE):
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        mini = self._chain(first_mini)
        self.minifat = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        self.entries: dict[str, tuple[int, int, int]] = {}
        directory = self._chain(self.first_dir)
        self.ministream = b""
        for at in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, at + 64)
            if kind in (1, 2, 5):
                name = directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
                start, length = struct.unpack_from("<II", directory, at + 116)
                if kind == 5:
                    self.ministream = self._chain(start)[:length]
                else:
                    self.entries.setdefault(name, (kind, start, length))

    def _sector(self, k: int) -> bytes:
        return self._sectors(k, 1)

    def _sectors(self, k: int, n: int) -> bytes:
        at = (k + 1) * self.size
        return self.raw[at : at + n * self.size].ljust(n * self.size, b"\0")

    def _chain(self, k: int) -> bytes:
        """The sectors of a chain, those that follow one another at once."""
        out, seen, fat = [], set(), self.fat
        while k < len(fat) and k not in seen:
            first, n = k, 0
            while k == first + n and k < len(fat) and k not in seen:
                seen.add(k)
                k, n = fat[k], n + 1
            out.append(self._sectors(first, n))
        return b"".join(out)

    def has(self, name: str) -> bool:
        return self.entries.get(name, (0,))[0] == 2

    def stream(self, name: str) -> bytes:
        _, k, length = self.entries[name]
        if length >= self.cutoff:
            return self._chain(k)[:length]
        out, seen = [], set()
        while k < len(self.minifat) and k not in seen:
            seen.add(k)
            out.append(self.ministream[k * self.small : (k + 1) * self.small])
            k = self.minifat[k]
        return b"".join(out)[:length]
