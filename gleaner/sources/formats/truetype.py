"""Which text a glyph of an embedded font stands for, by the `cmap` table of the font read backwards."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Subtables (platform, encoding) that map from Unicode, the best first.
UNICODE = ((3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0))
SYMBOL = (3, 0)


def glyph_texts(font: bytes) -> dict[int, str]:
    """Text by glyph number; empty if the font has no such table. The first character of a glyph counts, ordinary ones before private ones."""
    try:
        table = _table(font, b"cmap")
        if table is None:
            return {}
        places = {struct.unpack_from(">HH", table, 4 + 8 * k): struct.unpack_from(">I", table, 8 + 8 * k)[0] for k in range(struct.unpack_from(">H", table, 2)[0])}
        best = next((places[k] for k in (*UNICODE, SYMBOL) if k in places), None)
        if best is None:
            return {}
        found: dict[int, int] = {}
        for code, g in _pairs(table, best):
            code = code - 0xF000 if SYMBOL in places and 0xF000 <= code <= 0xF0FF else code
            if g and (g not in found or _private(found[g]) and not _private(code)):
                found[g] = code
    except struct.error:  # cut off
        return {}
    return {g: chr(c) for g, c in found.items() if c < 0x110000 and not 0xD800 <= c < 0xE000}


def _private(code: int) -> bool:
    return 0xE000 <= code <= 0xF8FF


def _table(font: bytes, name: bytes) -> bytes | None:
    if font[:4] == b"ttcf":
        return None
    for k in range(struct.unpack_from(">H", font, 4)[0] if len(font) >= 12 else 0):
        if font[12 + 16 * k : 16 + 16 * k] == name:
            at, size = struct.unpack_from(">II", font, 20 + 16 * k)
            return font[at : at + size]
    return None


def _pairs(t: bytes, at: int) -> Iterator[tuple[int, int]]:
    """(character, glyph) of a subtable."""
    kind = struct.unpack_from(">H", t, at)[0]
    if kind == 0:
        yield from enumerate(t[at + 6 : at + 262])
    elif kind == 4:
        n = struct.unpack_from(">H", t, at + 6)[0] // 2
        ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", t, at + 14 + skip + 2 * n * k) for k, skip in ((0, 0), (1, 2), (2, 2), (3, 2)))
        for k in range(n):
            for code in range(starts[k], min(ends[k], 0xFFFE) + 1):
                if offsets[k]:
                    place = at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (code - starts[k])
                    g = struct.unpack_from(">H", t, place)[0]
                    yield code, (g + deltas[k]) & 0xFFFF if g else 0
                else:
                    yield code, (code + deltas[k]) & 0xFFFF
    elif kind == 6:
        first, n = struct.unpack_from(">HH", t, at + 6)
        yield from enumerate(struct.unpack_from(f">{n}H", t, at + 10), first)
    elif kind == 12:
        for k in range(struct.unpack_from(">I", t, at + 12)[0]):
            a, b, g = struct.unpack_from(">III", t, at + 16 + 12 * k)
            for code in range(a, min(b, 0x10FFFF) + 1):
                yield code, g + code - a
