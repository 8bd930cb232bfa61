"""Word documents of the binary format: text by its piece table, cut into regions."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from .base import Options, Piece, numbered_lines
from .cfb import CompoundFile

EXTENSIONS = (".doc",)
MAGIC = 0xA5EC
_CONTROL = re.compile("([\x00-\x08\x0a-\x1f])")


def pieces(clx: bytes) -> list[tuple[int, int, int, bool]]:
    """(first character, last plus one, byte offset, compressed) of each piece of the text."""
    at = 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        return []
    size = struct.unpack_from("<I", clx, at + 1)[0]
    table = clx[at + 5 : at + 5 + size]
    n = (len(table) - 4) // 12
    bounds = struct.unpack_from(f"<{n + 1}I", table, 0)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", table, 4 * (n + 1) + 8 * k + 2)[0]
        packed = bool(fc & 0x40000000)
        fc &= 0x3FFFFFFF
        out.append((bounds[k], bounds[k + 1], fc // 2 if packed else fc, packed))
    return out


def text_of(raw: bytes) -> tuple[str, tuple[int, ...]]:
    """Whole text, and the lengths of its regions: body, footnotes, headers, macros, comments, endnotes, text boxes, header text boxes."""
    f = CompoundFile(raw)
    main = f.stream("WordDocument")
    if struct.unpack_from("<H", main, 0)[0] != MAGIC:
        raise ValueError("not a Word document")
    table = f.stream("1Table" if struct.unpack_from("<H", main, 0x0A)[0] & 0x0200 else "0Table")
    lengths = struct.unpack_from("<8I", main, 0x4C)
    at, size = struct.unpack_from("<II", main, 0x01A2)
    out = []
    for a, b, offset, packed in pieces(table[at : at + size]):
        n = b - a
        out.append(main[offset : offset + n].decode("cp1252", "replace") if packed else main[offset : offset + 2 * n].decode("utf-16-le", "replace"))
    return "".join(out), lengths


def clean(line: str) -> str:
    """Without field codes (what stands between the begin of a field and its separator) and control characters; a cell mark is a tab."""
    out, fields = [], []
    for k, x in enumerate(_CONTROL.split(line)):  # texts and control characters in turn
        if x == "\x13":
            fields.append(True)
        elif x == "\x14":
            if fields:
                fields[-1] = False
        elif x == "\x15":
            if fields:
                fields.pop()
        elif not any(fields):
            if k % 2 == 0:
                out.append(x)
            elif x == "\x07":
                out.append("\t")
    return "".join(out)


def region(text: str, start: int, length: int) -> str:
    return text[max(0, start) : max(0, start) + max(0, length)]


def read(raw: bytes, o: Options) -> Iterator[Piece]:
    text, lengths = text_of(raw)
    starts = [sum(lengths[:k]) for k in range(8)]
    for k, obj in ((0, None), (2, o.labels["header_footer"]), (4, o.labels["comment"]), (6, o.labels["shape"])):
        part = region(text, starts[k], lengths[k]).replace("\r\n", "\n")
        for mark in "\r\x0b\x0c":
            part = part.replace(mark, "\n")
        yield from numbered_lines([clean(x) for x in part.split("\n")], None, obj)
