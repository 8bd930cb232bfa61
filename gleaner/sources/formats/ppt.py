"""PowerPoint presentations of the binary format: a walk through the record tree."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from .base import Options, Piece, blank
from .cfb import CompoundFile

EXTENSIONS = (".ppt",)
#: Record types.
SLIDE, NOTES, SLIDE_LIST, TEXT_WIDE, TEXT_NARROW, CSTRING, COMMENT = 0x03EE, 0x03F0, 0x0FF0, 0x0FA0, 0x0FA8, 0x0FBA, 0x0FCC

_HEAD = struct.Struct("<HHI").unpack_from
_ZEROS = re.compile(rb"\0+")


class _Walk:
    def __init__(self, options: Options):
        self.o, self.slide, self.shape, self.comment = options, 0, 0, 0

    @property
    def sheet(self) -> str:
        return f"{self.o.labels['slide']}{self.slide}" if self.slide else self.o.labels["document_info"]

    def records(self, data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
        at = 0
        while at + 8 <= len(data):
            head, kind, size = _HEAD(data, at)
            if not head and not kind and not size:  # what fills a stream up: empty records, which say nothing
                at += (_ZEROS.match(data, at).end() - at) // 8 * 8
                continue
            yield head & 0xF, head >> 4, kind, data[at + 8 : at + 8 + size]
            at += 8 + size

    def text(self, text: str, notes: bool) -> Iterator[Piece]:
        lines = [(n, x.strip("\n")) for n, x in enumerate(text.split("\r"), 1)]
        lines = [(n, x) for n, x in lines if not blank(x)]
        if lines and not notes:
            self.shape += 1
        for n, x in lines:
            yield Piece(x, n, self.sheet, None, self.o.labels["note"] if notes else f"{self.o.labels['shape']}{self.shape}")

    def walk(self, data: bytes, notes: bool = False) -> Iterator[Piece]:
        for version, instance, kind, body in self.records(data):
            if kind == SLIDE_LIST:
                continue
            if kind == SLIDE:
                self.slide, self.shape, self.comment = self.slide + 1, 0, 0
            if kind == TEXT_WIDE:
                yield from self.text(body[: len(body) // 2 * 2].decode("utf-16-le", "replace"), notes)
            elif kind == TEXT_NARROW:
                yield from self.text(body.decode("cp1252", "replace"), notes)
            elif kind == COMMENT:
                for _, number, k, inside in self.records(body):
                    if k == CSTRING and number == 1:
                        text = inside[: len(inside) // 2 * 2].decode("utf-16-le", "replace")
                        if not blank(text):
                            self.comment += 1
                            yield Piece(text, 0, self.sheet, None, f"{self.o.labels['comment']}{self.comment}")
            elif version == 0xF:
                yield from self.walk(body, notes or kind == NOTES)


def read(raw: bytes, o: Options) -> Iterator[Piece]:
    return _Walk(o).walk(CompoundFile(raw).stream("PowerPoint Document"))
