"""Plain text: one entry for each line that is not blank."""

from __future__ import annotations

from collections.abc import Iterator

from ..encoding import decode
from .base import Options, Piece, new_lines, numbered_lines

EXTENSIONS = (".txt",)


def read(raw: bytes, options: Options) -> Iterator[Piece]:
    found = decode(raw, options.strict_probe)
    return numbered_lines(new_lines(found)) if options.of_interest(found) else iter(())
