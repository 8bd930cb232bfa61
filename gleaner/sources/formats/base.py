"""What all readers share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from ...schema import LABELS

#: Unicode white space as .NET knows it. U+001C to U+001F, which Python adds, are not in it.
WHITE = "\t\n\v\f\r \x85\xa0                　"


class Piece(NamedTuple):
    """An entry within its file."""

    content: str
    line: int = 0
    sheet: str | None = None
    cell: str | None = None
    obj: str | None = None


@dataclass(frozen=True)
class Options:
    formulas: bool = False
    strict_probe: bool = False
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))
    #: Of each keyword what a text must hold for its lines to be of interest, one of each tuple; of all keywords or any; fold: whatever their case.
    needed: tuple[tuple[tuple[str, ...], ...], ...] = ()
    needed_all: bool = True
    fold: bool = True
    #: Bytes of the ranges by which large texts are read.
    range_bytes: int = 32 << 20

    def of_interest(self, text: str) -> bool:
        text = text.lower() if self.needed and self.fold else text
        return not self.needed or (all if self.needed_all else any)(all(any(x in text for x in c) for c in k) for k in self.needed)


def blank(text: str | None) -> bool:
    return not (text or "").strip(WHITE)


def distinct(values: Iterable[str | None]) -> list[str]:
    """Trimmed values that are not blank, each once."""
    return list(dict.fromkeys(v.strip(WHITE) for v in values if not blank(v)))


def numbered(values: Iterable[str | None], label: str, sheet: str | None = None) -> Iterator[Piece]:
    """Distinct values, with the label and their number as object."""
    for n, v in enumerate(distinct(values), 1):
        yield Piece(v, 0, sheet, None, f"{label}{n}")


def new_lines(text: str) -> list[str]:
    """Split at CR LF, CR and LF."""
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def numbered_lines(lines: Iterable[str], sheet: str | None = None, obj: str | None = None) -> Iterator[Piece]:
    """Lines that are not blank; blank ones count."""
    for n, line in enumerate(lines, 1):
        if not blank(line):
            yield Piece(line, n, sheet, None, obj)
