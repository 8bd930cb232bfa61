"""Workbooks of the Office Open XML format."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from . import ooxml
from .base import Options, Piece, blank
from .ooxml import Package, R, inner, local, named

EXTENSIONS = (".xlsx", ".xlsm")
#: Built-in number formats of dates and times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_LITERALS = re.compile(r'"[^"]*"|\\.|_.|\[[^\]]*\]')


def is_date_format(number: int, code: str | None) -> bool:
    """Built-in date formats, and custom ones that name a part of a date outside literals."""
    if number in DATE_FORMATS:
        return True
    return number >= 164 and bool(re.search("[ydhsm]", _LITERALS.sub("", (code or "")).lower()))


def date_text(serial: float, base: datetime = datetime(1899, 12, 30)) -> str:
    """A serial date in a fixed form that no culture changes."""
    when = base + timedelta(days=int(serial) if serial >= 0 else -int(-serial)) + timedelta(seconds=round(abs(serial) % 1 * 86400))
    return when.strftime("%Y/%m/%d %H:%M:%S")


class Styles:
    """Whether each cell style shows dates; read once for a workbook."""

    def __init__(self, root: ET.Element | None):
        self.dates: list[bool] = []
        if root is None:
            return
        codes = {int(e.get("numFmtId", -1)): e.get("formatCode") for e in named(root, "numFmt")}
        for xfs in (e for e in root if local(e) == "cellXfs"):
            for xf in xfs:
                n = int(xf.get("numFmtId", 0))
                self.dates.append(is_date_format(n, codes.get(n)))

    def date(self, style: str | None) -> bool:
        k = int(style or 0)
        return k < len(self.dates) and self.dates[k]


def cell_value(c: ET.Element, shared: list[str], styles: Styles, o: Options) -> str:
    kids = {local(e): e for e in c}
    if o.formulas:
        formula = inner(kids["f"]) if "f" in kids else ""
        return "=" + formula if formula else ""
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return inner(kids["is"]) if "is" in kids else ""
    value = inner(kids["v"]) if "v" in kids else ""
    if not value:
        return ""
    if kind == "s":
        k = int(value) if value.isdigit() else -1
        return shared[k] if 0 <= k < len(shared) else value
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind == "n" and styles.date(c.get("s")):
        try:
            return date_text(float(value))
        except (ValueError, OverflowError):
            return value
    return value


def _drawings(p: Package, part: str, name: str, o: Options) -> Iterator[Piece]:
    """Paragraphs of shapes; the number advances with each shape that had one."""
    n = 1
    for drawing in p.related(part, "drawing"):
        root = p.xml(drawing)
        for shape in named(root, "sp") if root is not None else ():
            texts = [t for body in named(shape, "txBody") for t in ooxml.paragraphs(body, "drawingml") if not blank(t)]
            for t in texts:
                yield Piece(t, 0, name, None, f"{o.labels['shape']}{n}")
            n += bool(texts)


def _comments(p: Package, part: str, name: str, o: Options) -> Iterator[Piece]:
    for comments in p.related(part, "comments"):
        root = p.xml(comments)
        for c in named(root, "comment") if root is not None else ():
            if not blank(inner(c)):
                yield Piece(inner(c), 0, name, c.get("ref"), o.labels["comment"])


def _shared(p: Package, book: str) -> list[str]:
    return [inner(si) for t in p.related(book, "sharedStrings") for si in p.elements(t, "si")]


def _footers(p: Package, part: str) -> list[ET.Element]:
    """What the headers and footers of a large sheet hold; nothing if it is broken, which its rows will tell."""
    try:
        return [x for e in p.pull(part, "headerFooter") for x in e] if p.holds(part, b"headerFooter") else []
    except ValueError:
        return []


def _sheet(p: Package, part: str, name: str, shared: list[str], styles: Styles, o: Options) -> Iterator[Piece]:
    if p.large(part):
        if p.top(part) != "worksheet":
            return
        yield from ooxml.sheet_header_footer(_footers(p, part), name, o)
        rows = p.pull(part, "row")
    else:
        root = p.root(part)
        if local(root) != "worksheet":  # a sheet of another kind
            return
        yield from ooxml.sheet_header_footer(root.iter(), name, o)
        rows = named(root, "row")
    for row in rows:
        for c in row:
            text = cell_value(c, shared, styles, o) if local(c) == "c" else ""
            if not blank(text):
                yield Piece(text, int(row.get("r", 0)), name, c.get("r", ""), None)
    yield from _drawings(p, part, name, o)
    yield from _comments(p, part, name, o)


def read(raw: bytes, o: Options) -> Iterator[Piece]:
    """A workbook, shared strings, styles or a sheet that are broken are a failure of the file; other parts that are broken are passed over.

    Large sheets are gone through row by row.
    """
    p = Package(raw)
    for extra in (ooxml.properties, ooxml.hyperlinks, ooxml.alternative_text, ooxml.charts, ooxml.smart_art, ooxml.threaded_comments):
        yield from extra(p, o)
    book = p.main()
    root = p.root(book)
    shared = _shared(p, book)
    styles = Styles(next((p.root(t) for t in p.related(book, "styles")), None))
    for sheet in named(root, "sheet"):
        yield from _sheet(p, p.target(book, sheet.get(R + "id")), sheet.get("name"), shared, styles, o)
