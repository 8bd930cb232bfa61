"""Presentations of the Office Open XML format."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

from . import ooxml
from .base import Options, Piece, blank
from .ooxml import Package, R, inner, local, named

EXTENSIONS = (".pptx", ".pptm")


def _masters(p: Package, main: str, o: Options) -> Iterator[Piece]:
    for i, master in enumerate(p.related(main, "slideMaster"), 1):
        parts = [(master, f"{o.labels['slide_master']}{i}")]
        parts += [(layout, f"{o.labels['slide_layout']}{j}") for j, layout in enumerate(p.related(master, "slideLayout"), 1)]
        for part, name in parts:
            root = p.xml(part)
            if root is not None:
                yield from ooxml.numbered_paragraphs(ooxml.paragraphs(root, "drawingml"), name, o.labels["shape"])


def _name(shape: ET.Element) -> str:
    return next((e.get("name", "") for e in named(shape, "cNvPr")), "")


def _slide(p: Package, part: str, name: str, o: Options) -> Iterator[Piece]:
    root = p.root(part)
    for n, shape in enumerate(named(root, "sp"), 1):
        bodies = [e for e in shape if local(e) == "txBody"]
        texts = (t for body in bodies for t in ooxml.paragraphs(body, "drawingml"))
        yield from ooxml.numbered_paragraphs(texts, name, _name(shape) or f"{o.labels['shape']}{n}")
    for frame in named(root, "graphicFrame"):
        yield from ooxml.numbered_paragraphs(ooxml.paragraphs(frame, "drawingml"), name, o.labels["table_chart"])
    for notes in p.related(part, "notesSlide"):
        tree = p.xml(notes)
        if tree is not None:
            texts = (t for shape in named(tree, "sp") for body in shape if local(body) == "txBody" for t in ooxml.paragraphs(body, "drawingml"))
            yield from ooxml.numbered_paragraphs(texts, name, o.labels["note"])
    n = 0
    for comments in p.related(part, "comments"):
        tree = p.xml(comments)
        for cm in named(tree, "cm") if tree is not None else ():
            text = "".join(inner(t) for t in named(cm, "text", "t"))
            if not blank(text):
                n += 1
                yield Piece(text, 0, name, None, f"{o.labels['comment']}{n}")


def read(raw: bytes, o: Options) -> Iterator[Piece]:
    p = Package(raw)
    for extra in (ooxml.properties, ooxml.hyperlinks, ooxml.alternative_text, ooxml.charts, ooxml.smart_art):
        yield from extra(p, o)
    main = p.main()
    root = p.root(main)
    yield from _masters(p, main, o)
    for i, e in enumerate(named(root, "sldId"), 1):
        part = p.target(main, e.get(R + "id"))
        if part:
            yield from _slide(p, part, f"{o.labels['slide']}{i}", o)
