"""Documents of the Office Open XML format."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

from . import ooxml
from .base import Options, Piece, blank
from .ooxml import Package, inner, local, named

EXTENSIONS = (".docx", ".docm")


def _vml(e: ET.Element) -> bool:
    return local(e) == "shape" and "vml" in ooxml.namespace(e).lower()


def _body(e: ET.Element, in_shape: bool = False) -> Iterator[ET.Element]:
    """Paragraphs outside of VML shapes, in document order, those within others too."""
    for child in e:
        shape = in_shape or _vml(child)
        if local(child) == "p" and not shape and "wordprocessingml" in ooxml.namespace(child).lower():
            yield child
        yield from _body(child, shape)


def _runs(paragraph: ET.Element) -> str:
    return "".join(inner(r) for r in named(paragraph, "r") if "wordprocessingml" in ooxml.namespace(r).lower() and not any(_vml(x) for x in r.iter()))


def read(raw: bytes, o: Options) -> Iterator[Piece]:
    p = Package(raw)
    for extra in (ooxml.properties, ooxml.hyperlinks, ooxml.alternative_text):
        yield from extra(p, o)
    main = p.main()
    root = p.root(main)
    for body in (e for e in root if local(e) == "body"):
        for n, paragraph in enumerate(_body(body), 1):
            text = _runs(paragraph)
            if not blank(text):
                yield Piece(text, n)
    for n, shape in enumerate((e for e in root.iter() if _vml(e)), 1):
        if not blank(inner(shape)):
            yield Piece(inner(shape), 0, None, None, f"{o.labels['shape']}{n}")
    headers, footers = p.related(main, "header"), p.related(main, "footer")
    for part in (main, *headers, *footers):
        tree = p.xml(part)
        if tree is not None:
            yield from ooxml.word_text_boxes(tree, o)
    for label, parts in (("header", headers), ("footer", footers)):
        for n, part in enumerate(parts, 1):
            tree = p.xml(part)
            if tree is not None and not blank(inner(tree)):
                yield Piece(inner(tree), 0, None, None, f"{o.labels[label]}{n}")
    n = 0
    for part in p.related(main, "comments"):
        tree = p.xml(part)
        for n, comment in enumerate(named(tree, "comment") if tree is not None else (), n + 1):
            if not blank(inner(comment)):
                yield Piece(inner(comment), 0, None, None, f"{o.labels['comment']}{n}")
