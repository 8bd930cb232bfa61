"""Packages of the Office Open XML formats, and what their three readers share."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from xml.etree import ElementTree as ET

from .base import Options, Piece, blank, numbered

R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Parts of more bytes are gone through element by element, without a tree.
TREE_BYTES = 16 << 20
#: Trees of parts of at most so many bytes are kept for all who look through the parts of a file, as long as the parts come to no more than the second.
KEPT_PART, KEPT_ALL = 256 << 10, 4 << 20
#: Core and extended properties that are searched.
PROPERTIES = ("title", "subject", "creator", "keywords", "description", "category", "contentStatus", "contentType", "identifier", "language", "lastModifiedBy", "revision", "version")
#: Trees of parts of at most so many bytes are kept beyond their file: files of one maker have the same relationships, styles and content types.
SHARED_PART, SHARED_TREES = 8 << 10, 128
_LENGTHS = struct.Struct("<HH").unpack_from
HEADER_FOOTER = ("oddheader", "oddfooter", "evenheader", "evenfooter", "firstheader", "firstfooter")


@lru_cache(4096)
def _parts_of(tag) -> tuple[str, str]:
    """Namespace and local name of a tag; there are few, for very many elements."""
    if not isinstance(tag, str):
        return "", ""
    return tag[1:].partition("}")[0] if tag.startswith("{") else "", tag.rpartition("}")[2]


@lru_cache(SHARED_TREES)
def _tree_of(data: bytes) -> ET.Element:
    return ET.fromstring(data)


@lru_cache(4096)
def _where(part: str) -> tuple[str, str]:
    """The folder of a part, and the part that has its relationships."""
    folder, name = posixpath.split(part)
    return folder, posixpath.join(folder, "_rels", name + ".rels")


@lru_cache(4096)
def _reached(folder: str, target: str) -> str:
    """The part that a target names, seen from a folder."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))


def local(e: ET.Element) -> str:
    return _parts_of(e.tag)[1]


def namespace(e: ET.Element) -> str:
    return _parts_of(e.tag)[0]


def inner(e: ET.Element) -> str:
    return "".join(e.itertext())


def named(root: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if _parts_of(e.tag)[1] in names)


class Package:
    """Parts by name, their content types and relationships."""

    def __init__(self, raw: bytes):
        self.raw, self.zip = raw, zipfile.ZipFile(io.BytesIO(raw))
        self.names = {n.lower(): n for n in self.zip.namelist()}
        self._trees: dict[str, ET.Element] = {}
        self._kept = 0
        self.kinds: dict[str, str] = {}
        self.defaults: dict[str, str] = {}
        types = self.xml("[Content_Types].xml")
        for e in types if types is not None else ():
            if local(e) == "Override":
                self.kinds[e.get("PartName", "").lstrip("/").lower()] = e.get("ContentType", "")
            elif local(e) == "Default":
                self.defaults[e.get("Extension", "").lower()] = e.get("ContentType", "")
        self._rels: dict[str, list[tuple[str, str, str, bool]]] = {}
        self._parts: list[str] | None = None

    def has(self, part: str) -> bool:
        return part.lower() in self.names

    def kind(self, part: str) -> str:
        return self.kinds.get(part.lower()) or self.defaults.get(part.rpartition(".")[2].lower(), "")

    def xml(self, part: str) -> ET.Element | None:
        """Root of a part; None if it is absent, empty or broken."""
        try:
            return self._tree(self.names[part.lower()])
        except (KeyError, ET.ParseError, zipfile.BadZipFile):
            return None

    def _tree(self, name: str) -> ET.Element:
        """The tree of a part, which nobody changes."""
        found = self._trees.get(name)
        if found is None:
            data = self._data(name)
            found = _tree_of(data) if len(data) <= SHARED_PART else ET.fromstring(data)
            if len(data) <= KEPT_PART and self._kept + len(data) <= KEPT_ALL:
                self._trees[name] = found
                self._kept += len(data)
        return found

    def _data(self, name: str) -> bytes:
        """The bytes of a part. What is sound and plain is taken from where it lies; zipfile reads the rest, and says what is wrong."""
        info = self.zip.getinfo(name)
        at, end = info.header_offset, getattr(info, "_end_offset", None)
        if name.isascii() and name == info.orig_filename and info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.flag_bits & ~0x0806 and self.raw[at : at + 4] == b"PK\3\4" and end is not None:
            n, more = _LENGTHS(self.raw, at + 26)
            start = at + 30 + n + more
            if self.raw[at + 30 : at + 30 + n] == name.encode() and start + info.compress_size <= end:
                data = self.raw[start : start + info.compress_size]
                try:
                    data = zlib.decompressobj(-15).decompress(data, info.file_size + 1) if info.compress_type else data
                except zlib.error:
                    data = b""
                if len(data) == info.file_size and zlib.crc32(data) == info.CRC:
                    return data
        return self.zip.read(name)

    def root(self, part: str | None) -> ET.Element:
        """Root of a part that the document cannot do without: it fails if it is absent or broken."""
        name = self._name(part)
        try:
            return self._tree(name)
        except (ET.ParseError, zipfile.BadZipFile, zlib.error) as e:
            raise ValueError(f"the part {part} cannot be read: {e}") from None

    def _name(self, part: str | None) -> str:
        if not part or not self.has(part):
            raise ValueError(f"the part {part or 'of the document'} is missing")
        return self.names[part.lower()]

    def large(self, part: str | None) -> bool:
        return bool(part) and self.has(part) and self.zip.getinfo(self.names[part.lower()]).file_size > TREE_BYTES

    def top(self, part: str) -> str:
        """The name of the root of a part."""
        try:
            with self.zip.open(self._name(part)) as f:
                return next(local(e) for _, e in ET.iterparse(f, ("start",)))
        except (ET.ParseError, zipfile.BadZipFile, zlib.error, StopIteration) as e:
            raise ValueError(f"the part {part} cannot be read: {e}") from None

    def pull(self, part: str | None, *names: str) -> Iterator[ET.Element]:
        """The elements of these names, one after the other, each gone when the next is asked for. It fails where the part is broken."""
        above: list[ET.Element] = []
        inside = 0
        try:
            with self.zip.open(self._name(part)) as f:
                for event, e in ET.iterparse(f, ("start", "end")):
                    if event == "start":
                        above.append(e)
                        inside += local(e) in names
                        continue
                    above.pop()
                    if local(e) in names:
                        inside -= 1
                        yield e
                    if not inside and above:
                        del above[-1][-1]
        except (ET.ParseError, zipfile.BadZipFile, zlib.error) as e:
            raise ValueError(f"the part {part} cannot be read: {e}") from None

    def elements(self, part: str, *names: str) -> Iterator[ET.Element]:
        """The elements of these names of a part that must be there, from its tree unless that is large."""
        return self.pull(part, *names) if self.large(part) else named(self.root(part), *names)

    def holds(self, part: str, word: bytes) -> bool:
        """Whether the bytes of a part hold a word."""
        with self.zip.open(self._name(part)) as f:
            tail = b""
            while block := f.read(1 << 20):
                if word in tail + block:
                    return True
                tail = block[-len(word) :]
        return False

    def rels(self, part: str) -> list[tuple[str, str, str, bool]]:
        """(id, kind, target, external) of the relationships of a part; "" is the package."""
        if part not in self._rels:
            folder, where = _where(part)
            root = self.xml(where) if self.has(where) else None
            out = []
            for e in root if root is not None else ():
                external = e.get("TargetMode") == "External"
                target = e.get("Target", "")
                if not external:
                    target = _reached(folder, target)
                out.append((e.get("Id", ""), e.get("Type", "").rpartition("/")[2], target, external))
            self._rels[part] = out
        return self._rels[part]

    def related(self, part: str, kind: str) -> list[str]:
        return [t for _, k, t, ext in self.rels(part) if k == kind and not ext and self.has(t)]

    def target(self, part: str, rel_id: str | None) -> str | None:
        return next((t for i, _, t, ext in self.rels(part) if i == rel_id and not ext and self.has(t)), None)

    def main(self) -> str | None:
        return next(iter(self.related("", "officeDocument")), None)

    def parts(self) -> list[str]:
        """All parts that relationships reach, each once, depth first."""
        if self._parts is not None:
            return self._parts
        seen: dict[str, str] = {}
        todo = [t for _, _, t, ext in reversed(self.rels("")) if not ext]
        while todo:
            part = todo.pop()
            if part.lower() in seen or not self.has(part):
                continue
            seen[part.lower()] = part
            todo += [t for _, _, t, ext in reversed(self.rels(part)) if not ext]
        self._parts = list(seen.values())
        return self._parts

    def content(self, part: str) -> ET.Element | None:
        """Root of a part whose content type is XML."""
        return self.xml(part) if "xml" in self.kind(part).lower() else None


def properties(p: Package, o: Options) -> Iterator[Piece]:
    values: dict[str, str] = {}
    for kind in ("core-properties", "extended-properties"):
        for part in p.related("", kind):
            root = p.xml(part)
            for e in root if root is not None else ():
                values.setdefault(local(e), inner(e))
    return numbered((values.get(k) for k in PROPERTIES), o.labels["properties"])


def hyperlinks(p: Package, o: Options) -> Iterator[Piece]:
    return numbered((t for part in p.parts() for _, k, t, ext in p.rels(part) if k == "hyperlink" and ext), o.labels["hyperlink"])


def alternative_text(p: Package, o: Options) -> Iterator[Piece]:
    def values() -> Iterator[str | None]:
        for part in p.parts():
            if p.large(part):  # without its tree
                found = p.pull(part, "docPr", "cNvPr") if "xml" in p.kind(part).lower() and (p.holds(part, b"docPr") or p.holds(part, b"cNvPr")) else ()
            else:
                root = p.content(part)
                found = named(root, "docPr", "cNvPr") if root is not None else ()
            for e in found:
                yield e.get("descr")
                yield e.get("title")

    return numbered(values(), o.labels["alt_text"])


def paragraphs(root: ET.Element, family: str) -> Iterator[str]:
    """Texts of the paragraphs of a family of markup ("drawingml", "wordprocessingml")."""
    for e in named(root, "p"):
        if family in namespace(e).lower():
            runs = [inner(t) for t in named(e, "t")]
            yield "".join(runs) if runs or family != "drawingml" else inner(e)


def numbered_paragraphs(texts: Iterator[str], sheet: str | None, obj: str | None) -> Iterator[Piece]:
    """Paragraphs that are not blank, numbered without the blank ones."""
    for n, t in enumerate((t for t in texts if not blank(t)), 1):
        yield Piece(t, n, sheet, None, obj)


def part_paragraphs(p: Package, wanted: Callable[[str], bool], obj: str) -> Iterator[Piece]:
    for part in p.parts():
        if wanted(p.kind(part).lower()):
            root = p.content(part)
            if root is not None:
                yield from numbered_paragraphs(paragraphs(root, "drawingml"), None, obj)


def charts(p: Package, o: Options) -> Iterator[Piece]:
    return part_paragraphs(p, lambda k: "chart" in k, o.labels["table_chart"])


def smart_art(p: Package, o: Options) -> Iterator[Piece]:
    return part_paragraphs(p, lambda k: "diagram" in k, o.labels["smart_art"])


def threaded_comments(p: Package, o: Options) -> Iterator[Piece]:
    n = 0
    for part in p.parts():
        if "threadedcomment" in p.kind(part).lower():
            root = p.content(part)
            for e in named(root, "text", "t") if root is not None else ():
                if not blank(inner(e)):
                    n += 1
                    yield Piece(inner(e), 0, None, None, f"{o.labels['comment']}{n}")


def clean_header_footer(text: str) -> str:
    return re.sub("(?i)&[LCRPNDTFA]", " ", text).strip()


def sheet_header_footer(elements: Iterable[ET.Element], sheet: str, o: Options) -> Iterator[Piece]:
    """elements: those of a sheet, of which some hold its headers and footers."""
    texts = (clean_header_footer(inner(e)) for e in elements if local(e).lower() in HEADER_FOOTER)
    return numbered(texts, o.labels["header_footer"], sheet)


def word_text_boxes(root: ET.Element, o: Options) -> Iterator[Piece]:
    """Paragraphs of the text boxes of a part, a number for each box, then its drawing paragraphs, a number each."""
    shape = o.labels["shape"]
    n = 0
    for n, box in enumerate(named(root, "txbxContent"), 1):
        for text in paragraphs(box, "wordprocessingml"):
            if not blank(text):
                yield Piece(text, 0, None, None, f"{shape}{n}")
    for m, text in enumerate((t for t in paragraphs(root, "drawingml") if not blank(t)), n + 1):
        yield Piece(text, 0, None, None, f"{shape}{m}")
