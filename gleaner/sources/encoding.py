"""Encoding of a text file from its first bytes."""

from __future__ import annotations

import codecs
import re

PROBE_BYTES = 4096
#: Byte order marks, in the order in which they are tried.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Hiragana, katakana, common ideographs, full and half width forms.
JAPANESE = ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF))
SHIFT_JIS = "cp932"


_JAPANESE = re.compile("[%s]" % "".join(f"{chr(a)}-{chr(b)}" for a, b in JAPANESE))


def japanese_characters(text: str) -> int:
    return len(_JAPANESE.findall(text))


def _probe(raw: bytes, encoding: str, whole: bool, strict_probe: bool) -> bool:
    """Whether the bytes are valid; a character cut off at the end of a probe does not count against it."""
    try:
        if strict_probe and not whole:
            raw.decode(encoding, "strict")
        else:
            codecs.getincrementaldecoder(encoding)("strict").decode(raw, whole)
    except UnicodeDecodeError:
        return False
    return True


def detect(head: bytes, whole: bool = True, strict_probe: bool = False) -> str:
    """Name of the encoding. head: the first PROBE_BYTES of the file; whole: there are no more.

    A mark decides. Else what is valid as UTF-8 or as Shift_JIS only is that; what is both or neither goes to the one
    with more Japanese characters, and to UTF-8 if they are equal. strict_probe drops four bytes at the end of a probe
    without looking for the border of a character, and so takes some long Japanese texts for Shift_JIS.
    """
    if len(head) < 2 or head.isascii():  # ASCII is the same in both, and without a mark
        return "utf-8"
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    probe = head[:-4] if strict_probe and not whole else head
    utf8, sjis = (_probe(probe, e, whole, strict_probe) for e in ("utf-8", SHIFT_JIS))
    if utf8 != sjis:
        return "utf-8" if utf8 else SHIFT_JIS
    counts = [japanese_characters(probe.decode(e, "replace")) for e in ("utf-8", SHIFT_JIS)]
    return SHIFT_JIS if counts[1] > counts[0] else "utf-8"


def decode(raw: bytes, strict_probe: bool = False) -> str:
    return raw.decode(detect(raw[:PROBE_BYTES], len(raw) <= PROBE_BYTES, strict_probe), "replace")
