from gleaner.sources import encoding
from gleaner.sources import writers as samples
from gleaner.sources.formats import doc, docx, pdf, ppt, pptx, text, xls, xlsx
from gleaner.sources.formats.base import Options, blank
from gleaner.sources.readers import read_pieces

O = Options()


def rows(pieces):
    return [(p.content, p.line, p.sheet, p.cell, p.obj) for p in pieces]


def test_text_lines():
    got = rows(text.read(b"a\r\nb\rc\n\n  \nd", O))
    assert [(c, n) for c, n, *_ in got] == [("a", 1), ("b", 2), ("c", 3), ("d", 6)]


def test_blank_characters():
    assert all(blank(c) for c in (" ", "\xa0", "　", "\x85", "", None))
    assert not any(blank(c) for c in ("\x1c", "​", "x"))


def test_encodings():
    t = "日本語のテキスト、カナ"
    for e, want in (("utf-8", "utf-8"), ("utf-8-sig", "utf-8-sig"), ("cp932", "cp932"), ("utf-16", "utf-16"), ("utf-32", "utf-32")):
        assert encoding.detect(t.encode(e)) == want
        assert encoding.decode(t.encode(e)).strip("﻿") == t
    assert encoding.detect(b"") == encoding.detect(b"a") == encoding.detect(b"plain") == "utf-8"
    for pad in range(3):  # a character is cut at the border of the probe; Å (C3 85) before another is not valid in Shift_JIS
        long = (" " * pad + "日Å" * 3000).encode()
        assert encoding.detect(long[:4096], False) == "utf-8"
    assert encoding.detect("日".encode() * 5) == "cp932"  # valid as both, and more Japanese characters as Shift_JIS


def test_xlsx_values():
    got = rows(xlsx.read(samples.xlsx(), O))
    assert ("My title", 0, None, None, "Document Properties1") in got and ("Me", 0, None, None, "Document Properties2") in got
    assert ("http://example.org/x", 0, None, None, "Hyperlink1") in got
    assert ("picture of x", 0, None, None, "Alt Text1") in got and ("t", 0, None, None, "Alt Text2") in got
    assert ("chart title", 1, None, None, "Table/Chart") in got
    assert ("Top", 0, "First", None, "Header/Footer1") in got
    cells = {c: (v, n) for v, n, s, c, o in got if c and o is None}
    assert cells == {"A1": ("shared", 1), "B1": ("inline", 1), "C1": ("TRUE", 1), "A3": ("2024/01/01 12:00:00", 3), "B3": ("12.5", 3), "C3": ("7", 3), "D3": ("1", 3)}
    assert ("remark", 0, "First", "B1", "Comment") in got
    assert ("shape text", 0, "First", None, "Shape1") in got


def test_xlsx_formulas():
    got = rows(xlsx.read(samples.xlsx(), Options(formulas=True)))
    assert [(v, c) for v, _, _, c, o in got if c and o is None] == [("=SUM(A1:A2)", "C3")]


def test_date_formats():
    assert xlsx.is_date_format(14, None) and xlsx.is_date_format(165, "yyyy") and not xlsx.is_date_format(165, '"day"0') and not xlsx.is_date_format(1, "d")
    assert not xlsx.is_date_format(164, "[Red]0.00")


def test_docx():
    got = rows(docx.read(samples.docx(), O))
    assert ("one", 1, None, None, None) in got and ("three", 3, None, None, None) in got
    assert got.count(("boxed", 0, None, None, "Shape1")) == 2  # as a VML shape and as a text box
    assert ("head", 0, None, None, "Header2") in got and ("foot", 0, None, None, "Footer1") in got and ("said", 0, None, None, "Comment1") in got


def test_pptx():
    got = rows(pptx.read(samples.pptx(), O))
    assert got == [
        ("master", 1, "Slide Master1", None, "Shape"), ("layout", 1, "Slide Layout1", None, "Shape"), ("first shown", 1, "Slide1", None, "Shape1"),
        ("a", 1, "Slide2", None, "Title 1"), ("b", 2, "Slide2", None, "Title 1"), ("c", 1, "Slide2", None, "Shape2"), ("cell", 1, "Slide2", None, "Table/Chart"),
        ("note one", 1, "Slide2", None, "Note"), ("note two", 2, "Slide2", None, "Note"), ("remark", 0, "Slide2", None, "Comment1"),
    ]


def test_doc():
    got = rows(doc.read(samples.doc(), O))
    assert got == [("one", 1, None, None, None), ("shown two\t", 3, None, None, None), ("head", 1, None, None, "Header/Footer"), ("remark", 1, None, None, "Comment"), ("boxed Ж", 1, None, None, "Shape")]


def test_ppt():
    got = rows(ppt.read(samples.ppt(), O))
    assert got == [
        ("before", 1, "DocumentInfo", None, "Shape1"), ("one", 1, "Slide1", None, "Shape1"), ("two", 3, "Slide1", None, "Shape1"), ("three", 1, "Slide1", None, "Shape2"),
        ("remark", 0, "Slide1", None, "Comment1"), ("noted", 1, "Slide1", None, "Note"),
    ]


def test_xls():
    got = rows(xls.read(samples.xls(), O))
    assert got == [
        ("shared", 1, "One", "A1", None), ("remark", 0, "One", "A1", "Comment"), ("splé", 1, "One", "B1", None), ("2024/01/01 12:00:00", 2, "One", "A2", None), ("7", 2, "One", "B2", None),
        ("9.5", 3, "One", "A3", None), ("TRUE", 3, "One", "B3", None), ("in shape", 0, "One", None, "Shape1"),
    ]
    assert [r[:4] for r in rows(xls.read(samples.xls(), Options(formulas=True)))][:2] == [("remark", 0, "One", "A1"), ("=SUM(A1:A2)", 3, "One", "A3")]


def test_pdf():
    got = rows(pdf.read(samples.pdf(), O))
    assert got[:5] == [("The Title", 0, None, None, "Document Properties1"), ("Me", 0, None, None, "Document Properties2"), ("Chapter (1)", 0, None, None, "Bookmark1"), ("http://x.org", 0, None, None, "Bookmark2"), ("name your name Ann", 0, "Page1", None, "Form Field1")]
    assert ("Hello world", 1, "Page1", None, None) in got and ("second page", 1, "Page2", None, None) in got
    assert ("http://link.org", 0, "Page1", None, "Hyperlink1") in got and ("http://link.org", 0, "Page1", None, "Comment1") in got
    assert ("free", 0, "Page1", None, "Shape1") in got and ("text", 0, "Page1", None, "Shape1") in got and ("note", 0, "Page1", None, "Comment2") in got


def lzw(data):
    """Codes of 9 to 12 bits, as PDF has them, with the early change of widths."""
    table, width, bits, w = {bytes([k]): k for k in range(256)}, 9, "", b""
    out = lambda code: f"{code:0{width}b}"
    bits, size = out(256), 258
    for c in data:
        c = bytes([c])
        if w + c in table:
            w += c
            continue
        bits += out(table[w])
        table[w + c], size, w = size, size + 1, c
        width = 9 + sum(size >= 1 << k for k in (9, 10, 11))
        if size >= 4094:
            bits += out(table[w]) + out(256)
            table, width, size, w = {bytes([k]): k for k in range(256)}, 9, 258, b""
    bits += (out(table[w]) if w else "")
    size += 1
    width = 9 + sum(size >= 1 << k for k in (9, 10, 11))
    bits += out(257)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_pdf_filters():
    import random

    rng = random.Random(1)
    data = bytes(rng.choice(b"abc ") for _ in range(9000))
    assert pdf._lzw(lzw(data), 1) == data and pdf._lzw(lzw(b"-----A---B"), 1) == b"-----A---B"
    assert pdf._run_length(b"\x02abc\xfex\x80junk") == b"abcxxx"


def pdf_with(font, shown):
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", b"<</Length %d>>stream\n%s\nendstream" % (len(shown), shown), font]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R>>\n%%EOF"


def test_pdf_fonts():
    text = lambda font, shown: [p if isinstance(p, Exception) else p.content for p in read_pieces(pdf_with(font, b"BT /F1 12 Tf 10 10 Td " + shown + b" Tj ET"), ".pdf", O)]
    assert text(b"<</Subtype/Type1/Encoding<</Differences[1/eacute/Scaron/quoteright/A/uni00DF/fi]>>>>", b"<010203040506>") == ["éŠ’AßﬁX".replace("ﬁX", "fi")]
    assert text(b"<</Subtype/Type0/Encoding/90ms-RKSJ-H>>", b"<" + "日本".encode("cp932").hex().encode() + b">") == ["日本"]
    assert text(b"<</Subtype/Type0/Encoding/UniJIS-UTF16-H>>", b"<" + "日本".encode("utf-16-be").hex().encode() + b">") == ["日本"]
    unknown = text(b"<</Subtype/Type0/Encoding/Identity-H>>", b"<00410042>")
    assert len(unknown) == 1 and "unknown codes" in str(unknown[0])


def test_damaged_files_end_with_a_failure():
    for ext, raw in ((".xlsx", samples.xlsx()), (".docx", samples.docx()), (".pptx", samples.pptx()), (".doc", samples.doc()), (".xls", samples.xls()), (".ppt", samples.ppt()), (".pdf", samples.pdf())):
        for n in (0, 10, len(raw) // 3, len(raw) - 30):
            list(read_pieces(raw[:n], ext, O))
        assert isinstance(list(read_pieces(b"junk", ext, O))[-1], Exception)


def test_ciphers():
    """Published test vectors."""
    from gleaner.sources.formats import pdfcrypt as C

    assert C.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and C.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(size))
        assert C.encrypt_cbc(key, bytes(16), block).hex() == want and C.decrypt_blocks(key, bytes.fromhex(want)).tobytes() == block
    key, start = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    text = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    sealed = C.encrypt_cbc(key, start, text)
    assert sealed.hex() == "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2" and C.decrypt_cbc(key, start, sealed) == text


def test_encrypted_pdfs():
    want = rows(pdf.read(samples.pdf(), O))
    for method in ("RC4", "AES-128", "AES-256", "AES-256-6"):
        raw = samples.pdf(method=method)
        assert b"The Title" not in raw and rows(pdf.read(raw, O)) == want, method
    import pytest

    with pytest.raises(ValueError, match="with a password"):
        list(pdf.read(samples.pdf(method="RC4").replace(b"/P -44", b"/P -45"), O))
    with pytest.raises(ValueError, match="encrypted by Other"):
        list(pdf.read(samples.pdf(method="AES-128").replace(b"/Filter/Standard", b"/Filter/Other"), O))


def test_broken_parts():
    """A broken main part is a failure, with what came before it; a broken extra is passed over."""
    for make, ext, parts in ((samples.xlsx, ".xlsx", ["xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/sst.xml", "xl/styles.xml"]), (samples.docx, ".docx", ["word/document.xml"]), (samples.pptx, ".pptx", ["ppt/presentation.xml", "ppt/slides/s1.xml"])):
        whole = list(read_pieces(make(), ext, O))
        for part in parts:
            got = list(read_pieces(samples.without_end(make(), part), ext, O))
            assert isinstance(got[-1], ValueError) and part in str(got[-1]) and 0 <= len(got) - 1 < len(whole), part
    got = list(read_pieces(samples.without_end(samples.xlsx(), "xl/comments1.xml"), ".xlsx", O))
    assert len(got) == len(list(read_pieces(samples.xlsx(), ".xlsx", O))) - 1 and not any(isinstance(p, Exception) for p in got)


def test_extras_of_workbooks():
    got = rows(xlsx.read(samples.xlsx(), O))
    assert ("art", 1, None, None, "SmartArt") in got and [r for r in got if r[0].startswith("said")] == [("said first", 0, None, None, "Comment1"), ("said then", 0, None, None, "Comment2")]


def test_parts_without_a_tree(monkeypatch):
    """Going through elements one by one gives what trees give."""
    from gleaner.sources.formats import ooxml

    want = {formulas: rows(xlsx.read(samples.xlsx(), Options(formulas=formulas))) for formulas in (False, True)}
    monkeypatch.setattr(ooxml, "TREE_BYTES", 0)
    assert {formulas: rows(xlsx.read(samples.xlsx(), Options(formulas=formulas))) for formulas in (False, True)} == want
    got = list(read_pieces(samples.without_end(samples.xlsx(), "xl/worksheets/sheet1.xml"), ".xlsx", O))
    assert isinstance(got[-1], ValueError) and "shared" in [p.content for p in got[:-1]]  # rows before the damage are kept


def test_sheet_of_a_million_rows():
    """In a process of its own, which stays under 500 MB."""
    import subprocess
    import sys

    code = """
import io, resource, zipfile
from gleaner.sources import writers
from gleaner.sources.formats import xlsx
from gleaner.sources.formats.base import Options
old, out = zipfile.ZipFile(io.BytesIO(writers.xlsx())), io.BytesIO()
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as new:
    for n in old.namelist():
        if n != "xl/worksheets/sheet1.xml":
            new.writestr(n, old.read(n))
    with new.open("xl/worksheets/sheet1.xml", "w") as f:
        f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        for lo in range(0, 1_000_000, 10_000):
            f.write(b"".join(b'<row r="%d"><c r="A%d" t="inlineStr"><is><t>text %d</t></is></c><c r="B%d"><v>%d</v></c></row>' % (k, k, k, k, k) for k in range(lo + 1, lo + 10_001)))
        f.write(b"</sheetData><headerFooter><oddHeader>&amp;CTop</oddHeader></headerFooter></worksheet>")
n = total = 0
for p in xlsx.read(out.getvalue(), Options()):
    if p.cell and not p.obj:
        n, total = n + 1, total + p.line
    top = p.content if p.obj == "Header/Footer1" else top if n else None
assert (n, total, top) == (2_000_000, 2 * sum(range(1_000_001)), "Top"), (n, total, top)
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 500_000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_composite_fonts():
    """Without a map to Unicode, text is told by the font's own table."""
    from gleaner.sources.formats import truetype

    for way in range(3):
        assert rows(pdf.read(samples.pdf_composite(way=way), O)) == [("Zeile 日本", 1, "Page1", None, None), ("second", 2, "Page1", None, None)], way
    glyphs = {"a": 5, "b": 9, "\u65e5": 700, "\U0001f600": 701}
    assert truetype.glyph_texts(samples.font_file(glyphs, 12)) == {g: c for c, g in glyphs.items()}
    del glyphs["\U0001f600"]
    assert truetype.glyph_texts(samples.font_file(glyphs)) == {g: c for c, g in glyphs.items()}
    whole = samples.font_file(glyphs)
    assert truetype.glyph_texts(b"") == truetype.glyph_texts(b"x" * 40) == {} and all(isinstance(truetype.glyph_texts(whole[:k]), dict) for k in range(len(whole)))
    import struct

    six = struct.pack(">HHHHI", 0, 1, 0, 3, 12) + struct.pack(">HHHHH3H", 6, 16, 0, 65, 3, 4, 0, 6)
    nought = struct.pack(">HHHHI", 0, 1, 3, 0, 12) + struct.pack(">HHH", 0, 262, 0) + bytes(range(256))
    head = struct.pack(">IHHHH", 0x00010000, 1, 16, 0, 0) + b"cmap"
    assert truetype.glyph_texts(head + struct.pack(">III", 0, 28, len(six)) + six) == {4: "A", 6: "C"}
    assert truetype.glyph_texts(head + struct.pack(">III", 0, 28, len(nought)) + nought)[66] == "B"
    broken = samples.pdf_composite().replace(b"/FontFile2 8 0 R", b"")
    assert "unknown codes" in str(list(read_pieces(broken, ".pdf", O))[-1])


def test_parts_of_a_package_are_parsed_once(monkeypatch):
    from gleaner.sources.formats import ooxml

    parsed, parse = [], ooxml.ET.fromstring
    monkeypatch.setattr(ooxml.ET, "fromstring", lambda raw: parsed.append(bytes(raw)) or parse(raw))
    for make, read in ((samples.xlsx, xlsx.read), (samples.docx, docx.read), (samples.pptx, pptx.read)):
        parsed.clear()
        assert rows(read(make(), O)) and len(parsed) == len(set(parsed))
    want = rows(xlsx.read(samples.xlsx(), O))
    monkeypatch.setattr(ooxml, "KEPT_ALL", 1000)  # what is not kept is parsed again
    assert rows(xlsx.read(samples.xlsx(), O)) == want


def test_strings_of_a_file_are_decrypted_together(monkeypatch):
    from gleaner.sources.formats import pdfcrypt as C

    calls, blocks = [], C.decrypt_blocks
    monkeypatch.setattr(C, "decrypt_blocks", lambda key, data: calls.append(len(data)) or blocks(key, data))
    want = rows(pdf.read(samples.pdf(), O))
    for method, most in (("AES-128", 1), ("AES-256", 2)):  # the key of a file is encrypted too
        calls.clear()
        assert rows(pdf.read(samples.pdf(method=method), O)) == want and len(calls) <= most
    keys, texts = [bytes([k]) * 16 for k in range(3)], [b"x" * n for n in (0, 5, 16, 40, 200)]
    sealed = [bytes(16) + C.encrypt_cbc(k, bytes(16), t + bytes([16 - len(t) % 16]) * (16 - len(t) % 16)) for k in keys for t in texts]
    monkeypatch.setattr(C, "ALONE", 100)
    monkeypatch.setattr(C, "TOGETHER", 150)
    assert C.aes([(k, d) for k, d in zip([k for k in keys for _ in texts], sealed, strict=True)] + [(keys[0], b"short")]) == texts * 3 + [b""]


def test_zeros_that_fill_a_stream_are_no_records():
    walk = ppt._Walk(Options())
    stream = ppt.CompoundFile(samples.ppt()).stream("PowerPoint Document")
    told = [kind for _, _, kind, _ in walk.records(stream)]
    assert len(stream) == 4096 and len(told) < 10 and told[:2] == [0x0FA8, 0x0FF0]
    filled = [kind for _, _, kind, _ in walk.records(bytes(19) + b"\1" + bytes(20) + b"\2" * 8)]  # what follows zeros stays where it was
    assert filled == [0x0100, 0x0202]


def test_strings_of_a_workbook_are_taken_whole(monkeypatch):
    """Only strings over the border of records are put together from pieces."""
    taken, old = [], xls._Strings.take
    monkeypatch.setattr(xls._Strings, "take", lambda self, n: taken.append(n) or old(self, n))
    assert [p.content for p in xls.read(samples.xls(), Options())][:3] == ["shared", "remark", "splé"]
    assert taken[0] == 3 and taken.count(3) == 1


def test_sectors_in_a_row_are_read_at_once(monkeypatch):
    from gleaner.sources.formats.cfb import CompoundFile

    f, read, old = CompoundFile(samples.doc()), [], CompoundFile._sectors
    monkeypatch.setattr(CompoundFile, "_sectors", lambda self, k, n: read.append(n) or old(self, k, n))
    assert len(f.stream("WordDocument")) == 4096 and read == [8]
    assert doc.clean("a\x07\x13 CODE \x14b\x01\tc\x15\x07") == "a\tb\tc\t"


def test_sound_parts_are_taken_from_where_they_lie(monkeypatch):
    """zipfile reads only what is not plain, and says what is wrong."""
    import zipfile

    asked, old = [], zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, *a: asked.append(name) or old(self, name, *a))
    raw = samples.xlsx()
    whole = list(xlsx.read(raw, Options()))
    assert not asked and len(whole) == 19
    part = raw.replace(b"shape </a:t>", b"shapE </a:t>")  # the sum of the part is wrong
    assert [p.content for p in read_pieces(part, ".xlsx", Options()) if not isinstance(p, Exception)] != [p.content for p in whole]
    assert set(asked) == {"xl/drawings/d.xml"}


def test_texts_are_told_apart_by_patterns(monkeypatch):
    """The same count as character by character; plain ASCII is not counted at all."""
    for c in map(chr, range(0x110000)):
        assert encoding.japanese_characters(c) == any(a <= ord(c) <= b for a, b in encoding.JAPANESE)
    ascii = bytes(range(128))
    assert ascii.decode(encoding.SHIFT_JIS) == ascii.decode("utf-8")
    assert encoding.japanese_characters("日Å本 x") == 2
    monkeypatch.setattr(encoding, "japanese_characters", lambda text: 1 / 0)
    assert encoding.detect(ascii * 40, False) == encoding.detect(ascii, True, True) == "utf-8"


def test_equal_parts_of_workbooks_share_a_tree():
    a, b = (xlsx.Package(samples.xlsx(lambda x, n=n: f"{x} {n}")) for n in "ab")
    assert a.xml("xl/styles.xml") is b.xml("xl/styles.xml")
    assert a.xml("xl/sst.xml") is not b.xml("xl/sst.xml")
    assert a.rels("xl/workbook.xml") == b.rels("xl/workbook.xml") and a.rels("xl/worksheets/sheet1.xml") != b.rels("xl/worksheets/sheet1.xml")
