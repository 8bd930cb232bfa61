"""Small files of each format, from literal parts: for tests, and for queries that read back what they wrote.

Every text of a file passes through `t`, so that files can be told apart. t must not add characters that a format escapes.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from functools import lru_cache

from .formats import pdfcrypt as crypt
from .formats.pdf import Lexer

RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
XDR = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"


def rels(*items):
    """items: (id, kind, target[, external])"""
    body = "".join(f'<Relationship Id="{i}" Type="{RELS}/{k}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if x else ""}/>' for i, k, t, *x in items)
    return f'<Relationships xmlns="{PKG}">{body}</Relationships>'


def package(parts, kinds=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        over = "".join(f'<Override PartName="/{n}" ContentType="{k}"/>' for n, k in kinds)
        z.writestr("[Content_Types].xml", f'<Types><Default Extension="xml" ContentType="application/xml"/>{over}</Types>')
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


def without_end(raw: bytes, part: str, by: int = 20) -> bytes:
    """A package in which the end of one part is missing."""
    old, out = zipfile.ZipFile(io.BytesIO(raw)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            data = old.read(n)
            new.writestr(n, data[:-by] if n == part else data)
    return out.getvalue()


Text = Callable[[str], str]


def plain(text: str) -> str:
    return text


def core(t: Text) -> str:
    return f'<p xmlns:dc="d"><dc:title> {t("My title")} </dc:title><dc:creator>{t("Me")}</dc:creator><dc:subject>{t("Me")}</dc:subject></p>'


def xlsx(t: Text = plain) -> bytes:
    sheet = f"""<worksheet xmlns="{MAIN}"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>{t('inline')}</t></is></c><c r="C1" t="b"><v>1</v></c></row>
<row r="3"><c r="A3" s="1"><v>45292.5</v></c><c r="B3"><v>12.5</v></c><c r="C3"><f>SUM(A1:A2)</f><v>7</v></c><c r="D3" s="2"><v>1</v></c></row>
</sheetData><headerFooter><oddHeader>&amp;C{t('Top')} &amp;P</oddHeader></headerFooter></worksheet>"""
    styles = f"""<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="&quot;d&quot;0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>"""
    drawing = f'<xdr:wsDr xmlns:xdr="{XDR}" xmlns:a="{A}"><xdr:sp><xdr:nvSpPr><xdr:cNvPr descr="{t("picture of x")}" title="{t("t")}"/></xdr:nvSpPr></xdr:sp><xdr:sp><xdr:txBody><a:p><a:r><a:t>shape </a:t></a:r><a:r><a:t>{t("text")}</a:t></a:r></a:p></xdr:txBody></xdr:sp></xdr:wsDr>'
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml"), ("r2", "core-properties", "docProps/core.xml")),
        "docProps/core.xml": core(t),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets><sheet name="First" r:id="s1"/><sheet name="Chart" r:id="s2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("s1", "worksheet", "worksheets/sheet1.xml"), ("s2", "chartsheet", "chartsheets/c.xml"), ("x", "sharedStrings", "sst.xml"), ("y", "styles", "styles.xml")),
        "xl/sst.xml": f'<sst xmlns="{MAIN}"><si><r><t>sha</t></r><r><t>{t("red")}</t></r></si></sst>',
        "xl/styles.xml": styles,
        "xl/chartsheets/c.xml": f'<chartsheet xmlns="{MAIN}"/>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("d", "drawing", "../drawings/d.xml"), ("c", "comments", "../comments1.xml"), ("tc", "threadedComment", "../threadedComments/t1.xml"), ("h", "hyperlink", "http://example.org/" + t("x").replace(" ", "/"), True)),
        "xl/drawings/d.xml": drawing,
        "xl/drawings/_rels/d.xml.rels": rels(("k", "chart", "../charts/chart1.xml"), ("a", "diagramData", "../diagrams/data1.xml")),
        "xl/diagrams/data1.xml": f'<dgm:dataModel xmlns:dgm="urn:dgm" xmlns:a="{A}"><dgm:t><a:p><a:r><a:t>{t("art")}</a:t></a:r></a:p><a:p/></dgm:t></dgm:dataModel>',
        "xl/threadedComments/t1.xml": f'<ThreadedComments><threadedComment ref="A1"><text>{t("said first")}</text></threadedComment><threadedComment ref="A1"><text>{t("said then")}</text></threadedComment></ThreadedComments>',
        "xl/charts/chart1.xml": f'<c xmlns:a="{A}"><a:p><a:r><a:t>{t("chart title")}</a:t></a:r></a:p></c>',
        "xl/comments1.xml": f'<comments xmlns="{MAIN}"><commentList><comment ref="B1"><text><t>{t("remark")}</t></text></comment></commentList></comments>',
    }
    kinds = [("xl/charts/chart1.xml", "application/vnd.openxmlformats-officedocument.drawingml.chart+xml"), ("xl/drawings/d.xml", "application/vnd.openxmlformats-officedocument.drawing+xml")]
    kinds += [("xl/diagrams/data1.xml", "application/vnd.openxmlformats-officedocument.drawingml.diagramData+xml"), ("xl/threadedComments/t1.xml", "application/vnd.ms-excel.threadedcomments+xml")]
    return package(parts, kinds)


def docx(t: Text = plain) -> bytes:
    p = lambda x: f"<w:p><w:r><w:t>{t(x)}</w:t></w:r></w:p>"
    body = f'{p("one")}<w:p/>{p("three")}<w:p><w:r><w:pict><v:shape xmlns:v="urn:schemas-microsoft-com:vml"><v:textbox><w:txbxContent>{p("boxed")}</w:txbxContent></v:textbox></v:shape></w:pict></w:r></w:p>'
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml"), ("r2", "core-properties", "docProps/core.xml")),
        "docProps/core.xml": core(t),
        "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(("h1", "header", "header1.xml"), ("h2", "header", "header2.xml"), ("f1", "footer", "footer1.xml"), ("c", "comments", "comments.xml")),
        "word/header1.xml": f'<w:hdr xmlns:w="{W}"/>',
        "word/header2.xml": f'<w:hdr xmlns:w="{W}">{p("head")}</w:hdr>',
        "word/footer1.xml": f'<w:ftr xmlns:w="{W}">{p("foot")}</w:ftr>',
        "word/comments.xml": f'<w:comments xmlns:w="{W}"><w:comment>{p("said")}</w:comment></w:comments>',
    }
    return package(parts)


def pptx(t: Text = plain) -> bytes:
    def sp(text, name=""):
        return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{t(x) if x else x}</a:t></a:r></a:p>" for x in text) + "</p:txBody></p:sp>"

    tree = lambda kind, inside: f'<p:{kind} xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{inside}</p:spTree></p:cSld></p:{kind}>'
    frame = f"<p:graphicFrame><a:graphic><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>{t('cell')}</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphic></p:graphicFrame>"
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{RELS}"><p:sldIdLst><p:sldId id="2" r:id="b"/><p:sldId id="1" r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("a", "slide", "slides/s1.xml"), ("b", "slide", "slides/s2.xml"), ("m", "slideMaster", "m.xml")),
        "ppt/m.xml": tree("sldMaster", sp(["master"])),
        "ppt/_rels/m.xml.rels": rels(("l", "slideLayout", "l.xml")),
        "ppt/l.xml": tree("sldLayout", sp(["layout"])),
        "ppt/slides/s1.xml": tree("sld", sp(["a", "", "b"], "Title 1") + sp(["c"]) + frame),
        "ppt/slides/s2.xml": tree("sld", sp(["first shown"])),
        "ppt/slides/_rels/s1.xml.rels": rels(("n", "notesSlide", "../n1.xml"), ("c", "comments", "../c1.xml")),
        "ppt/n1.xml": tree("notes", sp(["note one"]) + sp(["note two"])),
        "ppt/c1.xml": f'<p:cmLst xmlns:p="{P}"><p:cm><p:text>{t("remark")}</p:text></p:cm></p:cmLst>',
    }
    return package(parts)


def cfb(streams):
    """A compound file with all streams of 4096 bytes and more in sectors of 512."""
    sectors, fat, entries = [], [], []

    def put(data):
        n = max(1, -(-len(data) // 512))
        first = len(sectors)
        for k in range(n):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            fat.append(first + k + 1 if k < n - 1 else 0xFFFFFFFE)
        return first

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append((name, 2, put(data), len(data)))
    entries.insert(0, ("Root Entry", 5, 0xFFFFFFFE, 0))
    directory = b""
    for name, kind, start, size in entries:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", start, size) + b"\0" * 4
    first_dir = put(directory)
    where = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    assert len(table) == 512
    sectors.append(table)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, where) + b"\xff" * (108 * 4)
    return head.ljust(512, b"\0") + b"".join(sectors)


def doc(t: Text = plain, more: int = 0) -> bytes:
    """more: characters that the last region claims beyond the end of the text."""
    body = f"{t('one')}\r\r\x13 HYPERLINK x \x14shown\x15 {t('two')}\x07\r"
    header, comment, box = (t(x) + "\r" for x in ("head", "remark", "boxed Ж"))
    text = body + header + comment + box
    narrow = body + header + comment
    main = bytearray(4096)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, 0x0200)
    struct.pack_into("<8I", main, 0x4C, len(body), 0, len(header), 0, len(comment), 0, len(box) + more, 0)
    main[1024 : 1024 + len(narrow)] = narrow.encode("cp1252")
    main[2048 : 2048 + 2 * len(box)] = box.encode("utf-16-le")
    plc = struct.pack("<3I", 0, len(narrow), len(text)) + struct.pack("<HIH", 0, (1024 * 2) | 0x40000000, 0) + struct.pack("<HIH", 0, 2048, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x01A2, 0, len(clx))
    return cfb({"WordDocument": bytes(main), "1Table": clx})


def ppt(t: Text = plain) -> bytes:
    atom = lambda kind, data, instance=0: struct.pack("<HHI", instance << 4, kind, len(data)) + data
    box = lambda kind, data: struct.pack("<HHI", 0xF, kind, len(data)) + data
    comment = box(0x0FCC, atom(0x0FBA, "who".encode("utf-16-le"), 0) + atom(0x0FBA, t("remark").encode("utf-16-le"), 1))
    stream = atom(0x0FA8, t("before").encode("cp1252")) + box(0x0FF0, atom(0x0FA8, b"skipped")) + box(0x03EE, atom(0x0FA0, f"{t('one')}\r\r{t('two')}".encode("utf-16-le")) + atom(0x0FA8, t("three").encode("cp1252")) + comment) + box(0x03F0, atom(0x0FA8, t("noted").encode("cp1252")))
    return cfb({"PowerPoint Document": stream})


def xls(t: Text = plain) -> bytes:
    rec = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    uni = lambda x: struct.pack("<HB", len(x), 0) + x.encode("latin-1")
    bof = rec(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    sst = rec(0xFC, struct.pack("<II", 2, 2) + uni(t("shared")) + struct.pack("<HB", 2 + len(t("lé")), 0) + b"sp") + rec(0x3C, b"\x01" + t("lé").encode("utf-16-le"))
    fixed = rec(0xE0, struct.pack("<HH", 0, 0).ljust(20, b"\0")) + rec(0xE0, struct.pack("<HH", 0, 14).ljust(20, b"\0"))
    bound = lambda at: rec(0x85, struct.pack("<IH", at, 0) + b"\x03\x00One")
    start = len(bof) + len(fixed) + len(bound(0)) + len(sst) + 4
    tokens = b"\x25" + struct.pack("<HHHH", 0, 1, 0xC000, 0xC000) + b"\x22\x01" + struct.pack("<H", 4)
    txo = lambda x: rec(0x1B6, struct.pack("<HHHHHHHH", 0, 0, 0, 0, 0, len(t(x)), 0, 0)) + rec(0x3C, b"\0" + t(x).encode())
    obj = lambda kind, k: rec(0x5D, struct.pack("<HHHHH", 0x15, 18, kind, k, 0).ljust(22, b"\0"))
    sheet = (
        bof + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + rec(0x203, struct.pack("<HHHd", 1, 0, 1, 45292.5)) + rec(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2))
        + rec(0x06, struct.pack("<HHHdHIH", 2, 0, 0, 9.5, 0, 0, len(tokens)) + tokens) + rec(0x205, struct.pack("<HHHBB", 2, 1, 0, 1, 0))
        + obj(0x19, 1) + txo("remark") + obj(0x06, 2) + txo("in shape") + rec(0x1C, struct.pack("<HHHH", 0, 0, 0, 1)) + rec(0x0A, b"")
    )
    return cfb({"Workbook": bof + fixed + bound(start) + sst + rec(0x0A, b"") + sheet})


def pdf(t: Text = plain, method: str = "") -> bytes:
    """method: encrypted for the empty password by RC4, AES-128, AES-256 or AES-256-6 (revision 6)."""
    b = lambda x: t(x).encode("latin-1")
    packed = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello) Tj ( " + b("world") + b") Tj 0 -20 Td <41> Tj ET")
    second = b"BT 1 0 0 1 10 10 Tm (" + b("second page") + b") Tj ET"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R/Outlines 6 0 R/AcroForm<</Fields[9 0 R]>>>>",
        b"<</Type/Pages/Kids[3 0 R 10 0 R]/Count 2/Resources<</Font<</F1 5 0 R>>>>>>",
        b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Annots[8 0 R 9 0 R 12 0 R 13 0 R]>>",
        b"<</Length %d/Filter/FlateDecode>>stream\n" % len(packed) + packed + b"\nendstream",
        b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>",
        b"<</First 7 0 R>>",
        b"<</Title(Chapter \\(1\\) " + b("") + b")/A<</S/URI/URI(http://x.org)>>>>",
        b"<</Subtype/Link/Rect[0 0 10 10]/A<</S/URI/URI(http://link.org)>>>>",
        b"<</Subtype/Widget/FT/Tx/T(name)/TU(your name)/V(" + b("Ann") + b")>>",
        b"<</Type/Page/Parent 2 0 R/Contents 11 0 R>>",
        b"<</Length %d>>stream\n" % len(second) + second + b"\nendstream",
        b"<</Subtype/FreeText/Contents(free\\r" + b("text") + b")>>",
        b"<</Subtype/Text/Contents<FEFF006E006F00740065>>>",
        b"<</Title(" + b("The Title") + b")/Author(Me)/Producer(Me)>>",
    ]
    end = b"/Root 1 0 R/Info 14 0 R"
    if method:
        objects = encrypted(objects, method)
        end += b"/Encrypt %d 0 R/ID[<00112233><00112233>]" % len(objects)
    out = b"%PDF-1.4\n"
    for k, o in enumerate(objects, 1):
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    return out + b"trailer<<" + end + b">>\n%%EOF"


def font_file(glyphs: dict[str, int], kind: int = 4) -> bytes:
    """A font that has nothing but a `cmap` table, of format 4 or 12, from characters to glyphs."""
    codes = sorted((ord(c), g) for c, g in glyphs.items())
    if kind == 4:
        n = len(codes) + 1
        starts = [c for c, _ in codes] + [0xFFFF]
        deltas = [(g - c) & 0xFFFF for c, g in codes] + [1]
        body = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *starts) + b"\0\0" + struct.pack(f">{n}H", *starts) + struct.pack(f">{n}H", *deltas) + bytes(2 * n)
    else:
        body = struct.pack(">HHIII", 12, 0, 16 + 12 * len(codes), 0, len(codes)) + b"".join(struct.pack(">III", c, c, g) for c, g in codes)
    table = struct.pack(">HHHHI", 0, 1, 3, 1 if kind == 4 else 10, 12) + body
    return struct.pack(">IHHHH", 0x00010000, 1, 16, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(table)) + table


def pdf_composite(t: Text = plain, way: int = 0) -> bytes:
    """Text in a composite font without a map to Unicode. way: codes are glyphs; lead to glyphs by a table; or to CIDs by a CMap of the file."""
    shown = [t("Zeile 日本"), t("second")]
    glyphs = {c: k for k, c in enumerate(sorted(set("".join(shown))), 3)}
    code = {c: g if way == 0 else 300 - g if way == 1 else 500 + g for c, g in glyphs.items()}
    table = bytearray(602)
    for c, g in glyphs.items():
        if way == 1:
            struct.pack_into(">H", table, 2 * code[c], g)
    text = b"BT /F1 12 Tf 72 700 Td <%b> Tj 0 -20 Td <%b> Tj ET" % tuple("".join(f"{code[c]:04X}" for c in x).encode() for x in shown)
    font = zlib.compress(font_file(glyphs, 12 if way == 1 else 4))
    cmap = b"1 begincidrange <%04X> <%04X> %d endcidrange" % (503, 503 + len(glyphs), 3)
    stream = lambda raw, more=b"": b"<</Length %d%b>>stream\n" % (len(raw), more) + raw + b"\nendstream"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", stream(text),
        b"<</Type/Font/Subtype/Type0/BaseFont/X/Encoding %b/DescendantFonts[6 0 R]>>" % (b"9 0 R" if way == 2 else b"/Identity-H"),
        b"<</Type/Font/Subtype/CIDFontType2/BaseFont/X/FontDescriptor 7 0 R/CIDToGIDMap %b>>" % (b"10 0 R" if way == 1 else b"/Identity"),
        b"<</Type/FontDescriptor/FontName/X/FontFile2 8 0 R>>", stream(font, b"/Filter/FlateDecode"), stream(cmap), stream(bytes(table)),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + o + b"\nendobj\n" for k, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R>>\n%%EOF"


@lru_cache
def _handler(method: str) -> tuple[bytes, bytes]:
    """The key of a file, and the dictionary that says how it is encrypted."""
    first_id, key32, salts = bytes.fromhex("00112233"), hashlib.sha256(b"key").digest(), b"validatekey salt"
    old = {"RC4": b"/V 2/R 3/Length 128", "AES-128": b"/V 4/R 4/Length 128/CF<</StdCF<</CFM/AESV2/Length 16>>>>/StmF/StdCF/StrF/StdCF"}
    if method in old:
        owner, rights = bytes(range(32)), -44
        key = hashlib.md5(crypt.PAD + owner + struct.pack("<i", rights) + first_id).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        user = hashlib.md5(crypt.PAD + first_id).digest()
        for k in range(20):
            user = crypt.rc4(bytes(x ^ k for x in key), user)
        head = b"<</Filter/Standard%b/O<%b>/U<%b>/P %d>>" % (old[method], owner.hex().encode(), (user + bytes(16)).hex().encode(), rights)
    else:
        key = key32
        told = crypt.hash_6 if method.endswith("-6") else lambda password, salt: hashlib.sha256(password + salt).digest()
        user = told(b"", salts[:8]) + salts
        sealed = crypt.encrypt_cbc(told(b"", salts[8:]), bytes(16), key)
        head = b"<</Filter/Standard/V 5/R %d/Length 256/CF<</StdCF<</CFM/AESV3/Length 32>>>>/StmF/StdCF/StrF/StdCF/O<00>/U<%b>/UE<%b>/P -44>>" % (6 if method.endswith("-6") else 5, user.hex().encode(), sealed.hex().encode())
    return key, head


def encrypted(objects: list[bytes], method: str) -> list[bytes]:
    """The objects with their strings and streams encrypted, and the dictionary that says how."""
    key, head = _handler(method)

    def sealed_by(number: int, data: bytes) -> bytes:
        start = hashlib.md5(b"%d" % number).digest()
        padded = data + bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
        if method.startswith("AES-256"):
            return start + crypt.encrypt_cbc(key, start, padded)
        own = hashlib.md5(key + struct.pack("<I", number)[:3] + b"\0\0" + (b"sAlT" if method == "AES-128" else b"")).digest()
        return crypt.rc4(own, data) if method == "RC4" else start + crypt.encrypt_cbc(own, start, padded)

    out = []
    for number, o in enumerate(objects, 1):
        front, stream, raw = o.partition(b"stream\n")
        strings = re.compile(rb"\((?:\\.|[^()\\])*\)|(?<!<)<[0-9A-F]+>", re.DOTALL)
        front = strings.sub(lambda m, number=number: b"<%b>" % sealed_by(number, Lexer(m[0]).value()).hex().encode(), front)
        if stream:
            raw = sealed_by(number, raw.removesuffix(b"\nendstream"))
            front = re.sub(rb"/Length \d+", b"/Length %d" % len(raw), front)
            front += stream + raw + b"\nendstream"
        out.append(front)
    return [*out, head]
