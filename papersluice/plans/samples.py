"""Small files in the formats that the extractors read, put together byte by byte, for queries and tests."""

import io
import struct
import zipfile
import zlib

W = 'xmlns:w="urn:w"'


def package(parts: dict[str, bytes | str], stored: tuple[str, ...] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx() -> bytes:
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>First line</w:t><w:tab/><w:t>after tab</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t><w:br/><w:t>third 预算</w:t></w:r></w:p></w:body></w:document>"
    return package({"word/document.xml": body, "word/footnotes.xml": f"<w:f {W}><w:p><w:t>a note</w:t></w:p></w:f>", "word/header2.xml": f"<w:h {W}><w:p><w:t>top</w:t></w:p></w:h>"})


def xlsx() -> bytes:
    shared = "<sst><si><t>name</t></si><si><r><t>par</t></r><r><t>ts</t></r><rPh><t>no</t></rPh></si></sst>"
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>9</v></c></row><row><c><v>12.5</v></c><c t="inlineStr"><is><t>inline</t></is></c></row></sheetData></worksheet>'
    return package({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet})


def pptx() -> bytes:
    def slide(text: str) -> str:
        return f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:r><a:t>{text}</a:t></a:r><a:fld><a:t>7</a:t></a:fld></a:p></p:sld>'

    return package({f"ppt/slides/slide{n}.xml": slide(f"slide {n}") for n in (10, 2, 1)})


def ofd() -> bytes:
    def page(text: str) -> str:
        return f"<Page><TextObject><TextCode>{text}</TextCode></TextObject></Page>"

    return package({"OFD.xml": "<OFD/>", "Doc_0/Document.xml": "<D/>", "Doc_0/Pages/Page_10/Content.xml": page("tenth"), "Doc_0/Pages/Page_2/Content.xml": page("second")})


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams in the root, all in normal sectors."""
    size, chains, sectors = 512, [], []
    for body in streams.values():
        body = body + bytes(max(0, 4096 - len(body)))  # no small sectors
        chains.append((len(sectors), len(body)))
        sectors += [body[i : i + size].ljust(size, b"\0") for i in range(0, len(body), size)]

    def node(name: str, kind: int, right: int, child: int, start: int, length: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) if name else 0, kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, length)

    nodes = [node("Root Entry", 5, 0xFFFFFFFF, 1 if streams else 0xFFFFFFFF, 0xFFFFFFFE, 0)]
    for i, (name, (start, length)) in enumerate(zip(streams, chains), 1):
        nodes.append(node(name, 2, i + 1 if i < len(streams) else 0xFFFFFFFF, 0xFFFFFFFF, start, length))
    while len(nodes) % 4:
        nodes.append(bytes(128))
    directory = len(sectors)
    raw = b"".join(nodes)
    sectors += [raw[i : i + size] for i in range(0, len(raw), size)]
    fat = [0xFFFFFFFF] * len(sectors)
    for start, length in [*chains, (directory, len(raw))]:
        n = -(-length // size)
        for j in range(n):
            fat[start + j] = start + j + 1 if j + 1 < n else 0xFFFFFFFE
    fat_at = len(sectors)
    n_fat = -(-(len(fat) + 2) // 128)
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(size * n_fat, b"\xff")
    sectors += [table[i : i + size] for i in range(0, len(table), size)]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *[fat_at + i if i < n_fat else 0xFFFFFFFF for i in range(109)])
    return head + b"".join(sectors)


def doc(encrypted: bool = False) -> bytes:
    wide, narrow = "宽字符 text\r".encode("utf-16-le"), b"narrow \x13 PAGE \x14result\x15 end\x07"
    main = bytearray(0x400)
    struct.pack_into("<HH", main, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", main, 0x0A, 0x0200 | (0x0100 if encrypted else 0))
    main += wide + narrow
    n1, n2 = len(wide) // 2, len(narrow)
    plc = struct.pack("<III", 0, n1, n1 + n2) + struct.pack("<HIH", 0, 0x400, 0) + struct.pack("<HIH", 0, (0x400 + len(wide)) * 2 | 0x40000000, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(main), "1Table": clx})


def ppt() -> bytes:
    def record(kind: int, body: bytes, container: bool = False) -> bytes:
        return struct.pack("<HHI", 0xF if container else 0, kind, len(body)) + body

    body = record(0x03EE, record(0x0FA0, "标题 one".encode("utf-16-le")) + record(0x0FA8, "正文".encode("gb18030") * 4), True)
    return compound({"PowerPoint Document": body})


def xls() -> bytes:
    def record(kind: int, body: bytes) -> bytes:
        return struct.pack("<HH", kind, len(body)) + body

    def label(s: str) -> bytes:
        return struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")

    strings = ["名称", "amount"]
    sst = struct.pack("<II", 2, 2) + b"".join(label(s) for s in strings)
    head = record(0x809, struct.pack("<HH", 0x600, 5) + bytes(12)) + record(0xE0, bytes(20)) + record(0xE0, struct.pack("<HH", 0, 14) + bytes(16)) + record(0xFC, sst)
    sheet = record(0x809, struct.pack("<HH", 0x600, 0x10) + bytes(12))
    sheet += record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1))
    sheet += record(0x203, struct.pack("<HHHd", 1, 0, 0, 12345.5)) + record(0x203, struct.pack("<HHHd", 1, 1, 1, 45000.0)) + record(0x27E, struct.pack("<HHHI", 2, 0, 0, 7 << 2 | 2)) + record(0x0A, b"")
    end = record(0x0A, b"")
    at = len(head) + len(record(0x85, struct.pack("<IHBB", 0, 0, 1, 0) + b"S")) + len(end)
    return compound({"Workbook": head + record(0x85, struct.pack("<IHBB", at, 0, 1, 0) + b"S") + end + sheet})


def wps() -> bytes:
    return compound({"Contents": b"\x01\x02\x03" * 5 + "水库巡检表 第一版".encode("gb18030") + b"\x00\x00" + "内部评审通过".encode("gb18030") + b"\x05\x00" * 9})


def pdf() -> bytes:
    return b"%PDF-1.4\n1 0 obj\n<< /Length 44 >>\nstream\nBT /F1 12 Tf 72 720 Td (Hello \\(world\\)) Tj ET\nendstream\nendobj\n%%EOF"


def pdf_pages() -> bytes:
    """Two pages whose content lies in the other order, the second in a font of mapped codes; the page tree lies in an object stream."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n2 beginbfchar <0001> <9884> <0002> <7B97> endbfchar\n1 beginbfrange <0010> <0012> <0061> endbfrange"
    tree = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>")]
    inner, body = b"", b""
    for number, text in tree:
        inner += b"%d %d " % (number, len(body))
        body += text + b" "
    packed = zlib.compress(inner + body)
    parts = [
        (7, _stream(b"BT /F2 12 Tf 72 700 Td <00010002> Tj 0 -14 Td [<0010> -300 <0011>] TJ ET")),
        (6, _stream(b"BT /F1 12 Tf 72 700 Td (caf\\351 one) Tj 40 0 Td ( still) Tj ET")),
        (3, b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << /F1 8 0 R >> >> >>"),
        (4, b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R] /Resources << /Font << /F2 9 0 R >> >> >>"),
        (8, b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"),
        (9, b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>"),
        (10, _stream(cmap)),
        (11, b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(inner), len(packed), packed)),
    ]
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in parts) + b"%%EOF"


def _stream(body: bytes) -> bytes:
    packed = zlib.compress(body)
    return b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)


def docx_with_type() -> bytes:
    """A document whose main part declares a document type."""
    return package({"word/document.xml": '<!DOCTYPE d [<!ENTITY e "x">]><d><p><t>&e;</t></p></d>', "[Content_Types].xml": "<Types/>"})
