import struct
import zipfile

from papersluice.plans import samples as fx
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papersluice.functions import router
from papersluice.functions.encoding import decode, is_utf8
from papersluice.functions.extract import archive, biff, extract, register_extractor
from papersluice.functions.extract.ole2 import clean_word
from papersluice.functions.extract.package import Package, entry_name

BIG = 1 << 20


@pytest.mark.parametrize(
    "text,codec,label",
    [
        ("编码检测：中文内容", "gb18030", "GB18030"), ("带标记", "utf-8-sig", "UTF-8"), ("naïve 文本", "utf-8", "UTF-8"), ("plain ascii text", "ascii", "ASCII"),
        ("目录与文件，全部为中文的一段文字。", "utf-16-le", "UTF-16LE"), ("plain ascii text", "utf-16-le", "UTF-16LE"), ("plain ascii text", "utf-16-be", "UTF-16BE"),
        ("目录与文件，全部为中文的一段文字。", "utf-16-be", "UTF-16BE"), ("扩展𠮷字", "gb18030", "GB18030"),
    ],
)
def test_decode(text, codec, label):
    assert decode(text.encode(codec)) == (text, label)


def test_decode_marks_and_edges():
    assert decode(b"") == decode(None) == ("", "ASCII")
    assert decode(b"\xff\xfe\x00\x00" + "a".encode("utf-32-le")) == ("a", "UTF-32LE")
    assert decode(b"\xfe\xff" + "标".encode("utf-16-be")) == ("标", "UTF-16BE")
    assert is_utf8("中".encode()[:2]) and not is_utf8(b"\xc0\xaf") and not is_utf8(b"\xf4\x90\x80\x80") and is_utf8(b"\xed\xa0\x80")
    for n in range(1, 9):
        assert decode(b"abcdefgh"[:n]).encoding == "ASCII"
        assert decode(b"abcdefgh"[:n], compat=True).encoding == ("UTF-16LE" if n < 8 else "ASCII")


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_decode_utf8_roundtrip(text):
    raw = text.encode("utf-8", "ignore")
    if not raw.isascii() and not any(raw.startswith(m) for m in (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        assert decode(raw) == (raw.decode(), "UTF-8")


def test_routes():
    assert len(router.EXTENSIONS) == 54 and len(router.ROUTES["text"]) == 39
    assert router.route_all(".wps") == ["ooxml", "ole2"] and router.route(".PDF") == "pdf" and router.route(".exe") is None
    assert [router.label(e) for e in (".docx", ".et", ".ppt", ".zip", ".md", ".exe", None)] == ["Word", "Excel", "PPT", "压缩包", "文本", "其他", "其他"]
    assert router.extension("/a.b/C.TXT") == ".txt" and router.extension("/a.b/c") == ""


@pytest.mark.parametrize(
    "ext,data,text",
    [
        (".docx", fx.docx(), "First line\tafter tab\nsecond\nthird 预算\na note\ntop"),
        (".xlsx", fx.xlsx(), "name\tparts\n\t12.5\tinline\n\n"),
        (".pptx", fx.pptx(), "slide 1\nslide 2\nslide 10\n"),
        (".wps", fx.docx(), "First line\tafter tab\nsecond\nthird 预算\na note\ntop"),
        (".ofd", fx.ofd(), "second\ntenth\n"),
        (".doc", fx.doc(), "宽字符 text\nnarrow result end\t"),
        (".xls", fx.xls(), "名称\tamount\n12345.5\t3/15/23\n7\n"),
        (".ppt", fx.ppt(), "标题 one正文正文正文正文"),
        (".wps", fx.wps(), "水库巡检表 第一版\n内部评审通过"),
        (".pdf", fx.pdf(), "Hello (world)\n"),
        (".txt", b"a longer line of text\0b", "a longer line of textb"),
    ],
)
def test_formats(ext, data, text):
    got = extract(ext, data, BIG)
    assert got.ok and got.error is None
    assert got.text.rstrip("\0") == text
    assert extract(ext, data, 5).text == text[:5]


def test_failures():
    assert not extract(".docx", fx.package({"readme.txt": "x"}), BIG).ok
    assert extract(".docx", fx.package({}), BIG).text == ""
    assert not extract(".ofd", fx.package({"a.txt": "x"}), BIG).ok
    assert "encrypted" in extract(".doc", fx.doc(encrypted=True), BIG).error
    assert not extract(".doc", b"nothing of the kind", BIG).ok
    assert "header" in extract(".pdf", b"x", BIG).error and not extract(".pdf", b"%PDF-1.4 no streams", BIG).ok
    assert not extract(".exe", b"", BIG).supported
    evil = fx.package({"word/document.xml": '<!DOCTYPE x [<!ENTITY e "boom">]><w xmlns:w="w"><w:t>&e;</w:t></w>'})
    assert "document type" in extract(".docx", evil, BIG).error
    for f in (fx.doc(), fx.xls(), fx.ppt(), fx.docx(), fx.ofd()):
        for cut in (9, 100, 600, len(f) // 2):
            extract(".doc", f[:cut], BIG), extract(".docx", f[:cut], BIG)  # never raises


def test_zip_names_and_methods():
    p = Package(fx.package({"b.txt": "2", "a.txt": "1" * 500, "目录/": ""}, stored=("b.txt",)))
    assert [e.name for e in p.entries] == ["a.txt", "b.txt", "目录/"] and p.entries[2].is_directory
    assert p.read(p.find("a.txt")) == b"1" * 500 and p.read(p.find("b.txt")) == b"2"
    assert entry_name("合同.txt".encode("gbk"), False) == "合同.txt" and entry_name("合同.txt".encode(), False) == "合同.txt" and entry_name(b"\xff", False) == "�"
    raw = bytearray(fx.package({"gbk.txt": "content"}))
    assert "content" in extract(".zip", bytes(raw.replace(b"gbk", "合".encode("gbk") + b"x")), BIG).text.replace("合x", "")
    broken = bytearray(fx.package({"a.txt": "text" * 50}))
    at = broken.find(b"PK\x01\x02")
    struct.pack_into("<H", broken, at + 10, 99)
    assert not extract(".zip", bytes(broken), BIG).ok
    assert not extract(".zip", b"PK\x03\x04", BIG).ok


def test_archives():
    nested = fx.package({"deep.txt": "level 4"})
    for n in (3, 2):
        nested = fx.package({f"l{n}.txt": f"level {n}", "in.zip": nested})
    text = extract(".zip", fx.package({"a.txt": "top", "w.docx": fx.docx(), "bad.docx": "x", "n.zip": nested, "x.bin": b"\1", "__MACOSX/a": "no", "d/.DS_Store": "no"}), BIG).text
    assert "── a.txt ──\ntop\n" in text and "First line" in text and "level 2" in text and "level 3" in text and "level 4" not in text
    assert "── bad.docx ──" in text and "── x.bin ──" in text and "MACOSX" not in text and "DS_Store" not in text
    many = extract(".zip", fx.package({f"{i:04}.bin": "" for i in range(600)}), BIG).text
    assert many.count("──") == 2 * archive.MAX_ENTRIES
    assert archive.skipped("__MACOSX/x") and archive.skipped("a/Thumbs.db") and not archive.skipped("a/b")


def test_number_formats():
    assert [biff.shown(0.5, "0%"), biff.shown(1234.5, "#,##0.00"), biff.shown(3.0, "General"), biff.shown(1 / 3, "General")] == ["50%", "1,234.50", "3", "0.3333333333"]
    assert biff.shown(45000.75, "yyyy-mm-dd h:mm") == "2023-03-15 18:00" and biff.shown(0.5, "h:mm AM/PM") == "12:00 PM"


def test_word_fields():
    assert clean_word("a\x13x\x13y\x14in\x15z\x14out\x15b\x1ec\x01") == "ainoutb-c"


def test_own_extractor():
    register_extractor("upper", lambda data, n: data.decode().upper(), (".shout",), "Shout")
    assert extract(".shout", b"hey", BIG)[:4] == (True, "HEY", None, "Shout")


def test_fixture_is_a_zip():
    assert zipfile.is_zipfile(__import__("io").BytesIO(fx.docx()))
