"""Word, Excel and PowerPoint files of the XML kind."""

from __future__ import annotations

import re

from papersluice.functions.extract import Unreadable
from papersluice.functions.extract.package import Package, Text, events


def extract(data: bytes, max_chars: int) -> str:
    if data[:2] != b"PK":
        raise Unreadable("not an OOXML file: no ZIP header")
    package = Package(data)
    if not package.entries:
        return ""
    names = [e.name for e in package.files()]
    out = Text(max_chars)
    if "word/document.xml" in names:
        _word(package, names, out)
    elif any(n.startswith("xl/worksheets/") for n in names):
        _workbook(package, names, out)
    elif any(n.startswith("ppt/slides/slide") for n in names):
        _slides(package, names, out)
    else:
        raise Unreadable("a ZIP container without a known document structure")
    return str(out)


def _part(package: Package, name: str):
    return events(package.read(package.find(name)))


def _word(package: Package, names: list[str], out: Text) -> None:
    parts = ["word/document.xml", "word/footnotes.xml", "word/endnotes.xml"]
    parts += [n for n in names if re.fullmatch(r"word/(?:header|footer).*\.xml", n, re.S)]
    for part in parts:
        if part not in names or out.full:
            continue
        inside = 0
        for kind, value, _ in _part(package, part):
            if kind == "text":
                if inside:
                    out.add(value)
            elif value == "t":
                inside += 1 if kind == "start" else -1
            elif kind == "start":
                if value == "p":
                    out.line()
                elif value == "tab":
                    out.add("\t")
                elif value in ("br", "cr"):
                    out.add("\n")
            if out.full:
                break


def _strings(package: Package, names: list[str]) -> list[str]:
    """Shared strings: rich runs joined, phonetic guides left out."""
    if "xl/sharedStrings.xml" not in names:
        return []
    out: list[str] = []
    guide = text = 0
    for kind, value, _ in _part(package, "xl/sharedStrings.xml"):
        step = 1 if kind == "start" else -1
        if kind == "text":
            if text and not guide and out:
                out[-1] += value
        elif value == "si" and kind == "start":
            out.append("")
        elif value == "rPh":
            guide += step
        elif value == "t":
            text += step
    return out


def _workbook(package: Package, names: list[str], out: Text) -> None:
    shared = _strings(package, names)
    for name in names:
        if not (name.startswith("xl/worksheets/") and name.endswith(".xml")) or "_rels" in name:
            continue
        open_: list[str] = []
        kind_of, value_of = "", ""
        for kind, value, attrs in _part(package, name):
            if kind == "start":
                open_.append(value)
                if value == "c":
                    kind_of, value_of = attrs.get("t", ""), ""
            elif kind == "text":
                if "c" in open_ and (open_[-1] == "v" or open_[-1] == "t" and "is" in open_):
                    value_of += value
            else:
                open_.pop()
                if value == "row":
                    out.add("\n")
                elif value == "c":
                    if kind_of == "s":
                        at = int(value_of) if re.fullmatch(r"\s*\+?\d+\s*", value_of) else -1
                        value_of = shared[at] if 0 <= at < len(shared) else ""
                    if value_of:
                        out.add("\t" if out.size else "")
                        out.add(value_of)
            if out.full:
                return
        out.add("\n")


def _slides(package: Package, names: list[str], out: Text) -> None:
    slides = []
    for n in names:
        if re.fullmatch(r"ppt/(?:slides/slide|notesSlides/notesSlide).*\.xml", n, re.S):
            number = re.search(r"[Ss]lide(\d+)(?!.*[Ss]lide)", n, re.S)
            slides.append((int(number[1]) if number else 1 << 31, n))
    for _, n in sorted(slides):
        field = text = 0
        for kind, value, _ in _part(package, n):
            step = 1 if kind == "start" else -1
            if kind == "text":
                if text and not field:
                    out.add(value)
            elif value == "fld":
                field += step
            elif value == "t":
                text += step
            elif value == "p" and kind == "start" and not field:
                out.line()
            if out.full:
                return
        out.add("\n")
