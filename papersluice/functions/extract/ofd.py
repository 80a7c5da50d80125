"""OFD page layout files."""

from __future__ import annotations

import re

from papersluice.functions.extract import Unreadable
from papersluice.functions.extract.package import Package, Text, events


def _number(name: str, prefix: str) -> int:
    found = re.findall(rf"{prefix}(\d*)", name)
    return int(found[-1]) if found and found[-1] else 1 << 31


def extract(data: bytes, max_chars: int) -> str:
    package = Package(data)
    if not package.entries:
        return ""
    names = [e.name for e in package.files()]
    if "OFD.xml" not in names and not any(n.startswith("Doc_") for n in names):
        raise Unreadable("a ZIP container without an OFD structure")
    xml = [n for n in names if n.startswith("Doc_") and n.endswith(".xml") and "_rels" not in n]
    pages = [n for n in xml if "/Pages/" in n] or xml
    out = Text(max_chars)
    for name in sorted(pages, key=lambda n: (_number(n, "Doc_"), _number(n, "Page_"), n)):
        inside = code = False
        for kind, value, _ in events(package.read(package.find(name))):
            if kind == "text":
                if inside and code:
                    out.add(value)
            elif value == "TextObject":
                inside = kind == "start"
                if not inside:
                    out.line()
            elif value == "TextCode":
                code = kind == "start"
            if out.full:
                return str(out)
    return str(out)
