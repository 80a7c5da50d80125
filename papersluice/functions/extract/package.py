"""ZIP containers and the XML in them."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

from papersluice.functions.extract import Unreadable


class Entry(NamedTuple):
    name: str
    offset: int
    compressed: int
    size: int
    method: int
    is_directory: bool


def entry_name(raw: bytes, utf8: bool) -> str:
    """UTF-8 if so flagged, else the first of strict UTF-8 and GB18030 that fits, else ASCII."""
    for codec in ("utf-8",) if utf8 else ("utf-8", "gb18030"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8" if utf8 else "ascii", "replace")


class Package:
    """Entries of a ZIP archive in order of their names; contents are not held against their checksums."""

    def __init__(self, data: bytes):
        self.data = data
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = z.infolist()
        except Exception as e:
            raise Unreadable(f"not a readable ZIP archive: {e}") from e
        self.entries = sorted((self._entry(i) for i in infos), key=lambda e: e.name.encode("utf-16-be", "surrogatepass"))

    def _entry(self, i: zipfile.ZipInfo) -> Entry:
        utf8 = bool(i.flag_bits & 0x800)
        name = entry_name(i.orig_filename.encode("utf-8" if utf8 else "cp437"), utf8)
        if max(i.file_size, i.compress_size, i.header_offset) >= 0xFFFFFFFF:
            raise Unreadable("ZIP64 is not supported")
        head = self.data[i.header_offset : i.header_offset + 30]
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise Unreadable("damaged ZIP entry")
        at = i.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        return Entry(name, at, i.compress_size, i.file_size, i.compress_type, name.endswith("/"))

    def files(self) -> list[Entry]:
        return [e for e in self.entries if not e.is_directory]

    def find(self, name: str) -> Entry | None:
        return next((e for e in self.files() if e.name == name), None)

    def read(self, entry: Entry, most: int | None = None) -> bytes:
        """Content of an entry, ``most`` bytes of it at most."""
        raw = self.data[entry.offset : entry.offset + entry.compressed]
        if entry.method == 0:
            return raw if most is None else raw[:most]
        if entry.method != 8:
            raise Unreadable(f"unsupported compression method {entry.method}")
        try:
            return zlib.decompressobj(-15).decompress(raw, most or 0)
        except zlib.error as e:
            raise Unreadable(f"damaged ZIP entry: {e}") from e


def events(xml: bytes) -> Iterator[tuple[str, str, dict | None]]:
    """("start", name, attributes), ("text", text, None) and ("end", name, None) in document order, names without prefixes.

    A document type declaration is refused; comments, instructions and entities of its own don't occur.
    """
    out: list[tuple[str, str, dict | None]] = []
    parser = expat.ParserCreate(namespace_separator="\n")
    parser.buffer_text = True

    def refuse(*_):
        raise Unreadable("a document type declaration is not allowed")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler = lambda name, attrs: out.append(("start", name.rpartition("\n")[2], {k.rpartition("\n")[2]: v for k, v in attrs.items()}))
    parser.EndElementHandler = lambda name: out.append(("end", name.rpartition("\n")[2], None))
    parser.CharacterDataHandler = lambda text: out.append(("text", text, None))
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise Unreadable(f"damaged XML: {e}") from e
    return iter(out)


class Text:
    """Text being put together, up to a limit."""

    def __init__(self, most: int):
        self.most, self.parts, self.size, self.last = most, [], 0, ""

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.size += len(s)
            self.last = s[-1]

    def line(self) -> None:
        """A line end, unless at the start or after one."""
        if self.size and self.last != "\n":
            self.add("\n")

    @property
    def full(self) -> bool:
        return self.size >= self.most

    def __str__(self) -> str:
        return "".join(self.parts)[: self.most]
