"""Compound files: old Word, Excel, PowerPoint and WPS documents."""

from __future__ import annotations

import re
import struct
import unicodedata

from papersluice.functions.encoding import decode
from papersluice.functions.extract import Unreadable, biff
from papersluice.functions.extract.package import Text

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
MAX_BYTES = 64 * 1024 * 1024
MINED_MIN, MINED_MAX, MINED_DEPTH = 32, 8 * 1024 * 1024, 8
RECORD_DEPTH = 48

FREE = 0xFFFFFFFA  # sector numbers from here on are marks


class Compound:
    """Streams and storages of a compound file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise Unreadable("not a compound file: no D0 CF 11 E0 header")
        if len(data) > MAX_BYTES:
            raise Unreadable("the compound file is too large")
        self.data = data
        self.shift, self.small_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= self.shift <= 16 or not 2 <= self.small_shift <= self.shift:
            raise Unreadable("damaged compound file header")
        directory, = struct.unpack_from("<I", data, 48)
        self.cutoff, small_fat, _, more, _ = struct.unpack_from("<IIIII", data, 56)
        fat_sectors = list(struct.unpack_from("<109I", data, 76))
        per = (1 << self.shift) // 4
        seen = set()
        while more < FREE and more not in seen:
            seen.add(more)
            block = self._numbers(self._sector(more))
            fat_sectors += block[: per - 1]
            more = block[-1]
        self.fat = [n for s in fat_sectors if s < FREE for n in self._numbers(self._sector(s))]
        self.small_fat = self._numbers(self._chain(small_fat)) if small_fat < FREE else []
        raw = self._chain(directory)
        self.nodes = [self._node(raw[i : i + 128]) for i in range(0, len(raw) - 127, 128)]
        if not self.nodes:
            raise Unreadable("the compound file has no directory")
        self.small = self._chain(self.nodes[0][5]) if self.nodes[0][5] < FREE else b""

    def _sector(self, n: int) -> bytes:
        at = (n + 1) << self.shift
        return self.data[at : at + (1 << self.shift)]

    @staticmethod
    def _numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < len(self.fat) and n not in seen:
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def _small_chain(self, n: int) -> bytes:
        out, seen, size = [], set(), 1 << self.small_shift
        while n < len(self.small_fat) and n not in seen:
            seen.add(n)
            out.append(self.small[n * size : (n + 1) * size])
            n = self.small_fat[n]
        return b"".join(out)

    @staticmethod
    def _node(raw: bytes) -> tuple[str, int, int, int, int, int, int]:
        """Name, kind (1 storage, 2 stream, 5 root), left, right, child, first sector, size."""
        length, = struct.unpack_from("<H", raw, 64)
        name = raw[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, size = struct.unpack_from("<II", raw, 116)
        return name, raw[66], left, right, child, start, size

    def children(self, node: int = 0) -> list[int]:
        """Numbers of a storage's members, in the order of the directory."""
        out, stack, seen = [], [self.nodes[node][4]], set()
        while stack:
            n = stack.pop()
            if n >= len(self.nodes) or n in seen:
                continue
            seen.add(n)
            if self.nodes[n][1] in (1, 2):
                out.append(n)
            stack += [self.nodes[n][3], self.nodes[n][2]]
        return sorted(out)

    def find(self, name: str) -> int | None:
        """A stream of the root by name, whatever its case."""
        return next((n for n in self.children() if self.nodes[n][1] == 2 and self.nodes[n][0].lower() == name.lower()), None)

    def read(self, node: int) -> bytes:
        start, size = self.nodes[node][5], self.nodes[node][6]
        return (self._small_chain(start) if size < self.cutoff else self._chain(start))[:size]

    def stream(self, name: str) -> bytes | None:
        n = self.find(name)
        return None if n is None else self.read(n)


def extract(data: bytes, max_chars: int) -> str:
    """By what streams there are: a workbook, a Word document, slides; else whatever text can be mined."""
    c = Compound(data)
    book = c.stream("Workbook") or c.stream("Book")
    if book is not None:
        try:
            return biff.extract(book, max_chars)
        except Exception:  # older or damaged workbooks are mined
            pass
    for stream, reader in (("WordDocument", _word), ("PowerPoint Document", _slides)):
        if c.find(stream) is not None:
            try:
                text = reader(c, max_chars)
            except Unreadable:
                raise
            except Exception:  # what has no sound structure is mined
                text = ""
            if text:
                return text[:max_chars]
    return mine(c, max_chars)


# --- Word --------------------------------------------------------------------------------------


def _word(c: Compound, max_chars: int) -> str:
    main = c.stream("WordDocument") or b""
    if len(main) < 0x1AA:
        return ""
    magic, version = struct.unpack_from("<HH", main, 0)
    flags, = struct.unpack_from("<H", main, 0x0A)
    if magic != 0xA5EC:
        return ""
    if flags & 0x0100:
        raise Unreadable("the document is encrypted")
    names = ("1Table", "0Table") if flags & 0x0200 else ("0Table", "1Table")
    table = next((t for t in map(c.stream, names) if t is not None), None)
    if version >= 0xC1 and table is not None:
        at, size = struct.unpack_from("<II", main, 0x1A2)
        if size and at + size <= len(table):
            text = _pieces(main, table[at : at + size], max_chars)
            if text:
                return text
    first, last = struct.unpack_from("<II", main, 0x18)
    if not first < last <= len(main):
        return ""
    body = main[first:last]
    return clean_word(body[: len(body) // 2 * 2].decode("utf-16-le", "replace") if flags & 0x4000 else decode(body).text)


def _pieces(main: bytes, clx: bytes, max_chars: int) -> str:
    """Text of the pieces in order; each is UTF-16, or one byte a character."""
    at = 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        return ""
    size, = struct.unpack_from("<I", clx, at + 1)
    plc = clx[at + 5 : at + 5 + size]
    n = (size - 4) // 12
    if n <= 0 or len(plc) < size:
        return ""
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    out = Text(max_chars)
    for i in range(n):
        count = min(ends[i + 1] - ends[i], max_chars - out.size)
        if count <= 0:
            continue
        place, = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)
        narrow, place = place >> 30 & 1, place & 0x3FFFFFFF
        start, length = (place // 2, count) if narrow else (place, 2 * count)
        if start + length <= len(main):
            out.add(clean_word(main[start : start + length].decode("cp1252" if narrow else "utf-16-le", "replace")))
        if out.full:
            break
    return str(out)


#: What control characters of Word text stand for.
_WORD_SIGNS = {"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t", "\x1e": "-"}


def clean_word(raw: str) -> str:
    """Line ends, tabs and hyphens for their codes; of fields only the results, other control characters dropped."""
    out: list[str] = []
    shown: list[bool] = []
    for ch in raw:
        if ch == "\x13":
            shown.append(False)
        elif ch == "\x14":
            if shown:
                shown[-1] = True
        elif ch == "\x15":
            if shown:
                shown.pop()
        elif ch in _WORD_SIGNS:
            out.append(_WORD_SIGNS[ch])
        elif (ch >= " " or ch in "\t\n") and (not shown or shown[-1]):
            out.append(ch)
    return "".join(out)


# --- PowerPoint --------------------------------------------------------------------------------


def _slides(c: Compound, max_chars: int) -> str:
    data = c.stream("PowerPoint Document") or b""
    if len(data) > MINED_MAX:
        return ""
    out = Text(max_chars)
    spans = [(0, len(data), 0)]
    while spans and not out.full:
        at, end, depth = spans.pop()
        if at + 8 > end:
            continue
        head, kind, size = struct.unpack_from("<HHI", data, at)
        stop = min(at + 8 + size, end)
        spans.append((stop, end, depth))
        body = data[at + 8 : stop]
        if head & 0xF == 0xF and depth < RECORD_DEPTH:
            spans.append((at + 8, stop, depth + 1))
        elif kind == 0x0FA0:
            out.add(_clean_slide(body[: len(body) // 2 * 2].decode("utf-16-le", "replace")))
        elif kind == 0x0FA8 and body:
            out.add(_clean_slide(decode(body).text))
    return str(out)


def _clean_slide(raw: str) -> str:
    text = raw.translate({0x0D: "\n", 0x0B: "\n", 0x1E: "-", 0x1F: None})
    return "".join(ch for ch in text if ch >= " " or ch in "\t\n")


# --- anything else -----------------------------------------------------------------------------


def _readable(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return kind not in ("Cc",) and ch != "�" and (kind[0] in "LPZ" or kind == "Nd" or "⺀" <= ch <= "鿿" or "＀" <= ch <= "￯" or ch.isspace())


def mine(c: Compound, max_chars: int) -> str:
    """Readable stretches of at least 3 characters from all streams."""
    found: list[str] = []
    stack = [(n, 0) for n in reversed(c.children())]
    while stack:
        node, depth = stack.pop()
        _, kind, *_, size = c.nodes[node]
        if kind == 1:
            if depth < MINED_DEPTH:
                stack += [(n, depth + 1) for n in reversed(c.children(node))]
        elif MINED_MIN <= size <= MINED_MAX:
            text = decode(c.read(node)).text
            runs = "".join(ch if _readable(ch) else "\0" for ch in text).split("\0")
            runs = [r.strip() for r in runs]
            kept = [r for r in runs if len(r) >= 3 and re.search(r"[^\W_]|[⺀-鿿＀-￯]", r)]
            if kept:
                found.append("\n".join(kept))
        if sum(map(len, found)) >= max_chars:
            break
    return "\n".join(found)[:max_chars]
