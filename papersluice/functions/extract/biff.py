"""Cells of BIFF8 workbooks, as they are shown."""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterator

from papersluice.functions.extract import Unreadable
from papersluice.functions.extract.package import Text

BOF, EOF, BOUNDSHEET, SST, CONTINUE, LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR, FORMAT, XF, DATEMODE, FILEPASS, RSTRING = (
    0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205, 0x41E, 0xE0, 0x22, 0x2F, 0xD6,
)

#: Number formats that files refer to without defining them.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 49: "@",
}
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


class _Parts:
    """A record and its continuations, read across their borders."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            piece = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def chars(self, n: int, wide: bool) -> str:
        """``n`` characters; a continuation within them begins with their width anew."""
        out = []
        while n and self.part < len(self.parts):
            left = len(self.parts[self.part]) - self.at
            if left <= 0:
                self.part, self.at = self.part + 1, 0
                if self.part < len(self.parts):
                    wide, self.at = bool(self.parts[self.part][0] & 1), 1
                continue
            count = min(n, left // 2 if wide else left) or 1
            raw = self.take(count * 2 if wide else count)
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= count
        return "".join(out)


def _string(raw: bytes, length_bytes: int = 2) -> str:
    n = int.from_bytes(raw[:length_bytes], "little")
    flags = raw[length_bytes] if len(raw) > length_bytes else 0
    body = raw[length_bytes + 1 :]
    return body[: 2 * n].decode("utf-16-le", "replace") if flags & 1 else body[:n].decode("latin-1")


def _shared(parts: list[bytes]) -> list[str]:
    p = _Parts(parts)
    p.take(4)
    out = []
    for _ in range(int.from_bytes(p.take(4), "little")):
        head = p.take(3)
        if len(head) < 3:
            break
        n, flags = struct.unpack("<HB", head)
        runs = int.from_bytes(p.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(p.take(4), "little") if flags & 4 else 0
        out.append(p.chars(n, bool(flags & 1)))
        p.take(4 * runs + extra)
    return out


def _rk(raw: int) -> float:
    value = float((raw >> 2) - (1 << 30) * (raw >> 31)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))[0]
    return value / 100 if raw & 1 else value


def shown(value: float, form: str, since_1904: bool = False) -> str:
    """A number in the given format; dates as year-month-day patterns tell, the rest in general form."""
    form = form.split(";")[0]
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", form)
    if plain.lower() != "general" and re.search(r"[dmyhs]", plain, re.I):
        return _date(value, plain, since_1904)
    digits = re.search(r"[#0?,]*[0#?](?:\.([0#?]+))?(%?)(E\+0+)?", plain)
    if digits and plain.lower() != "general":
        places = len(digits[1] or "")
        number = value * 100 if digits[2] else value
        text = f"{number:.{places}E}" if digits[3] else f"{number:,.{places}f}" if "," in digits[0] else f"{number:.{places}f}"
        return plain[: digits.start()] + text + digits[2] + plain[digits.end() :]
    text = f"{value:.10g}"
    return text if "e" not in text else text.upper()


def _date(value: float, form: str, since_1904: bool) -> str:
    day = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
    try:
        t = day + dt.timedelta(days=value)
    except OverflowError:
        return f"{value:.10g}"
    t = (t + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
    noon = bool(re.search("am/pm", form, re.I))
    out, last = [], ""
    for piece in re.findall(r"am/pm|y+|m+|d+|h+|s+|.", form, re.I | re.S):
        k = piece.lower()
        if k[0] == "m" and k != "am/pm" and (last == "h" or re.match(r"[^a-z]*s", form[form.lower().find(piece.lower()) + len(piece) :], re.I) and last in ("h", "")):
            out.append(f"{t.minute:0{min(len(k), 2)}d}")
        elif k == "am/pm":
            out.append("AM" if t.hour < 12 else "PM")
        elif k[0] in "ymdhs":
            hour = (t.hour - 1) % 12 + 1 if noon else t.hour
            out.append({"y": f"{t.year}" if len(k) > 2 else f"{t.year % 100:02d}", "m": t.strftime("%b" if len(k) == 3 else "%B") if len(k) > 2 else f"{t.month:0{len(k)}d}",
                        "d": t.strftime("%a" if len(k) == 3 else "%A") if len(k) > 2 else f"{t.day:0{len(k)}d}", "h": f"{hour:0{min(len(k), 2)}d}", "s": f"{t.second:0{min(len(k), 2)}d}"}[k[0]])
        else:
            out.append(piece)
        last = k[0] if k[0] in "ymdhs" else last
    return "".join(out)


def extract(book: bytes, max_chars: int) -> str:
    """Sheets in order, rows as lines, cells parted by tabs; empty cells and rows leave nothing."""
    first = next(records(book), None)
    if not first or first[0] != BOF or len(first[1]) < 2 or struct.unpack_from("<H", first[1])[0] != 0x600:
        raise Unreadable("not a BIFF8 workbook")
    sheets, formats, styles, shared, since_1904 = [], dict(BUILT_IN), [], [], False
    rest = list(records(book))
    for i, (kind, raw) in enumerate(rest):
        if kind == FILEPASS:
            raise Unreadable("the workbook is encrypted")
        if kind == BOUNDSHEET:
            sheets.append(struct.unpack_from("<I", raw)[0])
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", raw)[0]] = _string(raw[2:])
        elif kind == XF:
            styles.append(struct.unpack_from("<H", raw, 2)[0])
        elif kind == DATEMODE:
            since_1904 = bool(raw[0])
        elif kind == SST:
            parts = [raw]
            for k, more in rest[i + 1 :]:
                if k != CONTINUE:
                    break
                parts.append(more)
            shared = _shared(parts)
        elif kind == EOF:
            break

    def number(value: float, style: int) -> str:
        return shown(value, formats.get(styles[style] if style < len(styles) else 0, "General"), since_1904)

    out = Text(max_chars)
    for at in sheets:
        rows: dict[int, dict[int, str]] = {}
        waiting = None
        for kind, raw in records(book, at):
            if kind == EOF:
                break
            if kind == STRING and waiting:
                rows.setdefault(waiting[0], {})[waiting[1]] = _string(raw)
            if kind not in (LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, FORMULA, BOOLERR):
                continue
            row, col, style = struct.unpack_from("<HHH", raw)
            cells = rows.setdefault(row, {})
            if kind == LABELSST:
                n, = struct.unpack_from("<I", raw, 6)
                cells[col] = shared[n] if n < len(shared) else ""
            elif kind in (LABEL, RSTRING):
                cells[col] = _string(raw[6:])
            elif kind == NUMBER:
                cells[col] = number(struct.unpack_from("<d", raw, 6)[0], style)
            elif kind == RK:
                cells[col] = number(_rk(struct.unpack_from("<I", raw, 6)[0]), style)
            elif kind == MULRK:
                for j in range((len(raw) - 6) // 6):
                    s, v = struct.unpack_from("<HI", raw, 4 + 6 * j)
                    cells[col + j] = number(_rk(v), s)
            elif kind == BOOLERR:
                cells[col] = ERRORS.get(raw[6], "#ERR") if raw[7] else ("TRUE" if raw[6] else "FALSE")
            elif raw[12:14] == b"\xff\xff":  # a formula whose result isn't a number
                if raw[6] == 0:
                    waiting = (row, col)
                elif raw[6] == 1:
                    cells[col] = "TRUE" if raw[8] else "FALSE"
                elif raw[6] == 2:
                    cells[col] = ERRORS.get(raw[8], "#ERR")
            else:
                cells[col] = number(struct.unpack_from("<d", raw, 6)[0], style)
        for _, cells in sorted(rows.items()):
            line = "\t".join(v for _, v in sorted(cells.items()) if v)
            if line:
                out.add(line + "\n")
            if out.full:
                return str(out)
    return str(out)
