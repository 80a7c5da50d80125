"""Bytes of a text file to text, by a guess at their encoding.

Byte order mark, then UTF-8, UTF-16 without a mark, GB18030 and Big5; GB18030 if nothing fits.
"""

from __future__ import annotations

import codecs
import re
from typing import NamedTuple

import numpy as np

SAMPLE = 256 * 1024

#: Marks in the order in which they are tried.
MARKS = (("UTF-8", codecs.BOM_UTF8), ("UTF-32LE", codecs.BOM_UTF32_LE), ("UTF-32BE", codecs.BOM_UTF32_BE), ("UTF-16LE", codecs.BOM_UTF16_LE), ("UTF-16BE", codecs.BOM_UTF16_BE))
CODECS = {"UTF-8": "utf-8", "UTF-32LE": "utf-32-le", "UTF-32BE": "utf-32-be", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "ASCII": "ascii", "Big5": "big5", "GB18030": "gb18030"}

_GB18030 = re.compile(rb"(?:[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9])*+(?:[\x81-\xfe](?:[0-9].{0,1})?)?", re.S)
_BIG5 = re.compile(rb"(?:[\x00-\x7f]|[\xa1-\xf9][\x40-\x7e\xa1-\xfe])*+[\xa1-\xf9]?", re.S)


class Decoded(NamedTuple):
    text: str
    encoding: str


def decode(data: bytes | None, compat: bool = False) -> Decoded:
    """Text and the label of its encoding. Null and empty input give an empty text and ASCII.

    ``compat``: as historical indexes have it, ASCII of up to 7 bytes is taken for UTF-16LE.
    """
    if not data:
        return Decoded("", "ASCII")
    for name, mark in MARKS:
        if data.startswith(mark):
            return Decoded(data[len(mark) :].decode(CODECS[name], "replace"), name)
    name = guess(data[:SAMPLE], compat)
    return Decoded(data.decode(CODECS[name], "replace"), name)


def guess(sample: bytes, compat: bool = False) -> str:
    """Label of the encoding of bytes without a mark."""
    if is_utf8(sample):
        if not sample.isascii():
            return "UTF-8"
        half = len(sample) // 2
        even, odd = sample[::2].count(0), sample[1::2].count(0)
        least, most = half * 3 // 10, half // 20
        if not compat:
            least = max(1, least)
        return "UTF-16LE" if odd >= least and even <= most else "UTF-16BE" if even >= least and odd <= most else "ASCII"
    (le, le_control), (be, be_control) = (_usual(sample, order) for order in "<>")
    if le > 0.6 and le - be > 0.2 and le_control < 0.1:
        return "UTF-16LE"
    if be > 0.6 and be - le > 0.2 and be_control < 0.1:
        return "UTF-16BE"
    if not _GB18030.fullmatch(sample) and _BIG5.fullmatch(sample):
        return "Big5"
    return "GB18030"


def is_utf8(sample: bytes) -> bool:
    """Whether ``sample`` is UTF-8 but for a sequence that its end cuts off; surrogates pass."""
    for back in range(min(3, len(sample)), 0, -1):
        lead = sample[-back]
        if (0xC2 <= lead < 0xE0) + 2 * (0xE0 <= lead < 0xF0) + 3 * (0xF0 <= lead < 0xF8) >= back:
            sample = sample[:-back]
            break
    try:
        sample.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


#: Punctuation that is usual in text.
_MARKS = (0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x2026, 0x00B7)


def _usual(sample: bytes, order: str) -> tuple[float, float]:
    """Shares of usual and of control characters among 16-bit units."""
    u = np.frombuffer(sample[: len(sample) // 2 * 2], f"{order}u2")
    if not len(u):
        return 0.0, 0.0
    white = np.isin(u, (9, 10, 13))
    usual = white | (u >= 0x20) & (u <= 0x7E) | (u >= 0x4E00) & (u <= 0x9FA5) | (u >= 0x3000) & (u <= 0x303F) | (u >= 0xFF00) & (u <= 0xFFEF) | np.isin(u, _MARKS)
    control = ~white & (u < 0x20) | (u >= 0x7F) & (u <= 0x9F)
    return float(usual.mean()), float(control.mean())
