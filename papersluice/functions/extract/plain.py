"""Plain text and source files."""

from __future__ import annotations

from papersluice.functions.encoding import decode

MAX_BYTES = 20 * 1024 * 1024


def extract(data: bytes, max_chars: int) -> str:
    return decode(data[:MAX_BYTES]).text.replace("\0", "")[:max_chars]
