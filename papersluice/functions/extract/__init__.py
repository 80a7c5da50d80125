"""Text of files by their extension.

An extractor takes bytes and a limit of characters and returns text, or raises ``Unreadable``. The
extractors of an extension are tried in order of priority; the first that succeeds decides, else
the last one's message is the error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from papersluice.functions import router


class Unreadable(Exception):
    """The file isn't of the extractor's kind, is damaged or encrypted."""


class Extracted(NamedTuple):
    ok: bool
    text: str | None
    error: str | None
    label: str
    supported: bool = True


Extractor = Callable[[bytes, int], str]
_EXTRACTORS: dict[str, Extractor] = {}
_ADDED: list[tuple[str, frozenset[str], str]] = []


def register_extractor(name: str, extractor: Extractor, extensions: tuple[str, ...] = (), label: str = router.OTHER) -> None:
    """Adds an extractor, or puts another in a built-in one's place. Extensions given here come after the built-in ones."""
    _EXTRACTORS[name] = extractor
    if extensions:
        _ADDED.append((name, frozenset(e.lower() for e in extensions), label))


def _load() -> dict[str, Extractor]:
    if "text" not in _EXTRACTORS:
        from papersluice.functions.extract import archive, ofd, ole2, ooxml, pdf, plain

        for name, f in (("ooxml", ooxml.extract), ("ole2", ole2.extract), ("ofd", ofd.extract), ("pdf", pdf.extract), ("archive", archive.extract), ("text", plain.extract)):
            _EXTRACTORS.setdefault(name, f)
    return _EXTRACTORS


def extract(ext: str, data: bytes, max_chars: int) -> Extracted:
    """Text of a file of extension ``ext``; never raises."""
    known, ext = _load(), (ext or "").lower()
    names = router.route_all(ext) + [n for n, exts, _ in _ADDED if ext in exts]
    label = router.label(ext) if router.route(ext) else next((x for _, exts, x in _ADDED if ext in exts), router.OTHER)
    if not names:
        return Extracted(False, None, "unsupported format", label, False)
    error = None
    for name in names:
        try:
            return Extracted(True, known[name](data, max_chars)[:max_chars], None, label)
        except Exception as e:  # a damaged file must not end the task that reads it
            error = str(e) or type(e).__name__
    return Extracted(False, None, error, label)
