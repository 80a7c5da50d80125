"""ZIP archives: the names of their entries, and the text of those that can be read."""

from __future__ import annotations

from papersluice.functions import router
from papersluice.functions.extract.package import Package, Text

MAX_DEPTH, MAX_ENTRIES = 3, 512
MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 32 * 1024 * 1024, 128 * 1024 * 1024

#: What stands in place of an entry's content.
ENTRY_TOO_LARGE, TOTAL_TOO_LARGE = "（条目过大，跳过内容）", "（累计解压量超出上限，停止穿透）"


def skipped(name: str) -> bool:
    """Whether an entry is one that systems leave behind."""
    return not name or name.startswith("__MACOSX/") or name.endswith(("/__MACOSX", ".DS_Store", "Thumbs.db"))


def extract(data: bytes, max_chars: int, depth: int = 0) -> str:
    """``── name ──`` and the content of each entry; archives within archives down to MAX_DEPTH."""
    from papersluice.functions.extract import extract as by_extension

    package = Package(data)
    if depth >= MAX_DEPTH:
        return ""
    out, total = Text(max_chars), 0
    for entry in [e for e in package.files() if not skipped(e.name)][:MAX_ENTRIES]:
        if out.full:
            break
        out.add("\n" if out.size else "")
        out.add(f"── {entry.name} ──\n")
        if entry.size <= 0:
            continue
        if entry.size > MAX_ENTRY_BYTES:
            out.add(ENTRY_TOO_LARGE + "\n")
            continue
        total += entry.size
        if total > MAX_TOTAL_BYTES:
            out.add(TOTAL_TOO_LARGE + "\n")
            break
        ext = router.extension(entry.name)
        if ext not in router.EXTENSIONS or out.full:
            continue
        content = package.read(entry, MAX_ENTRY_BYTES)  # an entry that can't be inflated fails the archive
        room = max_chars - out.size
        if ext == ".zip":
            try:
                inner = extract(content, room, depth + 1)
            except Exception:  # a damaged inner archive keeps its name line
                inner = ""
        else:
            inner = by_extension(ext, content, room).text or ""
        if inner:
            out.add(inner + "\n")
    return str(out)
