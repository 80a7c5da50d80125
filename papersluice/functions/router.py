"""Which extractors a file extension goes to, and what its type is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "其他"

#: Extractor -> extensions and their labels, in order of priority.
ROUTES: dict[str, dict[str, str]] = {
    "ooxml": {".docx": "Word", ".docm": "Word", ".wps": "Word", ".xlsx": "Excel", ".xlsm": "Excel", ".et": "Excel", ".pptx": "PPT", ".pptm": "PPT", ".dps": "PPT"},
    "ole2": {".doc": "Word", ".wps": "Word", ".xls": "Excel", ".et": "Excel", ".ppt": "PPT", ".dps": "PPT"},
    "ofd": {".ofd": "OFD"},
    "pdf": {".pdf": "PDF"},
    "archive": {".zip": "压缩包"},
    "text": dict.fromkeys(
        (
            ".txt .log .ini .cfg .conf .csv .tsv .xml .json .html .htm .css .js .py .java .c .cpp .cc .h .hpp .cs .sql "
            ".bat .cmd .ps1 .vbs .md .markdown .yml .yaml .properties .php .rb .go .rs .tex .srt .lrc .reg"
        ).split(),
        "文本",
    ),
}

EXTENSIONS = frozenset(e for r in ROUTES.values() for e in r)


def extension(name: str) -> str:
    """Lower case, with the dot; empty if there is none."""
    base = name.replace("\\", "/").rpartition("/")[2]
    return base[base.rfind(".") :].lower() if "." in base else ""


def route_all(ext: str | None) -> list[str]:
    """Extractors that declare the extension, by priority."""
    ext = (ext or "").lower()
    return [name for name, exts in ROUTES.items() if ext in exts]


def route(ext: str | None) -> str | None:
    return next(iter(route_all(ext)), None)


def label(ext: str | None) -> str:
    """What the first extractor calls the type."""
    name = route(ext)
    return ROUTES[name][(ext or "").lower()] if name else OTHER


def extension_of(path: Column) -> Column:
    """As ``extension``, of a column."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[^./\\]*)$", 1))


def label_of(ext: Column) -> Column:
    """As ``label``, of a column: a literal map, no join."""
    entries = [F.lit(x) for e in sorted(EXTENSIONS) for x in (e, label(e))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(F.coalesce(ext, F.lit("")))), F.lit(OTHER))


def supported(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin(*sorted(EXTENSIONS)), F.lit(False))
