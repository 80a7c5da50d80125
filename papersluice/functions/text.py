"""Scalar text functions as Spark expressions: analysis, snippets, highlighting, presentation.

Lengths, offsets and windows count code points.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are indexed as overlapping pairs: kana, ideographs, hangul syllables, compatibility ideographs, everything beyond the BMP.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{10000}-\x{10FFFF}"
RUN = rf"[{CJK}]+|[\p{{L}}\p{{Nd}}]+"
#: Unicode white space.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SNIPPET_HALF = 80
SNIPPET_CHARS = 8192
CONTEXT = 40
TICKS_AT_EPOCH_US = 62_135_596_800_000_000


def lower(text: Column) -> Column:
    """Lower case, one character for one, so that offsets hold: the dotted capital I gives a plain i."""
    return F.lower(F.translate(text, "İ", "i"))


def tokens(text: Column) -> Column:
    """Index terms in order: words in lower case; a run of n > 1 CJK characters gives its n - 1 overlapping pairs, a single one itself.

    Everything else separates. Null gives an empty array.
    """
    padded = F.regexp_replace(F.coalesce(text, F.lit("")), f"([{CJK}]+)", " $1 ")
    runs = F.regexp_extract_all(padded, F.lit(RUN), F.lit(0))

    def split(r: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
        return F.when(r.rlike(f"^[{CJK}]") & (F.length(r) > 1), pairs).otherwise(F.array(lower(r)))

    return F.flatten(F.transform(runs, split))


def analyze(text: str) -> list[str]:
    """The same terms for a query string, on the driver."""
    cjk = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), CJK)
    out: list[str] = []
    for m in re.finditer(rf"[{cjk}]+|[^\W_]+", text):
        for run in re.findall(rf"[{cjk}]+|[^{cjk}]+", m.group()):
            if re.match(f"[{cjk}]", run):
                out.extend([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])
            else:
                out.extend(w.replace("İ", "i").lower() for w in "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in run).split())
    return out


def highlight_terms(query: str | None) -> list[str]:
    """What to highlight for a query: its runs of letters, digits and CJK characters in lower case, operators and field names included."""
    return re.findall(r"(?:[^\W_]|[⺀-\U0010ffff])+", (query or "").replace("İ", "i").lower())


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space become one space."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def snippet(text: Column, query: str) -> Column:
    """80 characters either side of the first query term, in query order, that occurs in the first 8192 characters.

    ``…`` stands where text was cut; no term, no hit and null text give an empty string.
    """
    found: Column = F.lit(None).cast("int")
    size: Column = F.lit(0)
    flat = collapse_space(F.substring(F.coalesce(text, F.lit("")), 1, SNIPPET_CHARS))
    low = lower(flat)
    for t in highlight_terms(query):
        at = F.nullif(F.instr(low, F.lit(t)), F.lit(0))
        size = F.when(found.isNull() & at.isNotNull(), F.lit(len(t))).otherwise(size)
        found = F.coalesce(found, at)
    return F.when(found.isNull(), F.lit("")).otherwise(window(flat, found, size, SNIPPET_HALF))


def window(text: Column, at: Column, size: Column, half: int) -> Column:
    """``text`` from ``half`` characters before the 1-based ``at`` to ``half`` after ``at + size``, with ``…`` where cut."""
    begin = F.greatest(F.lit(1), at - half)
    end = F.least(F.length(text), at + size - 1 + half)
    return F.concat(F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), F.substr(text, begin, end - begin + 1), F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))


def highlight_spans(text: Column, query: str) -> Column:
    """Array of (term, start) of all case-insensitive occurrences of every query term, by term, then place; 1-based."""
    low = lower(F.coalesce(text, F.lit("")))
    spans = F.array().cast("array<struct<term:string,start:int>>")
    for t in dict.fromkeys(highlight_terms(query)):
        spans = F.concat(spans, _occurrences(low, t))
    return spans


def _occurrences(low: Column, term: str) -> Column:
    """Places of ``term`` in ``low``: what the pieces between them add up to."""

    def place(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece)
        return F.struct((at + len(term)).alias("at"), F.concat(acc["found"], F.array(F.struct(F.lit(term).alias("term"), (at + 1).cast("int").alias("start")))).alias("found"))

    pieces = F.split(low, re.escape(term))
    none = F.array().cast("array<struct<term:string,start:int>>")
    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), none.alias("found")), place, lambda acc: acc["found"])


def ticks(ts: Column) -> Column:
    """100 ns since 0001-01-01 of a timestamp taken as UTC."""
    return (F.unix_micros(ts.cast("timestamp")) + F.lit(TICKS_AT_EPOCH_US)) * 10


def from_ticks(t: Column) -> Column:
    """Timestamp of ticks; null for null, zero and negative ones."""
    return F.when(t > 0, F.timestamp_micros((t / 10).cast("bigint") - F.lit(TICKS_AT_EPOCH_US)))


def format_size(size: Column) -> Column:
    """B, KB and MB with one decimal, GB with two, by 1024."""
    k = 1024.0
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.format_string("%.1f KB", size / k))
        .when(size < 1024**3, F.format_string("%.1f MB", size / k**2))
        .when(size.isNotNull(), F.format_string("%.2f GB", size / k**3))
    )


def format_modified(ticks_: Column) -> Column:
    """Day and minute, in UTC; empty if unknown."""
    return F.coalesce(F.date_format(from_ticks(ticks_), "yyyy-MM-dd HH:mm"), F.lit(""))
