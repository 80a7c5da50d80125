"""SQL for the same results in DuckDB: the documents view, analysis, search and snippets."""

from __future__ import annotations

import re

from papersluice.functions.text import CJK, RUN, SNIPPET_CHARS, SNIPPET_HALF, SPACE, TICKS_AT_EPOCH_US, highlight_terms
from papersluice.plans.query import ANALYZED, MUST, MUST_NOT, Clause, parse_lenient, scored

DOCS = f"""docs AS (SELECT path, string_split(path, '/')[-1] AS filename, lower(regexp_extract(coalesce(path, ''), '(\\.[^./\\\\]*)$', 1)) AS ext,
  filetype, batch, size, (epoch_us(modified) + {TICKS_AT_EPOCH_US}) * 10 AS modified_ticks, text AS content, doc_id FROM documents)"""


def TOKENS(column: str) -> str:  # noqa: N802
    return (
        f"flatten(list_transform(regexp_extract_all(regexp_replace(coalesce({column}, ''), '([{CJK}]+)', ' \\1 ', 'g'), '{RUN}'), "
        f"lambda r: CASE WHEN regexp_matches(r, '^[{CJK}]') AND length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [lower(r)] END))"
    )


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(terms: list[str]) -> str:
    return "[" + ", ".join(map(_text, terms)) + "]"


def _tf(arr: str, c: Clause) -> str:
    n = len(c.terms)
    if n == 1:
        return f"len(list_filter({arr}, lambda t: t = {_text(c.terms[0])}))"
    starts = f"range(1, greatest(1, len({arr}) - {n} + 1) + 1)"
    if c.slop:
        places = [f"list_filter(range(0, len({arr})), lambda j: {arr}[j + 1] = {_text(t)})" for t in c.terms]
        near = " AND ".join(f"len(list_filter({p}, lambda q: q - {i} >= low AND q - {i} <= low + {c.slop})) > 0" for i, p in enumerate(places) if i)
        return f"len(list_filter({places[0]}, lambda a: len(list_filter(range(a - {c.slop}, a + 1), lambda low: {near})) > 0))"
    return f"len(list_filter({starts}, lambda i: {arr}[i:i+{n - 1}] = {_list(c.terms)}))"


def _evaluate(c: Clause, numbers: dict[tuple[str, str], str]) -> tuple[str, str]:
    if c.kind == "group":
        parts = [(x, *_evaluate(x, numbers)) for x in c.clauses]
        positive = [(x, m, s) for x, m, s in parts if x.occur != MUST_NOT]
        must = [m for x, m, _ in positive if x.occur == MUST] or ["(" + " OR ".join(m for _, m, _ in positive) + ")"]
        match = " AND ".join([*must, *(f"NOT {m}" for x, m, _ in parts if x.occur == MUST_NOT)])
        total = " + ".join(f"CASE WHEN {m} THEN {s} ELSE 0 END" for _, m, s in positive)
        hits = " + ".join(f"({m})::INT" for _, m, _ in positive)
        return f"({match})", f"(({total}) * ({hits}) / {float(len(positive))} * {c.boost})"
    if c.kind == "exact":
        return f"coalesce({'modified_ticks' if c.field == 'modified' else c.field}::VARCHAR = {_text(c.terms[0])}, false)", str(c.boost)
    matches, scores = [], []
    for name in (c.field,) if c.field else ANALYZED:
        arr = f"t_{name}"
        if c.kind in ("term", "phrase"):
            tf, idf = _tf(arr, c), "(" + " + ".join(numbers.get((name, t), "0") for t in c.terms) + ")"
            matches.append(f"{tf} > 0")
            scores.append(f"CASE WHEN {tf} > 0 THEN sqrt({tf}) * {idf} * {idf} / sqrt(len({arr})) ELSE 0 END * {c.boost}")
            continue
        scores = [str(c.boost)]
        if c.kind == "wildcard":
            pattern = "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in c.terms[0])
            matches.append(f"len(list_filter({arr}, lambda t: regexp_full_match(t, {_text(pattern)}))) > 0")
        elif c.kind == "fuzzy":
            matches.append(f"len(list_filter({arr}, lambda t: levenshtein(t, {_text(c.terms[0])}) <= {c.slop})) > 0")
        else:
            low, high = c.terms if name not in ANALYZED else [x.lower() for x in c.terms]
            a, b = (">=", "<=") if c.inclusive else (">", "<")
            if name in ANALYZED:
                matches.append(f"len(list_filter({arr}, lambda t: t {a} {_text(low)} AND t {b} {_text(high)})) > 0")
            else:
                matches.append(f"coalesce({name} {a} {low} AND {name} {b} {high}, false)")
    return "(" + " OR ".join(matches) + ")", "(" + " + ".join(scores) + ")"


def search_sql(q: str, k: int, batch: str | None = None, snippets: bool = False) -> str:
    """``batch``: an SQL expression."""
    root = parse_lenient(q)
    columns = "path, filename, filetype, coalesce(batch, '') AS batch, coalesce(size, 0) AS size"
    shown = f", {snippet_sql('content', q)} AS snippet" if snippets else ""
    if root is None:
        return f"WITH {DOCS} SELECT {columns}, 0.0::DOUBLE AS score{shown} FROM docs WHERE false"
    terms = sorted({(n, t) for c in scored(root) for n in ((c.field,) if c.field else ANALYZED) for t in c.terms})
    numbers = {x: f"i{j}" for j, x in enumerate(terms)}
    stats = ", ".join(["count(*) AS n", *(f"1 + ln(count(*)::DOUBLE / (count(*) FILTER (WHERE list_contains(t_{n}, {_text(t)})) + 1)) AS i{j}" for j, (n, t) in enumerate(terms))])
    match, score = _evaluate(root, numbers)
    only = f" AND batch = {batch}" if batch else ""
    return f"""WITH {DOCS}, a AS (SELECT *, {TOKENS('filename')} AS t_filename, {TOKENS('content')} AS t_content FROM docs), s AS (SELECT {stats} FROM a)
SELECT {columns}, round({score}, 6) AS score{shown} FROM a, s WHERE {match}{only} ORDER BY score DESC, path LIMIT {k}"""


def snippet_sql(column: str, q: str) -> str:
    flat = f"regexp_replace(substr(coalesce({column}, ''), 1, {SNIPPET_CHARS}), '[{SPACE}]+', ' ', 'g')"
    out = "''"
    for t in reversed(highlight_terms(q)):
        at = f"strpos(lower({flat}), {_text(t)})"
        begin, end = f"greatest(1, {at} - {SNIPPET_HALF})", f"least(length({flat}), {at} + {len(t)} - 1 + {SNIPPET_HALF})"
        cut = f"(CASE WHEN {begin} > 1 THEN '…' ELSE '' END) || substr({flat}, {begin}, {end} - {begin} + 1) || (CASE WHEN {end} < length({flat}) THEN '…' ELSE '' END)"
        out = f"CASE WHEN {at} > 0 THEN {cut} ELSE {out} END"
    return out
