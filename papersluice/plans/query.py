"""The query language: parsed into clauses, evaluated as columns over a document's terms.

Words are OR-ed by default; AND, OR, NOT, &&, ||, !, + and - combine them from left to right;
quotes make a phrase, field: restricts a clause, parentheses group. Further: ``te?m*`` wildcards,
``term~`` and ``term~1`` (edits), ``"a b"~2`` (moves), ``[a TO b]`` and ``{a TO b}`` ranges and
``^2`` boosts. A wildcard can't come first. A query that doesn't parse is taken as plain words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from dataclasses import field as default

from papersluice.functions.text import analyze

ANALYZED = ("filename", "content")
EXACT = ("path", "filetype", "batch", "size", "modified")

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"


class QueryError(ValueError):
    pass


@dataclass
class Clause:
    """``kind``: term, phrase, wildcard, fuzzy, range, exact or group."""

    occur: str
    kind: str
    field: str | None = None
    terms: list[str] = default(default_factory=list)
    clauses: list[Clause] = default(default_factory=list)
    boost: float = 1.0
    slop: int = 0
    inclusive: bool = True


_LEX = re.compile(
    r"""\s*(?:
      (?P<op>AND\b|OR\b|NOT\b|&&|\|\||!) | (?P<sign>[+-]) | (?P<open>\() | (?P<close>\)) |
      (?:(?P<field>[A-Za-z_]+):)? (?:
        (?P<quote>"(?:\\.|[^"\\])*") | (?P<range>[\[{][^\]}]*\s+TO\s+[^\]}]*[\]}]) | (?P<group>\() |
        (?P<word>(?:\\.|[^\s()\[\]{}":\\])+)
      )(?P<tail>(?:~\d*(?:\.\d+)?)?(?:\^\d+(?:\.\d+)?)?)
    )""",
    re.X,
)


def parse(query: str) -> Clause:
    """The query as a group; raises QueryError."""
    root, rest = _group(query, 0, False)
    if query[rest:].strip():
        raise QueryError(query)
    return root


def parse_lenient(query: str | None) -> Clause | None:
    """The query as a group; as plain words if it doesn't parse; None if there is nothing to look for."""
    text = (query or "").strip()
    if not text:
        return None
    try:
        root = parse(text)
    except QueryError:
        root = Clause(MUST, "group", clauses=[c for w in text.split() if (c := _analyzed(SHOULD, None, w))])
    return root if any(c.occur != MUST_NOT for c in root.clauses) else None


def _group(text: str, at: int, inner: bool) -> tuple[Clause, int]:
    clauses: list[Clause] = []
    pending: str | None = None  # AND or OR before the next clause
    occur: str | None = None
    closed = not inner
    while at < len(text) and text[at:].strip():
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise QueryError(text)
        at = m.end()
        if m["close"]:
            if not inner:
                raise QueryError(text)
            closed = True
            break
        if m["op"]:
            if m["op"] in ("NOT", "!"):
                occur = MUST_NOT
            elif pending or not clauses:
                raise QueryError(text)
            else:
                pending = "AND" if m["op"] in ("AND", "&&") else "OR"
            continue
        if m["sign"]:
            occur = MUST if m["sign"] == "+" else MUST_NOT
            continue
        if m["open"] or m["group"]:
            clause, at = _group(text, at, True)
            if m["field"]:
                clause = _within(clause, _known(m["field"]))
            tail = re.compile(r"\^(\d+(?:\.\d+)?)").match(text, at)
            if tail:
                clause, at = replace(clause, boost=float(tail[1])), tail.end()
        else:
            clause = _leaf(m)
        if pending == "AND" and clauses and clauses[-1] and clauses[-1].occur == SHOULD:
            clauses[-1] = replace(clauses[-1], occur=MUST)
        if clause:
            clauses.append(replace(clause, occur=occur or (MUST if pending == "AND" else SHOULD)))
        pending = occur = None
    if pending or occur or not closed:
        raise QueryError(text)
    return Clause(SHOULD, "group", clauses=clauses), at


def _known(name: str) -> str:
    if name not in ANALYZED + EXACT:
        raise QueryError(name)
    return name


def _within(clause: Clause, name: str) -> Clause:
    if clause.kind == "group":
        return replace(clause, clauses=[_within(c, name) for c in clause.clauses])
    return clause if clause.field else replace(clause, field=name)


def _leaf(m: re.Match) -> Clause | None:
    name = _known(m["field"]) if m["field"] else None
    fuzzy, boost = re.fullmatch(r"(~\d*(?:\.\d+)?)?(?:\^(\d+(?:\.\d+)?))?", m["tail"]).groups()
    boost = float(boost or 1)
    if m["range"]:
        low, high = (x.strip() for x in re.split(r"\s+TO\s+", m["range"][1:-1], maxsplit=1))
        return Clause(SHOULD, "range", name, [low, high], boost=boost, inclusive=m["range"][0] == "[")
    if m["quote"]:
        text = re.sub(r"\\(.)", r"\1", m["quote"][1:-1])
        if name in EXACT:
            return Clause(SHOULD, "exact", name, [text], boost=boost)
        clause = _analyzed(SHOULD, name, text)
        slop = int(float(fuzzy[1:] or 0)) if fuzzy else 0
        return clause and replace(clause, boost=boost, slop=slop)
    word = m["word"]
    tail = re.search(r"(?<!\\)(~\d*(?:\.\d+)?)?(?:\^(\d+(?:\.\d+)?))?$", word)
    if tail and tail.group():
        word, fuzzy, boost = word[: tail.start()], tail[1] or fuzzy, float(tail[2] or boost)
    plain = re.sub(r"\\(.)", r"\1", word)
    if name in EXACT:
        return Clause(SHOULD, "exact", name, [plain], boost=boost)
    if word[0] in "*?":
        raise QueryError(word)
    if re.search(r"(?<!\\)[*?]", word):
        return Clause(SHOULD, "wildcard", name, [plain.lower()], boost=boost)
    if fuzzy:
        return Clause(SHOULD, "fuzzy", name, [plain.lower()], boost=boost, slop=int(float(fuzzy[1:])) if fuzzy[1:] and float(fuzzy[1:]) >= 1 else 2)
    clause = _analyzed(SHOULD, name, plain)
    return clause and replace(clause, boost=boost)


def _analyzed(occur: str, name: str | None, text: str) -> Clause | None:
    terms = analyze(text)
    return Clause(occur, "term" if len(terms) == 1 else "phrase", name, terms) if terms else None


def scored(clause: Clause) -> list[Clause]:
    """All term and phrase clauses that count for the score."""
    if clause.kind == "group":
        return [x for c in clause.clauses if c.occur != MUST_NOT for x in scored(c)]
    return [clause] if clause.kind in ("term", "phrase") else []
