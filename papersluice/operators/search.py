"""Keyword search over documents: boolean match, TF-IDF score, top-k, snippets.

``search`` evaluates a query straight on a documents table: one pass gathers the statistics (a
single row), a second one matches, scores and keeps the best k; nothing is shuffled but the k rows
of each task, and only documents that hold a term's characters at all are analyzed. ``build_postings`` and ``search_postings`` do the same over an inverted index, where
only the rows of the query's terms are read.

Documents have: path, filename, filetype, batch, size, modified_ticks, content.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersluice.functions.text import format_modified, format_size, from_ticks, lower, snippet, tokens
from papersluice.plans.query import ANALYZED, MUST, MUST_NOT, Clause, parse_lenient, scored
from papersluice.session import spread

MAX_RESULTS = 500
#: Results up to which the k best are brought to the driver to read their contents by path.
COLLECTED_RESULTS = 1000
FIELDS = ("path", "filename", "filetype", "batch", "size", "modified_ticks")


def _key(name: str, term: str) -> str:
    return f"{name}\x00{term}"


def _fields(clause: Clause) -> tuple[str, ...]:
    return (clause.field,) if clause.field else ANALYZED


class _Stats:
    """Number of documents, and in how many of them each field has each term."""

    def __init__(self, docs: int, having: dict[str, int]):
        self.docs, self.having = docs, having

    def idf(self, name: str, term: str) -> Column:
        return F.lit(1.0) + F.log(F.lit(float(max(self.docs, 1))) / F.lit(float(self.having.get(_key(name, term), 0) + 1)))


def _occurrences(arr: Column, terms: list[str], slop: int = 0) -> Column:
    """How often the terms follow one another in ``arr`` (or stand within ``slop`` moves of it, if given)."""
    if len(terms) == 1:
        return F.size(F.filter(arr, lambda t: t == terms[0]))
    n = len(terms)
    if slop:
        return F.size(_close([_places(arr, t) for t in terms], slop))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(arr) - n + 1))
    wanted = F.array(*[F.lit(t) for t in terms])
    return F.when(F.size(arr) < n, F.lit(0)).otherwise(F.size(F.filter(starts, lambda i: (F.get(arr, i - 1) == terms[0]) & (F.slice(arr, i, n) == wanted))))


def _places(arr: Column, term: str) -> Column:
    return F.filter(F.transform(arr, lambda x, i: F.when(x == term, i)), lambda i: i.isNotNull())


def _close(places: list[Column], slop: int) -> Column:
    """Places of the first term from which all terms can be moved into their order by ``slop`` places in all.

    The place of term i less i is where the phrase would begin; those beginnings have to lie within ``slop`` of one another.
    """

    def begins(other: Column, i: int, low: Column) -> Column:
        return F.exists(other, lambda q: (q - i >= low) & (q - i <= low + slop))

    def all_begin(low: Column) -> Column:
        ok = F.lit(True)
        for i, other in enumerate(places[1:], 1):
            ok = ok & begins(other, i, low)
        return ok

    return F.filter(places[0], lambda at: F.exists(F.sequence(at - slop, at), all_begin))


def _evaluate(clause: Clause, stats: _Stats) -> tuple[Column, Column]:
    """Whether a document matches, and its score."""
    if clause.kind == "group":
        parts = [(c, *_evaluate(c, stats)) for c in clause.clauses]
        positive = [(c, m, s) for c, m, s in parts if c.occur != MUST_NOT]
        if not positive:
            return F.lit(False), F.lit(0.0)
        required = [m for c, m, _ in positive if c.occur == MUST]
        match = F.lit(True)
        for m in required:
            match = match & m
        if not required:
            match = F.lit(False)
            for _, m, _ in positive:
                match = match | m
        for c, m, _ in parts:
            if c.occur == MUST_NOT:
                match = match & ~m
        score, hits = F.lit(0.0), F.lit(0)
        for _, m, s in positive:
            score, hits = score + F.when(m, s).otherwise(0.0), hits + m.cast("int")
        return match, score * hits / F.lit(float(len(positive))) * clause.boost
    if clause.kind == "exact":
        column = "modified_ticks" if clause.field == "modified" else clause.field
        return F.coalesce(F.col(column).cast("string") == F.lit(clause.terms[0]), F.lit(False)), F.lit(clause.boost)
    match, score = F.lit(False), F.lit(0.0)
    for name in _fields(clause):
        if clause.kind == "range" and name not in ANALYZED:
            match, score = match | _stored_range(clause, name), F.lit(clause.boost)
            continue
        arr = F.col(f"t_{name}")
        if clause.kind in ("term", "phrase"):
            tf = _occurrences(arr, clause.terms, clause.slop)
            idf = F.lit(0.0)
            for t in clause.terms:
                idf = idf + stats.idf(name, t)
            match = match | (tf > 0)
            score = score + F.when(tf > 0, F.sqrt(tf.cast("double")) * idf * idf / F.sqrt(F.size(arr).cast("double"))).otherwise(0.0) * clause.boost
            continue
        match, score = match | F.exists(arr, lambda t: _term_like(clause, t)), F.lit(clause.boost)
    return match, score


def _stored_range(clause: Clause, name: str) -> Column:
    value, (low, high) = F.col("modified_ticks" if name == "modified" else name), clause.terms
    if name in ("size", "modified"):
        low, high = (int(x) if x.lstrip("-").isdigit() else x for x in (low, high))
    one = F.lit(True)
    if low != "*":
        one = one & (value >= F.lit(low) if clause.inclusive else value > F.lit(low))
    if high != "*":
        one = one & (value <= F.lit(high) if clause.inclusive else value < F.lit(high))
    return F.coalesce(one, F.lit(False))


def _term_like(clause: Clause, term: Column) -> Column:
    """Whether ``term`` is one of a wildcard, fuzzy or range clause; what can be reaches the scan of an index sorted by term."""
    if clause.kind == "wildcard":
        text = clause.terms[0]
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text) + "$"
        return term.startswith(re.match(r"[^*?]*", text).group()) & term.rlike(pattern)
    if clause.kind == "fuzzy":
        return F.levenshtein(term, F.lit(clause.terms[0])) <= clause.slop
    low, high = (x.lower() for x in clause.terms)
    return ((term >= low) if clause.inclusive else (term > low)) & ((term <= high) if clause.inclusive else (term < high))


def search(docs: DataFrame, query: str | None, k: int = MAX_RESULTS, batch: str | None = None, snippets: bool = False) -> DataFrame:
    """The best ``k`` documents: path, filename, filetype, batch, size, modified_ticks, modified, score [, snippet].

    A blank query and one that only excludes match nothing. ``batch`` restricts the result, not the
    statistics. Scores are rounded to six places and ties ordered by path; missing stored fields come
    as empty strings, a missing size as 0. Null texts are empty. Documents repeated under one path
    come repeated: the index operators keep paths unique.
    """
    root = parse_lenient(query)
    base = spread(docs.select(*FIELDS, "content"))
    if root is None:
        match, score = F.lit(False), F.lit(0.0)
    else:
        wanted = sorted({(n, t) for c in scored(root) for n in _fields(c) if n in ANALYZED for t in c.terms})
        # Unfolding an array of one struct keeps the optimizer from putting the analysis into every place its result is used.
        analysis = F.inline(F.array(F.struct(*[tokens(F.col(n)).alias(f"t_{n}") for n in ANALYZED])))
        base = (base.where(_possible(wanted)) if _only_scored(root) else base).select("*", analysis)
        total = docs.select(F.count("*")).first()[0] if wanted else 0
        having = base.select(*[F.sum(F.array_contains(f"t_{n}", t).cast("bigint")) for n, t in wanted]).first() if wanted else ()
        stats = _Stats(total, {_key(n, t): v or 0 for (n, t), v in zip(wanted, having)})
        match, score = _evaluate(root, stats)
    if batch:
        base = base.where(F.col("batch") == batch)
    best = base.where(match).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "path").limit(k)
    return best.select(*_stored(), "score", *([snippet(F.col("content"), query or "").alias("snippet")] if snippets else []))


def _only_scored(clause: Clause) -> bool:
    """Whether a match needs one of the scored terms."""
    if clause.kind != "group":
        return clause.kind in ("term", "phrase")
    return all(_only_scored(c) for c in clause.clauses if c.occur != MUST_NOT)


def _possible(wanted: list[tuple[str, str]]) -> Column:
    """Whether a document holds some term at all, as a run of characters: far cheaper than analyzing it."""
    out = F.lit(False)
    for n in sorted({n for n, _ in wanted}):
        low = lower(F.coalesce(F.col(n), F.lit("")))
        for t in sorted({t for m, t in wanted if m == n}):
            out = out | low.contains(t)
    return out


def _stored() -> list[Column]:
    return [
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("path", "filename", "filetype", "batch")],
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("modified_ticks", F.lit(0)).cast("bigint").alias("modified_ticks"),
        from_ticks(F.col("modified_ticks")).alias("modified"),
    ]


def build_postings(docs: DataFrame) -> DataFrame:
    """Inverted index: field, term, path, positions (sorted), tf, n_terms (of the field).

    Terms are counted before the shuffle, and the shuffle is by path and term together, so neither a
    frequent term nor a long document makes a hot partition.
    """
    parts = F.array(*[F.struct(F.lit(n).alias("field"), tokens(F.col(n)).alias("terms")) for n in ANALYZED])  # analyzed once, as above
    per_field = spread(docs.select("path", *ANALYZED)).select("path", F.inline(parts)).withColumn("n_terms", F.size("terms"))
    exploded = per_field.select("path", "field", "n_terms", F.posexplode("terms").alias("pos", "term"))
    return exploded.groupBy("path", "field", "term", "n_terms").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("field", "term", "path", "positions", F.size("positions").alias("tf"), "n_terms")


def search_postings(postings: DataFrame, docs: DataFrame, query: str | None, k: int = MAX_RESULTS, batch: str | None = None, snippets: bool = False) -> DataFrame:
    """``search`` over an index: same results, without analyzing a document.

    Only the postings of the query's terms, and of those that its wildcards, fuzzy terms and ranges
    stand for, are read (the filter reaches the scan and, with postings sorted by term, skips most row
    groups). They are gathered per document, where phrases are matched on positions, ranked and cut
    to ``k``; stored fields join those k rows, and contents are read for them only. Clauses on stored
    fields (exact, ranges of size and the like) read those fields of all documents, but no contents.
    """
    root = parse_lenient(query)
    leaves = _leaves(root) if root else []
    terms = sorted({t for c in leaves if c.kind in ("term", "phrase") for t in c.terms})
    like = [c for c in leaves if c.kind in ("wildcard", "fuzzy") or c.kind == "range" and any(f in ANALYZED for f in _fields(c))]
    stored = any(c.kind == "exact" or c.kind == "range" and any(f not in ANALYZED for f in _fields(c)) for c in leaves)
    wanted = F.col("term").isin(terms)
    for c in like:
        wanted = wanted | _term_like(c, F.col("term"))
    hits = postings.where(wanted)
    counted = hits.where(F.col("term").isin(terms)).groupBy("field", "term").agg(F.count("*").alias("n")).collect() if terms else []
    stats = _Stats(docs.count() if terms else 0, {_key(r.field, r.term): r.n for r in counted})
    places = F.when(F.col("term").isin(terms), F.col("positions"))
    wide = hits.groupBy("path").agg(F.collect_list(F.struct("field", "term", places.alias("positions"), "n_terms")).alias("p"))
    if stored:
        wide = docs.select(*FIELDS).join(wide, "path", "left").withColumn("p", F.coalesce("p", F.expr("cast(array() AS array<struct<field:string,term:string,positions:array<int>,n_terms:int>>)")))
    match, score = _gathered(root, stats) if root else (F.lit(False), F.lit(0.0))
    ranked = wide.where(match).select("path", F.round(score, 6).alias("score"))
    if batch:
        ranked = ranked.join(docs.where(F.col("batch") == batch).select("path"), "path", "left_semi")
    top = ranked.orderBy(F.desc("score"), "path").limit(k)
    if k > COLLECTED_RESULTS:
        kept = docs.select(*FIELDS, *["content"] * snippets).join(top, "path")
    else:
        rows = top.collect()
        kept = docs.where(F.col("path").isin([r.path for r in rows])).select(*FIELDS, *["content"] * snippets).join(F.broadcast(docs.sparkSession.createDataFrame(rows, "path string, score double")), "path")
    return kept.select(*_stored(), "score", *([snippet(F.col("content"), query or "").alias("snippet")] if snippets else [])).orderBy(F.desc("score"), "path")


def _leaves(c: Clause) -> list[Clause]:
    return [x for y in c.clauses for x in _leaves(y)] if c.kind == "group" else [c]


def _posting(name: str, term: str) -> Column:
    return F.get(F.filter("p", lambda x: (x["field"] == name) & (x["term"] == term)), 0)


def _some_like(clause: Clause, name: str) -> Column:
    return F.exists("p", lambda x: (x["field"] == name) & _term_like(clause, x["term"]))


def _followed(places: Column, others: Column, by: int) -> Column:
    return F.filter(places, lambda x: F.array_contains(others, x + by))


def _gathered(clause: Clause, stats: _Stats) -> tuple[Column, Column]:
    """As _evaluate, over the array ``p`` of a document's postings."""
    if clause.kind == "group":
        return _evaluate_group(clause, stats)
    if clause.kind == "exact":
        return _evaluate(clause, stats)
    match, score = F.lit(False), F.lit(0.0)
    for name in _fields(clause):
        if clause.kind not in ("term", "phrase"):
            if clause.kind == "range" and name not in ANALYZED:
                one = _stored_range(clause, name)
            else:
                one = _some_like(clause, name)
            match, score = match | one, F.lit(clause.boost)
            continue
        none = F.array().cast("array<int>")
        found = [F.coalesce(_posting(name, t)["positions"], none) for t in clause.terms]
        if clause.slop and len(found) > 1:
            places = _close(found, clause.slop)
        else:
            places = found[0]
            for i, others in enumerate(found[1:], 1):
                places = _followed(places, others, i)
        tf = F.size(places)
        idf = F.lit(0.0)
        for t in clause.terms:
            idf = idf + stats.idf(name, t)
        match = match | (tf > 0)
        score = score + F.when(tf > 0, F.sqrt(tf.cast("double")) * idf * idf / F.sqrt(_posting(name, clause.terms[0])["n_terms"].cast("double"))).otherwise(0.0) * clause.boost
    return match, score


def _evaluate_group(clause: Clause, stats: _Stats) -> tuple[Column, Column]:
    parts = [(c, *_gathered(c, stats)) for c in clause.clauses]
    positive = [(m, s) for c, m, s in parts if c.occur != MUST_NOT]
    if not positive:
        return F.lit(False), F.lit(0.0)
    match, required = F.lit(True), False
    for c, m, _ in parts:
        if c.occur == MUST:
            match, required = match & m, True
        elif c.occur == MUST_NOT:
            match = match & ~m
    if not required:
        some = F.lit(False)
        for m, _ in positive:
            some = some | m
        match = match & some
    score, hits = F.lit(0.0), F.lit(0)
    for m, s in positive:
        score, hits = score + F.when(m, s).otherwise(0.0), hits + m.cast("int")
    return match, score * hits / F.lit(float(len(positive))) * clause.boost


def present(results: DataFrame) -> DataFrame:
    """Results as they are shown: size in B to GB, modified to the minute, score with two decimals."""
    return results.select(
        "path", "filename", "filetype", format_size(F.col("size")).alias("size"), format_modified(F.col("modified_ticks")).alias("modified"),
        F.format_string("%.2f", "score").alias("score"),
    )
