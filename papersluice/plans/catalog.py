"""Registered queries of the core and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from papersluice.operators.increments import replay_runs
from papersluice.operators.snapshot_diff import snapshot_changes
from papersluice.session import load, spread, work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


LATEST_STAMPS = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY loaded_at DESC NULLS LAST, size DESC NULLS LAST,
      modified_ticks DESC NULLS LAST, batch DESC NULLS LAST) AS rn
    FROM file_stamps WHERE snapshot_no IS NOT NULL AND path IS NOT NULL) WHERE rn = 1),
pairs AS (SELECT snapshot_no AS before_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS after_no
  FROM (SELECT DISTINCT snapshot_no FROM latest)),
old AS (SELECT p.after_no AS no, l.* FROM latest l JOIN pairs p ON l.snapshot_no = p.before_no WHERE p.after_no IS NOT NULL),
new AS (SELECT p.after_no AS no, l.* FROM latest l JOIN pairs p ON l.snapshot_no = p.after_no),
both_sides AS (
  SELECT coalesce(n.no, o.no) AS snapshot_no, coalesce(n.path, o.path) AS path,
    o.path IS NULL AS is_new, n.path IS NULL AS is_gone,
    o.size IS DISTINCT FROM n.size AS size_differs, o.modified_ticks IS DISTINCT FROM n.modified_ticks AS ticks_differ,
    o.batch IS DISTINCT FROM n.batch AS batch_differs
  FROM old o FULL JOIN new n ON o.no = n.no AND o.path = n.path),
changes AS (
  SELECT *, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'changed' END AS change_kind
  FROM both_sides WHERE is_new OR is_gone OR size_differs OR ticks_differ OR batch_differs)
"""


@query("p2_found", f"WITH {LATEST_STAMPS} SELECT snapshot_no, path, change_kind FROM changes")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(load(spark, sf_dir, "file_stamps")).select("snapshot_no", "path", "change_kind")


@query(
    "p2_fields",
    f"""WITH {LATEST_STAMPS}, f AS (
  SELECT snapshot_no, change_kind, unnest(CASE WHEN change_kind <> 'changed' THEN ['']
    ELSE list_filter(['size', 'modified_ticks', 'batch'], lambda x: (x = 'size' AND size_differs) OR (x = 'modified_ticks' AND ticks_differ) OR (x = 'batch' AND batch_differs)) END) AS field
  FROM changes) SELECT snapshot_no, change_kind, field, count(*) AS n FROM f GROUP BY ALL""",
)
def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field changed, per snapshot; additions and removals under an empty field."""
    found = snapshot_changes(load(spark, sf_dir, "file_stamps"))
    return found.selectExpr("snapshot_no", "change_kind", "explode(if(change_kind = 'changed', changed_fields, array(''))) AS field").groupBy("snapshot_no", "change_kind", "field").count().withColumnRenamed("count", "n")


RUN_STAMPS = """
ok AS (SELECT run_no, min(started_at) AS started_at FROM index_runs GROUP BY run_no HAVING bool_or(coalesce(completed, false))),
stamp_at AS (
  SELECT * FROM (
    SELECT k.run_no, f.path, f.size, f.modified_ticks, f.batch,
      row_number() OVER (PARTITION BY k.run_no, f.path ORDER BY f.observed_at DESC, f.feed_id DESC) AS rn
    FROM ok k JOIN stamp_feed f ON f.arrived_at <= k.started_at) WHERE rn = 1),
before AS (SELECT run_no, lag(run_no) OVER (ORDER BY started_at, run_no) AS prev FROM ok)
"""


@query(
    "p5_found",
    f"""WITH {RUN_STAMPS} SELECT a.run_no, a.path FROM stamp_at a JOIN before b ON a.run_no = b.run_no
LEFT JOIN stamp_at o ON o.run_no = b.prev AND o.path = a.path
WHERE o.path IS NULL OR a.size IS DISTINCT FROM o.size OR a.modified_ticks IS DISTINCT FROM o.modified_ticks OR a.batch IS DISTINCT FROM o.batch""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_runs(load(spark, sf_dir, "stamp_feed"), load(spark, sf_dir, "index_runs"), work_dir(spark, "p5-target"))


# --- reference operators over the documents table ---------------------------------------------

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from papersluice.functions import router, text  # noqa: E402
from functools import reduce  # noqa: E402

from papersluice.operators import index, rules, search  # noqa: E402
from papersluice.operators.order import ranked  # noqa: E402
from papersluice.plans.oracle import DOCS, TOKENS, search_sql, snippet_sql  # noqa: E402


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the index's shape."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), router.extension_of(F.col("path")).alias("ext"), "filetype", "batch",
        "size", text.ticks(F.col("modified")).alias("modified_ticks"), F.col("text").alias("content"), "doc_id",
    )


def _register(name: str, sql: str | None, plan: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(documents(spark, sf_dir))

    run.__name__ = name
    query(name, sql)(run)


_register("scan_project", f"WITH {DOCS} SELECT path, filename, ext, size, modified_ticks FROM docs", lambda d: d.select("path", "filename", "ext", "size", "modified_ticks"))
_register("scan_order", f"WITH {DOCS} SELECT path, row_number() OVER (ORDER BY path) AS n FROM docs", lambda d: ranked(d.select("path"), "path"))
_register("ext_filter", f"WITH {DOCS} SELECT path, ext FROM docs WHERE ext IN ('.txt', '.csv', '.zip')", lambda d: d.where(F.col("ext").isin(".txt", ".csv", ".zip")).select("path", "ext"))
_register("exclude_dirs", f"WITH {DOCS} SELECT path FROM docs WHERE NOT starts_with(lower(path), '/srv/depot/training/') AND NOT starts_with(lower(path), '/srv/depot/legal/')", lambda d: d.where(~F.lower("path").startswith("/srv/depot/training/") & ~F.lower("path").startswith("/srv/depot/legal/")).select("path"))
_LABELS = ", ".join(f"('{e}', '{router.label(e)}')" for e in sorted(router.EXTENSIONS))
_register(
    "route_labels",
    f"WITH {DOCS}, labels AS (SELECT * FROM (VALUES {_LABELS}) t(ext, label)) SELECT d.path, coalesce(l.label, '{router.OTHER}') AS label FROM docs d LEFT JOIN labels l ON d.ext = l.ext",
    lambda d: d.select("path", router.label_of(F.col("ext")).alias("label")),
)
_register("tokenize_counts", f"WITH {DOCS}, t AS (SELECT unnest({TOKENS('content')}) AS term FROM docs) SELECT term, count(*) AS n FROM t GROUP BY term", lambda d: spread(d.select("content")).select(F.explode(text.tokens(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")))
_register("tokenize_docs", f"WITH {DOCS} SELECT path, md5(array_to_string({TOKENS('content')}, ' ')) AS digest FROM docs", lambda d: spread(d.select("path", "content")).select("path", F.md5(F.array_join(text.tokens(F.col("content")), " ")).alias("digest")))
_register(
    "postings",
    f"""WITH {DOCS}, p AS (SELECT path, 'content' AS field, {TOKENS('content')} AS terms FROM docs UNION ALL SELECT path, 'filename', {TOKENS('filename')} FROM docs),
e AS (SELECT path, field, len(terms) AS n_terms, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM p)
SELECT field, term, path, count(*) AS tf, n_terms, array_to_string(list_sort(list(pos)), ',') AS positions FROM e GROUP BY field, term, path, n_terms""",
    lambda d: search.build_postings(d).withColumn("positions", F.array_join("positions", ",")),
)


def _search(name: str, q: str, k: int = 100, batch: str | None = None, snippets: bool = False) -> None:
    columns = ["path", "filename", "filetype", "batch", "size", "score", *["snippet"] * snippets]
    _register(name, search_sql(q, k, batch, snippets), lambda d: search.search(d, q, k, batch, snippets).select(*columns))


_search("search_or_topk", "voucher inventory signatures", 50, snippets=True)
_search("search_and", "stamped AND receipt", 500)
_search("search_not", "catalogue NOT stamped", 500)
_search("search_required_prohibited", "+the -voucher registry", 500)
_search("search_phrase", '"unless the owner objects"', 500)
_search("search_phrase_cjk", "检验报告", 500)
_search("search_field_filename", "filename:pdf budget", 500)
_search("search_keyword_field", "filetype:PDF +register", 500)
_search("search_group", "(voucher OR receipt) AND (stamped OR sealed)", 500)
_search("search_wildcard", "inven* +wa?er", 500)
_search("search_fuzzy", "recipt~1", 500)
_search("search_range", "content:[zebra TO zinc] size:[0 TO 300]", 500)
_search("search_boost", "voucher^3 receipt", 200)
_search("search_proximity", '"retention period"~2', 500)
_search("search_syntax_fallback", 'the "unclosed voucher', 200)
_search("search_blank", "   ", 50)
_search("search_only_negative", "-voucher", 50)
query("search_batch_filter", search_sql("voucher receipt", 500, "(SELECT min(batch) FROM documents)"))(
    lambda spark, sf_dir: search.search(documents(spark, sf_dir), "voucher receipt", 500, load(spark, sf_dir, "documents").agg(F.min("batch")).first()[0]).select("path", "filename", "filetype", "batch", "size", "score")
)
_register("search_postings", search_sql("+voucher stamped -receipt \"the owner\"", 200), lambda d: search.search_postings(search.build_postings(d), d, "+voucher stamped -receipt \"the owner\"", 200).select("path", "filename", "filetype", "batch", "size", "score"))
_register("snippet_window", f"WITH {DOCS} SELECT path, {snippet_sql('content', 'that')} AS snippet FROM docs", lambda d: spread(d.select("path", "content")).select("path", text.snippet(F.col("content"), "that").alias("snippet")))
_register("snippet_query_order", f"WITH {DOCS} SELECT path, {snippet_sql('content', '编号 the AND voucher')} AS snippet FROM docs", lambda d: spread(d.select("path", "content")).select("path", text.snippet(F.col("content"), "编号 the AND voucher").alias("snippet")))
_register(
    "highlight_spans",
    f"""WITH {DOCS}, s AS (SELECT path, lower(coalesce(content, '')) AS low FROM docs), p AS (SELECT path, t.term, string_split(low, t.term) AS pieces FROM s, (VALUES ('voucher'), ('编号')) t(term)),
u AS (SELECT path, term, pieces, unnest(range(1, len(pieces))) AS i FROM p)
SELECT path, term, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(term) + 1 AS start FROM u""",
    lambda d: d.select("path", F.inline(text.highlight_spans(F.col("content"), "voucher 编号"))),
)
_register("collapse_space", f"WITH {DOCS} SELECT path, md5(regexp_replace(content, '[{text.SPACE}]+', ' ', 'g')) AS digest FROM docs", lambda d: d.select("path", F.md5(text.collapse_space(F.col("content"))).alias("digest")))
_register(
    "format_size",
    f"""WITH {DOCS} SELECT path, CASE WHEN size * 977 < 1024 THEN (size * 977)::VARCHAR || ' B' WHEN size * 977 < 1048576 THEN printf('%.1f KB', size * 977 / 1024.0::DOUBLE)
WHEN size * 977 < 1073741824 THEN printf('%.1f MB', size * 977 / 1048576.0::DOUBLE) WHEN size IS NOT NULL THEN printf('%.2f GB', size * 977 / 1073741824.0::DOUBLE) END AS shown FROM docs""",
    lambda d: d.select("path", text.format_size(F.col("size") * 977).alias("shown")),
)
_register("ticks_roundtrip", f"WITH {DOCS} SELECT d.path, s.modified FROM docs d JOIN documents s ON d.path = s.path", lambda d: d.select("path", text.from_ticks(F.col("modified_ticks")).cast("timestamp_ntz").alias("modified")))


# --- rules

_RULES = [
    rules.Rule("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "regex", "low", id="a"),
    rules.Rule("mobile", r"1[3-9]\d{9}", "regex", "medium", id="b"),
    rules.Rule("broken", r"([", "regex", "high", id="c"),
    rules.Rule("secret", "保密", "keyword", "high", id="d"),
    rules.Rule("Classified", "Classified", "keyword", "critical", id="e"),
    rules.Rule("pdf", "PDF", "keyword", "low", True, False, id="f"),
    rules.Rule("hex name", r"f[0-9a]{4}", "regex", "medium", True, False, id="g"),
]


def _rule_sql(cap: int | None = None, used: Sequence[rules.Rule] = _RULES, most: int | None = None) -> str:
    def window(text_: str, at: str, size: str) -> str:
        return f"(CASE WHEN {at} > 41 THEN '…' ELSE '' END) || translate(substr({text_}, greatest(1, {at} - 40), least(length({text_}), {at} + {size} - 1 + 40) - greatest(1, {at} - 40) + 1), chr(10) || chr(13) || chr(9), '   ') || (CASE WHEN {at} + {size} - 1 + 40 < length({text_}) THEN '…' ELSE '' END)"

    parts = []
    for i, r in rules.usable(used):
        for kind, phase, col in (("filename", 0, "filename"), ("content", 1, "content")):
            if not (r.match_filename if phase == 0 else r.match_content):
                continue
            t = f"coalesce({col}, '')" if phase == 0 or most is None else f"CASE WHEN size > {most} THEN '' ELSE coalesce({col}, '') END"
            t, pattern = f"({t})", r.pattern.replace(r"\d", r"\p{Nd}")  # digits of any script
            if r.type == "regex":
                lead = f"(?s)^(.*?)({pattern})"
                hit, at, size = f"regexp_matches({t}, '{pattern}')", f"(length(regexp_extract({t}, '{lead}', 1)) + 1)", f"length(regexp_extract({t}, '{lead}', 2))"
                shown = f"regexp_extract({t}, '{pattern}')" if phase == 0 else window(t, at, size)
            else:
                at, size = f"strpos(lower({t}), '{r.pattern.lower()}')", str(len(r.pattern))
                hit, shown = f"{at} > 0", f"'{r.pattern}'" if phase == 0 else window(t, at, size)
            parts.append(f"SELECT path, {phase} AS phase, {i} AS rule_ord, '{r.name}' AS rule_name, '{r.risk}' AS risk, '{kind}' AS match_type, {shown} AS matched FROM docs WHERE {hit}")
    body = " UNION ALL ".join(parts)
    return f"WITH {DOCS}, h AS ({body}) SELECT * FROM h" + (f" ORDER BY path, phase, rule_ord LIMIT {cap}" if cap else "")


_register("rules_detect", _rule_sql(), lambda d: rules.detect(d, _RULES, cap=None))
#: With words that many documents have, so that there are more hits than the cap lets through.
_COMMON = [*_RULES, *(rules.Rule(w, w, "keyword", "low", id=w) for w in ("the", "der", "la", "в", "的", "e"))]
_register("rules_cap_1000", _rule_sql(1000, _COMMON), lambda d: rules.detect(d, _COMMON))
_register("rules_guards", _rule_sql(None, _RULES, 900), lambda d: rules.detect(d, _RULES, cap=None, max_bytes=900))
_register("rules_names_only", _rule_sql(None, [replace(r, match_content=False) for r in _RULES]), lambda d: rules.detect(d, _RULES, include_content=False, cap=None))
_register(
    "rules_risk_rollup",
    _rule_sql().replace("SELECT * FROM h", "SELECT risk, count(*) AS n_hits, count(DISTINCT path) AS n_files, CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END AS severity FROM h GROUP BY risk"),
    lambda d: rules.rollup(rules.detect(d, _RULES, cap=None)),
)
_register("rules_defaults", _rule_sql(None, rules.DEFAULT_RULES), lambda d: rules.detect(d, cap=None))


# --- index maintenance: what is indexed is one state of the documents, the scan another

_FILES_SQL = """
indexed AS (SELECT path, filename, filetype, coalesce(batch, '') AS batch, size, modified_ticks, content FROM docs WHERE doc_id % 7 <> 3),
files AS (SELECT path, filename, ext, size, CASE WHEN doc_id % 5 = 1 THEN modified_ticks + 10 ELSE modified_ticks END AS modified_ticks, coalesce(batch, '') AS batch, content FROM docs WHERE doc_id % 11 <> 4),
actions AS (
  SELECT coalesce(f.path, i.path) AS path,
    CASE WHEN f.path IS NULL THEN (CASE WHEN {gone} THEN 'removed' ELSE 'kept' END) WHEN i.path IS NULL THEN 'added'
      WHEN f.size IS NOT DISTINCT FROM i.size AND f.modified_ticks IS NOT DISTINCT FROM i.modified_ticks AND f.batch IS NOT DISTINCT FROM i.batch THEN 'skipped' ELSE 'updated' END AS action,
    f.size, f.modified_ticks, f.batch
  FROM files f FULL JOIN indexed i ON f.path = i.path)
"""
_ALL_SQL = f"WITH {DOCS}, {_FILES_SQL.format(gone='true')}"
_ROOT = "/srv/depot/planning"
_ROOT_SQL = f"WITH {DOCS}, {_FILES_SQL.format(gone=f"starts_with(i.path, '{_ROOT}/')")}"
_AFTER_SQL = """, after AS (SELECT path, batch, size, modified_ticks FROM indexed i WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.path = i.path AND a.action IN ('removed', 'updated'))
UNION ALL SELECT a.path, a.batch, a.size, a.modified_ticks FROM actions a WHERE action IN ('added', 'updated'))"""


def _states(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexed documents, and a later listing with other stamps, without some files and with new ones."""
    d = d.withColumn("batch", F.coalesce("batch", F.lit("")))
    indexed = d.where("doc_id % 7 <> 3").select("path", "filename", "filetype", "batch", "size", "modified_ticks", "content")
    files = d.where("doc_id % 11 <> 4").withColumn("modified_ticks", F.when(F.col("doc_id") % 5 == 1, F.col("modified_ticks") + 10).otherwise(F.col("modified_ticks")))
    return indexed, files.drop("doc_id")


def _extracted(files: DataFrame) -> DataFrame:
    """The listing's texts, as an extractor would give them."""
    return files.select("path", router.supported(F.col("ext")).alias("supported"), F.lit(True).alias("ok"), F.col("content").alias("text"), F.lit(None).cast("string").alias("error"), router.label_of(F.col("ext")).alias("label"))


def _after(d: DataFrame, **scope) -> tuple[DataFrame, DataFrame, DataFrame]:
    indexed, files = _states(d)
    actions = index.diff(files, indexed, **scope)
    fresh = index.to_documents(actions.where(F.col("action").isin("added", "updated")), _extracted(files))
    return actions, fresh, index.apply_changes(indexed, actions, fresh)


def _diffed(d: DataFrame, **scope) -> DataFrame:
    indexed, files = _states(d)
    return index.diff(files, indexed, **scope).select("path", "action")


_register("incremental_diff", f"{_ALL_SQL} SELECT path, action FROM actions", lambda d: _diffed(d, removal_scope="all"))
_register("incremental_delete_root", f"{_ROOT_SQL} SELECT path, action FROM actions", lambda d: _diffed(d, root=_ROOT))
_register("incremental_cancelled", f"WITH {DOCS}, {_FILES_SQL.format(gone='false')} SELECT path, action FROM actions", lambda d: _diffed(d, cancelled=True))
_register("incremental_upsert", f"{_ALL_SQL} {_AFTER_SQL} SELECT * FROM after", lambda d: _after(d, removal_scope="all")[2].select("path", "batch", "size", "modified_ticks"))
_register(
    "run_stats",
    f"""{_ALL_SQL} {_AFTER_SQL}, n AS (SELECT a.action, count(*) AS n, count(*) FILTER (WHERE d.ext NOT IN ({", ".join(f"'{e}'" for e in sorted(router.EXTENSIONS))})) AS u FROM actions a LEFT JOIN docs d ON a.path = d.path GROUP BY a.action)
SELECT (sum(n) FILTER (WHERE action = 'added'))::BIGINT AS added, (sum(n) FILTER (WHERE action = 'updated'))::BIGINT AS updated, (sum(n) FILTER (WHERE action = 'skipped'))::BIGINT AS skipped, 0::BIGINT AS failed,
coalesce(sum(u) FILTER (WHERE action IN ('added', 'updated')), 0)::BIGINT AS unsupported, (sum(n) FILTER (WHERE action = 'removed'))::BIGINT AS removed, (SELECT count(*) FROM after) AS total_docs, true AS completed FROM n""",
    lambda d: index.run_stats(*_after(d, removal_scope="all")),
)
_register("batch_counts", f"WITH {DOCS} SELECT coalesce(batch, '') AS batch, count(*) AS n_docs FROM docs GROUP BY ALL", index.batch_counts)
_register(
    "batch_reassign",
    f"WITH {DOCS} SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE coalesce(batch, '') END AS batch FROM docs",
    lambda d: index.apply_changes(
        d.select(*[c.split()[0] for c in index.DOC_SCHEMA.split(", ")]),
        (a := index.diff(d.where("doc_id % 2 = 0").withColumn("batch", F.lit("again")), d, cancelled=True)),
        index.to_documents(a.where(F.col("action").isin("added", "updated")), None, include_content=False),
    ).select("path", F.coalesce("batch", F.lit("")).alias("batch")),
)
query("batch_delete", "SELECT path FROM documents WHERE batch IS DISTINCT FROM (SELECT max(batch) FROM documents)")(
    lambda spark, sf_dir: index.delete_batch(documents(spark, sf_dir), load(spark, sf_dir, "documents").agg(F.max("batch")).first()[0]).select("path")
)
query("batch_options", "SELECT b.id, b.name, count(d.path) AS n_docs FROM batches b LEFT JOIN documents d ON d.batch = b.id GROUP BY b.id, b.name")(
    lambda spark, sf_dir: index.batch_options(load(spark, sf_dir, "batches"), documents(spark, sf_dir))
)
query("batch_summary", "SELECT (SELECT count(*) FROM batches) AS n_batches, (SELECT count(*) FROM documents WHERE batch IN (SELECT id FROM batches)) AS n_docs")(
    lambda spark, sf_dir: index.batch_summary(load(spark, sf_dir, "batches"), documents(spark, sf_dir))
)


# --- a stored index: the documents in one version, half of them again in a delta, some removed and put back


def _store(spark: SparkSession, sf_dir: str) -> index.IndexStore:
    docs = documents(spark, sf_dir).select(*[c.split()[0] for c in index.DOC_SCHEMA.split(", ")])
    old = docs.withColumn("content", F.when(F.crc32("path") % 2 == 0, F.lit("an older text")).otherwise(F.col("content")))
    store = index.IndexStore(spark, work_dir(spark, "index"))
    store.commit("base", old.where(F.crc32("path") % 3 > 0))
    store.apply("removal", docs.limit(0), docs.where(F.crc32("path") % 5 == 0))
    store.apply("delta", docs.where((F.crc32("path") % 2 == 0) | (F.crc32("path") % 3 == 0) | (F.crc32("path") % 5 == 0)), docs.limit(0))
    return store


_STORED = ["voucher inventory signatures", '+voucher stamped -receipt "the owner"', "inven* +wa?er", "recipt~1", "content:[zebra TO zinc] size:[0 TO 300]", '"retention period"~2', "filetype:PDF +register", "检验报告", "(voucher OR receipt) AND (stamped OR sealed)"]


@query("store_search", " UNION ALL ".join(f"SELECT '{q}' AS q, path, filename, filetype, batch, size, score, snippet FROM ({search_sql(q, 300, None, True)})" for q in _STORED))
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of every kind over a stored index of a base and deltas."""
    store = _store(spark, sf_dir)
    docs, postings = store.read(), store.postings()
    found = [search.search_postings(postings, docs, q, 300, snippets=True).select(F.lit(q).alias("q"), "path", "filename", "filetype", "batch", "size", "score", "snippet") for q in _STORED]
    return reduce(DataFrame.unionByName, found)


@query("store_documents", f"WITH {DOCS} SELECT path, md5(coalesce(content, '')) AS digest FROM docs")
def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).read().select("path", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


@query("clear_all", "SELECT n_before, n_after FROM (SELECT count(*) AS n_before, 0::BIGINT AS n_after FROM documents)")
def clear_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a stored index before and after it is cleared."""
    store = _store(spark, sf_dir)
    before = store.count()
    store.commit("clear", store.read().limit(0))
    return spark.createDataFrame([(before, store.count())], "n_before bigint, n_after bigint")


def _changes(d: DataFrame, **how) -> DataFrame:
    files = d.withColumn("batch", F.coalesce("batch", F.lit("")))
    return index.to_documents(files.select("path", "filename", "ext", "size", "modified_ticks", "batch"), _extracted(files) if how.get("include_content", True) else None, **how)


_EXTS = ", ".join(f"'{e}'" for e in sorted(router.EXTENSIONS))
_register(
    "oversize_degrade",
    f"WITH {DOCS} SELECT path, CASE WHEN ext NOT IN ({_EXTS}) OR coalesce(size, 0) > 900 THEN '' ELSE coalesce(content, '') END AS content, ext IN ({_EXTS}) AND coalesce(size, 0) > 900 AS failed FROM docs",
    lambda d: _changes(d, max_bytes=900).select("path", "content", F.col("error").isNotNull().alias("failed")),
)
_register("filename_only_mode", f"WITH {DOCS} SELECT path, '{router.OTHER}' AS filetype, '' AS content FROM docs", lambda d: _changes(d, include_content=False).select("path", "filetype", "content"))
_register("truncate_maxchars", f"WITH {DOCS} SELECT path, CASE WHEN ext IN ({_EXTS}) THEN substr(coalesce(content, ''), 1, 64) ELSE '' END AS content FROM docs", lambda d: _changes(d, max_chars=64).select("path", "content"))


# --- files, as tables of bytes

from papersluice.plans import samples  # noqa: E402
from papersluice.sources.files import decode_bytes, decode_table, list_files, ordered_files, unreadable, zip_entries  # noqa: E402

_SAMPLES = {
    "a.docx": (samples.docx, "First line\tafter tab\nsecond\nthird 预算\na note\ntop"), "b.xlsx": (samples.xlsx, "name\tparts\n\t12.5\tinline\n\n"),
    "c.pptx": (samples.pptx, "slide 1\nslide 2\nslide 10\n"), "d.wps": (samples.docx, "First line\tafter tab\nsecond\nthird 预算\na note\ntop"), "e.ofd": (samples.ofd, "second\ntenth\n"),
    "f.doc": (samples.doc, "宽字符 text\nnarrow result end\t"), "g.xls": (samples.xls, "名称\tamount\n12345.5\t3/15/23\n7\n"), "h.ppt": (samples.ppt, "标题 one正文正文正文正文"),
    "i.wps": (samples.wps, "水库巡检表 第一版\n内部评审通过"), "j.pdf": (samples.pdf, "Hello (world)\n"), "k.zip": (lambda: samples.package({"in/a.txt": "text", "b.bin": "x"}), "── b.bin ──\n\n── in/a.txt ──\ntext\n"),
    "p.pdf": (samples.pdf_pages, "café one still\n预算\na b\n"), "q.docx": (samples.docx_with_type, None),
    "r.zip": (lambda: samples.package({"__MACOSX/x.txt": "x", "d/.DS_Store": "x", "Thumbs.db": "x", "kept.txt": "y"}), "── kept.txt ──\ny\n"),
    "s.zip": (lambda: samples.package({"big.txt": "0" * (33 << 20), "small.txt": "y"}), "── big.txt ──\n（条目过大，跳过内容）\n\n── small.txt ──\ny\n"),
    "t.zip": (lambda: samples.package({"in.zip": samples.package({"deep.txt": "z"})}), "── in.zip ──\n── deep.txt ──\nz\n\n"),
    "l.exe": (lambda: b"MZ", None), "m.docx": (lambda: b"PK damaged", None), "n.txt": (lambda: "国标编码的文本内容".encode("gb18030"), "国标编码的文本内容"), "o.doc": (lambda: samples.doc(True), None),
}


def _sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _sample_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, router.extension(n), bytearray(f())) for n, (f, _) in _SAMPLES.items()], "path string, ext string, bytes binary")


@query("extract_formats", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(t is not None).lower()}, {_sql_text(t)}, '{router.label(router.extension(n))}')" for n, (_, t) in _SAMPLES.items()) + ") t(path, ok, text, label)")
def extract_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_table(_sample_table(spark), index.MAX_CHARS).select("path", "ok", "text", "label")


_ENCODED = [("目录与文件，全部为中文。", "目录与文件，全部为中文。".encode(c), n) for c, n in (("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("gb18030", "GB18030"), ("utf-16-le", "UTF-16LE"), ("utf-16-be", "UTF-16BE"))]
_ENCODED += [("plain ascii", "plain ascii".encode(c), n) for c, n in (("ascii", "ASCII"), ("utf-16-le", "UTF-16LE"), ("utf-16-be", "UTF-16BE"), ("utf-32", "UTF-32LE"))]
_ENCODED += [("啊\ufffd", b"\xb0\xa1\xff", "GB18030"), ("", b"", "ASCII"), ("ab", b"ab", "ASCII")]


@query("decode_encodings", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{n}')" for i, (t, _, n) in enumerate(_ENCODED)) + ") t(id, text, encoding)")
def decode_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_bytes(spark.createDataFrame([(i, bytearray(b)) for i, (_, b, _) in enumerate(_ENCODED)], "id int, bytes binary"))


@query("zip_entries_listed", "SELECT * FROM (VALUES ('a', 'a.txt', 500::BIGINT, 8, false, false), ('a', 'b.txt', 1, 0, false, false), ('a', '目录/', 0, 8, true, false), ('b', NULL, NULL, NULL, NULL, true)) t(path, name, size, method, is_directory, damaged)")
def zip_entries_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = samples.package({"b.txt": "2", "a.txt": "1" * 500, "目录/": ""}, stored=("b.txt",))
    raw = spark.createDataFrame([("a", bytearray(archive)), ("b", bytearray(b"PK damaged"))], "path string, bytes binary")
    return zip_entries(raw).select("path", "name", "size", "method", "is_directory", F.col("error").isNotNull().alias("damaged"))


# --- a directory tree, listed and indexed

import os  # noqa: E402

_TREE = {"a.txt": "机密 alpha", "b/c.md": "beta", "b/d/e.pdf": samples.pdf(), "b/d/f/g.bin": "x", "b/d/f/h/i.txt": "deep words", "_hidden.txt": "u", "skip/s.txt": "left out", "z.zip": samples.package({"in.txt": "archived"})}


def _plant(spark: SparkSession) -> str:
    """Writes the tree, with links to a directory, to a file and to nothing, into a new shared folder."""
    root = work_dir(spark, "tree").removeprefix("file://").removeprefix("file:")
    for name, body in _TREE.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())
    os.symlink(f"{root}/b", f"{root}/linked")
    os.symlink(f"{root}/a.txt", f"{root}/file-link.txt")
    os.symlink(f"{root}/nothing", f"{root}/dangling.txt")
    return root


def _listed(*names: str) -> str:
    sizes = {n: len(b if isinstance(b, bytes) else b.encode()) for n, b in _TREE.items()} | {"file-link.txt": len(_TREE["a.txt"].encode())}
    return "SELECT path, ext, size, row_number() OVER (ORDER BY path) AS n FROM (VALUES " + ", ".join(f"('/{n}', '.{n.rpartition('.')[2]}', {sizes[n]}::BIGINT)" for n in names) + ") t(path, ext, size)"


def _tree(name: str, names: Sequence[str], at: str = "", **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _plant(spark)
        how = options | ({"exclude": [f"{root}/{x}" for x in options["exclude"]]} if "exclude" in options else {})
        return ordered_files(list_files(spark, root + at, **how)).select(F.expr(f"substring(path, {len(root) + 1})").alias("path"), "ext", "size", "n")

    run.__name__ = name
    query(name, _listed(*names))(run)


_EVERY = [*_TREE, "file-link.txt"]
_tree("tree_listed", _EVERY)
_tree("tree_extensions", ["b/c.md", "b/d/e.pdf"], extensions=[".md", ".pdf"])
_tree("tree_excluded", [n for n in _EVERY if not n.startswith(("skip/", "b/d/"))], exclude=["SKIP/", "b/d"])
_tree("tree_single", ["b/d/f/g.bin"], "/b/d/f/g.bin", extensions=[".txt"])


@query("tree_unreadable", "SELECT * FROM (VALUES ('/dangling.txt')) t(path)")
def tree_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _plant(spark)
    return unreadable(spark, root).select(F.expr(f"substring(path, {len(root) + 1})").alias("path"))


_STEPS = [  # step, added, updated, skipped, failed, unsupported, removed, total_docs, batches
    ("scan", 9, 0, 0, 0, 1, 0, 9, 1), ("again", 0, 0, 9, 0, 0, 0, 9, 1), ("changed", 1, 2, 6, 1, 0, 1, 9, 1), ("second root by name", 1, 0, 0, 0, 0, 0, 10, 2), ("rebuilt", 9, 0, 0, 1, 1, 1, 9, 3),
    ("batch deleted", 0, 0, 0, 0, 0, 9, 0, 2), ("cleared", 0, 0, 0, 0, 0, 0, 0, 0),
]


@query("engine_runs", "SELECT * FROM (VALUES " + ", ".join(map(str, _STEPS)) + ") t(step, added, updated, skipped, failed, unsupported, removed, total_docs, batches)")
def engine_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs of an engine did to its index and its registry of batches: scan, update, another root, rebuild, removal."""
    from papersluice.api import Engine

    root, home = _plant(spark), work_dir(spark, "home")
    engine, rows = Engine(spark, home), []

    def note(step: str, r=None, removed: int = 0) -> None:
        counts = (r.added, r.updated, r.skipped, r.failed, r.unsupported, r.removed) if r else (0, 0, 0, 0, 0, removed)
        rows.append((step, *counts, engine.total_docs(), len(engine.batches.all())))

    first = engine.scan(root, "first")
    note("scan", first)
    note("again", engine.update_batch(first.batch.id))
    with open(f"{root}/a.txt", "w") as f:
        f.write("changed entirely")
    with open(f"{root}/new.md", "w") as f:
        f.write("fresh")
    with open(f"{root}/bad.docx", "wb") as f:
        f.write(b"PK damaged")
    os.unlink(f"{root}/z.zip")
    os.unlink(f"{root}/file-link.txt")
    os.symlink(f"{root}/b/c.md", f"{root}/file-link.txt")
    note("changed", engine.update_batch(first.batch.id))
    other = work_dir(spark, "other").removeprefix("file://").removeprefix("file:")
    os.makedirs(other)
    with open(f"{other}/o.txt", "w") as f:
        f.write("other root")
    note("second root by name", engine.scan(other, include_content=False))
    rebuilt = engine.scan(root, "whole", full_rebuild=True)
    note("rebuilt", rebuilt)
    before = engine.total_docs()
    engine.delete_batch(rebuilt.batch.id)
    note("batch deleted", removed=before - engine.total_docs())
    engine.clear()
    note("cleared")
    return spark.createDataFrame(rows, "step string, added int, updated int, skipped int, failed int, unsupported int, removed int, total_docs int, batches int")


_INLINE = ["中a文b 报告v2", "哈哈哈, 单", "foo-bar １２ x", "𠮷野家 한국어 カタカナ", "", "İstanbul ÀÉ"]


@query("tokenize_cjk_inline", f"WITH t AS (SELECT unnest([{', '.join(_sql_text(x) for x in _INLINE)}]) AS x) SELECT x, array_to_string({TOKENS('x')}, '|') AS terms FROM t")
def tokenize_cjk_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _INLINE], "x string").select("x", F.array_join(text.tokens(F.col("x")), "|").alias("terms"))


_register(
    "present_results",
    f"""WITH r AS ({search_sql("voucher receipt", 100)}) SELECT r.path, r.filename, r.filetype,
CASE WHEN r.size < 1024 THEN r.size::VARCHAR || ' B' WHEN r.size < 1048576 THEN printf('%.1f KB', r.size / 1024.0::DOUBLE) ELSE printf('%.1f MB', r.size / 1048576.0::DOUBLE) END AS size,
strftime(d.modified, '%Y-%m-%d %H:%M') AS modified, printf('%.2f', r.score) AS score FROM r JOIN documents d ON r.path = d.path""",
    lambda d: search.present(search.search(d, "voucher receipt", 100)),
)
