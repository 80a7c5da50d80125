"""Incremental index maintenance on document tables, and a versioned store for them.

Everything here is a plan over DataFrames: ``files`` is a listing (path, filename, ext, size,
modified_ticks, batch), ``docs`` what is indexed (path, filename, filetype, batch, size,
modified_ticks, content). Extraction happens between ``diff`` and ``apply_changes`` and only for
files that are new or changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersluice.functions.router import OTHER
from papersluice.operators.increments import VersionedTarget
from papersluice.operators.search import build_postings
from papersluice.session import broadcast_if_small

MAX_CHARS = 4 * 1024 * 1024
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_ERRORS_SHOWN = 200

ADDED, UPDATED, SKIPPED, REMOVED, KEPT = "added", "updated", "skipped", "removed", "kept"
#: Deltas after which the store is written as one version; touched paths up to which they are broadcast.
COMPACT_AFTER, TOUCHED_ROWS = 8, 500_000
POSTINGS_SCHEMA = "field string, term string, path string, positions array<int>, tf int, n_terms int"
DOC_SCHEMA = "path string, filename string, filetype string, batch string, size bigint, modified_ticks bigint, content string"


def stamps(docs: DataFrame) -> DataFrame:
    """path, size, modified_ticks, batch of what is indexed; a null batch counts as the empty one."""
    return docs.select("path", "size", "modified_ticks", F.coalesce("batch", F.lit("")).alias("batch"))


def diff(files: DataFrame, docs: DataFrame, removal_scope: str = "root", root: str | None = None, full_rebuild: bool = False, cancelled: bool = False) -> DataFrame:
    """``files`` with an ``action``, and a row for each indexed path that is gone.

    A file is updated if its size, ticks or batch differ from the indexed ones (null being a value
    of its own), skipped if none does. An indexed path that ``files`` lacks is removed if it lies
    under ``root`` (``removal_scope`` root) or anywhere (all), else kept; a cancelled run removes
    nothing. A full rebuild adds every file and removes every other path. Paths compare exactly;
    a path listed twice counts once, its latest ticks deciding. Rows without a path are left out.
    """
    listed = files.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("modified_ticks", "size", "filename", "ext", F.coalesce("batch", F.lit("")).alias("batch"))).alias("f"))
    known = stamps(docs.where("path IS NOT NULL")).select(F.col("path").alias("path"), F.struct("size", "modified_ticks", "batch").alias("o"))
    both = listed.join(known, "path", "full_outer")
    same = F.col("f.size").eqNullSafe(F.col("o.size")) & F.col("f.modified_ticks").eqNullSafe(F.col("o.modified_ticks")) & F.col("f.batch").eqNullSafe(F.col("o.batch"))
    if cancelled:
        gone: Column = F.lit(False)
    elif full_rebuild or removal_scope == "all":
        gone = F.lit(True)
    else:
        gone = F.col("path").startswith(root.rstrip("/") + "/") if root else F.lit(True)
    action = (
        F.when(F.col("f").isNull(), F.when(gone, REMOVED).otherwise(KEPT))
        .when(F.lit(full_rebuild) | F.col("o").isNull(), ADDED)
        .when(same, SKIPPED)
        .otherwise(UPDATED)
    )
    return both.select("path", action.alias("action"), "f.filename", "f.ext", "f.size", "f.modified_ticks", "f.batch")


def to_documents(changed: DataFrame, texts: DataFrame | None, include_content: bool = True, max_chars: int = MAX_CHARS, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Documents of the added and updated files, with ``ok``, ``unsupported`` and ``error``.

    ``texts``: path, supported, ok, text, error, label for the files that were read. Without content
    every file is indexed by name under the label of others; so is one of an unknown type. A file
    larger than ``max_bytes`` is indexed by name and counts as failed; one whose extraction failed
    is not indexed at all.
    """
    if not include_content or texts is None:
        return changed.select("path", "filename", F.lit(OTHER).alias("filetype"), "batch", "size", "modified_ticks", F.lit("").alias("content"), F.lit(True).alias("ok"), F.lit(False).alias("unsupported"), F.lit(None).cast("string").alias("error"))
    x = changed.join(texts.select("path", "supported", F.col("ok").alias("read"), "text", F.col("error").alias("why"), "label"), "path", "left")
    supported = F.coalesce("supported", F.lit(False))
    large = supported & (F.coalesce("size", F.lit(0)) > max_bytes)
    failed = supported & ~large & ~F.coalesce("read", F.lit(False))
    return x.select(
        "path", "filename", F.when(supported, F.col("label")).otherwise(OTHER).alias("filetype"), "batch", "size", "modified_ticks",
        F.when(supported & ~large & ~failed, F.coalesce(F.substring("text", 1, max_chars), F.lit(""))).otherwise("").alias("content"),
        (~failed).alias("ok"), (~supported).alias("unsupported"),
        F.when(large, F.lit(f"larger than {max_bytes} bytes: indexed by name")).when(failed, F.coalesce("why", F.lit("not readable"))).alias("error"),
    )


def apply_changes(docs: DataFrame, actions: DataFrame, documents: DataFrame) -> DataFrame:
    """The index after a run: what was neither removed nor replaced, and the new documents.

    A document whose file couldn't be read again stays as it was, old stamp included, so the next
    run tries it again.
    """
    fresh = documents.where("ok").select(*docs.columns)
    out = actions.where(F.col("action") == REMOVED).select("path").union(fresh.select("path"))
    return docs.join(out.distinct(), "path", "left_anti").select(*docs.columns).unionByName(fresh)


def run_stats(actions: DataFrame, documents: DataFrame, total: DataFrame, completed: bool = True) -> DataFrame:
    """One row: added, updated, skipped, failed, unsupported, removed, total_docs, completed.

    A file too large counts as failed and as added or updated as well; one that failed counts as neither.
    """
    d = documents.join(actions.select("path", "action"), "path").agg(
        *[F.count(F.when(F.col("ok") & (F.col("action") == a), 1)).alias(a) for a in (ADDED, UPDATED)],
        F.count("error").alias("failed"),
        F.count(F.when(F.col("unsupported"), 1)).alias("unsupported"),
    )
    a = actions.agg(*[F.count(F.when(F.col("action") == x, 1)).alias(x) for x in (SKIPPED, REMOVED)])
    n = total.agg(F.count("*").alias("total_docs"))
    keyed = [x.withColumn("_k", F.lit(1)) for x in (d, a, n)]
    one = keyed[0].join(keyed[1], "_k").join(keyed[2], "_k")
    return one.select(ADDED, UPDATED, SKIPPED, "failed", "unsupported", REMOVED, "total_docs", F.lit(completed).alias("completed"))


def errors(documents: DataFrame, limit: int | None = MAX_ERRORS_SHOWN) -> DataFrame:
    """path, message of what went wrong, by path; at most ``limit`` rows for display, None for all."""
    found = documents.where("error IS NOT NULL").select("path", F.col("error").alias("message"))
    return found if limit is None else found.orderBy("path").limit(limit)


def delete_batch(docs: DataFrame, batch: str | None) -> DataFrame:
    """Without the batch's documents; a blank id deletes nothing."""
    return docs if not (batch or "").strip() else docs.where(~F.col("batch").eqNullSafe(F.lit(batch)))


def batch_counts(docs: DataFrame) -> DataFrame:
    """Live documents per batch."""
    return docs.groupBy(F.coalesce("batch", F.lit("")).alias("batch")).agg(F.count("*").alias("n_docs"))


def batch_options(batches: DataFrame, docs: DataFrame) -> DataFrame:
    """Every registered batch with its live count, 0 if it has none."""
    counts = batch_counts(docs)
    return batches.join(counts, batches.id == counts.batch, "left").select("id", "name", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def batch_summary(batches: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: number of batches, and of the documents in them."""
    return batch_options(batches, docs).agg(F.count("*").alias("n_batches"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"))


@dataclass
class IndexStore:
    """Versions of the documents and their postings in a shared folder.

    A run publishes a delta: its new and changed documents, their postings, and the paths that are
    gone; what it did not touch is not written again. After COMPACT_AFTER deltas all is written as one
    version, and what only earlier states consist of is removed, the one before kept. Readers keep the
    version they opened. A missing or damaged store reads as the last good state, or an empty index.
    Postings lie sorted by term, so a query's terms are found by the row groups' statistics.
    """

    spark: SparkSession
    root: str

    def __post_init__(self):
        self._target = VersionedTarget(self.spark, self.root, T._parse_datatype_string(DOC_SCHEMA))

    def _live(self, name: str = "", schema: str = DOC_SCHEMA) -> DataFrame:
        """The documents, or the table ``name`` beside them: of each path what the last version that touched it has."""
        versions = self._target.current()
        if not versions:
            return self.spark.createDataFrame([], schema)
        base, *deltas = versions
        whole = self._target.table(base, name, schema)
        if not deltas:
            return whole
        touched = [self._target.table(m).select("path").unionByName(self._target.table(m, "gone", "path string")).select("path", F.lit(m["no"]).alias("_last")) for m in deltas]
        last = broadcast_if_small(reduce(DataFrame.unionByName, touched).groupBy("path").agg(F.max("_last").alias("_last")), TOUCHED_ROWS)
        fresh = reduce(DataFrame.unionByName, [self._target.table(m, name, schema).withColumn("_no", F.lit(m["no"])) for m in deltas])
        kept = fresh.join(last.withColumnRenamed("_last", "_no"), ["path", "_no"], "left_semi").drop("_no")
        return whole.join(last, "path", "left_anti").unionByName(kept)

    def read(self) -> DataFrame:
        return self._live()

    def postings(self) -> DataFrame:
        return self._live("postings", POSTINGS_SCHEMA)

    @staticmethod
    def _ordered(postings: DataFrame) -> DataFrame:
        return postings.select(*[c.split()[0] for c in POSTINGS_SCHEMA.split(", ")]).repartitionByRange("term", "path").sortWithinPartitions("term", "path")

    def commit(self, run: str, docs: DataFrame, postings: DataFrame | None = None) -> bool:
        """Puts ``docs`` in place of all there is; False if ``run`` was committed before. ``postings``: of ``docs``; built if not given."""
        docs = docs.select(*self._target.schema.names)
        made = build_postings(docs) if postings is None else postings
        return self._target.publish(run, docs, replaces=True, beside={"postings": self._ordered(made)})

    def apply(self, run: str, fresh: DataFrame, gone: DataFrame) -> bool:
        """Publishes the documents ``fresh`` (in place of those of their paths) and the removal of the paths ``gone``; False if ``run`` was committed before."""
        fresh = fresh.select(*self._target.schema.names)
        if not self._target.current():
            return self.commit(run, fresh)
        done = self._target.publish(run, fresh, beside={"postings": self._ordered(build_postings(fresh)), "gone": gone.select("path").distinct()})
        if len(self._target.current()) > COMPACT_AFTER:
            self.commit(f"compact-{run}", self.read(), self.postings())
            self._target.vacuum(keep=2)
        return done

    def count(self) -> int:
        return self.read().count()


def apply_to_postings(postings: DataFrame, actions: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings after a run: only those of removed and replaced documents go, only new documents are analyzed."""
    fresh = documents.where("ok")
    out = actions.where(F.col("action") == REMOVED).select("path").union(fresh.select("path")).distinct()
    return postings.join(out, "path", "left_anti").select("field", "term", "path", "positions", "tf", "n_terms").unionByName(build_postings(fresh))
