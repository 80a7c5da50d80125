"""The engine: scans directories into batches, searches what is indexed, and runs detection rules."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.functions.text import highlight_spans, snippet
from papersluice.operators import index, rules, search
from papersluice.session import materialize
from papersluice.sources.files import list_files, read_texts
from papersluice.sources.stores import Batch, BatchRegistry, RuleStore, Settings, new_batch_id


class Busy(RuntimeError):
    """Another run holds the engine."""


class Cancelled(RuntimeError):
    """The run was told to stop; nothing of it was committed."""


@dataclass
class RunResult:
    batch: Batch
    added: int = 0
    updated: int = 0
    skipped: int = 0
    failed: int = 0
    unsupported: int = 0
    removed: int = 0
    total_docs: int = 0
    completed: bool = True
    errors: list[tuple[str, str]] = field(default_factory=list)


class Engine:
    """``home`` is a folder that all executors share; the index, batches, rules and settings live in it.

    One run (scan, update, removal, detection) goes at a time; a second is refused. Searches read
    the last committed version and are never refused. ``commit_every`` is accepted for callers that
    set it: a run is committed as a whole, by one rename.
    """

    def __init__(self, spark: SparkSession, home: str, removal_scope: str = "root", commit_every: int = 200):
        self.spark, self.home, self.removal_scope, self.commit_every = spark, home.rstrip("/"), removal_scope, commit_every
        self.store = index.IndexStore(spark, f"{self.home}/index")
        self.batches = BatchRegistry(f"{self.home}/batches.json")
        self.rules = RuleStore(f"{self.home}/rules.json")
        self.settings_path = f"{self.home}/settings.json"
        self._gate, self._group = threading.Lock(), f"papersluice-{uuid.uuid4().hex}"
        self._stop = threading.Event()
        self._current: str | None = None
        self.truncated = False
        self.log: logging.Logger = logging.getLogger("papersluice")

    @property
    def settings(self) -> Settings:
        return Settings.load(self.settings_path)

    @contextmanager
    def _exclusive(self):
        if not self._gate.acquire(blocking=False):
            raise Busy("another run is going on")
        self._stop.clear()
        self.spark.sparkContext.setJobGroup(self._group, "papersluice run", interruptOnCancel=True)
        try:
            yield
        except Exception as e:
            if self._stop.is_set():
                self.log.warning("run stopped; nothing was committed")
                raise Cancelled("stopped") from e
            self.log.exception("run failed")
            raise
        finally:
            self._current = None
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self._gate.release()

    @property
    def busy(self) -> bool:
        return self._gate.locked()

    def cancel(self) -> None:
        """Stops the run that is going on; nothing of it is committed."""
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self._group)

    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks in all of the run's jobs that are going on."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(self._group) if (info := tracker.getJobInfo(j)) for i in info.stageIds if (s := tracker.getStageInfo(i))]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)

    def current(self) -> str | None:
        """What the run is at: the batch's root and the step."""
        return self._current

    # --- scanning

    def scan(self, root: str, name: str = "", include_content: bool = True, exclude: Sequence[str] = (), full_rebuild: bool = False) -> RunResult:
        """Indexes a directory as a new batch; a path belongs to the batch that scanned it last."""
        id_ = new_batch_id()
        batch = Batch(id_, name.strip() or id_, root, include_content=include_content)
        with self._exclusive():
            result = self._run(batch, exclude, full_rebuild)
            self.batches.add(batch)
            return result

    def update_batch(self, id_: str) -> RunResult:
        """Scans a batch's root again under its id."""
        batch = self.batches.find(id_)
        if batch is None:
            raise KeyError(id_)
        with self._exclusive():
            return self._run(batch, (), False)

    def _run(self, batch: Batch, exclude: Sequence[str], full_rebuild: bool) -> RunResult:
        self._current = f"{batch.root_path}: listing"
        docs = self.store.read()
        files = list_files(self.spark, batch.root_path, exclude=[self.home, *exclude]).withColumn("batch", F.lit(batch.id))
        actions = materialize(index.diff(files, docs, self.removal_scope, batch.root_path, full_rebuild), "actions")
        changed = actions.where(F.col("action").isin(index.ADDED, index.UPDATED))
        self._current = f"{batch.root_path}: reading"
        texts = read_texts(changed, index.MAX_CHARS, index.MAX_FILE_BYTES) if batch.include_content else None
        fresh = materialize(index.to_documents(changed, texts, batch.include_content), "fresh")
        if self._stop.is_set():
            raise Cancelled("stopped")
        self._current = f"{batch.root_path}: indexing"
        run, made = f"{batch.id}-{uuid.uuid4().hex}", fresh.where("ok")
        if full_rebuild:
            self.store.commit(run, made)
        else:
            self.store.apply(run, made, actions.where(F.col("action") == index.REMOVED))
        row = index.run_stats(actions, fresh, self.store.read()).first().asDict()
        self.log.info("batch %s of %s: %s", batch.id, batch.root_path, row)
        return RunResult(batch, **row, errors=[tuple(r) for r in index.errors(fresh).collect()])

    # --- batches

    def delete_batch(self, id_: str) -> None:
        if not id_.strip():
            return
        with self._exclusive():
            docs = self.store.read()
            self.store.apply(f"delete-{uuid.uuid4().hex}", docs.limit(0), docs.where(F.col("batch") == id_))
            self.batches.remove(id_)

    def clear(self) -> None:
        with self._exclusive():
            self.store.commit(f"clear-{uuid.uuid4().hex}", self.store.read().limit(0))
            self.batches.clear()

    def batch_count(self, id_: str) -> int:
        return self.store.read().where(F.col("batch") == id_).count() if id_.strip() else 0

    def batch_options(self) -> DataFrame:
        return index.batch_options(self.batches.as_frame(self.spark), self.store.read())

    def batch_summary(self) -> DataFrame:
        return index.batch_summary(self.batches.as_frame(self.spark), self.store.read())

    # --- reading

    def total_docs(self) -> int:
        return self.store.count()

    def search(self, query: str, k: int = search.MAX_RESULTS, batch: str | None = None, snippets: bool = True) -> DataFrame:
        return search.search_postings(self.store.postings(), self.store.read(), query, k, batch, snippets)

    def preview(self, path: str, query: str) -> DataFrame:
        """Snippet and highlight spans of one document."""
        doc = self.store.read().where(F.col("path") == path)
        s = snippet(F.col("content"), query)
        return doc.select("path", s.alias("snippet")).withColumn("spans", highlight_spans(F.col("snippet"), query))

    def detect(self, path: str, include_content: bool = True, rule_list: Iterable[rules.Rule] | None = None, cap: int | None = rules.MAX_HITS) -> DataFrame:
        """Hits in the files under ``path``, or in the file ``path``; reads the files, not the index.

        ``truncated`` of the engine then tells whether there are more than ``cap``.
        """
        with self._exclusive():
            files = list_files(self.spark, path)
            used = list(self.rules.all() if rule_list is None else rule_list)
            if include_content and any(r.match_content for r in used):
                texts = read_texts(files, index.MAX_CHARS, index.MAX_FILE_BYTES).where("ok").select("path", F.col("text").alias("content"))
                docs = files.join(texts, "path", "left")
            else:
                docs = files.withColumn("content", F.lit(None).cast("string"))
            if cap is None:
                return materialize(rules.detect(docs, used, include_content, None), "hits")
            # One more than wanted tells whether something was cut off.
            found = materialize(rules.detect(docs, used, include_content, cap + 1), "hits").orderBy("path", "phase", "rule_ord")
            self.truncated = found.count() > cap
            return found.limit(cap)
