"""Directory trees as tables: a listing source, and the text of listed files.

The listing is a Python data source. The driver opens directories, widest level first, until there
are PARTS subtrees; each is walked by the executor that reads it. Extensions, excluded directories
and directory links are cut off while walking. The tree has to be mounted on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from papersluice.functions import router
from papersluice.functions.encoding import decode
from papersluice.functions.extract import extract
from papersluice.functions.extract.package import Package
from papersluice.operators.order import ranked

LISTING = "path string, filename string, ext string, size bigint, modified_ticks bigint"
TEXTS = "path string, supported boolean, ok boolean, text string, error string, label string"
#: Bytes of files that one extraction task should read.
TASK_BYTES = 256 * 1024 * 1024
#: Subtrees into which a tree is split, if it has so many, so that a deep folder with most files does not fall to one task.
PARTS = 512
EPOCH_TICKS = 621_355_968_000_000_000


class Subtree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _entries(path: str) -> list[os.DirEntry]:
    """Members of a directory; none if it can't be read."""
    try:
        with os.scandir(path) as it:
            return sorted(it, key=lambda e: e.name)
    except OSError:
        return []


def _is_dir(e: os.DirEntry) -> bool:
    """A directory that isn't a link; one whose attributes can't be read is left out."""
    try:
        return e.is_dir(follow_symlinks=False)
    except OSError:
        return False


def _same(path: str) -> str:
    return os.path.normpath(path).rstrip("/").lower()


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        exts = options.get("extensions")
        self.extensions = None if exts is None else frozenset(e.strip().lower() for e in exts.split(",") if e.strip())
        self.exclude = frozenset(_same(os.path.abspath(p)) for p in options.get("exclude", "").split(os.pathsep) if p)

    def partitions(self) -> Sequence[InputPartition]:
        if os.path.isfile(self.root):
            return [Subtree(self.root, False)]
        # A directory that was opened here is listed without its subdirectories, the others with all below.
        opened, level = [], [self.root]
        while level and len(opened) + len(level) < PARTS:
            opened += level
            level = [e.path for p in level for e in _entries(p) if _is_dir(e) and _same(e.path) not in self.exclude]
        return [*(Subtree(p, False) for p in opened), *(Subtree(p, True) for p in level)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        if os.path.isfile(partition.path):  # a single file is listed whatever its extension
            yield from self._row(partition.path)
            return
        stack = [partition.path]
        while stack:
            for e in _entries(stack.pop()):
                if _is_dir(e):
                    if partition.deep and _same(e.path) not in self.exclude:
                        stack.append(e.path)
                elif self.extensions is None or router.extension(e.name) in self.extensions:
                    yield from self._row(e.path)

    @staticmethod
    def _row(path: str) -> Iterator[tuple]:
        try:
            if not os.path.isfile(path):
                return
            s = os.stat(path)
        except OSError:
            return
        name = os.path.basename(path)
        yield path, name, router.extension(name), s.st_size, EPOCH_TICKS + s.st_mtime_ns // 100


class TreeSource(DataSource):
    """``spark.read.format("doctree").option("extensions", ".txt,.pdf").option("exclude", "/a/b").load("/root")``"""

    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Files under ``root`` (or the file ``root``), unordered (``ordered_files`` gives their order); what can't be read is left out.

    ``extensions``: only these, in lower case with the dot; None for all. ``exclude``: directories
    whose subtrees are left out, compared whole and whatever their case.
    """
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("doctree")
    if extensions is not None:
        reader = reader.option("extensions", ",".join(extensions))
    if exclude:
        reader = reader.option("exclude", os.pathsep.join(exclude))
    return reader.load(root)


def ordered_files(files: DataFrame) -> DataFrame:
    """A listing with ``n``, each file's place in the order of the paths (from 1), without bringing it into one partition."""
    return ranked(files, "path")


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of directories under ``root`` that can't be listed and of files that can't be looked at: what a listing leaves out."""
    top = os.path.abspath(root)
    dirs = list_files(spark, root).select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, every = [], {top}
            for d in b.column(0).to_pylist():
                while d.startswith(top) and d not in every:
                    every.add(d)
                    d = os.path.dirname(d)
            for d in sorted(every):
                try:
                    with os.scandir(d) as it:
                        for e in it:
                            try:
                                if e.is_dir(follow_symlinks=False):
                                    os.scandir(e.path).close()
                                else:
                                    os.stat(e.path)
                            except OSError:
                                bad.append(e.path)
                except OSError:
                    bad.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["path"])

    return dirs.mapInArrow(run, "path string").distinct()


ENTRIES = "path string, name string, size bigint, method int, is_directory boolean, error string"


def zip_entries(raw: DataFrame) -> DataFrame:
    """``path``, ``name``, ``size``, ``method``, ``is_directory``, ``error`` of every entry of ZIP archives in a table with path and bytes.

    An archive that can't be read gives one row with its ``error`` and nothing else; null bytes count as damaged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, e.name, e.size, e.method, e.is_directory, None) for e in Package(data or b"").entries]
                except Exception as e:  # a damaged archive must not end the task
                    rows.append((path, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "name", "size", "method", "is_directory", "error"])

    return raw.select("path", "bytes").mapInArrow(run, ENTRIES)


def decode_bytes(raw: DataFrame, compat: bool = False) -> DataFrame:
    """``id``, ``text``, ``encoding`` of a table with id and bytes, by the guess at their encoding."""
    kind = raw.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(d, compat) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.text for x in found], pa.string()), pa.array([x.encoding for x in found], pa.string())], names=["id", "text", "encoding"])

    return raw.select("id", "bytes").mapInArrow(run, f"id {kind}, text string, encoding string")


def read_texts(files: DataFrame, max_chars: int, max_bytes: int) -> DataFrame:
    """path, supported, ok, text, error, label of each file; files larger than ``max_bytes`` are not opened."""
    total = files.selectExpr("coalesce(sum(size), 0) AS n").first().n
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, ext, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not (ext in router.EXTENSIONS):
                    x = (path, False, False, None, None, router.OTHER)
                elif (size or 0) > max_bytes:
                    x = (path, True, False, None, "too large", router.label(ext))
                else:
                    try:
                        with open(path, "rb") as f:
                            r = extract(ext, f.read(), max_chars)
                        x = (path, True, r.ok, r.text, r.error, r.label)
                    except OSError as e:
                        x = (path, True, False, None, str(e), router.label(ext))
                kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string())
                names = ["path", "supported", "ok", "text", "error", "label"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds)], names=names)

    return files.select("path", "ext", "size").repartition(int(tasks)).mapInArrow(run, TEXTS)


def decode_table(raw: DataFrame, max_chars: int) -> DataFrame:
    """As ``read_texts`` for a table with path, ext, bytes, such as ``binaryFile`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, extract(e or "", d or b"", max_chars)) for p, e, d in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.string()), *(pa.array([getattr(r, a) for _, r in rows], k) for a, k in (("supported", pa.bool_()), ("ok", pa.bool_()), ("text", pa.string()), ("error", pa.string()), ("label", pa.string())))],
                names=["path", "supported", "ok", "text", "error", "label"],
            )

    return raw.select("path", "ext", "bytes").mapInArrow(run, TEXTS)
