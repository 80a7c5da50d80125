"""Small registries kept as JSON files in a shared folder: import batches, rules and settings.

Each save puts a new file in place of the old one by one rename, on whatever file system the path
names. A missing or unreadable file gives the defaults.
"""

from __future__ import annotations

import datetime as dt
import logging
import os
from dataclasses import asdict, dataclass, field
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession

from papersluice.operators.rules import DEFAULT_RULES, Rule
from papersluice.shared import SharedFolder

LOG_BYTES = 2 * 1024 * 1024


def _at(path: str, spark: SparkSession | None) -> tuple[SharedFolder, str]:
    folder, _, name = path.rpartition("/")
    return SharedFolder(spark or SparkSession.active(), folder or "."), name


def _load(path: str, spark: SparkSession | None = None):
    folder, name = _at(path, spark)
    return folder.load(name)


def _save(path: str, value, spark: SparkSession | None = None) -> None:
    folder, name = _at(path, spark)
    folder.save(name, value)


def new_batch_id(now: dt.datetime | None = None) -> str:
    now = now or dt.datetime.now()
    return f"batch_{now:%Y%m%d%H%M%S}{now.microsecond // 1000:03d}"


@dataclass
class Batch:
    id: str
    name: str
    root_path: str
    created_at: str = field(default_factory=lambda: dt.datetime.now().isoformat(timespec="milliseconds"))
    include_content: bool = True


class BatchRegistry:
    """Import batches in order of creation."""

    def __init__(self, path: str):
        self.path = path

    def all(self) -> list[Batch]:
        return [Batch(**b) for b in _load(self.path) or []]

    def find(self, id_: str) -> Batch | None:
        return next((b for b in self.all() if b.id == id_), None)

    def add(self, batch: Batch) -> None:
        _save(self.path, [asdict(b) for b in [*(b for b in self.all() if b.id != batch.id), batch]])

    def remove(self, id_: str) -> bool:
        left = [b for b in self.all() if b.id != id_]
        removed = len(left) < len(self.all())
        if removed:
            _save(self.path, [asdict(b) for b in left])
        return removed

    def clear(self) -> None:
        _save(self.path, [])

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(b) for b in self.all()], "id string, name string, root_path string, created_at string, include_content boolean")


class RuleStore:
    """Rules in order; the defaults if none are stored. Ids stay as they are across edits."""

    def __init__(self, path: str):
        self.path = path

    def all(self) -> list[Rule]:
        return [Rule(**r) for r in _load(self.path) or []] or list(DEFAULT_RULES)

    def save(self, rules: list[Rule]) -> None:
        _save(self.path, [asdict(r.normalised()) for r in rules])

    def add(self, rule: Rule) -> None:
        self.save([*self.all(), rule])

    def remove(self, id_: str) -> None:
        self.save([r for r in self.all() if r.id != id_])


@dataclass
class Settings:
    source_directory: str = ""
    index_directory: str = ""
    full_rebuild: bool = False

    @classmethod
    def load(cls, path: str) -> Settings:
        value = _load(path)
        return cls(**{k: v for k, v in (value or {}).items() if k in cls.__dataclass_fields__})

    def save(self, path: str) -> None:
        _save(path, asdict(self))


def rolling_log(path: str, name: str = "papersluice") -> logging.Logger:
    """A logger whose file is put aside at 2 MB."""
    log = logging.getLogger(name)
    if not any(isinstance(h, RotatingFileHandler) and h.baseFilename == os.path.abspath(path) for h in log.handlers):
        handler = RotatingFileHandler(path, maxBytes=LOG_BYTES, backupCount=1, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
