"""Processing only new or changed records, with the target as the only state.

The target is a folder of published versions. Every row in it carries the source key and the
version of the source row it came from, so what is still to be done is the source less what the
target holds in that version or a later one; no other bookkeeping can get out of step. A version
becomes visible when its manifest is made, at once and for one writer only: a run that fails before
leaves nothing behind, and a run that is repeated after finds its version there and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersluice.shared import SharedFolder

#: Published versions after which the state is rewritten as one.
COMPACT_AFTER = 16
#: Seconds after which data that no version names is taken for left behind by a failed writer.
ABANDONED_AFTER = 24 * 3600


class VersionedTarget:
    """Published versions in a shared folder.

    A manifest that is missing, cut short or otherwise damaged counts as a version that was never
    published: readers get the last good state, and rows that only it held are done again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.folder = SharedFolder(spark, self.root)
        self._known: dict[str, dict] = {}

    def _numbers(self) -> list[str]:
        return [n for n in self.folder.names("_published") if n.endswith(".json")]

    def manifests(self) -> list[dict]:
        """Published versions with their numbers (``no``), oldest first. A manifest never changes, so each is read once."""
        out = []
        for n in self._numbers():
            if n not in self._known:
                m = self.folder.load(f"_published/{n}")
                if not isinstance(m, dict) or not {"run", "data", "replaces"} <= m.keys() or not self.folder.exists(m["data"]):
                    continue
                self._known[n] = m | {"no": int(n[:-5])}
            out.append(self._known[n])
        return out

    def published(self, run: str) -> bool:
        return any(m["run"] == run for m in self.manifests())

    def publish(self, run: str, df: DataFrame, replaces: bool = False, beside: dict[str, DataFrame] | None = None) -> bool:
        """Writes ``df`` and makes it visible as the version of ``run``; False if ``run`` is already there.

        Tables ``beside`` it become visible with it. Of two writers that race for the same version
        number one fails, and nothing of it is seen.
        """
        if self.published(run):
            return False
        number = max((int(n[:-5]) for n in self._numbers()), default=-1) + 1
        data = f"data/{number:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{data}")
        for name, other in (beside or {}).items():
            other.write.parquet(f"{self.root}/{data}-{name}")
        if not self.folder.claim(f"_published/{number:08d}.json", json.dumps({"run": run, "data": data, "replaces": replaces, "beside": sorted(beside or {})})):
            for name in ("", *(f"-{n}" for n in beside or {})):
                self.folder.remove(data + name)
            raise RuntimeError(f"version {number} was published by another writer")
        return True

    def current(self) -> list[dict]:
        """The versions that make up the state: the last one that replaces all before, and those after it."""
        found = self.manifests()
        return found[max((i for i, m in enumerate(found) if m["replaces"]), default=0) :]

    def table(self, m: dict, name: str = "", schema: str | T.StructType | None = None) -> DataFrame:
        """What a version published, or the table ``name`` beside it."""
        return self.spark.read.schema(schema or self.schema).parquet(f"{self.root}/{m['data']}" + (f"-{name}" if name else ""))

    def read(self, kind: str = "state") -> DataFrame:
        """``state``: rows since the last compaction; ``deltas``: what every run published."""
        found = self.current() if kind == "state" else [m for m in self.manifests() if not m["replaces"]]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.root}/{m['data']}" for m in found]) if found else self.spark.createDataFrame([], self.schema)

    def vacuum(self, keep: int = 1) -> int:
        """Removes the data that only states before the last ``keep`` consist of, and what failed writers left; the number of tables removed.

        For targets whose state is all that is wanted (an index): the rows that runs put out go as well.
        """
        found = self.manifests()
        whole = [i for i, m in enumerate(found) if m["replaces"]]
        kept = {m["data"] for m in (found[whole[-keep] :] if len(whole) >= keep else found)}
        named = {m["data"] for m in found}
        gone = 0
        for n in self.folder.names("data"):
            base = "data/" + "-".join(n.split("-")[:2])
            if base not in kept and (base in named or self.folder.age(f"data/{n}") > ABANDONED_AFTER):
                self.folder.remove(f"data/{n}")
                gone += 1
        self._known.clear()
        return gone


class IncrementalFeed:
    """Applies a feed of observed row versions to a target, run by run.

    ``key`` names the source key, ``fields`` what a version consists of, ``order`` what makes one
    version newer than another, ``arrival`` when a row became visible to runs.
    """

    def __init__(self, spark: SparkSession, root: str, feed: DataFrame, key: str = "path", fields: Sequence[str] = ("size", "modified_ticks", "batch"), order: Sequence[str] = ("observed_at", "feed_id"), arrival: str = "arrived_at"):
        self.key, self.fields, self.order, self.arrival = key, list(fields), list(order), arrival
        self.columns = [key, *self.order, *self.fields]
        self.feed = feed.select(*self.columns, arrival).where(F.col(key).isNotNull())
        state = T.StructType([T.StructField(f.name, f.dataType) for f in self.feed.select(*self.columns).schema])
        self.schema = T.StructType([*state, T.StructField("emitted", T.BooleanType()), T.StructField("run", T.StringType())])
        self.target = VersionedTarget(spark, root, self.schema)

    def _newest(self, df: DataFrame) -> DataFrame:
        """One row per key: the greatest by order, ties by the fields. Combined before the shuffle."""
        best = df.groupBy(self.key).agg(F.max(F.struct(*self.order, *self.fields)).alias("best"))
        return best.select(self.key, "best.*")

    def run(self, run: str, upto) -> bool:
        """Publishes what is new or changed among the rows that arrived by ``upto``; False if ``run`` was published before.

        What is new is derived from the target's keys and versions alone, so a row that comes to the
        feed late, whatever its time of arrival says, is done by the next run. State and source meet
        in one join on the key: source versions that the target holds, or holds later ones of, drop out.
        """
        if self.target.published(run):
            return False
        when = self.feed.schema[self.arrival].dataType
        arrived = self.feed.where(F.col(self.arrival) <= F.lit(str(upto)).cast(when))
        version = F.struct(*[F.col(c) for c in self.order])
        values = F.struct(*[F.col(c) for c in self.fields])
        held = self._newest(self.target.read().select(*self.columns)).select(self.key, version.alias("_version"), values.alias("_values"))
        ahead = (
            self._newest(arrived.select(*self.columns))
            .join(held, self.key, "left")
            .where(F.col("_version").isNull() | (version > F.col("_version")))
            .select(*self.columns, (F.col("_version").isNull() | ~values.eqNullSafe(F.col("_values"))).alias("emitted"), F.lit(run).alias("run"))
        )
        self.target.publish(run, ahead)
        if len(self.target.current()) > COMPACT_AFTER:
            compact = self._newest(self.target.read().select(*self.columns)).select("*", F.lit(False).alias("emitted"), F.lit(None).cast("string").alias("run"))
            self.target.publish(f"compact-{uuid.uuid4().hex}", compact.select(*self.schema.names), replaces=True)
        return True

    def emitted(self) -> DataFrame:
        """Rows that any run put out: new or changed then."""
        return self.target.read("deltas").where("emitted")


def successful_runs(runs: DataFrame) -> DataFrame:
    """run_no and started_at of the runs with a row that has completed = true, one row each."""
    return runs.where("run_no IS NOT NULL").groupBy("run_no").agg(F.min("started_at").alias("started_at"), F.max(F.coalesce("completed", F.lit(False))).alias("ok")).where("ok AND started_at IS NOT NULL").select("run_no", "started_at")


def replay_runs(feed: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """What each successful run of a log had to process: ``run_no``, ``path``.

    Runs that failed publish nothing, so their rows fall to the next run that succeeds. Repeated
    and re-sent feed rows, late and disordered arrival and null sizes or batches are covered; feed
    rows without a path or an arrival time are never visible. An empty log or feed gives no rows.
    The run log (one row a run) is small and is walked by the driver; rows never are.
    """
    spark = feed.sparkSession
    log = successful_runs(runs).orderBy("started_at", "run_no").collect()
    inc = IncrementalFeed(spark, root, feed)
    for r in log:
        inc.run(str(r.run_no), r.started_at)
    return inc.emitted().select(F.col("run").cast(dict(runs.dtypes)["run_no"]).alias("run_no"), "path")
