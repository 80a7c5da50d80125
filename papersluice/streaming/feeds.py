"""Structured Streaming forms: rules over arriving documents, and a stamp feed applied batch by batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papersluice.operators.increments import IncrementalFeed
from papersluice.operators.rules import DEFAULT_RULES, Rule, detect


def detect_stream(docs: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Hits of a stream of documents (path, filename, content); stateless, so without the ordered cap."""
    return detect(docs, rules, cap=None)


def hit_rates(hits: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Hits per risk and window of event time; rows later than ``late`` are left out, each window is final once."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window), "risk").agg(F.count("*").alias("n_hits")).select("window.start", "window.end", "risk", "n_hits")


def apply_feed(feed: DataFrame, target_root: str, checkpoint: str, **columns) -> StreamingQuery:
    """Applies a stream of observed stamps to a versioned target, exactly once.

    Each micro-batch is published under its number: one that is repeated after a failure finds its
    version there and is passed over.
    """

    def publish(batch: DataFrame, number: int) -> None:
        inc = IncrementalFeed(batch.sparkSession, target_root, batch, **columns)
        upto = batch.agg(F.max(inc.arrival)).first()[0]
        if upto is not None:
            inc.run(f"batch-{number:012d}", upto)

    return feed.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
