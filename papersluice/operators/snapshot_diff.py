"""What changed between consecutive full snapshots of a table.

Each snapshot is unpivoted into signed cells (key, field, value): +1 for the later snapshot of a
pair, -1 for the earlier one, plus a presence marker per key. A cell that both snapshots share
sums to zero; what is left classifies the key and names the changed fields. No join of two
snapshots takes place, so any number of consecutive pairs costs one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papersluice.session import BROADCAST_ROWS

PRESENCE = ""


def snapshot_changes(
    df: DataFrame,
    snapshot: str = "snapshot_no",
    keys: Sequence[str] = ("path",),
    fields: Sequence[str] = ("size", "modified_ticks", "batch"),
    version: str = "loaded_at",
) -> DataFrame:
    """Changes between each delivered snapshot and the one delivered before it.

    Result: ``snapshot``, the keys, ``change_kind`` (added, removed, changed) and
    ``changed_fields`` (sorted; empty unless changed).

    * Of several rows of a key in a snapshot the one with the greatest ``version`` counts (null is
      the least); ties are settled by the field values, so the result does not depend on row order.
    * Null is a value of its own in every field. Keys compare exactly.
    * Rows with a null snapshot or a null key have no identity and are left out.
    * The first snapshot, an empty table and a table with one snapshot give no rows.
    * Other columns, whatever their names, are ignored.

    Repeated rows are combined before the shuffle, so a key repeated without end does not skew it;
    after that a key has one row per snapshot and all later steps stay within its partition.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    src = df.select(
        F.col(snapshot).alias("s"),
        *[F.col(c).alias(k) for c, k in zip(keys, ks)],
        F.struct(F.col(version).alias("v"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)]).alias("r"),
    ).dropna(subset=["s", *ks])
    latest = src.groupBy("s", *ks).agg(F.max("r").alias("r"))

    # One row per delivery, read once: as long as there are few, they are brought here and broadcast.
    order = Window.orderBy("s")
    pairs = src.select("s").distinct().select("s", F.lag("s").over(order).isNotNull().alias("has_before"), F.lead("s").over(order).alias("after"))
    few = pairs.take(BROADCAST_ROWS + 1)
    if len(few) <= BROADCAST_ROWS:
        pairs = F.broadcast(df.sparkSession.createDataFrame(few, pairs.schema))

    cells = [(F.lit(PRESENCE), F.lit(None).cast("string"))] + [(F.lit(c), F.col(f"r.f{i}")) for i, c in enumerate(fields)]
    signed = [
        F.struct(later.alias("later"), F.lit(sign).alias("sign"), field.alias("field"), value.alias("value"))
        for later, sign in ((F.when(F.col("has_before"), F.col("s")), 1), (F.col("after"), -1))
        for field, value in cells
    ]
    unpivoted = (
        latest.repartition(*ks)
        .join(pairs, "s")
        .select(*ks, F.inline(F.array(*signed)))
        .where(F.col("later").isNotNull())
    )
    left = unpivoted.groupBy(*ks, "later", "field", "value").agg(F.sum("sign").alias("n")).where("n != 0")
    rows = left.groupBy(*ks, "later").agg(
        F.max(F.when(F.col("field") == PRESENCE, F.col("n"))).alias("presence"),
        F.sort_array(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field")))).alias("changed"),
    )
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return rows.select(
        F.col("later").alias(snapshot),
        *[F.col(k).alias(c) for c, k in zip(keys, ks)],
        kind.alias("change_kind"),
        F.when(F.col("presence").isNull(), F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )
