"""The order of all rows, without bringing them into one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersluice.session import materialize


def ranked(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    """``rows`` with their place in the order of ``by`` (from 1, nulls last, equal ones in any order) as ``name``.

    Rows are sorted within ranges; a row's place is the number of rows in the ranges before it and
    its place within its own. The ranges are written once, since another run may cut them elsewhere.
    """
    spark = rows.sparkSession
    order = F.col(by).asc_nulls_last()
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    at = materialize(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before, starts = 0, []
    for r in at.groupBy("_range").count().orderBy("_range").collect():  # one row a range
        starts.append((r["_range"], before))
        before += r["count"]
    starts = spark.createDataFrame(starts, "_range bigint, _before bigint")
    return at.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
