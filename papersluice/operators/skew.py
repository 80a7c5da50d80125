"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which every key of the many side is split.
SALTS = 16


def attach(many: DataFrame, per_key: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``per_key``, which has at most one row per key.

    Each key of ``many`` is spread over ``salts`` parts by a hash of its ``spread`` columns and
    ``per_key`` is repeated for each part, so no task gets a whole hot key.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def pairs_within(rows: DataFrame, sizes: DataFrame, on: Sequence[str], spread: Sequence[str], block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Two copies of ``rows`` ready to be joined on ``on`` and ``_part``: every pair of rows of a key meets once in one part.

    ``sizes``: one row per key with its number of rows ``n``. A key of n rows has ceil(n / block)
    parts; the first copy is split over them, the second repeated in each, so a task holds at most
    about ``block`` rows of the first copy per part however hot the key is.
    """
    parted = attach(rows, sizes.select(*on, F.ceil(F.col("n") / block).cast("bigint").alias("_parts")), on, spread)
    first = parted.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), *spread), F.col("_parts"))).drop("_parts")
    second = parted.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    return first, second
