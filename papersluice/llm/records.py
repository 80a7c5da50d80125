"""Text fields of the tables as records: field, rec_id, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.session import load

#: field -> table, id column, text column
FIELDS = {
    "snippet": ("search_results", "result_id", "snippet"),
    "matched": ("hits", "hit_id", "matched"),
    "filename": ("search_results", "result_id", "filename"),
    "name": ("zip_entries", "entry_id", "name"),
}


def text_records(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """``field``, ``rec_id``, ``text`` of the named fields; rows without an id or with a null or empty text make no record."""
    parts = []
    for field in fields:
        table, key, text = FIELDS[field]
        parts.append(load(spark, sf_dir, table).select(F.lit(field).alias("field"), F.col(key).alias("rec_id"), F.col(text).alias("text")))
    return reduce(DataFrame.union, parts).where("rec_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
