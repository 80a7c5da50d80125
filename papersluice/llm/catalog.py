"""Registered queries of this subpackage and the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm import abuse
from papersluice.llm.bpe import encode_corpus
from papersluice.llm.garbled import find_garbled, garbled_ids
from papersluice.llm.leakage import find_leaks
from papersluice.llm.lookalike import lookalike_classes, lookalike_pairs
from papersluice.llm.personal import find_personal
from papersluice.llm.records import text_records
from papersluice.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(text_records(spark, sf_dir, "snippet", "matched"))


@query("p1_classes")
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(text_records(spark, sf_dir, "snippet", "matched"))


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_ids(text_records(spark, sf_dir, "name", "filename", "snippet"))


@query("p3_restored")
def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(text_records(spark, sf_dir, "name", "filename", "snippet"))


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(text_records(spark, sf_dir, "matched", "snippet"))
    return found.select("field", "rec_id", F.explode("kinds").alias("kind")).distinct()


@query("p4_redacted")
def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(text_records(spark, sf_dir, "matched", "snippet"))


@query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = abuse.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "review_labels"))
    return scored.where("flagged").select("doc_id")


@query("p8_scores")
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "review_labels"), keep=["source"])


@query("p8_rates")
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(load(spark, sf_dir, "documents"), load(spark, sf_dir, "review_labels"))
