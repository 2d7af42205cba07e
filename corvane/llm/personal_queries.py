"""Queries of personal information in texts (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import personal
from corvane.session import Scratch
from corvane.sources.tables import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_spans(table(spark, d, "documents").select("doc_id", "text")).drop("score")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return personal.redact(docs, Scratch(spark).keep(personal.personal_spans(docs)))


QUERIES = {f.__name__: f for f in (p10_found, p10_redacted)}
SQL: dict[str, str] = {}
