"""Queries over the texts of documents: packing (p8) and leaks of evaluation items (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import leaks, packing
from corvane.session import Scratch
from corvane.sources.tables import table

CAPACITY = 2048


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = Scratch(spark).keep(packing.token_counts(table(spark, d, "documents").select("doc_id", "text")))
    return packing.pack(sizes, CAPACITY)


def p9_windows(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leaks.leaks(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    # a case is a verified passage that stands there with the same words
    return p9_windows(spark, d).filter("passage and same").select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """How many passages of an item each document holds, how many of them unchanged, and how alike it is at the item's own size (null: not alike)."""
    own = F.col("similarity")
    got = p9_windows(spark, d).groupBy("doc_id", "item_id")
    return got.agg(F.count_if(F.col("passage")).alias("passages"), F.count_if(F.col("passage") & F.col("same")).alias("unchanged"), F.max(F.when(~F.col("passage"), own)).alias("similarity"))


QUERIES = {f.__name__: f for f in (p8_containers, p9_found, p9_report)}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+')"
_P9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(k) WHERE len(w) > 0),
dw AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS r(k) WHERE len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g"""
SQL = {"p9_found": _P9}
