"""Queries of the set similarity join (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.text import filled
from corvane.llm import similar
from corvane.session import attach
from corvane.sources.tables import table

THRESHOLD = 0.6


def compound_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "fragment_edges").select(filled("source").alias("source"), F.lower(filled("metaedge")).alias("metaedge"), filled("target").alias("target"))
    return e.filter("startswith(source, 'Compound::') and metaedge is not null and target is not null")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.expanded(*similar.similar_sets(compound_edges(spark, d), "source", ["metaedge", "target"], THRESHOLD))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every compound with its class of equal sets, the size of that class, and how many other classes are like it."""
    pairs, members = similar.similar_sets(compound_edges(spark, d), "source", ["metaedge", "target"], THRESHOLD)
    links = pairs.select(F.col("source_a").alias("class_source")).unionByName(pairs.select(F.col("source_b").alias("class_source"))).groupBy("class_source").agg(F.count(F.lit(1)).alias("links"))
    return attach(members, links.withColumn("n", F.col("links")), ["class_source"], "n", "left").select("source", "class_source", "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_EDGES = f"""e AS (SELECT DISTINCT trim(source, {_BLANKS}) AS s, lower(trim(metaedge, {_BLANKS})) AS m, trim(target, {_BLANKS}) AS t FROM fragment_edges
  WHERE trim(source, {_BLANKS}) LIKE 'Compound::%' AND trim(metaedge, {_BLANKS}) <> '' AND trim(target, {_BLANKS}) <> '')"""
_SIZES = "z AS (SELECT s, count(*) AS n FROM e GROUP BY s)"
# pairs share one of the rarest values: of n values, n - ceil(0.6 n) + 1
_P1 = f"""
WITH {_EDGES}, {_SIZES}, f AS (SELECT m, t, count(*) AS df FROM e GROUP BY m, t),
r AS (SELECT e.*, z.n, row_number() OVER (PARTITION BY e.s ORDER BY f.df, e.m, e.t) AS k FROM e JOIN f ON e.m = f.m AND e.t = f.t JOIN z ON z.s = e.s),
p AS (SELECT * FROM r WHERE k <= n - ceil(0.6 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.s AS sa, b.s AS sb, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.m = b.m AND a.t = b.t AND a.s < b.s)
SELECT sa AS source_a, sb AS source_b FROM c JOIN e x ON x.s = sa JOIN e y ON y.s = sb AND y.m = x.m AND y.t = x.t
GROUP BY sa, sb, na, nb HAVING CAST(count(*) AS DOUBLE) / (na + nb - count(*)) >= 0.6"""
SQL = {"p1_found": _P1}
