"""The knowledge graph as two DataFrames: nodes (id, name, kind) and edges (source, metaedge, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.text import filled
from corvane.sources.tables import table

# Which relations make evidence paths, and what they mean; all others make none.
PATHS = {"ctd": ("treatment", "disease"), "cdg": ("gene_context", "gene"), "cug": ("gene_context", "gene"), "cbg": ("gene_context", "gene"), "ccse": ("side_effect_context", "side effect")}
GENES = ("cbg", "cug", "cdg")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct by id; of several names or kinds the first in order. Nodes without id or kind are left out."""
    n = table(spark, d, "fragment_nodes").select(filled("id").alias("id"), filled("name").alias("name"), F.lower(filled("kind")).alias("kind"))
    return n.filter("id is not null and kind is not null").groupBy("id").agg(F.min("name").alias("name"), F.min("kind").alias("kind"))


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every sound row, repeated ones too."""
    e = table(spark, d, "fragment_edges").select(filled("source").alias("source"), F.lower(filled("metaedge")).alias("metaedge"), filled("target").alias("target"))
    return e.filter("source is not null and metaedge is not null and target is not null")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct triples: loading a row twice changes nothing."""
    return all_edges(spark, d).distinct()


def complete_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Partitioned by kind and by metaedge, so that a query of one relation reads that relation only."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("metaedge").parquet(f"{folder}/edges")


def _b(c: str) -> str:
    return f"nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '')"


#: The same as SQL, to head a WITH list.
SQL = f"""nodes AS (SELECT {_b("id")} AS id, min({_b("name")}) AS name, min(lower({_b("kind")})) AS kind FROM fragment_nodes
  WHERE {_b("id")} IS NOT NULL AND {_b("kind")} IS NOT NULL GROUP BY {_b("id")}),
rows_ AS (SELECT {_b("source")} AS source, lower({_b("metaedge")}) AS metaedge, {_b("target")} AS target FROM fragment_edges
  WHERE {_b("source")} IS NOT NULL AND {_b("metaedge")} IS NOT NULL AND {_b("target")} IS NOT NULL),
edges AS (SELECT DISTINCT * FROM rows_)"""
