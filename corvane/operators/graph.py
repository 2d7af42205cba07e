"""Questions to the knowledge graph, each one lazily composed plan; nothing is asked once per compound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.ordered import rank_within
from corvane.functions.text import search_term
from corvane.sources.graph import PATHS


def search(nodes: DataFrame, kind: str, term: str, limit: int = 25) -> DataFrame:
    """Nodes of a kind by relevance: equal names, then beginnings, then names that hold the term; id or name as given also count."""
    raw, word = F.lit(term.strip()), search_term(F.lit(term))
    name = F.lower("name")
    hit = (word == "") | (F.lower("id") == F.lower(raw)) | (name == F.lower(raw)) | (name == word) | F.contains(name, word)
    rank = F.when((word == "") | (name == word), 0).when(F.startswith(name, word), 1).when(F.contains(name, word), 2).otherwise(3)
    return nodes.filter((F.col("kind") == kind) & F.coalesce(hit, F.lit(False))).select("id", "name", rank.alias("relevance")).orderBy("relevance", "name", "id").limit(limit)


def request(terms: list[object], most: int = 10, longest: int = 200) -> list[str]:
    """Terms of a request, trimmed, without blanks and repeats, in order; raises if there are none, too many or too long ones."""
    out = list(dict.fromkeys(t.strip() for t in terms if isinstance(t, str) and t.strip()))
    if not 1 <= len(out) <= most or any(len(t) > longest for t in out):
        raise ValueError(f"1 to {most} terms of at most {longest} signs are needed")
    return out


def resolve(terms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pos, term, id, name) of requests (pos, term): by id, else by name, in any case; the first request of each id is kept,
    unknown ones have a null id. Of several nodes of a name the first id counts."""
    key = terms.withColumn("k", F.lower(F.trim("term")))
    by_id = catalog.select(F.lower("id").alias("k"), F.col("id").alias("id1"), F.col("name").alias("name1"))
    by_name = catalog.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("id2"), F.min_by("name", "id").alias("name2"))
    got = key.join(by_id, "k", "left").join(by_name, "k", "left").select("pos", "term", F.coalesce("id1", "id2").alias("id"), F.coalesce("name1", "name2").alias("name"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return got.withColumn("n", first).filter("id is null or n = 1").drop("n")


def best_match(terms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pos, term, id, name) of requests (pos, term): by id as given, else the first node by relevance whose name the term is, begins or is held by."""
    by_id = catalog.select(F.col("id").alias("term"), F.col("id").alias("id1"), F.col("name").alias("name1"))
    got = terms.withColumn("term", F.trim("term")).join(by_id, "term", "left")
    word, name = search_term("term"), F.lower("name")
    rank = F.when(name == word, 0).when(F.startswith(name, word), 1).otherwise(2)
    # requests are some ten rows
    hits = catalog.join(F.broadcast(got.filter("id1 is null and term <> ''").select("pos", "term")), F.contains(name, word))
    best = hits.groupBy("pos").agg(F.min(F.struct(rank.alias("r"), "name", "id")).alias("b"))
    return got.join(best, "pos", "left").select("pos", "term", F.coalesce("id1", "b.id").alias("id"), F.coalesce("name1", "b.name").alias("name"))


def endpoints(edges: DataFrame, nodes: DataFrame, more: DataFrame) -> DataFrame:
    """The nodes at either end of the edges, and those of more (id); ends that aren't nodes are left out."""
    ids = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).unionByName(more.select("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def named(edges: DataFrame, nodes: DataFrame, metaedges: tuple[str, ...]) -> DataFrame:
    """Edges of some relations with the names of both ends; edges that lack an end are left out."""
    s = nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"))
    return edges.filter(F.col("metaedge").isin(*metaedges)).join(s, "source").join(t, "target")


def treating(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(drug, drug_name, disease) of all treatments between nodes."""
    return named(edges, nodes, ("ctd",)).select(F.col("source").alias("drug"), F.col("source_name").alias("drug_name"), F.col("target").alias("disease"))


def most_treated(treating: DataFrame, n: int) -> DataFrame:
    """The n diseases that the most compounds treat."""
    return treating.groupBy("disease").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "disease").limit(n).select("disease")


def treatments(treating: DataFrame, diseases: list[str]) -> DataFrame:
    """Compounds that treat any of the diseases: (drug, drug_name, disease_ids, covered)."""
    t = treating.filter(F.col("disease").isin(*diseases)) if diseases else treating.limit(0)
    return t.groupBy("drug").agg(F.min("drug_name").alias("drug_name"), F.array_sort(F.collect_set("disease")).alias("disease_ids")).withColumn("covered", F.size("disease_ids"))


def in_order(treatments: DataFrame) -> DataFrame:
    """treatments with pos, their place: most diseases first, then by name and id."""
    order = [F.desc("covered"), F.col("drug_name").asc_nulls_last(), F.col("drug")]
    # names by their first two signs, nulls behind all; at most some thousand buckets
    begin = F.coalesce(F.concat(F.lit("0"), F.substring("drug_name", 1, 2)), F.lit("1"))
    return rank_within(treatments, [], F.concat(F.lpad((F.lit(10**6) - F.col("covered")).cast("string"), 7, "0"), begin), order, "pos")


def top_related(edges: DataFrame, nodes: DataFrame, metaedges: tuple[str, ...], n: int = 5) -> DataFrame:
    """Per compound the first n related nodes by name; a node that two relations reach takes two places."""
    order = Window.partitionBy("source").orderBy(F.col("target_name").asc_nulls_last(), "metaedge", "target")
    return named(edges, nodes, metaedges).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(F.col("source").alias("drug"), "place", "metaedge", F.col("target").alias("related"), F.col("target_name").alias("related_name"))


def incident(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges at either end of which a seed stands, as a union of two semi-joins; seeds has the column id."""
    out = edges.join(seeds, edges["source"] == seeds["id"], "left_semi")
    into = edges.join(seeds, edges["target"] == seeds["id"], "left_semi").join(seeds, edges["source"] == seeds["id"], "left_anti")
    return out.unionByName(into)


def path_id(source: Column, metaedge: Column, target: Column, graph: str, version: str) -> Column:
    """A digest of a path that doesn't depend on names."""
    text = F.to_json(F.array(F.lit(graph), source, metaedge, target, F.lit(version)))
    return F.concat(F.lit("graph-path:"), F.substring(F.sha2(text, 256), 1, 24))


def evidence_paths(edges: DataFrame, nodes: DataFrame, graph: str = "graph", version: str = "1") -> DataFrame:
    """(path_id, drug, semantic, metaedge, target, target_name) of the relations that make paths."""
    semantic = F.element_at(F.create_map(*[F.lit(x) for k, v in PATHS.items() for x in (k, v[0])]), F.col("metaedge"))
    e = named(edges, nodes, tuple(PATHS))
    return e.select(path_id(F.col("source"), F.col("metaedge"), F.col("target"), graph, version).alias("path_id"), F.col("source").alias("drug"), semantic.alias("semantic"), "metaedge", "target", "target_name")
