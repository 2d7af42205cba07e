"""Features of compounds and of pairs of them, from the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.ordered import running_sum
from corvane.session import Scratch

# The sets of neighbours of a compound, by relation.
ROLES = {"ctd": "treated_disease", "cpd": "palliated_disease", "cbg": "bound_gene", "cug": "upregulated_gene", "cdg": "downregulated_gene", "ccse": "side_effect"}


COUNTS = ["treated_disease", "palliated_disease", "bound_gene", "upregulated_gene", "downregulated_gene", "side_effect", "pharmacologic_class", "resemblance"]
BIT = {r: 1 << i for i, r in enumerate(COUNTS)}


def ends(edges: DataFrame) -> DataFrame:
    """(compound, neighbour, bits): every edge from each of its compounds, with the bit of the set that it puts the other end
    into, 0 for none; in one pass over the edges. Classes point at compounds, likeness holds both ways, a loop is one end."""
    m = F.col("metaedge")
    out = {k: BIT[r] for k, r in ROLES.items()} | {"crc": BIT["resemblance"]}
    back = {"pcic": BIT["pharmacologic_class"], "crc": BIT["resemblance"]}
    bit = lambda d: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), m), F.lit(0))
    one = F.struct(F.col("source").alias("compound"), F.col("target").alias("neighbour"), bit(out).alias("bits"))
    two = F.struct(F.col("target").alias("compound"), F.col("source").alias("neighbour"), bit(back).alias("bits"))
    loop = F.struct(F.col("source").alias("compound"), F.col("target").alias("neighbour"), bit(out).bitwiseOR(bit(back)).alias("bits"))
    both = F.when(F.col("source") == F.col("target"), F.array(loop)).otherwise(F.array(one, two))
    return edges.select(F.explode(both).alias("x")).select("x.*").filter("startswith(compound, 'Compound::')")


def neighbours(edges: DataFrame, role: str) -> DataFrame:
    """(compound, neighbour), distinct, of one set family."""
    return ends(edges).filter(F.col("bits").bitwiseAND(F.lit(BIT[role])) != 0).select("compound", "neighbour").distinct()


def compound_features(all_edges: DataFrame) -> DataFrame:
    """One row per compound: sizes of its sets, of their unions, and its degree, in which repeated rows count."""
    return features_of(ends(all_edges).groupBy("compound", "neighbour").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("rows")))


def features_of(near: DataFrame) -> DataFrame:
    """The same from (compound, neighbour, bits, rows)."""
    has = lambda roles: F.count_if(F.col("bits").bitwiseAND(F.lit(sum(BIT[r] for r in roles))) != 0)
    sizes = [has([r]).alias(r) for r in COUNTS]
    gene, disease = ([r for r in COUNTS if r.endswith(f"_{k}")] for k in ("gene", "disease"))
    return near.groupBy("compound").agg(F.sum("rows").alias("degree"), *sizes, has(gene).alias("gene"), has(disease).alias("disease"))


#: The scalar features of a compound and the families of sets, by the name that they have in pair features.
SCALARS = {"ctd_disease_count": "treated_disease", "cpd_disease_count": "palliated_disease", "side_effect_count": "side_effect", "pharmacologic_class_count": "pharmacologic_class", "resemblance_neighbor_count": "resemblance", "graph_degree": "degree"} | {f"{k}_count": k for k in COUNTS if k.endswith("_gene")}
GENES = [r for r in COUNTS if r.endswith("_gene")]
FAMILIES = {r: [r] for r in ("treated_disease", "side_effect", "pharmacologic_class", *GENES)} | {"gene": GENES}
DESCRIPTORS = ("molecular_weight", "logp", "tpsa", "hbd", "hba", "rotatable_bonds")


def presence(a: Column, b: Column, count: str, both: str) -> list[Column]:
    return [(a.cast("int") + b.cast("int")).cast("double").alias(count), (a & b).cast("int").cast("double").alias(both)]


def mean_and_difference(x: Column, y: Column, name: str) -> list[Column]:
    return [((x + y) / 2).cast("double").alias(f"{name}_mean"), F.abs(x - y).cast("double").alias(f"{name}_abs_difference")]


def graph_pair_features(pairs: DataFrame, all_edges: DataFrame, scratch: Scratch) -> DataFrame:
    """pairs (a, b), distinct, with their 41 features from the graph; a side may be null. All but the two availability features are null unless
    both sides have an edge.

    Neighbours are found in one pass over the edges, as bits of the families they are in, and met once for all families.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("compound")).filter("compound is not null").distinct()
    near = ends(all_edges).groupBy("compound", "neighbour").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("rows"))
    near = scratch.keep(near.join(named, "compound", "left_semi"))
    sizes = scratch.keep(features_of(near))
    side = lambda s: near.filter("bits <> 0").select(F.col("compound").alias(s), "neighbour", F.col("bits").alias(f"bits_{s}"))
    has = lambda s, family: F.col(f"bits_{s}").bitwiseAND(F.lit(sum(BIT[r] for r in FAMILIES[family]))) != 0
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "neighbour"])
    common = both.groupBy("a", "b").agg(*[F.count_if(has("a", f) & has("b", f)).alias(f"common_{f}") for f in FAMILIES])
    of = lambda s: sizes.select(F.col("compound").alias(s), F.struct(*[c for c in sizes.columns if c != "compound"]).alias(f"of_{s}"))
    x = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").join(common, ["a", "b"], "left")
    out = presence(F.col("of_a").isNotNull(), F.col("of_b").isNotNull(), "hetionet_available_count", "both_hetionet_available")
    for name, key in SCALARS.items():
        out += mean_and_difference(F.col(f"of_a.{key}"), F.col(f"of_b.{key}"), f"graph_{name}")
    there = F.col("of_a").isNotNull() & F.col("of_b").isNotNull()
    for f in FAMILIES:
        shared = F.coalesce(f"common_{f}", F.lit(0))
        union = F.col(f"of_a.{f}") + F.col(f"of_b.{f}") - shared
        out += [F.when(there, shared).cast("double").alias(f"{f}_intersection_count"), union.cast("double").alias(f"{f}_union_count"), F.when(union == 0, 0.0).otherwise(shared / union).alias(f"{f}_jaccard")]
    return x.select("a", "b", *out)


def molecular_pair_features(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """pairs (a, b), distinct, with 14 features from a table of descriptors (compound, and one column each); null unless both sides are in it."""
    of = lambda s: descriptors.select(F.col("compound").alias(s), F.struct(*DESCRIPTORS).alias(f"of_{s}"))
    x = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    out = presence(F.col("of_a").isNotNull(), F.col("of_b").isNotNull(), "structure_available_count", "both_structures_available")
    for d in DESCRIPTORS:
        out += mean_and_difference(F.col(f"of_a.{d}"), F.col(f"of_b.{d}"), d)
    return x.select("a", "b", *out)


def with_pair_features(rows: DataFrame, sides: tuple[str, str], features: DataFrame) -> DataFrame:
    """rows with the features of their pair of sides; a null side is like one that no table knows."""
    a, b = sides
    keyed = features.withColumnsRenamed({"a": "__a", "b": "__b"})
    return rows.join(keyed, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b")), "left").drop("__a", "__b")


def exact_quantiles(histogram: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Interpolated quantiles from (keys..., num, n): exact, and no group is gathered."""
    total = histogram.groupBy(*keys).agg(F.sum("n").alias("all"))
    h = running_sum(histogram, keys, "num", "n", "upto").join(F.broadcast(total), keys)  # a row per key
    parts = []
    for name, p in probabilities.items():
        at = (F.col("all") - 1) * p
        low, high = (F.min(F.when(F.col("upto") > f(at), F.col("num"))) for f in (F.floor, F.ceil))
        parts.append((low + (high - low) * F.first(at - F.floor(at))).alias(name))
    return h.groupBy(*keys).agg(*parts)


def one_hot(df: DataFrame, key: str, column: str, most: int = 1000, values: list[str] | None = None) -> DataFrame:
    """(key, a column is_<value> for each value): nulls count as the most frequent value, of equal ones the first.

    Raises beyond `most` values, so that the width of the result has a bound. values: a closed list instead of those found.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"{column} has more than {most} values")
    if not counts:
        return df.select(key)
    value = F.coalesce(column, F.lit(counts[0][column]))
    return df.select(key, *[(value == v).cast("int").alias(f"is_{v}") for v in values or sorted(r[column] for r in counts)])


def off_domain(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, infinite, missing) counts: what a model refuses or fills."""
    cell = lambda c: F.struct(F.lit(c).alias("feature"), (F.abs(c) == float("inf")).alias("infinite"), (F.col(c).isNull() | F.isnan(c)).alias("missing"))
    x = df.select(F.explode(F.array(*[cell(c) for c in names])).alias("x"))
    return x.groupBy("x.feature").agg(F.count(F.when(F.col("x.infinite"), 1)).alias("infinite"), F.count(F.when(F.col("x.missing"), 1)).alias("missing"))
