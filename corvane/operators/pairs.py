"""Cleaning of drug-pair rows: malformed ones aside, ids in order, repeats and conflicts found, names resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.names import normal_name
from corvane.functions.ordered import rank_by_digest
from corvane.functions.text import bare, filled, folded, is_blank, valid_drug_id

REQUIRED = ["DDInterID_A", "DDInterID_B", "Drug_A", "Drug_B", "Level"]
LABELS = ["major", "moderate", "minor", "unknown"]


def malformed(rows: DataFrame) -> DataFrame:
    """(row_id, missing): rows that lack a required value, and how many."""
    n = sum((is_blank(c).cast("int") for c in REQUIRED), F.lit(0))
    return rows.select("row_id", n.alias("missing")).filter("missing > 0")


def canonical(rows: DataFrame) -> DataFrame:
    """Sound rows with their ids in order; names go with the ids."""
    a, b = bare("DDInterID_A"), bare("DDInterID_B")
    level = folded("Level")
    ok = valid_drug_id("DDInterID_A") & valid_drug_id("DDInterID_B") & F.coalesce(level.isin(*LABELS), F.lit(False))
    for c in REQUIRED:
        ok = ok & ~is_blank(c)
    turned = a > b
    name = lambda x, y: F.when(turned, filled(x)).otherwise(filled(y))
    return rows.filter(ok).select(
        "row_id", F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), name("Drug_B", "Drug_A").alias("name_a"), name("Drug_A", "Drug_B").alias("name_b"),
        level.alias("level"), turned.alias("turned"), filled("source_file").alias("source_file"), filled("atc_category").alias("atc"), F.concat_ws("|", F.least(a, b), F.greatest(a, b)).alias("pair_id"),
    )


def exact_repeats(pairs: DataFrame) -> DataFrame:
    """(rows, distinct_rows, repeats) over ids, names and level."""
    one = pairs.groupBy("id_a", "id_b", "name_a", "name_b", "level").agg(F.count(F.lit(1)).alias("n"))
    return one.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum("n") - F.count(F.lit(1))).alias("repeats"))


def pair_facts(pairs: DataFrame) -> DataFrame:
    """Per pair: rows, in how many side orders and with how many labels (unknown counts as one)."""
    return pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("rows"), (F.max(F.col("turned").cast("int")) - F.min(F.col("turned").cast("int")) + 1).alias("orders"), F.min("level").alias("low"), F.max("level").alias("high"), F.countDistinct("level").alias("labels"))


def deduplicated(pairs: DataFrame) -> DataFrame:
    """One row per pair without conflict: the first by source file and id, with all source files and categories."""
    first = F.min(F.struct(F.coalesce("source_file", F.lit("")).alias("f"), F.col("row_id"), F.col("name_a"), F.col("name_b"))).alias("first")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return pairs.groupBy("pair_id").agg(first, F.min("level").alias("level"), F.max("level").alias("other"), joined("source_file").alias("source_files"), joined("atc").alias("categories")).filter("level = other").select("pair_id", "first.row_id", "first.name_a", "first.name_b", "level", "source_files", "categories")


def drug_dimension(pairs: DataFrame) -> DataFrame:
    """(id, name): the drugs of both sides, with the first of their names in order."""
    side = lambda s: pairs.select(F.col(f"id_{s}").alias("id"), F.col(f"name_{s}").alias("name"))
    return side("a").unionByName(side("b")).groupBy("id").agg(F.min("name").alias("name"))


def map_names(drugs: DataFrame, compounds: DataFrame) -> DataFrame:
    """(id, compound, status): exact_name for one compound of the name, ambiguous for several, unmapped for none."""
    by = compounds.select(normal_name(F.col("name")).alias("k"), F.col("id").alias("c")).filter("k is not null").groupBy("k").agg(F.countDistinct("c").alias("n"), F.min("c").alias("c"))
    got = drugs.withColumn("k", normal_name(F.col("name"))).join(by, "k", "left")
    status = F.when(F.col("n") == 1, "exact_name").when(F.col("n") > 1, "ambiguous").otherwise("unmapped")
    return got.select("id", F.when(F.col("n") == 1, F.col("c")).alias("compound"), status.alias("status"))


def classify_structure(rows: DataFrame) -> DataFrame:
    """rows with found: what a query result amounts to, by the first rule that applies."""
    s = folded("structure_status")
    rule = (
        F.when(s == "excluded_multiple_candidates", "ambiguous").when(F.col("pubchem_cid").isNull() & (s == "query_error"), "rejected").when(F.col("pubchem_cid").isNull(), "unmapped")
        .when(~F.coalesce(normal_name(filled("pubchem_title")) == normal_name(filled("ddinter_name")), F.lit(False)), "ambiguous")
        .when(is_blank("smiles") | is_blank("inchikey"), "rejected").otherwise("exact_unique")
    )
    return rows.withColumn("found", rule)


def unexpected_levels(rows: DataFrame) -> DataFrame:
    """(level, n): levels that rows have besides the allowed ones, blank ones left out."""
    level = folded("Level")
    return rows.filter((level != "") & ~level.isin(*LABELS)).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def require_levels(rows: DataFrame) -> DataFrame:
    """rows, if no level is unexpected; raises otherwise, naming at most ten."""
    if bad := [r["level"] for r in unexpected_levels(rows).orderBy("level").limit(10).collect()]:
        raise ValueError(f"unexpected levels: {bad}")
    return rows


def validate_mapping(rows: DataFrame) -> DataFrame:
    """(check_name, violations) of a structure mapping: accepted rows have an id, a structure and a key; statuses are known. Raises where columns are missing."""
    missing = {"ddinter_id", "mapping_status", "pubchem_cid", "smiles", "inchikey"} - set(rows.columns)
    if missing:
        raise ValueError(f"mapping lacks {sorted(missing)}")
    accepted = folded("mapping_status") == "exact_unique"
    bad = {"accepted_without_cid": accepted & F.col("pubchem_cid").isNull(), "accepted_without_structure": accepted & is_blank("smiles"), "accepted_without_key": accepted & is_blank("inchikey"), "blank_id": is_blank("ddinter_id")}
    one = rows.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in bad.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("violations")) for k in bad])).alias("x")).select("x.*")


def two_sided(pairs: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """pairs with value_a and value_b, looked up for both sides."""
    one = lambda s: mapping.select(F.col(key).alias(f"id_{s}"), F.col(value).alias(f"{value}_{s}"))
    return pairs.join(one("a"), "id_a", "left").join(one("b"), "id_b", "left")


def coverage_class(a: Column, b: Column, word: str) -> Column:
    return F.when(a & b, f"both_{word}").when(a, f"only_drug_a_{word}").when(b, f"only_drug_b_{word}").otherwise(f"neither_{word}")


def one_sided_class(a: Column, b: Column, word: str) -> Column:
    """As coverage_class, whichever the one side is."""
    return F.when(a & b, f"both_{word}").when(a | b, f"one_{word}").otherwise(f"neither_{word}")


def latest_structures(rows: DataFrame) -> DataFrame:
    """(id, cid, found, smiles): what the latest row of each drug, by its bare id, amounts to."""
    order = ["retrieved_at", F.coalesce("pubchem_cid", F.lit(-1)), *[F.coalesce(c, F.lit("")) for c in ("structure_status", "ddinter_id", "ddinter_name", "pubchem_title", "smiles", "inchikey")]]
    x = classify_structure(rows).groupBy(bare("ddinter_id").alias("id"))
    return x.agg(F.max_by(F.struct(F.col("pubchem_cid").alias("cid"), "found", filled("smiles").alias("smiles")), F.struct(*order)).alias("x")).select("id", "x.*")


def stratified(df: DataFrame, label: str, key: str, test: float = 0.2) -> DataFrame:
    """df with split: of each label the first round(test x n) by the digest of the key are test."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    x = rank_by_digest(df, [label], key, "__place").join(F.broadcast(sizes), label)  # a row per label
    return x.withColumn("split", F.when(F.col("__place") <= F.floor(F.col("__n") * test + 0.5), "test").otherwise("train")).drop("__place", "__n")


def folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    return rank_by_digest(df, [label], key, "__place").withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__place")
