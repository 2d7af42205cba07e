"""The registered queries of this package and the SQL they are held against."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.text import bare, usable_atc, usable_level, usable_source
from corvane.llm import formatting, pairs, splits, survivors
from corvane.session import Scratch
from corvane.sources.tables import table


def p6_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = pairs.valid_pairs(table(spark, d, "ddinter_malformed_rows"))
    side = [F.concat(bare(f"DDInterID_{s}"), F.lit("|"), bare(f"Drug_{s}")) for s in "AB"]
    return formatting.collapse(rows, "row_id", [F.least(*side), F.greatest(*side)])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members = p6_parts(spark, d)[1]
    return members.filter("row_id <> group_id").select(F.col("group_id").alias("group_row_id"), "row_id")


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct record with its number of copies."""
    return p6_parts(spark, d)[0].select(F.col("group_id").alias("group_row_id"), "copies")


USABLE = {"level": lambda: usable_level("Level"), "source": lambda: usable_source("source_file"), "atc": lambda: usable_atc("atc_category")}


def pair_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of drug pairs with their usable fields. Ids in their plain spelling are trusted."""
    plain = sum((F.when(F.coalesce(F.col(f"DDInterID_{s}").rlike(r"^DDInter[0-9]+\z"), F.lit(False)), 1).otherwise(0) for s in "AB"), F.lit(0))
    rows = pairs.valid_pairs(table(spark, d, "ddinter_malformed_rows"))
    return rows.select("row_id", "loaded_at", *pairs.id_pair(), plain.alias("trust"), *[c().alias(f"has_{k}") for k, c in USABLE.items()])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    usable = {k: F.col(f"has_{k}") for k in USABLE}
    got = survivors.survivors(pair_records(spark, d), ["low_id", "high_id"], "row_id", usable, "loaded_at", F.col("trust"), ("recency",), "field")
    return got.select("group_row_id", *[F.coalesce(f"{k}_row_id", F.lit(-1)).cast("bigint").alias(f"{k}_row_id") for k in USABLE])


def p3_layers(spark: SparkSession, d: str) -> DataFrame:
    """Record by record: the first skyline is filled from the layers behind it."""
    usable = {k: F.col(f"has_{k}") for k in USABLE}
    got = survivors.survivors(pair_records(spark, d), ["low_id", "high_id"], "row_id", usable, "loaded_at", F.col("trust"), ("completeness", "recency", "trust"), "layer")
    return got.drop("low_id", "high_id")


def p2_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, held = table(spark, d, "ddinter_severity_dataset"), table(spark, d, "secondary_cold_start_holdout_drugs")
    tied, groups = splits.tied_rows(rows, "row_id", ["drug_a_ddinter_id", "drug_b_ddinter_id"], held.select("held_out_ddinter_id"), scratch := Scratch(spark))
    return scratch.keep(tied), groups


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tied, groups = p2_parts(spark, d)
    from corvane.session import attach

    got = attach(tied.filter("component is not null"), groups.filter("size > 1"), ["component"], "size")
    return got.select(F.col("row").alias("row_id"), "group_row_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    tied, groups = p2_parts(spark, d)
    return splits.assign(tied, groups, {"train": 0.8, "validation": 0.1, "test": 0.1}).select(F.col("row").alias("row_id"), "split")


QUERIES = {f.__name__: f for f in (p6_found, p6_copies, p3_found, p3_layers, p2_found, p2_splits)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def sql_trim(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


def sql_bare(c: str) -> str:
    return rf"lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{Nd}}]', '', 'g'))"


_VALID = " AND ".join(f"regexp_matches({sql_bare(c)}, '^ddinter[0-9]+$')" for c in ("DDInterID_A", "DDInterID_B"))
_SIDES = [f"{sql_bare(f'DDInterID_{s}')} || '|' || {sql_bare(f'Drug_{s}')}" for s in "AB"]
_P6 = f"SELECT row_id, least({_SIDES[0]}, {_SIDES[1]}) AS x, greatest({_SIDES[0]}, {_SIDES[1]}) AS y FROM ddinter_malformed_rows WHERE {_VALID}"

_OK = {
    "level": f"coalesce(lower({sql_trim('Level')}) IN ('major', 'moderate', 'minor'), false)",
    "source": f"coalesce(regexp_full_match(lower({sql_trim('source_file')}), 'ddinter_downloads_code_[abcdghjlmnprsv]\\.csv'), false)",
    "atc": f"coalesce(regexp_full_match(lower({sql_trim('atc_category')}), '[abcdghjlmnprsv]'), false)",
}
_IDS = [sql_bare(f"DDInterID_{s}") for s in "AB"]
_P3 = f"""
WITH r AS (SELECT row_id, loaded_at, least({_IDS[0]}, {_IDS[1]}) AS x, greatest({_IDS[0]}, {_IDS[1]}) AS y, {", ".join(f"{c} AS has_{k}" for k, c in _OK.items())}
  FROM ddinter_malformed_rows WHERE {_VALID}),
w AS (SELECT *, {", ".join(f"CASE WHEN has_{k} THEN row_number() OVER (PARTITION BY x, y, has_{k} ORDER BY loaded_at DESC NULLS LAST, row_id) END AS p_{k}" for k in _OK)} FROM r)
SELECT min(row_id) AS group_row_id, {", ".join(f"coalesce(min(CASE WHEN p_{k} = 1 THEN row_id END), -1) AS {k}_row_id" for k in _OK)}
FROM w GROUP BY x, y HAVING count(*) > 1"""

_TRUST = " + ".join(f"CAST(coalesce(regexp_full_match(DDInterID_{s}, 'DDInter[0-9]+'), false) AS INT)" for s in "AB")
_HAS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(_OK.values()))
# a cell's layer is the length of the longest chain of cells of which each dominates the next
_P3_LAYERS = f"""
WITH RECURSIVE r AS (SELECT row_id, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS seen, least({_IDS[0]}, {_IDS[1]}) AS x, greatest({_IDS[0]}, {_IDS[1]}) AS y, {_HAS} AS has, {_TRUST} AS trust
  FROM ddinter_malformed_rows WHERE {_VALID}),
g AS (SELECT x, y, min(row_id) AS group_row_id, count(*) AS copies FROM r GROUP BY x, y HAVING count(*) > 1),
c AS (SELECT r.x, r.y, has, bit_count(has) AS full_, trust, seen, row_id FROM r JOIN g ON g.x = r.x AND g.y = r.y QUALIFY row_number() OVER (PARTITION BY r.x, r.y, has, trust ORDER BY seen DESC, row_id) = 1),
d AS (SELECT a.row_id AS over, b.row_id AS under FROM c a JOIN c b ON a.x = b.x AND a.y = b.y AND a.full_ >= b.full_ AND a.seen >= b.seen AND a.trust >= b.trust AND (a.full_ > b.full_ OR a.seen > b.seen OR a.trust > b.trust)),
chain AS (SELECT row_id, 1 AS k FROM c UNION SELECT d.under, k + 1 FROM chain JOIN d ON d.over = chain.row_id),
l AS (SELECT c.*, m.k FROM c JOIN (SELECT row_id, max(k) AS k FROM chain GROUP BY row_id) m ON m.row_id = c.row_id),
w AS (SELECT *, {", ".join(f"CASE WHEN has & {1 << i} > 0 THEN row_number() OVER (PARTITION BY x, y, has & {1 << i} > 0 ORDER BY k, full_ DESC, seen DESC, trust DESC, row_id) END AS p_{n}" for i, n in enumerate(_OK))} FROM l)
SELECT group_row_id, copies, max(k) AS layers, count(CASE WHEN k = 1 THEN 1 END) AS skyline, {", ".join(f"min(CASE WHEN p_{n} = 1 THEN row_id END) AS {n}_row_id" for n in _OK)}
FROM w JOIN g ON g.x = w.x AND g.y = w.y GROUP BY w.x, w.y, group_row_id, copies"""

_P2 = f"""
WITH RECURSIVE held AS (SELECT DISTINCT lower({sql_trim("held_out_ddinter_id")}) AS e FROM secondary_cold_start_holdout_drugs WHERE coalesce({sql_trim("held_out_ddinter_id")}, '') <> ''),
has AS (
  SELECT row_id, lower({sql_trim("drug_a_ddinter_id")}) AS e FROM ddinter_severity_dataset WHERE lower({sql_trim("drug_a_ddinter_id")}) IN (SELECT e FROM held)
  UNION SELECT row_id, lower({sql_trim("drug_b_ddinter_id")}) FROM ddinter_severity_dataset WHERE lower({sql_trim("drug_b_ddinter_id")}) IN (SELECT e FROM held)),
link AS (SELECT DISTINCT p.e AS a, q.e AS b FROM has p JOIN has q ON p.row_id = q.row_id),
reach AS (SELECT a AS root, b AS e FROM link UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.e),
comp AS (SELECT e, min(root) AS c FROM reach GROUP BY e),
tied AS (SELECT DISTINCT h.row_id, c.c FROM has h JOIN comp c ON c.e = h.e)
SELECT row_id, min(row_id) OVER (PARTITION BY c) AS group_row_id FROM tied QUALIFY count(*) OVER (PARTITION BY c) > 1"""

SQL = {
    "p6_found": f"WITH k AS ({_P6}), g AS (SELECT *, min(row_id) OVER (PARTITION BY x, y) AS group_row_id FROM k) SELECT group_row_id, row_id FROM g WHERE row_id <> group_row_id",
    "p6_copies": f"WITH k AS ({_P6}) SELECT min(row_id) AS group_row_id, count(*) AS copies FROM k GROUP BY x, y",
    "p3_found": _P3,
    "p3_layers": _P3_LAYERS,
    "p2_found": _P2,
}

for _name in ("similar_queries", "text_queries", "match_queries", "personal_queries"):
    if importlib.util.find_spec(f"corvane.llm.{_name}"):
        _m = importlib.import_module(f"corvane.llm.{_name}")
        QUERIES |= _m.QUERIES
        SQL |= _m.SQL
