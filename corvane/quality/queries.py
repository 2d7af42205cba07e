"""The registered queries of the profile (p5) and of rejected rows (p7), and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.quality import profile as P, rejects as R
from corvane.session import Scratch
from corvane.sources.tables import FEATURES, METADATA, table

DOMAINS = {f: P.feature_domain(f) for f in FEATURES}
EVERY = [*METADATA, *FEATURES, "ddi_severity", "recorded_at", "loaded_at"]


def stored_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feature_coverage").select(
        F.col("load_id").alias("load"), F.col("previous_load_id").alias("previous_load"), "feature",
        F.col("missing_percentage").alias("missing_pct"), F.col("zero_percentage_of_nonmissing").alias("zero_pct"), F.col("unique_nonmissing_values").alias("unique_values"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # loads x features x masks rows, from which all findings come
    masks = Scratch(spark).keep(P.mask_counts(table(spark, d, "ddinter_severity_dataset"), "load_id", FEATURES, DOMAINS))
    stored = stored_coverage(spark, d)
    found = P.findings(P.profile_of(masks, FEATURES), stored, P.divergence_of(masks, FEATURES, stored))
    return found.select(F.col("load").cast("int").alias("load_id"), "feature", "finding")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of every load."""
    prof = P.profile(table(spark, d, "ddinter_severity_dataset"), "load_id", EVERY, DOMAINS)
    return prof.select(
        F.col("load").alias("load_id"), "feature", "rows", "nonmissing", "missing", F.round("missing_pct", 6).alias("missing_pct"), F.round("zero_pct", 6).alias("zero_pct"),
        "unique_values", "off_domain", "low", "high", "masks", "dominant_mask", "rare_mask_rows",
    )


def p5_rare_masks(spark: SparkSession, d: str) -> DataFrame:
    return P.rare_masks(table(spark, d, "ddinter_severity_dataset"), "load_id", EVERY).withColumn("share", F.round("share", 9)).withColumnRenamed("load", "load_id")


def p5_mask_divergence(spark: SparkSession, d: str) -> DataFrame:
    before = stored_coverage(spark, d).select("load", "previous_load")
    got = P.mask_divergence(table(spark, d, "ddinter_severity_dataset"), "load_id", EVERY, before)
    return got.select(F.col("load").alias("load_id"), F.col("previous_load").alias("previous_load_id"), "feature", F.round("divergence", 6).alias("divergence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return R.rejects(table(spark, d, "ddinter_source_lines"), table(spark, d, "ddinter_malformed_rows"))


def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The sound lines as typed columns."""
    return R.typed(R.load_lines(table(spark, d, "ddinter_source_lines")).filter("reason is null"))


QUERIES = {f.__name__: f for f in (p5_found, p5_profile, p5_rare_masks, p5_mask_divergence, p7_found, p7_loaded)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def sql_trim(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


def sql_bare(c: str) -> str:
    return rf"lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{Nd}}]', '', 'g'))"


def sql_valid(c: str) -> str:
    return f"regexp_matches({sql_bare(c)}, '^ddinter[0-9]+$')"


def _long(columns: list[str]) -> str:
    """Unpivoted rows (load_id, feature, v) of number columns, v null where missing."""
    cast = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} + 0.0 END AS {c}" for c in columns)
    return f"(UNPIVOT (SELECT load_id, {', '.join(f'coalesce({c}, -1e300) AS {c}' for c in columns)} FROM (SELECT load_id, {cast} FROM ddinter_severity_dataset)) ON {', '.join(columns)} INTO NAME feature VALUE w)"


_OFF = """(CASE WHEN feature LIKE '%\\_jaccard' ESCAPE '\\' THEN v < 0 OR v > 1
  WHEN feature LIKE 'both\\_%' ESCAPE '\\' THEN v NOT IN (0, 1)
  WHEN feature LIKE '%\\_available\\_count' ESCAPE '\\' THEN v NOT IN (0, 1, 2)
  WHEN feature = 'logp_mean' THEN false ELSE v < 0 END)"""

_OWN = f"""own AS (
  SELECT load_id, feature, 100.0 * (count(*) - count(v)) / count(*) AS mp,
    CASE WHEN count(v) > 0 THEN 100.0 * count(CASE WHEN v = 0 THEN 1 END) / count(v) END AS zp,
    count(DISTINCT v) AS u, count(CASE WHEN {_OFF} THEN 1 END) AS off
  FROM (SELECT load_id, feature, nullif(w, -1e300) AS v FROM {_long(FEATURES)}) GROUP BY load_id, feature)"""

_P5_FOUND = f"""
WITH {_OWN}, held AS (
  SELECT DISTINCT c.load_id, c.previous_load_id, c.feature, c.missing_percentage AS mp0, c.zero_percentage_of_nonmissing AS zp0,
    c.unique_nonmissing_values AS u0, o.mp, o.zp, o.u
  FROM feature_coverage c LEFT JOIN own o ON o.load_id = c.load_id AND o.feature = c.feature)
SELECT load_id, feature, 'coverage_wrong' AS finding FROM held
WHERE (mp0 IS NULL) <> (mp IS NULL) OR (zp0 IS NULL) <> (zp IS NULL) OR (u0 IS NULL) <> (u IS NULL)
  OR coalesce(abs(mp0 - mp) > 0.001, false) OR coalesce(abs(zp0 - zp) > 0.001, false) OR coalesce(u0 <> u, false)
UNION SELECT load_id, feature, 'invalid_value' FROM own WHERE off > 0
UNION SELECT h.load_id, h.feature, 'missing_shift' FROM held h JOIN own p ON p.load_id = h.previous_load_id AND p.feature = h.feature
  WHERE round(abs(round(h.mp, 6) - round(p.mp, 6)), 4) > 10
UNION SELECT h.load_id, h.feature, 'zero_shift' FROM held h JOIN own p ON p.load_id = h.previous_load_id AND p.feature = h.feature
  WHERE round(abs(round(h.zp, 6) - round(p.zp, 6)), 4) > 10
"""

_TEXTS = [c for c in EVERY if c not in FEATURES]
_NUMBERS = ["drug_a_pubchem_cid", "drug_b_pubchem_cid"]


def _unfolded(c: str) -> str:
    num = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} + 0.0 END" if c in FEATURES else f"CAST({c} AS DOUBLE)" if c in _NUMBERS else "CAST(NULL AS DOUBLE)"
    text = "CAST(NULL AS VARCHAR)" if c in FEATURES else f"CAST({c} AS VARCHAR)"
    return f"SELECT load_id, '{c}' AS feature, {text} AS t, {num} AS v FROM ddinter_severity_dataset"


_TEXT_MASK = "t"
for _runs, _sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[\p{Lo}\p{Lm}\p{Lt}]+", "o"), (r"\p{Nd}+", "9"), (r"\s+", " ")):
    _TEXT_MASK = f"regexp_replace({_TEXT_MASK}, '{_runs}', '{_sign}', 'g')"
_MASK = f"""CASE WHEN v IS NULL THEN {_TEXT_MASK} ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN abs(v) = CAST('inf' AS DOUBLE) THEN 'inf' WHEN v = 0 THEN '0' WHEN abs(v) < 1 THEN '0.9'
  WHEN abs(v) = floor(abs(v)) THEN '9' ELSE '9.9' END END"""
_MASKS = f"""cells AS ({' UNION ALL '.join(_unfolded(c) for c in EVERY)}),
hist AS (SELECT load_id, feature, t, v, count(*) AS n FROM cells GROUP BY ALL),
masks AS (SELECT load_id, feature, {_MASK} AS mask, count(coalesce(t, CAST(v AS VARCHAR))) AS u, sum(n) AS rows, sum(CASE WHEN feature IN ({', '.join(f"'{c}'" for c in FEATURES)}) AND {_OFF} THEN n ELSE 0 END) AS off, min(v) AS low, max(v) AS high
  FROM hist GROUP BY ALL)"""
_P5_PROFILE = f"""WITH {_MASKS},
w AS (SELECT *, sum(CASE WHEN mask IS NOT NULL THEN rows ELSE 0 END) OVER (PARTITION BY load_id, feature) AS total, row_number() OVER (PARTITION BY load_id, feature ORDER BY mask IS NULL, rows DESC, mask) AS place FROM masks)
SELECT load_id, feature, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(CASE WHEN mask IS NOT NULL THEN rows ELSE 0 END) AS BIGINT) AS nonmissing, CAST(sum(CASE WHEN mask IS NULL THEN rows ELSE 0 END) AS BIGINT) AS missing,
  round(100.0 * sum(CASE WHEN mask IS NULL THEN rows ELSE 0 END) / sum(rows), 6) AS missing_pct, round(100.0 * sum(CASE WHEN mask = '0' AND low IS NOT NULL THEN rows ELSE 0 END) / nullif(sum(CASE WHEN mask IS NOT NULL THEN rows ELSE 0 END), 0), 6) AS zero_pct,
  CAST(sum(u) AS BIGINT) AS unique_values, CAST(sum(off) AS BIGINT) AS off_domain, min(low) AS low, max(high) AS high, count(mask) AS masks, max(CASE WHEN place = 1 THEN mask END) AS dominant_mask,
  CAST(sum(CASE WHEN mask IS NOT NULL AND place > 1 AND rows < 0.005 * total THEN rows ELSE 0 END) AS BIGINT) AS rare_mask_rows FROM w GROUP BY load_id, feature"""
_P5_RARE = f"""WITH {_MASKS}, w AS (SELECT *, CAST(rows AS DOUBLE) / sum(rows) OVER (PARTITION BY load_id, feature) AS share, row_number() OVER (PARTITION BY load_id, feature ORDER BY rows DESC, mask) AS place FROM masks WHERE mask IS NOT NULL)
SELECT load_id, feature, mask, CAST(rows AS BIGINT) AS rows, round(share, 9) AS share FROM w WHERE share < 0.005 AND place > 1"""
_P5_DIVERGENCE = f"""WITH {_MASKS}, p AS (SELECT load_id, feature, coalesce(mask, '?missing') AS mask, CAST(rows AS DOUBLE) / sum(rows) OVER (PARTITION BY load_id, feature) AS p FROM masks),
pairs AS (SELECT DISTINCT load_id, previous_load_id FROM feature_coverage WHERE previous_load_id IS NOT NULL), loads AS (SELECT DISTINCT load_id, feature FROM p),
both_ AS (SELECT a.load_id, a.previous_load_id, l.feature FROM pairs a JOIN loads l ON l.load_id = a.load_id JOIN loads m ON m.load_id = a.previous_load_id AND m.feature = l.feature),
x AS (SELECT b.*, mask, p, 0.0 AS q FROM both_ b JOIN p ON p.load_id = b.load_id AND p.feature = b.feature UNION ALL SELECT b.*, mask, 0.0, p FROM both_ b JOIN p ON p.load_id = b.previous_load_id AND p.feature = b.feature),
s AS (SELECT load_id, previous_load_id, feature, mask, sum(p) AS p, sum(q) AS q FROM x GROUP BY ALL)
SELECT load_id, previous_load_id, feature, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS divergence FROM s GROUP BY ALL"""

_LINES = rf"""
  SELECT line_id, source_file, loaded_at, regexp_replace(coalesce(raw_line, ''), chr(13) || '$', '') AS s FROM ddinter_source_lines"""
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_PARSED = rf"""
lines AS ({_LINES}), marked AS (
  SELECT *, regexp_full_match(s, '(?s){_FIELD}(?:,{_FIELD})*') AS ok,
    length(regexp_replace(regexp_replace(s, '(?s)"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 AS width FROM lines),
fields AS (
  SELECT *, {", ".join(f"regexp_extract(s, '(?s)^{('(?:' + _FIELD + ',)') * 0}{(_FIELD + ',') * k}({_FIELD})', 1) AS f{k}" for k in range(5))} FROM marked),
bare AS (
  SELECT line_id, source_file, loaded_at, ok, width, {", ".join(f"CASE WHEN f{k} LIKE '" + '"' + f"%' THEN replace(substr(f{k}, 2, length(f{k}) - 2), repeat(chr(34), 2), chr(34)) ELSE f{k} END AS f{k}" for k in range(5))} FROM fields)"""


def _fault(a: str, da: str, b: str, db: str, level: str, source: str) -> str:
    blank = " OR ".join(f"coalesce({sql_trim(c)}, '') = ''" for c in (a, da, b, db, level))
    return f"""CASE WHEN {blank} THEN 'missing_value'
    WHEN NOT {sql_valid(a)} OR NOT {sql_valid(b)} THEN 'invalid_id'
    WHEN lower({sql_trim(level)}) NOT IN ('major', 'moderate', 'minor', 'unknown') THEN 'invalid_level'
    WHEN NOT coalesce(regexp_full_match(lower({sql_trim(source)}), 'ddinter_downloads_code_[abcdghjlmnprsv]\\.csv'), false) THEN 'invalid_source_file' END"""


_LINE_FAULT = f"CASE WHEN NOT ok THEN 'quoting' WHEN width <> 5 THEN 'column_count' ELSE {_fault('f0', 'f1', 'f2', 'f3', 'f4', 'source_file')} END"

_P7_FOUND = f"""
WITH {_PARSED}
SELECT * FROM (
  SELECT 'line' AS origin, line_id AS record_id, {_LINE_FAULT} AS reason FROM bare
  UNION ALL SELECT 'row', row_id, {_fault("DDInterID_A", "Drug_A", "DDInterID_B", "Drug_B", "Level", "source_file")} FROM ddinter_malformed_rows)
WHERE reason IS NOT NULL"""

_P7_LOADED = f"""
WITH {_PARSED}
SELECT line_id, CAST(CAST(regexp_replace(f0, '[^0-9]', '', 'g') AS HUGEINT) AS VARCHAR) AS drug_a_number, {sql_trim("f1")} AS drug_a_name,
  CAST(CAST(regexp_replace(f2, '[^0-9]', '', 'g') AS HUGEINT) AS VARCHAR) AS drug_b_number, {sql_trim("f3")} AS drug_b_name,
  upper(left({sql_trim("f4")}, 1)) || lower(substr({sql_trim("f4")}, 2)) AS level, upper(regexp_extract(lower(source_file), 'code_([a-z])\\.csv', 1)) AS atc_category, loaded_at
FROM bare WHERE {_LINE_FAULT} IS NULL"""

SQL = {"p5_found": _P5_FOUND, "p5_profile": _P5_PROFILE, "p5_rare_masks": _P5_RARE, "p5_mask_divergence": _P5_DIVERGENCE, "p7_found": _P7_FOUND, "p7_loaded": _P7_LOADED}
