"""Registered queries of pair rows, features, metrics and checks, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.names import normal_name
from corvane.functions.text import ATC, filled, folded
from corvane.operators import features as X, metrics as M, pairs as P
from corvane.quality import profile as R
from corvane.session import Scratch
from corvane.sources import graph as S
from corvane.sources.tables import FEATURES, METADATA, table

Q: dict = {}
SQL: dict[str, str] = {}
CLASSES = ["Major", "Moderate", "Minor"]


def query(sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _t(c: str) -> str:
    return f"nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '')"


def _bare(c: str) -> str:
    return rf"lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{Nd}}]', '', 'g'))"


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that compatibility forms and case folding turn into another one, what they turn into, and those that turn into several."""
    import unicodedata

    one, to, more = [], [], []
    for k in [*range(0x80, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(k)
        if unicodedata.category(c) in ("Cn", "Cs", "Mn") or c.lower() != c:
            continue
        f = unicodedata.normalize("NFKC", c).casefold()
        if f != c and len(f) == 1:
            one.append(c), to.append(f)
        elif f != c and k < 0x100 or 0xFB00 <= k < 0xFB07 or k == 0x2122:
            more.append((c, f))
    return "".join(one).replace("'", "''"), "".join(to).replace("'", "''"), more


_ONE, _TO, _MORE = _fold_tables()


def _fold(c: str) -> str:
    """SQL of normal_name, for letters of Latin, Greek and Cyrillic, ligatures and wide forms."""
    out = f"translate(lower(nfc_normalize({c})), '{_ONE}', '{_TO}')"
    for old, new in _MORE:
        out = f"replace({out}, '{old}', '{new}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_PAIRS = f"""WITH r AS (SELECT row_id, {_bare("DDInterID_A")} AS a, {_bare("DDInterID_B")} AS b, {_t("DDInterID_A")} AS ra, {_t("DDInterID_B")} AS rb, {_t("Drug_A")} AS da, {_t("Drug_B")} AS db,
  {_t("Level")} AS lv, {_t("source_file")} AS source_file, {_t("atc_category")} AS atc FROM ddinter_malformed_rows),
pairs AS (SELECT row_id, least(a, b) AS id_a, greatest(a, b) AS id_b, CASE WHEN a > b THEN db ELSE da END AS name_a, CASE WHEN a > b THEN da ELSE db END AS name_b, lower(lv) AS level, a > b AS turned,
  source_file, atc, least(a, b) || '|' || greatest(a, b) AS pair_id FROM r
  WHERE regexp_matches(a, '^ddinter[0-9]+$') AND regexp_matches(b, '^ddinter[0-9]+$') AND lower(lv) IN ('major', 'moderate', 'minor', 'unknown') AND da IS NOT NULL AND db IS NOT NULL)"""


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ddinter_malformed_rows")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.canonical(raw(spark, d))


@query(f"{_PAIRS} SELECT row_id, CAST(ra IS NULL AS INT) + CAST(rb IS NULL AS INT) + CAST(da IS NULL AS INT) + CAST(db IS NULL AS INT) + CAST(lv IS NULL AS INT) AS missing FROM r WHERE ra IS NULL OR rb IS NULL OR da IS NULL OR db IS NULL OR lv IS NULL")
def pair_malformed(spark: SparkSession, d: str) -> DataFrame:
    return P.malformed(raw(spark, d))


@query(f"{_PAIRS} SELECT row_id, pair_id, name_a, name_b, level, turned FROM pairs")
def pair_canonical(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("row_id", "pair_id", "name_a", "name_b", "level", "turned")


@query(f"{_PAIRS} SELECT count(*) AS rows, count(DISTINCT (id_a, id_b, name_a, name_b, level)) AS distinct_rows, count(*) - count(DISTINCT (id_a, id_b, name_a, name_b, level)) AS repeats FROM pairs")
def pair_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return P.exact_repeats(pairs(spark, d))


@query(f"{_PAIRS} SELECT pair_id, count(*) AS rows FROM pairs GROUP BY pair_id HAVING count(DISTINCT turned) > 1")
def pair_reverse_dups(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_facts(pairs(spark, d)).filter("orders > 1").select("pair_id", "rows")


@query(f"{_PAIRS} SELECT pair_id, count(*) AS rows, count(DISTINCT level) AS labels FROM pairs GROUP BY pair_id HAVING count(DISTINCT level) > 1")
def pair_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_facts(pairs(spark, d)).filter("low <> high").select("pair_id", "rows", "labels")


_DEDUP = f"""{_PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(source_file, ''), row_id) AS k FROM pairs),
g AS (SELECT pair_id, min(level) AS level, coalesce(string_agg(DISTINCT source_file, ';' ORDER BY source_file), '') AS source_files, coalesce(string_agg(DISTINCT atc, ';' ORDER BY atc), '') AS categories FROM pairs GROUP BY pair_id HAVING min(level) = max(level))"""


@query(f"{_DEDUP} SELECT g.pair_id, g.level, g.source_files, g.categories, f.row_id, f.name_a, f.name_b FROM g JOIN f ON f.pair_id = g.pair_id WHERE k = 1")
def pair_dedup(spark: SparkSession, d: str) -> DataFrame:
    return P.deduplicated(pairs(spark, d))


@query(f"""{_PAIRS}, g AS (SELECT pair_id, count(*) AS n, count(DISTINCT turned) AS o, count(DISTINCT level) AS l FROM pairs GROUP BY pair_id)
SELECT (SELECT count(*) FROM r) AS rows, CAST(sum(n) AS BIGINT) AS sound, count(*) AS pairs, count(CASE WHEN o > 1 THEN 1 END) AS both_orders, count(CASE WHEN l > 1 THEN 1 END) AS conflicts FROM g""")
def pair_audit(spark: SparkSession, d: str) -> DataFrame:
    x = P.pair_facts(pairs(spark, d)).select("rows", "orders", "labels", F.lit(0).cast("bigint").alias("raw"))
    every = raw(spark, d).agg(F.count(F.lit(1)).alias("raw")).select(*[F.lit(None).cast("bigint").alias(c) for c in ("rows", "orders", "labels")], "raw")
    return x.unionByName(every).agg(F.sum("raw").alias("rows"), F.sum("rows").alias("sound"), F.count("rows").alias("pairs"), F.count(F.when(F.col("orders") > 1, 1)).alias("both_orders"), F.count(F.when(F.col("labels") > 1, 1)).alias("conflicts"))


@query(f"{_PAIRS} SELECT level, count(*) AS n FROM pairs GROUP BY level")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_PAIRS} SELECT source_file, count(*) AS rows, count(*) - count(ra) AS no_a, count(*) - count(rb) AS no_b, count(*) - count(lv) AS no_level FROM r GROUP BY source_file")
def source_missing_counts(spark: SparkSession, d: str) -> DataFrame:
    gone = lambda c: F.count(F.when(filled(c).isNull(), 1))
    return raw(spark, d).groupBy(filled("source_file").alias("source_file")).agg(F.count(F.lit(1)).alias("rows"), gone("DDInterID_A").alias("no_a"), gone("DDInterID_B").alias("no_b"), gone("Level").alias("no_level"))


_DRUGS = f"{_PAIRS}, drugs AS (SELECT id, min(name) AS name FROM (SELECT id_a AS id, name_a AS name FROM pairs UNION ALL SELECT id_b, name_b FROM pairs) GROUP BY id)"


@query(f"{_DRUGS} SELECT * FROM drugs")
def drug_dimension(spark: SparkSession, d: str) -> DataFrame:
    return P.drug_dimension(pairs(spark, d))


_MAPPED = rf"""{_DRUGS}, {S.SQL}, byname AS (SELECT {_fold("name")} AS k, count(DISTINCT id) AS n, min(id) AS c FROM nodes WHERE kind = 'compound' AND name IS NOT NULL GROUP BY 1),
mapped AS (SELECT d.id, CASE WHEN n = 1 THEN c END AS compound, CASE WHEN n = 1 THEN 'exact_name' WHEN n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status FROM drugs d LEFT JOIN byname ON k = {_fold("d.name")})"""


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return P.map_names(P.drug_dimension(pairs(spark, d)), S.nodes(spark, d).filter("kind = 'compound'"))


@query(f"{_MAPPED} SELECT * FROM mapped")
def name_mapping(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d)


@query(f"SELECT id, {_fold('name')} AS k FROM (SELECT DISTINCT {_t('id')} AS id, {_t('name')} AS name FROM fragment_nodes) WHERE name IS NOT NULL")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    """Normalised names of all nodes."""
    n = table(spark, d, "fragment_nodes").select(filled("id").alias("id"), filled("name").alias("name")).distinct().filter("name is not null")
    return n.select("id", normal_name(F.col("name")).alias("k"))


_LATEST = f"""latest AS (SELECT *, row_number() OVER (PARTITION BY {_bare("ddinter_id")} ORDER BY retrieved_at DESC NULLS LAST, coalesce(pubchem_cid, -1) DESC, {", ".join(f"coalesce({c}, '') DESC" for c in ("structure_status", "ddinter_id", "ddinter_name", "pubchem_title", "smiles", "inchikey"))}) AS k FROM ddinter_pubchem_mapping)"""
_RULE = rf"""CASE WHEN lower({_t("structure_status")}) = 'excluded_multiple_candidates' THEN 'ambiguous' WHEN pubchem_cid IS NULL AND lower({_t("structure_status")}) = 'query_error' THEN 'rejected' WHEN pubchem_cid IS NULL THEN 'unmapped'
WHEN NOT coalesce({_fold(_t("pubchem_title"))} = {_fold(_t("ddinter_name"))}, false) THEN 'ambiguous'
WHEN {_t("smiles")} IS NULL OR {_t("inchikey")} IS NULL THEN 'rejected' ELSE 'exact_unique' END"""


@query(f"SELECT found, lower({_t('mapping_status')}) AS told, count(*) AS n FROM (SELECT *, {_RULE} AS found FROM ddinter_pubchem_mapping) GROUP BY 1, 2")
def structure_classify(spark: SparkSession, d: str) -> DataFrame:
    return P.classify_structure(table(spark, d, "ddinter_pubchem_mapping")).groupBy("found", folded("mapping_status").alias("told")).agg(F.count(F.lit(1)).alias("n")).withColumn("told", F.nullif("told", F.lit("")))


def _cover(x: str, y: str, word: str) -> str:
    return f"CASE WHEN {x} AND {y} THEN 'both_{word}' WHEN {x} THEN 'only_drug_a_{word}' WHEN {y} THEN 'only_drug_b_{word}' ELSE 'neither_{word}' END"


@query(f"""{_MAPPED}, p AS (SELECT DISTINCT id_a, id_b, pair_id FROM pairs) SELECT pair_id, {_cover("a.compound IS NOT NULL", "b.compound IS NOT NULL", "mapped")} AS coverage
FROM p LEFT JOIN mapped a ON a.id = id_a LEFT JOIN mapped b ON b.id = id_b""")
def pair_mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select("id_a", "id_b", "pair_id").distinct()
    got = P.two_sided(p, mapped(spark, d), "id", "compound")
    return got.select("pair_id", P.coverage_class(F.col("compound_a").isNotNull(), F.col("compound_b").isNotNull(), "mapped").alias("coverage"))


_ST = f"""{_LATEST}, st AS (SELECT {_bare("ddinter_id")} AS id, pubchem_cid AS cid, {_RULE} AS found, {_t("smiles")} AS smiles FROM latest WHERE k = 1)"""


def _one_sided(x: str, y: str) -> str:
    return f"CASE WHEN {x} AND {y} THEN 'both_structured' WHEN {x} OR {y} THEN 'one_structured' ELSE 'neither_structured' END"


@query(f"""{_PAIRS}, {_ST}, p AS (SELECT DISTINCT id_a, id_b, pair_id FROM pairs)
SELECT pair_id, {_one_sided("coalesce(a.found = 'exact_unique', false)", "coalesce(b.found = 'exact_unique', false)")} AS coverage FROM p LEFT JOIN st a ON a.id = id_a LEFT JOIN st b ON b.id = id_b""")
def pair_structure_coverage(spark: SparkSession, d: str) -> DataFrame:
    st = P.latest_structures(table(spark, d, "ddinter_pubchem_mapping")).withColumn("ok", F.col("found") == "exact_unique")
    got = P.two_sided(pairs(spark, d).select("id_a", "id_b", "pair_id").distinct(), st, "id", "ok")
    t = lambda c: F.coalesce(c, F.lit(False))
    return got.select("pair_id", P.one_sided_class(t("ok_a"), t("ok_b"), "structured").alias("coverage"))


@query(f"{_PAIRS} SELECT row_id, pair_id, level = 'unknown' AS aside FROM pairs")
def unknown_audit(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("row_id", "pair_id", (F.col("level") == "unknown").alias("aside"))


@query(f"""{_DRUGS}, m AS (SELECT {_bare("ddinter_id")} AS id, bool_or(lower({_t("structure_status")}) = 'query_error') AS again FROM ddinter_pubchem_mapping GROUP BY 1)
SELECT d.id, CASE WHEN m.id IS NULL THEN 'new' ELSE 'retry' END AS why FROM drugs d LEFT JOIN m ON m.id = d.id WHERE m.id IS NULL OR m.again""")
def enrichment_pending(spark: SparkSession, d: str) -> DataFrame:
    from corvane.functions.text import bare

    drugs = P.drug_dimension(pairs(spark, d)).select("id")
    known = table(spark, d, "ddinter_pubchem_mapping").select(bare("ddinter_id").alias("id"), (folded("structure_status") == "query_error").alias("again"))
    new = drugs.join(known, "id", "left_anti").withColumn("why", F.lit("new"))
    return new.unionByName(drugs.join(known.filter("again"), "id", "left_semi").withColumn("why", F.lit("retry")))


@query(f"{_PAIRS} SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs) GROUP BY id ORDER BY n DESC, id LIMIT 15")
def frequent_drugs(spark: SparkSession, d: str) -> DataFrame:
    """The 15 drugs on the most rows."""
    p = pairs(spark, d)
    return p.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(15)


# --- features -----------------------------------------------------------------------------------------------------------

_ROLE = "CASE metaedge " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.ROLES.items()) + " END"
_NEAR = f"""WITH {S.SQL}, near AS (SELECT DISTINCT * FROM (
  SELECT source AS compound, {_ROLE} AS role, target AS neighbour FROM edges WHERE metaedge IN ({", ".join(f"'{k}'" for k in X.ROLES)})
  UNION ALL SELECT target, 'pharmacologic_class', source FROM edges WHERE metaedge = 'pcic' UNION ALL SELECT target, 'resemblance', source FROM edges WHERE metaedge = 'crc'
  UNION ALL SELECT source, 'resemblance', target FROM edges WHERE metaedge = 'crc') WHERE compound LIKE 'Compound::%')"""
_CF = f"""{_NEAR}, deg AS (SELECT compound, count(*) AS degree FROM (SELECT source AS compound FROM rows_ UNION ALL SELECT target FROM rows_ WHERE source <> target) WHERE compound LIKE 'Compound::%' GROUP BY compound),
cf AS (SELECT deg.compound, degree, {", ".join(f"count(DISTINCT CASE WHEN role = '{r}' THEN neighbour END) AS {r}" for r in X.COUNTS)}, count(DISTINCT CASE WHEN role LIKE '%\\_gene' ESCAPE '\\' THEN neighbour END) AS gene,
  count(DISTINCT CASE WHEN role LIKE '%\\_disease' ESCAPE '\\' THEN neighbour END) AS disease FROM deg LEFT JOIN near ON near.compound = deg.compound GROUP BY deg.compound, degree)"""
_PP = "pp AS (SELECT DISTINCT drug_a_hetionet_id AS a, drug_b_hetionet_id AS b FROM ddinter_severity_dataset WHERE drug_a_hetionet_id IS NOT NULL AND drug_b_hetionet_id IS NOT NULL)"


def severity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ddinter_severity_dataset")


def graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    return severity(spark, d).select(F.col("drug_a_hetionet_id").alias("a"), F.col("drug_b_hetionet_id").alias("b")).filter("a is not null and b is not null").distinct()


@query(f"{_CF} SELECT * FROM cf")
def compound_set_features(spark: SparkSession, d: str) -> DataFrame:
    return X.compound_features(S.all_edges(spark, d))


_FAM = f"""fam AS (SELECT DISTINCT compound, family, neighbour FROM near JOIN (VALUES {", ".join(f"('{r}', '{f}')" for f, roles in X.FAMILIES.items() for r in roles)}) AS m(role, family) ON m.role = near.role)"""


def _graph_features(pp: str, name: str) -> str:
    """CTEs that end in `name`: pairs (a, b) of the CTE pp with their features of the graph."""
    shared = ", ".join(f"sum(CASE WHEN x.family = '{f}' THEN 1 ELSE 0 END) AS common_{f}" for f in X.FAMILIES)
    cols = ["CAST(CAST(x.compound IS NOT NULL AS INT) + CAST(y.compound IS NOT NULL AS INT) AS DOUBLE) AS hetionet_available_count", "CAST(CAST(x.compound IS NOT NULL AND y.compound IS NOT NULL AS INT) AS DOUBLE) AS both_hetionet_available"]
    cols += [f"(x.{k} + y.{k}) / 2.0 AS graph_{n}_mean, CAST(abs(x.{k} - y.{k}) AS DOUBLE) AS graph_{n}_abs_difference" for n, k in X.SCALARS.items()]
    for f in X.FAMILIES:
        c, u = f"coalesce(common_{f}, 0)", f"(x.{f} + y.{f} - coalesce(common_{f}, 0))"
        cols.append(f"CAST(CASE WHEN x.compound IS NOT NULL AND y.compound IS NOT NULL THEN {c} END AS DOUBLE) AS {f}_intersection_count, CAST({u} AS DOUBLE) AS {f}_union_count, CASE WHEN {u} = 0 THEN 0.0 ELSE CAST({c} AS DOUBLE) / {u} END AS {f}_jaccard")
    return f"""{name}_c AS (SELECT a, b, {shared} FROM {pp} JOIN fam x ON x.compound = a JOIN fam y ON y.compound = b AND y.family = x.family AND y.neighbour = x.neighbour GROUP BY a, b),
{name} AS (SELECT p.a, p.b, {", ".join(cols)} FROM {pp} p LEFT JOIN cf x ON x.compound = p.a LEFT JOIN cf y ON y.compound = p.b LEFT JOIN {name}_c c ON c.a = p.a AND c.b = p.b)"""


def _count(sign: str) -> str:
    return f"CAST(length(smiles) - length(replace(smiles, '{sign}', '')) AS DOUBLE)"


_DESCRIPTORS = f"""descriptors AS (SELECT cid AS compound, CASE WHEN isnan(molecular_weight) THEN NULL ELSE molecular_weight END AS molecular_weight, {_count("C")} / 10.0 AS logp, {_count("O")} * 20.0 AS tpsa, {_count("N")} AS hbd, {_count("O")} AS hba, {_count("C")} - {_count("1")} AS rotatable_bonds
  FROM pubchem_compounds WHERE {_t("smiles")} IS NOT NULL)"""


def _molecular_features(mp: str, name: str) -> str:
    cols = ["CAST(CAST(x.compound IS NOT NULL AS INT) + CAST(y.compound IS NOT NULL AS INT) AS DOUBLE) AS structure_available_count", "CAST(CAST(x.compound IS NOT NULL AND y.compound IS NOT NULL AS INT) AS DOUBLE) AS both_structures_available"]
    cols += [f"(x.{k} + y.{k}) / 2.0 AS {k}_mean, abs(x.{k} - y.{k}) AS {k}_abs_difference" for k in X.DESCRIPTORS]
    return f"{name} AS (SELECT p.a, p.b, {', '.join(cols)} FROM {mp} p LEFT JOIN descriptors x ON x.compound = p.a LEFT JOIN descriptors y ON y.compound = p.b)"


GRAPH_FEATURES, MOLECULAR_FEATURES = FEATURES[: FEATURES.index("structure_available_count")], FEATURES[FEATURES.index("structure_available_count") :]
_SCALAR_NAMES, _SET_NAMES = [c for c in GRAPH_FEATURES[2:] if c.startswith("graph_")], [c for c in GRAPH_FEATURES[2:] if not c.startswith("graph_")]
_GF = f"{_CF}, {_FAM}, {_PP}, {_graph_features('pp', 'gf')}"


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """A table of descriptors. Only the weight is real: nothing here computes the others from structures, so that counts of signs stand in for them."""
    c = table(spark, d, "pubchem_compounds").filter(filled("smiles").isNotNull())
    n = lambda sign: F.length("smiles").cast("double") - F.length(F.replace("smiles", F.lit(sign), F.lit(""))).cast("double")
    return c.select(F.col("cid").alias("compound"), F.when(~F.isnan("molecular_weight"), F.col("molecular_weight")).alias("molecular_weight"), (n("C") / 10.0).alias("logp"), (n("O") * 20.0).alias("tpsa"), n("N").alias("hbd"), n("O").alias("hba"), (n("C") - n("1")).alias("rotatable_bonds"))


def graph_features(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    return X.graph_pair_features(p, S.all_edges(spark, d), Scratch(spark))


@query(f"{_GF} SELECT a, b, hetionet_available_count, both_hetionet_available, {', '.join(_SCALAR_NAMES)} FROM gf")
def pair_graph_scalars(spark: SparkSession, d: str) -> DataFrame:
    return graph_features(spark, d, graph_pairs(spark, d)).select("a", "b", *GRAPH_FEATURES[:2], *_SCALAR_NAMES)


@query(f"{_GF} SELECT a, b, {', '.join(_SET_NAMES)} FROM gf")
def pair_graph_sets(spark: SparkSession, d: str) -> DataFrame:
    return graph_features(spark, d, graph_pairs(spark, d)).select("a", "b", *_SET_NAMES)


@query(f"""WITH {_DESCRIPTORS}, mp AS (SELECT DISTINCT drug_a_pubchem_cid AS a, drug_b_pubchem_cid AS b FROM ddinter_severity_dataset WHERE drug_a_pubchem_cid IS NOT NULL AND drug_b_pubchem_cid IS NOT NULL), {_molecular_features("mp", "mf")}
SELECT a, b, {", ".join(MOLECULAR_FEATURES)} FROM mf""")
def pair_molecular(spark: SparkSession, d: str) -> DataFrame:
    p = severity(spark, d).select(F.col("drug_a_pubchem_cid").alias("a"), F.col("drug_b_pubchem_cid").alias("b")).filter("a is not null and b is not null").distinct()
    return X.molecular_pair_features(p, descriptors(spark, d)).select("a", "b", *MOLECULAR_FEATURES)


_NEAR_ALONE = _CF.split(f"WITH {S.SQL}, ", 1)[1]
_SUPERVISED = f"""{_DEDUP}, drugs AS (SELECT id, min(name) AS name FROM (SELECT id_a AS id, name_a AS name FROM pairs UNION ALL SELECT id_b, name_b FROM pairs) GROUP BY id), {_MAPPED.split(f"{_DRUGS}, ", 1)[1]}, {_ST}, {_NEAR_ALONE}, {_FAM}, {_DESCRIPTORS},
known AS (SELECT g.pair_id, split_part(g.pair_id, '|', 1) AS ia, split_part(g.pair_id, '|', 2) AS ib, f.name_a, f.name_b, upper(left(g.level, 1)) || substr(g.level, 2) AS severity, g.source_files, g.categories FROM g JOIN f ON f.pair_id = g.pair_id WHERE k = 1 AND g.level <> 'unknown'),
full_ AS (SELECT n.*, a.compound AS ha, b.compound AS hb, a.status AS sa, b.status AS sb, x.cid AS ca, y.cid AS cb, x.found AS fa, y.found AS fb, CASE WHEN x.smiles IS NOT NULL THEN x.cid END AS ma, CASE WHEN y.smiles IS NOT NULL THEN y.cid END AS mb
  FROM known n LEFT JOIN mapped a ON a.id = ia LEFT JOIN mapped b ON b.id = ib LEFT JOIN st x ON x.id = ia LEFT JOIN st y ON y.id = ib),
pp AS (SELECT DISTINCT ha AS a, hb AS b FROM full_), mp AS (SELECT DISTINCT ma AS a, mb AS b FROM full_), {_graph_features("pp", "gf")}, {_molecular_features("mp", "mf")}
SELECT pair_id, ia AS drug_a_ddinter_id, name_a AS drug_a_name, ib AS drug_b_ddinter_id, name_b AS drug_b_name, severity AS source_severity, source_files AS source_file, categories AS atc_category, 'pairs' AS source_dataset, '1' AS dataset_version,
  ha AS drug_a_hetionet_id, hb AS drug_b_hetionet_id, sa AS drug_a_mapping_status, sb AS drug_b_mapping_status, {_cover("coalesce(sa = 'exact_name', false)", "coalesce(sb = 'exact_name', false)", "mapped")} AS pair_mapping_coverage,
  ca AS drug_a_pubchem_cid, cb AS drug_b_pubchem_cid, fa AS drug_a_pubchem_status, fb AS drug_b_pubchem_status, {_one_sided("coalesce(fa = 'exact_unique', false)", "coalesce(fb = 'exact_unique', false)")} AS pair_structure_coverage,
  {", ".join(GRAPH_FEATURES + MOLECULAR_FEATURES)}, severity AS ddi_severity FROM full_ LEFT JOIN gf ON gf.a IS NOT DISTINCT FROM ha AND gf.b IS NOT DISTINCT FROM hb LEFT JOIN mf ON mf.a IS NOT DISTINCT FROM ma AND mf.b IS NOT DISTINCT FROM mb"""


@query(_SUPERVISED)
def supervised_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs with their metadata, all features and the label, in the stored order of columns."""
    scratch = Scratch(spark)
    p = scratch.keep(pairs(spark, d))
    known = P.deduplicated(p).filter("level <> 'unknown'").select("pair_id", F.split_part("pair_id", F.lit("|"), F.lit(1)).alias("id_a"), F.split_part("pair_id", F.lit("|"), F.lit(2)).alias("id_b"), "name_a", "name_b", F.initcap("level").alias("severity"), "source_files", "categories")
    names = P.map_names(P.drug_dimension(p), S.nodes(spark, d).filter("kind = 'compound'"))
    st = P.latest_structures(table(spark, d, "ddinter_pubchem_mapping")).withColumn("m", F.when(F.col("smiles").isNotNull(), F.col("cid")))
    sides = scratch.keep(names.join(st, "id", "full").select("id", F.struct("compound", "status", "cid", "found", "m").alias("of")))
    rows = scratch.keep(P.two_sided(known, sides, "id", "of"))
    g = graph_features(spark, d, rows.select(F.col("of_a.compound").alias("a"), F.col("of_b.compound").alias("b")).distinct())
    m = X.molecular_pair_features(rows.select(F.col("of_a.m").alias("a"), F.col("of_b.m").alias("b")).distinct(), descriptors(spark, d))
    full = X.with_pair_features(X.with_pair_features(rows, ("of_a.compound", "of_b.compound"), g), ("of_a.m", "of_b.m"), m)
    is_ = lambda s, field, value: F.coalesce(F.col(f"of_{s}.{field}") == value, F.lit(False))
    columns = {
        "drug_a_ddinter_id": "id_a", "drug_a_name": "name_a", "drug_b_ddinter_id": "id_b", "drug_b_name": "name_b", "source_severity": "severity", "source_file": "source_files", "atc_category": "categories",
        "source_dataset": F.lit("pairs"), "dataset_version": F.lit("1"), "ddi_severity": "severity",
        "pair_mapping_coverage": P.coverage_class(is_("a", "status", "exact_name"), is_("b", "status", "exact_name"), "mapped"), "pair_structure_coverage": P.one_sided_class(is_("a", "found", "exact_unique"), is_("b", "found", "exact_unique"), "structured"),
    } | {f"drug_{s}_{k}": f"of_{s}.{v}" for s in "ab" for k, v in (("hetionet_id", "compound"), ("mapping_status", "status"), ("pubchem_cid", "cid"), ("pubchem_status", "found"))}
    column = lambda c: c if not isinstance(c, str) else F.col(c)
    return full.select(*[column(columns.get(c, c)).alias(c) for c in [*METADATA, *FEATURES, "ddi_severity"]])


_NUM = ["molecular_weight_mean", "logp_mean", "tpsa_mean", "side_effect_jaccard", "gene_union_count"]
_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS v FROM ddinter_severity_dataset" for c in FEATURES) + ")"


@query(f"""SELECT feature, count(v) AS nonmissing, count(*) - count(v) AS missing, round(100.0 * (count(*) - count(v)) / count(*), 6) AS missing_pct, round(100.0 * count(CASE WHEN v = 0 THEN 1 END) / nullif(count(v), 0), 6) AS zero_pct,
count(DISTINCT v) AS unique_values, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM {_LONG} GROUP BY feature""")
def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every feature over all loads, from one histogram of values."""
    df = severity(spark, d).withColumn("all", F.lit(1))
    h = Scratch(spark).keep(R.value_histogram(df, "all", FEATURES).select("k", "num", "n"))
    n, v = F.col("n"), F.col("num")
    some = F.when(v.isNotNull(), n).otherwise(0)
    g = h.groupBy("k").agg(F.sum(n).alias("rows"), F.sum(some).alias("nonmissing"), F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"), F.count(v).alias("unique_values"), F.sum(v * n).alias("s"), F.min(v).alias("min"), F.max(v).alias("max"))
    g = g.withColumn("avg", F.col("s") / F.nullif("nonmissing", F.lit(0)))
    # the sum of squares around the mean, for a standard deviation without cancellation
    around = h.join(F.broadcast(g.select("k", "avg")), "k").groupBy("k").agg(F.sum(n * F.pow(v - F.col("avg"), 2)).alias("ss"))
    q = X.exact_quantiles(h.filter("num is not null"), ["k"], {"q25": 0.25, "median": 0.5, "q75": 0.75})
    got = g.join(around, "k").join(q, "k", "left")
    r = lambda c: F.round(c, 6)
    return got.select(
        R.named(FEATURES).alias("feature"), "nonmissing", (F.col("rows") - F.col("nonmissing")).alias("missing"), r(100.0 * (F.col("rows") - F.col("nonmissing")) / F.col("rows")).alias("missing_pct"), r(100.0 * F.col("zeros") / F.nullif("nonmissing", F.lit(0))).alias("zero_pct"),
        "unique_values", r("avg").alias("mean"), r(F.sqrt(F.col("ss") / F.nullif(F.col("nonmissing") - 1, F.lit(0)))).alias("std"), "min", r("q25").alias("q25"), r("median").alias("median"), r("q75").alias("q75"), "max",
    )


@query(f"SELECT feature FROM {_LONG} GROUP BY feature HAVING count(DISTINCT v) <= 1 OR 100.0 * count(CASE WHEN v = 0 THEN 1 END) / nullif(count(v), 0) >= 99.5")
def near_constant(spark: SparkSession, d: str) -> DataFrame:
    """Features with one value at most, or of which 99.5 % or more are zero."""
    p = R.profile(severity(spark, d).withColumn("all", F.lit(1)), "all", FEATURES)
    return p.filter("unique_values <= 1 or zero_pct >= 99.5").select("feature")


_RUNTIME = f"""{_MAPPED}, {_ST}, {_NEAR_ALONE}, {_FAM}, {_DESCRIPTORS}, bridge AS (SELECT compound, max(id) AS id FROM mapped WHERE status = 'exact_name' GROUP BY compound), {_PP},
asked AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM pp UNION SELECT a, a FROM pp),
req AS (SELECT q.a, q.b, CASE WHEN q.a = q.b THEN 'unsupported_pair' WHEN x.id IS NULL OR y.id IS NULL THEN 'missing_drug_mapping' WHEN u.id IS NULL OR v.id IS NULL THEN 'missing_feature_source' END AS reason, CASE WHEN u.smiles IS NOT NULL THEN u.cid END AS ma, CASE WHEN v.smiles IS NOT NULL THEN v.cid END AS mb
  FROM asked q LEFT JOIN bridge x ON x.compound = q.a LEFT JOIN bridge y ON y.compound = q.b LEFT JOIN st u ON u.id = x.id LEFT JOIN st v ON v.id = y.id),
gp AS (SELECT a, b FROM req WHERE reason IS NULL), mp AS (SELECT DISTINCT ma AS a, mb AS b FROM req WHERE reason IS NULL), {_graph_features("gp", "gf")}, {_molecular_features("mp", "mf")}
SELECT req.a AS drug_a, req.b AS drug_b, reason, {", ".join(f"CASE WHEN reason IS NULL THEN {c} END AS {c}" for c in GRAPH_FEATURES + MOLECULAR_FEATURES)} FROM req LEFT JOIN gf ON gf.a = req.a AND gf.b = req.b AND reason IS NULL LEFT JOIN mf ON mf.a IS NOT DISTINCT FROM ma AND mf.b IS NOT DISTINCT FROM mb AND reason IS NULL"""


@query(_RUNTIME)
def pair_feature_runtime(spark: SparkSession, d: str) -> DataFrame:
    """The features of requested pairs of compounds in order of their ids, or why they can't be built; failures are rows, not errors."""
    p = graph_pairs(spark, d)
    asked = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(p.select("a", F.col("a").alias("b"))).distinct()
    bridge = mapped(spark, d).filter("status = 'exact_name'").groupBy("compound").agg(F.max("id").alias("id"))
    st = P.latest_structures(table(spark, d, "ddinter_pubchem_mapping")).select("id", F.lit(True).alias("has"), F.when(F.col("smiles").isNotNull(), F.col("cid")).alias("m"))
    known = bridge.join(st, "id", "left")
    of = lambda s: known.select(F.col("compound").alias(s), F.struct("id", "has", "m").alias(f"of_{s}"))
    why = F.when(F.col("a") == F.col("b"), "unsupported_pair").when(F.col("of_a").isNull() | F.col("of_b").isNull(), "missing_drug_mapping").when(F.col("of_a.has").isNull() | F.col("of_b.has").isNull(), "missing_feature_source")
    rows = Scratch(spark).keep(asked.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", why.alias("reason"), F.col("of_a.m").alias("ma"), F.col("of_b.m").alias("mb")))
    good = rows.filter("reason is null")
    g = graph_features(spark, d, good.select("a", "b"))
    m = X.molecular_pair_features(good.select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct(), descriptors(spark, d))
    full = X.with_pair_features(good.join(g, ["a", "b"]), ("ma", "mb"), m)
    return full.unionByName(rows.filter("reason is not null"), allowMissingColumns=True).select(F.col("a").alias("drug_a"), F.col("b").alias("drug_b"), "reason", *FEATURES)


@query(f"""WITH {S.SQL}, pos AS (SELECT DISTINCT source AS c, target AS t FROM edges WHERE metaedge = 'ctd' AND target IN (SELECT id FROM nodes WHERE kind = 'disease') AND source IN (SELECT id FROM nodes WHERE kind = 'compound')),
neg AS (SELECT c, t FROM (SELECT c.c, n.id AS t FROM (SELECT DISTINCT c FROM pos) c, nodes n WHERE n.kind = 'disease') x WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.c = x.c AND p.t = x.t)),
drawn AS (SELECT c, t FROM neg ORDER BY md5(c || '|' || t), c, t LIMIT (SELECT 2 * count(*) FROM pos)),
every AS (SELECT c, t, 1 AS label FROM pos UNION ALL SELECT c, t, 0 FROM drawn), oc AS (SELECT c, count(*) AS n FROM pos GROUP BY c), ot AS (SELECT t, count(*) AS n FROM pos GROUP BY t),
og AS (SELECT source AS c, count(DISTINCT target) AS n FROM edges WHERE metaedge IN ('cbg', 'cug', 'cdg') GROUP BY source)
SELECT e.c AS compound, e.t AS disease, label, coalesce(oc.n, 0) - label AS other_diseases, coalesce(ot.n, 0) - label AS other_compounds, coalesce(og.n, 0) AS genes FROM every e LEFT JOIN oc ON oc.c = e.c LEFT JOIN ot ON ot.t = e.t LEFT JOIN og ON og.c = e.c""")
def legacy_ctd_features(spark: SparkSession, d: str) -> DataFrame:
    """Treatments and twice as many pairs that aren't, drawn by digest, with counts that leave the pair itself out.

    The catalog of diseases is a closed list of some tens of nodes; every treating compound is paired with it in its own row.
    """
    n, e = S.nodes(spark, d), S.edges(spark, d)
    diseases = n.filter("kind = 'disease'").select("id")
    pos = e.filter("metaedge = 'ctd'").select(F.col("source").alias("compound"), F.col("target").alias("disease"))
    pos = pos.join(diseases, pos["disease"] == diseases["id"], "left_semi").join(n.filter("kind = 'compound'").select("id"), F.col("compound") == F.col("id"), "left_semi")
    catalog = F.array(*[F.lit(r["id"]) for r in diseases.orderBy("id").collect()])
    neg = pos.select("compound").distinct().select("compound", F.explode(catalog).alias("disease")).join(pos, ["compound", "disease"], "left_anti")
    drawn = neg.orderBy(F.md5(F.concat_ws("|", "compound", "disease")), "compound", "disease").limit(2 * pos.count())
    every = pos.withColumn("label", F.lit(1)).unionByName(drawn.withColumn("label", F.lit(0)))
    count = lambda k, name: pos.groupBy(k).agg(F.count(F.lit(1)).alias(name))
    genes = e.filter(F.col("metaedge").isin(*S.GENES)).groupBy(F.col("source").alias("compound")).agg(F.countDistinct("target").alias("genes"))
    got = every.join(count("compound", "oc"), "compound", "left").join(count("disease", "ot"), "disease", "left").join(genes, "compound", "left")
    less = lambda c: F.coalesce(c, F.lit(0)) - F.col("label")
    return got.select("compound", "disease", "label", less("oc").alias("other_diseases"), less("ot").alias("other_compounds"), F.coalesce("genes", F.lit(0)).alias("genes"))


@query("""WITH k AS (SELECT row_id, ddi_severity, row_number() OVER (PARTITION BY ddi_severity ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS k, count(*) OVER (PARTITION BY ddi_severity) AS n FROM ddinter_severity_dataset)
SELECT row_id, CASE WHEN k <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM k""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return P.stratified(severity(spark, d).select("row_id", "ddi_severity"), "ddi_severity", "row_id").select("row_id", "split")


@query("SELECT row_id, CAST((row_number() OVER (PARTITION BY ddi_severity ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INT) AS fold FROM ddinter_severity_dataset")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return P.folds(severity(spark, d).select("row_id", "ddi_severity"), "ddi_severity", "row_id").select("row_id", "fold")


_HELD = """drug AS (SELECT DISTINCT id FROM (SELECT drug_a_ddinter_id AS id FROM ddinter_severity_dataset UNION ALL SELECT drug_b_ddinter_id FROM ddinter_severity_dataset) WHERE id IS NOT NULL),
held AS (SELECT id FROM drug ORDER BY md5(id), id LIMIT (SELECT CAST(round(count(*) * 0.1) AS BIGINT) FROM drug))"""


@query(f"WITH {_HELD} SELECT row_id, CASE WHEN drug_a_ddinter_id IN (SELECT id FROM held) OR drug_b_ddinter_id IN (SELECT id FROM held) THEN 'test' ELSE 'train' END AS split FROM ddinter_severity_dataset")
def cold_start_split(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the drugs, by digest, is held out; rows with one of them on either side are test rows."""
    rows = severity(spark, d).select("row_id", F.col("drug_a_ddinter_id").alias("a"), F.col("drug_b_ddinter_id").alias("b"))
    drugs = rows.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    held = drugs.orderBy(F.md5("id"), "id").limit(round(drugs.count() * 0.1 + 1e-9)).withColumn("held", F.lit(True))
    got = rows.join(held.select(F.col("id").alias("a"), F.col("held").alias("ha")), "a", "left").join(held.select(F.col("id").alias("b"), F.col("held").alias("hb")), "b", "left")
    return got.select("row_id", F.when(F.coalesce("ha", "hb").isNotNull(), "test").otherwise("train").alias("split"))


@query("""SELECT count(*) AS rows, count(DISTINCT pair_id) AS pairs, count(DISTINCT load_id) AS loads, (SELECT count(DISTINCT id) FROM (SELECT drug_a_ddinter_id AS id FROM ddinter_severity_dataset UNION ALL SELECT drug_b_ddinter_id FROM ddinter_severity_dataset)) AS drugs,
round(100.0 * count(CASE WHEN pair_mapping_coverage = 'both_mapped' THEN 1 END) / count(*), 3) AS both_mapped_pct, round(100.0 * count(CASE WHEN pair_structure_coverage = 'both_structured' THEN 1 END) / count(*), 3) AS both_structured_pct FROM ddinter_severity_dataset""")
def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    s = severity(spark, d)
    share = lambda c, v: F.round(100.0 * F.count(F.when(F.col(c) == v, 1)) / F.count(F.lit(1)), 3)
    one = s.agg(F.count(F.lit(1)).alias("rows"), share("pair_mapping_coverage", "both_mapped").alias("both_mapped_pct"), share("pair_structure_coverage", "both_structured").alias("both_structured_pct"))
    many = lambda cols, name: s.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("x")).filter("x is not null").distinct().agg(F.count(F.lit(1)).alias(name))
    parts = [one, many(["pair_id"], "pairs"), many(["load_id"], "loads"), many(["drug_a_ddinter_id", "drug_b_ddinter_id"], "drugs")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


# --- metrics ------------------------------------------------------------------------------------------------------------

_MW = "CASE WHEN isnan(molecular_weight_mean) THEN NULL ELSE molecular_weight_mean END"
_PRED = f"""p AS (SELECT row_id, ddi_severity AS truth, CASE WHEN {_MW} > 500 THEN 'Major' WHEN {_MW} < 350 THEN 'Minor' ELSE 'Moderate' END AS predicted, coalesce({_MW}, 0) AS mw FROM ddinter_severity_dataset)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a stand-in prediction and score, to hold the metrics against SQL."""
    mw = F.when(~F.isnan("molecular_weight_mean"), F.col("molecular_weight_mean"))
    return severity(spark, d).select("row_id", F.col("ddi_severity").alias("truth"), F.when(mw > 500, "Major").when(mw < 350, "Minor").otherwise("Moderate").alias("predicted"), F.coalesce(mw, F.lit(0.0)).alias("mw"))


@query(f"WITH {_PRED}, c AS (SELECT unnest(['Major', 'Moderate', 'Minor']) AS truth) SELECT c.truth, {', '.join(f'''count(CASE WHEN predicted = '{c}' THEN 1 END) AS {c.lower()}''' for c in CLASSES)} FROM c LEFT JOIN p ON p.truth = c.truth GROUP BY c.truth")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predictions(spark, d), CLASSES)


_PRF = f"""WITH {_PRED}, c AS (SELECT unnest(['Major', 'Moderate', 'Minor']) AS class), s AS (SELECT class, count(CASE WHEN truth = class AND predicted = class THEN 1 END) AS tp, count(CASE WHEN predicted = class THEN 1 END) AS pp, count(CASE WHEN truth = class THEN 1 END) AS support FROM c, p GROUP BY class),
prf AS (SELECT class, coalesce(CAST(tp AS DOUBLE) / nullif(pp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp / nullif(pp + support, 0), 0) AS f1, support, tp FROM s)"""


def _r(cols: list[str]) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


@query(f"{_PRF} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf")
def class_prf(spark: SparkSession, d: str) -> DataFrame:
    return M.per_class(predictions(spark, d), CLASSES).select("class", *_r(["precision", "recall", "f1"]), "support")


@query(f"{_PRF} SELECT round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS balanced_accuracy, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy FROM prf")
def macro_micro_weighted(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(M.per_class(predictions(spark, d), CLASSES)).select(*_r(["macro_f1", "macro_precision", "balanced_accuracy", "weighted_f1", "accuracy"]))


_OVR = f"WITH {_PRED}, o AS (SELECT 'Major' AS class, CAST(truth = 'Major' AS INT) AS positive, mw AS score FROM p UNION ALL SELECT 'Minor', CAST(truth = 'Minor' AS INT), -mw FROM p UNION ALL SELECT 'Moderate', CAST(truth = 'Moderate' AS INT), -abs(mw - 425) FROM p)"


def one_versus_rest(spark: SparkSession, d: str) -> DataFrame:
    score = {"Major": F.col("mw"), "Minor": -F.col("mw"), "Moderate": -F.abs(F.col("mw") - 425)}
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col("truth") == c).cast("int").alias("positive"), (s + F.lit(0.0)).alias("score")) for c, s in score.items()]))
    return predictions(spark, d).select(x.alias("x")).select("x.*")


@query(f"""{_OVR}, r AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS k FROM o)
SELECT class, round((sum(CASE WHEN positive = 1 THEN k END) - sum(positive) * (sum(positive) + 1) / 2.0) / (sum(positive) * (count(*) - sum(positive))), 6) AS auroc FROM r GROUP BY class""")
def auroc_ovr(spark: SparkSession, d: str) -> DataFrame:
    return M.auroc(one_versus_rest(spark, d)).select("class", F.round("auroc", 6).alias("auroc"))


@query(f"""{_OVR}, g AS (SELECT class, score, count(*) AS n, sum(positive) AS p FROM o GROUP BY class, score), c AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY class ORDER BY score DESC) AS al FROM g)
SELECT class, round(sum(CAST(p AS DOUBLE) * tp / al) / sum(p), 6) AS average_precision FROM c GROUP BY class""")
def average_precision_ovr(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(one_versus_rest(spark, d)).select("class", F.round("average_precision", 6).alias("average_precision"))


_FOLD = f"WITH {_PRED}, k AS (SELECT *, (row_number() OVER (PARTITION BY truth ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS fold FROM p), a AS (SELECT fold, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS acc, avg(CASE WHEN truth = 'Moderate' THEN 1.0 ELSE 0.0 END) AS base FROM k GROUP BY fold)"


def fold_accuracy(spark: SparkSession, d: str) -> DataFrame:
    k = P.folds(predictions(spark, d), "truth", "row_id")
    return k.groupBy("fold").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("acc"), F.avg((F.col("truth") == "Moderate").cast("double")).alias("base"))


@query(f"{_FOLD} SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM a")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return fold_accuracy(spark, d).agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_pop("acc"), 6).alias("std"))


@query(f"{_FOLD}, m AS (SELECT 0 AS pos, 'rule' AS model, avg(acc) AS score FROM a UNION ALL SELECT 1, 'majority', avg(base) FROM a) SELECT model FROM m ORDER BY score DESC, pos LIMIT 1")
def model_select(spark: SparkSession, d: str) -> DataFrame:
    """The better mean over the folds; of equal ones the first."""
    one = fold_accuracy(spark, d).agg(F.avg("acc").alias("a"), F.avg("base").alias("b"))
    return one.select(F.when(F.col("a") >= F.col("b"), "rule").otherwise("majority").alias("model"))


_MED = f"(SELECT quantile_cont({_MW}, 0.5) FROM ddinter_severity_dataset)"


def imputed(spark: SparkSession, d: str) -> DataFrame:
    s = severity(spark, d).select("row_id", F.when(~F.isnan("molecular_weight_mean"), F.col("molecular_weight_mean")).alias("v"))
    h = s.filter("v is not null").groupBy(F.lit(0).alias("k"), F.col("v").alias("num")).agg(F.count(F.lit(1)).alias("n"))
    m = X.exact_quantiles(h, ["k"], {"median": 0.5}).first()  # one row
    return s.select("row_id", F.coalesce("v", F.lit(m["median"] if m else None).cast("double")).alias("v"))


@query(f"SELECT row_id, coalesce({_MW}, {_MED}) AS v FROM ddinter_severity_dataset")
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    return imputed(spark, d)


@query(f"WITH i AS (SELECT row_id, coalesce({_MW}, {_MED}) AS v FROM ddinter_severity_dataset) SELECT row_id, round((v - (SELECT avg(v) FROM i)) / (SELECT stddev_pop(v) FROM i), 6) AS z FROM i")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    i = imputed(spark, d)
    one = i.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    lit = lambda x: F.lit(x).cast("double")
    return i.select("row_id", F.round((F.col("v") - lit(one["m"])) / F.nullif(lit(one["s"]), F.lit(0.0)), 6).alias("z"))


@query("SELECT ddi_severity, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ddinter_severity_dataset), 2) AS pct FROM ddinter_severity_dataset GROUP BY ddi_severity")
def severity_percent(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = severity(spark, d).groupBy("ddi_severity").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # a row per label


@query(f"SELECT feature, round(log10(nullif(round(var_samp(v), 9), 0)), 4) AS log_variance FROM {_LONG} GROUP BY feature")
def variance_log10(spark: SparkSession, d: str) -> DataFrame:
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.when(~F.isnan(c), F.col(c)).alias("v")) for c in FEATURES])).alias("x")
    return severity(spark, d).select(x).groupBy("x.feature").agg(F.round(F.log10(F.nullif(F.round(F.var_samp("x.v"), 9), F.lit(0.0))), 4).alias("log_variance"))


@query(f"SELECT ddi_severity AS class, CAST(least(34, greatest(0, floor(({_MW} - 100) / 20))) AS INT) AS bin, count(*) AS n FROM ddinter_severity_dataset WHERE {_MW} IS NOT NULL GROUP BY 1, 2")
def density_histogram(spark: SparkSession, d: str) -> DataFrame:
    """35 bins of molecular weight from 100 to 800; what lies outside is in the first or last."""
    s = severity(spark, d).filter("molecular_weight_mean is not null and not isnan(molecular_weight_mean)")
    b = F.least(F.lit(34), F.greatest(F.lit(0), F.floor((F.col("molecular_weight_mean") - 100) / 20))).cast("int")
    return s.groupBy(F.col("ddi_severity").alias("class"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT feature, max(v) AS high, min(v) AS low FROM {_LONG} WHERE feature IN ({', '.join(repr(c) for c in _NUM)}) GROUP BY feature")
def descriptor_maxima(spark: SparkSession, d: str) -> DataFrame:
    p = R.profile(severity(spark, d).withColumn("all", F.lit(1)), "all", _NUM)
    return p.select("feature", "high", "low")


# --- checks -------------------------------------------------------------------------------------------------------------


@query("""SELECT 'row_id_unique' AS check_name, count(*) - count(DISTINCT row_id) AS violations FROM ddinter_severity_dataset
UNION ALL SELECT 'known_label', count(CASE WHEN coalesce(ddi_severity, '') NOT IN ('Major', 'Moderate', 'Minor') THEN 1 END) FROM ddinter_severity_dataset
UNION ALL SELECT 'sides_in_order', count(CASE WHEN drug_a_ddinter_id > drug_b_ddinter_id THEN 1 END) FROM ddinter_severity_dataset
UNION ALL SELECT 'pair_id_of_sides', count(CASE WHEN pair_id <> drug_a_ddinter_id || '|' || drug_b_ddinter_id THEN 1 END) FROM ddinter_severity_dataset""")
def q_contract(spark: SparkSession, d: str) -> DataFrame:
    s = severity(spark, d)
    bad = {"known_label": ~F.coalesce("ddi_severity", F.lit("")).isin(*CLASSES), "sides_in_order": F.col("drug_a_ddinter_id") > F.col("drug_b_ddinter_id"), "pair_id_of_sides": F.col("pair_id") != F.concat("drug_a_ddinter_id", F.lit("|"), "drug_b_ddinter_id")}
    one = s.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in bad.items()])
    repeats = s.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit("row_id_unique").alias("check_name"), "violations")
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("violations")) for k in bad])).alias("x")).select("x.*").unionByName(repeats)


_GONE = lambda c: f"({c} IS NULL OR isnan({c}))"
_GRAPH, _STRUCT = GRAPH_FEATURES[2:], MOLECULAR_FEATURES[2:]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(CASE WHEN {_GONE(c)} = ({flag} = 1) THEN 1 END) AS violations FROM ddinter_severity_dataset WHERE {flag} IN (0, 1)" for flag, cols in (("both_hetionet_available", _GRAPH), ("both_structures_available", _STRUCT)) for c in cols))
def q_missingness(spark: SparkSession, d: str) -> DataFrame:
    """A measurement is missing exactly where its availability flag says so."""
    cells = []
    for flag, cols in (("both_hetionet_available", _GRAPH), ("both_structures_available", _STRUCT)):
        cells += [F.struct(F.lit(c).alias("feature"), (F.col(flag).isin(0, 1) & ((F.col(c).isNull() | F.isnan(c)) == (F.col(flag) == 1))).alias("bad")) for c in cols]
    return severity(spark, d).select(F.explode(F.array(*cells)).alias("x")).groupBy("x.feature").agg(F.count(F.when(F.col("x.bad"), 1)).alias("violations"))


_BACK = ", ".join(["a", "b", *GRAPH_FEATURES])


@query(f"""{_GF}, rp AS (SELECT b AS a, a AS b FROM pp), {_graph_features("rp", "gr")}, back AS (SELECT b AS a, a AS b, {", ".join(GRAPH_FEATURES)} FROM gr),
{_DESCRIPTORS}, mp AS (SELECT DISTINCT drug_a_pubchem_cid AS a, drug_b_pubchem_cid AS b FROM ddinter_severity_dataset WHERE drug_a_pubchem_cid IS NOT NULL AND drug_b_pubchem_cid IS NOT NULL), nm AS (SELECT b AS a, a AS b FROM mp), {_molecular_features("mp", "mf")}, {_molecular_features("nm", "mr")}
SELECT 'graph' AS part, (SELECT count(*) FROM pp) AS pairs, count(*) AS violations FROM (SELECT {_BACK} FROM gf EXCEPT ALL SELECT {_BACK} FROM back)
UNION ALL SELECT 'molecular', (SELECT count(*) FROM mp), count(*) FROM (SELECT a, b, {", ".join(MOLECULAR_FEATURES)} FROM mf EXCEPT ALL SELECT b, a, {", ".join(MOLECULAR_FEATURES)} FROM mr)""")
def q_symmetry(spark: SparkSession, d: str) -> DataFrame:
    """In how many of the pairs any feature differs if its sides are turned."""
    turned = lambda p: p.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in p.columns if c not in ("a", "b")])
    g = graph_pairs(spark, d)
    m = severity(spark, d).select(F.col("drug_a_pubchem_cid").alias("a"), F.col("drug_b_pubchem_cid").alias("b")).filter("a is not null and b is not null").distinct()
    made = {"graph": (g, lambda p: graph_features(spark, d, p)), "molecular": (m, lambda p: X.molecular_pair_features(p, descriptors(spark, d)))}
    out = None
    for name, (p, of) in made.items():
        there, back = of(p), turned(of(turned(p)))
        bad = there.exceptAll(back.select(there.columns)).agg(F.count(F.lit(1)).alias("violations"))
        one = bad.crossJoin(p.agg(F.count(F.lit(1)).alias("pairs"))).select(F.lit(name).alias("part"), "pairs", "violations")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_HELD}, s AS (SELECT pair_id, drug_a_ddinter_id IN (SELECT id FROM held) OR drug_b_ddinter_id IN (SELECT id FROM held) AS test FROM ddinter_severity_dataset) SELECT count(*) AS pairs_in_both FROM (SELECT pair_id FROM s GROUP BY pair_id HAVING count(DISTINCT test) > 1)")
def q_split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    s = cold_start_split(spark, d).join(severity(spark, d).select("row_id", "pair_id"), "row_id")
    return s.groupBy("pair_id").agg(F.min("split").alias("x"), F.max("split").alias("y")).filter("x <> y").agg(F.count(F.lit(1)).alias("pairs_in_both"))


@query("SELECT pair_mapping_coverage, pair_structure_coverage, count(*) AS n FROM ddinter_severity_dataset GROUP BY 1, 2")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return severity(spark, d).groupBy("pair_mapping_coverage", "pair_structure_coverage").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_PAIRS} SELECT id_a AS drug, count(DISTINCT id_b) AS partners, count(*) AS rows FROM pairs GROUP BY id_a")
def takeaway_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct unordered pairs against rows, by the first drug."""
    one = pairs(spark, d).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy(F.col("id_a").alias("drug")).agg(F.count(F.lit(1)).alias("partners"), F.sum("n").alias("rows"))


@query("SELECT user_id, date_trunc('day', ts) AS day, count(*) AS requests, count(*) > 6 AS limited FROM events GROUP BY 1, 2")
def request_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Requests per client in fixed windows; the stream of the same is in corvane.streaming.windows."""
    from corvane.streaming.windows import window_counts

    return window_counts(table(spark, d, "events"), "1 day", 6).withColumnRenamed("start", "day")


@query("SELECT row_id, " + ", ".join(f"CAST(coalesce(atc_category, (SELECT atc_category FROM ddinter_severity_dataset WHERE atc_category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) = '{a}' AS INT) AS is_{a}" for a in "ABCDGHJLMNPRSV") + " FROM ddinter_severity_dataset")
def one_hot_category(spark: SparkSession, d: str) -> DataFrame:
    """The ATC letter of each row as indicators."""
    return X.one_hot(severity(spark, d), "row_id", "atc_category", values=list(ATC))


@query(f"SELECT feature, count(CASE WHEN abs(w) = CAST('inf' AS DOUBLE) THEN 1 END) AS infinite, count(CASE WHEN w IS NULL OR isnan(w) THEN 1 END) AS missing FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS w FROM ddinter_severity_dataset" for c in FEATURES)}) GROUP BY feature")
def feature_domains(spark: SparkSession, d: str) -> DataFrame:
    return X.off_domain(severity(spark, d), FEATURES)


@query(rf"SELECT DISTINCT {_t('source')} AS raw, CASE WHEN regexp_matches({_t('source')}, '(?i)^(compound::)?DB[0-9]{{5,}}$') THEN 'Compound::DB' || regexp_extract({_t('source')}, '([0-9]{{5,}})$', 1) ELSE lower({_t('source')}) END AS id FROM fragment_edges WHERE {_t('source')} IS NOT NULL")
def compound_ids(spark: SparkSession, d: str) -> DataFrame:
    from corvane.functions.text import compound_id

    return table(spark, d, "fragment_edges").select(filled("source").alias("raw")).filter("raw is not null").distinct().withColumn("id", compound_id("raw"))


QUERIES = Q
