"""Registered queries of the graph and of candidate sets, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corvane.operators import candidates as C, graph as G
from corvane.session import Scratch
from corvane.sources import graph as S

TERM, REQUEST = "an", ["asthma", "Disease::DOID:990003", "no such disease", "GOUT", "disease::doid:990003"]
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {S.SQL}{sql}" if sql.startswith(",") else f"WITH {S.SQL}\n{sql}"
        return f

    return put


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return S.nodes(spark, d), S.edges(spark, d)


_NAMED = "named AS (SELECT e.*, s.name AS source_name, t.name AS target_name, t.kind AS target_kind FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target)"
def _cand(n: int, x: str = "") -> str:
    """CTEs of the candidates of the n most treated diseases, with the suffix x."""
    return f"""tgt{x} AS (SELECT target AS disease FROM named WHERE metaedge = 'ctd' GROUP BY target ORDER BY count(DISTINCT source) DESC, target LIMIT {n}), tpos{x} AS (SELECT disease, row_number() OVER (ORDER BY disease) - 1 AS bit FROM tgt{x}),
cand{x} AS (SELECT source AS drug, min(source_name) AS drug_name, string_agg(DISTINCT target, ';' ORDER BY target) AS disease_ids, count(DISTINCT target) AS covered, CAST(sum(1 << bit) AS BIGINT) AS mask
  FROM (SELECT DISTINCT source, source_name, target, bit FROM named JOIN tpos{x} ON target = disease WHERE metaedge = 'ctd') GROUP BY source),
cpos{x} AS (SELECT *, row_number() OVER (ORDER BY covered DESC, drug_name NULLS LAST, drug) AS pos FROM cand{x})"""


def _ranked(x: str = "") -> str:
    """CTEs of all sets of up to three candidates and of the first hundred."""
    return f"""sets{x} AS (
  SELECT 'candidate-set:' || drug AS set_id, drug AS drugs, 1 AS size, bit_count(mask) AS covered, mask FROM cpos{x}
  UNION ALL SELECT 'candidate-set:' || a.drug || '+' || b.drug, a.drug || '+' || b.drug, 2, bit_count(a.mask | b.mask), a.mask | b.mask FROM cpos{x} a JOIN cpos{x} b ON a.pos < b.pos
  UNION ALL SELECT 'candidate-set:' || a.drug || '+' || b.drug || '+' || c.drug, a.drug || '+' || b.drug || '+' || c.drug, 3, bit_count(a.mask | b.mask | c.mask), a.mask | b.mask | c.mask FROM cpos{x} a JOIN cpos{x} b ON a.pos < b.pos JOIN cpos{x} c ON b.pos < c.pos),
top{x} AS (SELECT *, row_number() OVER (ORDER BY covered DESC, size, set_id) AS rank FROM sets{x} QUALIFY rank <= 100)"""


_CAND = f"{_NAMED}, {_cand(2)}"
_TOP = f"{_CAND}, {_ranked()}"


def request(spark: SparkSession, d: str, n: int = 2) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(nodes, edges, treatments as a written table, the n most treated diseases)."""
    v, e = both(spark, d)
    t = Scratch(spark).keep(G.treating(e, v))
    return v, e, t, sorted(r["disease"] for r in G.most_treated(t, n).collect())  # n rows


def candidates_of(spark: SparkSession, t: DataFrame, names: list[str]) -> DataFrame:
    """(pos, drug, mask) of all compounds that treat one of the diseases."""
    return Scratch(spark).keep(C.masked(G.in_order(G.treatments(t, names)), names))


def top_sets(spark: SparkSession, d: str, n: int = 2) -> tuple[DataFrame, DataFrame, list[str], DataFrame, DataFrame]:
    """(the first hundred sets of up to three candidates, candidates, diseases, nodes, edges)."""
    v, e, t, names = request(spark, d, n)
    cand = candidates_of(spark, t, names)
    return C.first_sets(cand, 3), cand, names, v, e


def joined(sets: DataFrame) -> DataFrame:
    return sets.withColumn("drugs", F.array_join("drugs", "+"))


@query(f"""SELECT id, name, CASE WHEN lower(name) = '{TERM}' THEN 0 WHEN lower(name) LIKE '{TERM}%' THEN 1 WHEN lower(name) LIKE '%{TERM}%' THEN 2 ELSE 3 END AS relevance
FROM nodes WHERE kind = 'disease' AND (lower(id) = '{TERM}' OR lower(name) LIKE '%{TERM}%') ORDER BY relevance, name, id LIMIT 25""")
def disease_search(spark: SparkSession, d: str) -> DataFrame:
    return G.search(S.nodes(spark, d), "disease", TERM)


@query("SELECT id, name, 0 AS relevance FROM nodes WHERE kind = 'disease' ORDER BY name, id LIMIT 25")
def disease_catalog(spark: SparkSession, d: str) -> DataFrame:
    return G.search(S.nodes(spark, d), "disease", "")


_REQ = ", ".join(f"({i}, '{t}')" for i, t in enumerate(REQUEST))


@query(f""", req AS (SELECT * FROM (VALUES {_REQ}) AS v(pos, term)), c AS (SELECT * FROM nodes WHERE kind = 'disease'),
m AS (SELECT pos, term, coalesce((SELECT min(id) FROM c WHERE lower(id) = lower(term)), (SELECT min(id) FROM c WHERE lower(name) = lower(term))) AS id FROM req)
SELECT pos, term, m.id, c.name FROM m LEFT JOIN c ON c.id = m.id QUALIFY m.id IS NULL OR row_number() OVER (PARTITION BY m.id ORDER BY pos) = 1""")
def disease_resolve(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame(list(enumerate(REQUEST)), "pos int, term string")
    return G.resolve(terms, S.nodes(spark, d).filter("kind = 'disease'"))


_TERMS = ["heart", "Disease::DOID:990003", "no such disease", "an"]


@query(f""", req AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_TERMS))}) AS v(pos, term)), c AS (SELECT * FROM nodes WHERE kind = 'disease'),
m AS (SELECT pos, term, coalesce((SELECT id FROM c WHERE id = term), (SELECT id FROM c WHERE lower(name) LIKE '%' || lower(term) || '%' ORDER BY CASE WHEN lower(name) = lower(term) THEN 0 WHEN lower(name) LIKE lower(term) || '%' THEN 1 ELSE 2 END, name, id LIMIT 1)) AS id FROM req)
SELECT pos, term, m.id, c.name FROM m LEFT JOIN c ON c.id = m.id""")
def disease_best_match(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame(list(enumerate(_TERMS)), "pos int, term string")
    return G.best_match(terms, S.nodes(spark, d).filter("kind = 'disease'"))


@query(f", {_NAMED}, {_cand(1)} SELECT source AS drug, source_name AS drug_name, target AS disease, target_name AS disease_name FROM named JOIN tgt ON target = disease WHERE metaedge = 'ctd'")
def treatments_for_disease(spark: SparkSession, d: str) -> DataFrame:
    """The compounds that treat the most treated disease."""
    n, e, _, names = request(spark, d, 1)
    return G.named(e.filter(F.col("target").isin(*names)), n, ("ctd",)).select(F.col("source").alias("drug"), F.col("source_name").alias("drug_name"), F.col("target").alias("disease"), F.col("target_name").alias("disease_name"))


@query(f", {_CAND} SELECT pos, drug, drug_name, disease_ids, covered FROM cpos")
def treatments_for_set(spark: SparkSession, d: str) -> DataFrame:
    _, _, t, names = request(spark, d)
    return G.in_order(G.treatments(t, names)).withColumn("disease_ids", F.array_join("disease_ids", ";"))


def _top(metaedges: str) -> str:
    return f""", {_NAMED} SELECT source AS drug, row_number() OVER (PARTITION BY source ORDER BY target_name NULLS LAST, metaedge, target) AS place, metaedge, target AS related, target_name AS related_name
FROM named WHERE metaedge IN ({metaedges}) QUALIFY place <= 5"""


@query(_top("'cbg', 'cug', 'cdg'"))
def drug_targets_topn(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.top_related(e, n, S.GENES)


@query(_top("'ccse'"))
def drug_side_effects_topn(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.top_related(e, n, ("ccse",))


@query(f""", {_NAMED} SELECT source AS drug, min(source_name) AS drug_name, count(DISTINCT CASE WHEN metaedge IN ('cbg', 'cug', 'cdg') THEN target END) AS genes,
count(DISTINCT CASE WHEN metaedge = 'ccse' THEN target END) AS side_effects, count(DISTINCT CASE WHEN metaedge = 'ctd' THEN target END) AS diseases FROM named WHERE source LIKE 'Compound::%' GROUP BY source""")
def drug_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    x = G.named(e, n, ("cbg", "cug", "cdg", "ccse", "ctd", "cpd", "crc")).filter("startswith(source, 'Compound::')")
    role = F.when(F.col("metaedge").isin(*S.GENES), "genes").when(F.col("metaedge") == "ccse", "side_effects").when(F.col("metaedge") == "ctd", "diseases").otherwise("other")
    # two levels of counting instead of one expansion per distinct count
    flat = x.select(F.col("source").alias("drug"), F.col("source_name").alias("drug_name"), role.alias("role"), "target").distinct()
    n_of = lambda r: F.count(F.when(F.col("role") == r, 1)).alias(r)
    return flat.groupBy("drug").agg(F.min("drug_name").alias("drug_name"), n_of("genes"), n_of("side_effects"), n_of("diseases"))


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(metaedge, 'total') AS metaedge, count(*) AS n FROM edges GROUP BY ROLLUP (metaedge)")
def metaedge_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(spark, d).rollup("metaedge").agg(F.count(F.lit(1)).alias("n")).withColumn("metaedge", F.coalesce("metaedge", F.lit("total")))


@query(f""", {_CAND}, seeds AS (SELECT DISTINCT source AS id FROM edges WHERE metaedge = 'ctd' AND target IN (SELECT disease FROM tgt))
SELECT source, metaedge, target FROM edges WHERE source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds)""")
def fragment_extract(spark: SparkSession, d: str) -> DataFrame:
    _, e, _, names = request(spark, d)
    seeds = e.filter((F.col("metaedge") == "ctd") & F.col("target").isin(*names)).select(F.col("source").alias("id")).distinct()
    return G.incident(e, seeds)


@query(f""", {_CAND}, seeds AS (SELECT DISTINCT source AS id FROM edges WHERE metaedge = 'ctd' AND target IN (SELECT disease FROM tgt)),
frag AS (SELECT source, target FROM edges WHERE source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds))
SELECT id, name, kind FROM nodes WHERE id IN (SELECT source FROM frag UNION SELECT target FROM frag UNION SELECT disease FROM tgt)""")
def fragment_nodes_extract(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the fragment: all ends of its edges and the diseases themselves."""
    n, e, _, names = request(spark, d)
    seeds = e.filter((F.col("metaedge") == "ctd") & F.col("target").isin(*names)).select(F.col("source").alias("id")).distinct()
    return G.endpoints(G.incident(e, seeds), n, spark.createDataFrame([(x,) for x in names], "id string"))


@query("""SELECT 'source' AS side, source, metaedge, target FROM edges WHERE source NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'target', source, metaedge, target FROM edges WHERE target NOT IN (SELECT id FROM nodes)""")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    lost = lambda side: e.join(n, e[side] == n["id"], "left_anti").select(F.lit(side).alias("side"), "source", "metaedge", "target")
    return lost("source").unionByName(lost("target"))


@query("""SELECT 'only_loaded' AS side, count(*) AS n FROM (SELECT * FROM edges EXCEPT ALL SELECT * FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))
UNION ALL SELECT 'only_complete', count(*) FROM (SELECT * FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) EXCEPT ALL SELECT * FROM edges)""")
def graph_identity_diff(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    good = S.complete_edges(e, n)
    size = lambda a, b, name: a.exceptAll(b).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return size(e, good, "only_loaded").unionByName(size(good, e, "only_complete"))


@query(f", {_NAMED} SELECT source AS class, source_name AS class_name, target AS drug, target_name AS drug_name FROM named WHERE metaedge = 'pcic'")
def pharm_class_members(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.named(e, n, ("pcic",)).select(F.col("source").alias("class"), F.col("source_name").alias("class_name"), F.col("target").alias("drug"), F.col("target_name").alias("drug_name"))


@query(f", {_NAMED} SELECT DISTINCT n.id AS disease, t.source AS drug FROM nodes n LEFT JOIN named t ON t.target = n.id AND t.metaedge = 'ctd' WHERE n.kind = 'disease'")
def disease_to_drugs(spark: SparkSession, d: str) -> DataFrame:
    """Every disease with the compounds that treat it, in a row each; a null for diseases without any."""
    n, e = both(spark, d)
    t = G.named(e, n, ("ctd",)).select(F.col("target").alias("id"), F.col("source").alias("drug")).distinct()
    return n.filter("kind = 'disease'").select("id").join(t, "id", "left").select(F.col("id").alias("disease"), "drug")


@query(f", {_CAND} SELECT drug, covered, round(CAST(covered AS DOUBLE) / greatest(1, (SELECT count(*) FROM tgt)), 6) AS coverage FROM cpos")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    _, _, t, names = request(spark, d)
    return G.treatments(t, names).select("drug", "covered", F.round(F.col("covered") / max(1, len(names)), 6).alias("coverage"))


@query(f", {_TOP} SELECT size, covered, count(*) AS sets FROM sets WHERE size <= 2 GROUP BY size, covered")
def combinations_k2(spark: SparkSession, d: str) -> DataFrame:
    """How many of all sets of one or two candidates cover so many diseases."""
    _, _, t, names = request(spark, d)
    return C.set_counts(candidates_of(spark, t, names), 2)


@query(f", {_TOP} SELECT size, covered, count(*) AS sets FROM sets GROUP BY size, covered")
def combinations_k3(spark: SparkSession, d: str) -> DataFrame:
    """The same of up to three."""
    _, _, t, names = request(spark, d)
    return C.set_counts(candidates_of(spark, t, names), 3)


@query(f", {_TOP} SELECT set_id, drugs, size, covered FROM top")
def candidate_sets_topk(spark: SparkSession, d: str) -> DataFrame:
    return joined(top_sets(spark, d)[0]).drop("mask")


@query(f", {_TOP} SELECT set_id, rank FROM top")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return C.rank(top_sets(spark, d)[0]).select("set_id", "rank")


@query(f", {_TOP} SELECT set_id, disease AS uncovered FROM top JOIN tpos ON mask & (1 << bit) = 0")
def candidate_uncovered(spark: SparkSession, d: str) -> DataFrame:
    sets, _, names, _, _ = top_sets(spark, d)
    miss = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) == 0, F.lit(t)) for i, t in enumerate(names)]
    return sets.select("set_id", F.explode(F.filter(F.array(*miss), lambda x: x.isNotNull())).alias("uncovered"))


_PATHS = f"""{_NAMED}, paths AS (SELECT 'graph-path:' || substr(sha256('["graph","' || source || '","' || metaedge || '","' || target || '","1"]'), 1, 24) AS path_id, source AS drug,
  CASE metaedge WHEN 'ctd' THEN 'treatment' WHEN 'ccse' THEN 'side_effect_context' ELSE 'gene_context' END AS semantic, metaedge, target, target_name FROM named WHERE metaedge IN ('ctd', 'cdg', 'cug', 'cbg', 'ccse'))"""


@query(f", {_PATHS} SELECT * FROM paths")
def evidence_paths(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.evidence_paths(e, n)


def winners(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The best sets by member, and the paths of their members only: evidence is joined after the ranking."""
    sets, _, _, n, e = top_sets(spark, d)
    members = sets.select("set_id", F.explode("drugs").alias("drug"))
    drugs = F.broadcast(members.select("drug").distinct())  # at most 300 rows
    return members, G.evidence_paths(e.join(drugs, e["source"] == drugs["drug"], "left_semi"), n)


_MEM = f"{_TOP}, {_PATHS[len(_NAMED) + 2 :]}, mem AS (SELECT set_id, unnest(string_split(drugs, '+')) AS drug FROM top)"


@query(f", {_MEM} SELECT DISTINCT set_id, path_id FROM mem JOIN paths USING (drug)")
def set_path_union(spark: SparkSession, d: str) -> DataFrame:
    members, paths = winners(spark, d)
    return members.join(paths, "drug").select("set_id", "path_id").distinct()


@query(f", {_MEM} SELECT DISTINCT path_id, p.drug, semantic, target FROM paths p WHERE p.drug IN (SELECT drug FROM mem)")
def response_paths(spark: SparkSession, d: str) -> DataFrame:
    """The distinct paths of all winning sets."""
    _, paths = winners(spark, d)
    return paths.select("path_id", "drug", "semantic", "target").distinct()


@query(f", {_MEM} SELECT set_id, drug, semantic, count(*) AS paths FROM mem JOIN paths USING (drug) GROUP BY set_id, drug, semantic")
def member_evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    members, paths = winners(spark, d)
    return members.join(paths, "drug").groupBy("set_id", "drug", "semantic").agg(F.count(F.lit(1)).alias("paths"))


@query(f", {_MEM} SELECT set_id, semantic, count(*) AS n, min(target) AS first_target FROM mem JOIN paths USING (drug) GROUP BY set_id, semantic")
def explain_channels(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the winning sets by channel."""
    members, paths = winners(spark, d)
    return members.join(paths, "drug").groupBy("set_id", "semantic").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first_target"))


@query(f", {_TOP}, m AS (SELECT set_id, unnest(string_split(drugs, '+')) AS drug, generate_subscripts(string_split(drugs, '+'), 1) AS i FROM top WHERE size > 1) SELECT a.set_id, a.drug AS drug_a, b.drug AS drug_b FROM m a JOIN m b ON a.set_id = b.set_id AND a.i < b.i")
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs within each winning set."""
    top = top_sets(spark, d)[0].filter("size > 1")
    a = top.select("set_id", F.posexplode("drugs").alias("i", "drug_a"))
    b = top.select("set_id", F.posexplode("drugs").alias("j", "drug_b"))
    return a.join(b, "set_id").filter("i < j").select("set_id", "drug_a", "drug_b")


@query(f", {_TOP} SELECT rank, set_id FROM top WHERE rank > (SELECT 5 * (least(1000, greatest(1, ceil(max(rank) / 5.0))) - 1) FROM top)")
def page_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Page 1,000 of five a page, which is the last one there is."""
    return C.page(C.rank(top_sets(spark, d)[0]), 1000).select("rank", "set_id")


@query(f", {_TOP} SELECT set_id, rank, CASE WHEN covered = (SELECT count(*) FROM tgt) THEN 'full' ELSE 'part' END AS cover, size FROM top")
def comparison_view(spark: SparkSession, d: str) -> DataFrame:
    sets, _, names, _, _ = top_sets(spark, d)
    return C.rank(sets).select("set_id", "rank", F.when(F.col("covered") == len(names), "full").otherwise("part").alias("cover"), "size")


@query(f""", {_TOP} SELECT count(DISTINCT set_id) AS sets, count(DISTINCT CASE WHEN size = 2 THEN set_id END) AS pairs, count(DISTINCT drug) AS drugs, max(covered) AS best
FROM (SELECT top.*, unnest(string_split(drugs, '+')) AS drug FROM top)""")
def response_metrics(spark: SparkSession, d: str) -> DataFrame:
    top = top_sets(spark, d)[0]
    x = top.select("set_id", "size", "covered", F.explode("drugs").alias("drug"))
    return x.agg(F.countDistinct("set_id").alias("sets"), F.countDistinct(F.when(F.col("size") == 2, F.col("set_id"))).alias("pairs"), F.countDistinct("drug").alias("drugs"), F.max("covered").alias("best"))


_FIRST = "CASE semantic WHEN 'treatment' THEN 0 WHEN 'gene_context' THEN 1 ELSE 2 END"


@query(f""", {_MEM}, v AS (SELECT set_id, target, semantic, metaedge, drug, row_number() OVER (PARTITION BY set_id, semantic ORDER BY target, metaedge, drug) AS k FROM mem JOIN paths USING (drug)),
w AS (SELECT DISTINCT set_id, target, semantic FROM v WHERE k <= 10)
SELECT set_id, target, semantic, row_number() OVER (PARTITION BY set_id ORDER BY {_FIRST}, target) AS place FROM w QUALIFY place <= 30""")
def viz_nodes_edges(spark: SparkSession, d: str) -> DataFrame:
    """Up to ten nodes a channel for a drawing of each winning set, treatments first, then genes, then side effects; thirty in all."""
    members, paths = winners(spark, d)
    order = Window.partitionBy("set_id", "semantic").orderBy("target", "metaedge", "drug")
    few = members.join(paths, "drug").withColumn("k", F.row_number().over(order)).filter("k <= 10").select("set_id", "target", "semantic").distinct()
    first = F.when(F.col("semantic") == "treatment", 0).when(F.col("semantic") == "gene_context", 1).otherwise(2)
    return few.withColumn("place", F.row_number().over(Window.partitionBy("set_id").orderBy(first, "target"))).filter("place <= 30")


@query(f""", {_NAMED}, {_cand(1, "1")}, {_ranked("1")}, {_cand(2, "2")}, {_ranked("2")}
SELECT coalesce(a.set_id, b.set_id) AS set_id, a.rank AS old_rank, b.rank AS new_rank, CASE WHEN a.set_id IS NULL THEN 'added' WHEN b.set_id IS NULL THEN 'removed' WHEN a.rank <> b.rank THEN 'moved' ELSE 'same' END AS change FROM top1 a FULL JOIN top2 b ON a.set_id = b.set_id""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a second disease changes in the first hundred sets."""
    return C.compare_rankings(C.rank(top_sets(spark, d, 1)[0]), C.rank(top_sets(spark, d, 2)[0]))


@query(f""", {_CAND}, one AS (SELECT 0 AS step, drug, mask FROM cpos ORDER BY bit_count(mask) DESC, pos LIMIT 1),
two AS (SELECT 1 AS step, c.drug FROM cpos c, one o WHERE bit_count(o.mask) < 0.8 * (SELECT count(*) FROM tgt) AND bit_count(c.mask & ~o.mask) > 0 ORDER BY bit_count(c.mask & ~o.mask) DESC, c.pos LIMIT 1)
SELECT step, drug FROM one UNION ALL SELECT step, drug FROM two""")
def greedy_drug_cover(spark: SparkSession, d: str) -> DataFrame:
    _, _, t, names = request(spark, d)
    chosen = C.cover_by_classes(candidates_of(spark, t, names), len(names))
    return spark.createDataFrame([(i, x) for i, x in enumerate(chosen)], "step int, drug string")


_CHOSEN = f"""{_TOP}, n AS (SELECT count(*) AS n FROM tgt), s1 AS (SELECT * FROM top ORDER BY bit_count(mask) DESC, size, rank LIMIT 1),
s2 AS (SELECT t.* FROM top t, s1 WHERE bit_count(s1.mask) < 0.8 * (SELECT n FROM n) AND bit_count(t.mask & ~s1.mask) > 0 ORDER BY bit_count(t.mask & ~s1.mask) DESC, bit_count(t.mask) DESC, t.size, t.rank LIMIT 1),
chosen AS (SELECT 0 AS step, set_id, mask FROM s1 UNION ALL SELECT 1, set_id, mask FROM s2)"""


@query(f", {_CHOSEN} SELECT step, set_id FROM chosen")
def greedy_set_cover(spark: SparkSession, d: str) -> DataFrame:
    sets, _, names, _, _ = top_sets(spark, d)
    top = [(r["set_id"], r["drugs"], {t for i, t in enumerate(names) if r["mask"] >> i & 1}) for r in sets.collect()]  # 100 rows
    return spark.createDataFrame([(i, x) for i, x in enumerate(C.greedy_set_cover(top, names))], "step int, set_id string")


@query(f""", {_CHOSEN} SELECT disease AS target, EXISTS (SELECT 1 FROM chosen WHERE mask & (1 << bit) > 0) AS covered, CAST((SELECT count(*) FROM chosen) AS INT) AS sets,
CAST((SELECT bit_count(bit_or(mask)) FROM chosen) AS DOUBLE) / greatest(1, (SELECT n FROM n)) AS coverage FROM tpos""")
def optimizer_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the greedy selection of sets covers, in the order of the targets."""
    sets, _, names, _, _ = top_sets(spark, d)
    top = {r["set_id"]: r for r in sets.collect()}  # 100 rows
    cover = {s: {t for i, t in enumerate(names) if r["mask"] >> i & 1} for s, r in top.items()}
    chosen = C.greedy_set_cover([(s, r["drugs"], cover[s]) for s, r in top.items()], names)
    got = set().union(*[cover[s] for s in chosen]) if chosen else set()
    return spark.createDataFrame([(t, t in got, len(chosen), len(got) / max(1, len(names))) for t in names], "target string, covered boolean, sets int, coverage double")


@query(f"SELECT id, name FROM nodes WHERE lower(name || ' ' || id) LIKE '%{TERM}%' AND kind = 'disease'")
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).filter((F.col("kind") == "disease") & F.contains(F.lower(F.concat(F.col("name"), F.lit(" "), F.col("id"))), F.lit(TERM))).select("id", "name")


QUERIES = Q
