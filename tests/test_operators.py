"""Operators on literal rows: candidates, covers, pairs, metrics, sources, models, streams."""

import gzip
import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.names import normal_name
from corvane.functions.ordered import rank_by_digest, running_sum
from corvane.functions.text import bare, is_blank, mask, search_term, valid_drug_id
from corvane.operators import candidates as C, features as X, graph as G, metrics as M, models as L, pairs as P
from corvane.session import Scratch, attach
from corvane.sources import files, graph as S


def test_text(spark):
    rows = [(None,), ("",), (" \t\r\n",), ("DD-Inter 12.",), ("DDInter",), ("ddinter7x",), ("Ünï-Code 9",)]
    df = spark.createDataFrame(rows, "s string").select("s", is_blank("s").alias("b"), bare("s").alias("k"), valid_drug_id("s").alias("v"), mask("s").alias("m"))
    got = [tuple(r)[1:] for r in df.collect()]
    assert [g[0] for g in got] == [True, True, True, False, False, False, False]
    assert [g[1] for g in got] == ["", "", "", "ddinter12", "ddinter", "ddinter7x", "ünïcode9"]
    assert [g[2] for g in got] == [False, False, False, True, False, False, False]
    assert got[6][3] == "Aa-Aa 9"
    assert spark.range(1).select(search_term(F.lit("  Type_2--X ")).alias("x")).first()["x"] == "type 2 x"


def test_normal_name(spark):
    df = spark.createDataFrame([("Straße  ﬁ ",), (" Plain  Name ",), (None,)], "s string").select(normal_name(F.col("s")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["strasse fi", "plain name", None]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_is_a_join(spark, how):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(400)}") for i in range(3000)] + [(9999, None), (9998, "none")]
    df = spark.createDataFrame(rows, "value long, k string")
    groups = df.filter("k is not null and k <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    got = attach(df, groups, ["k"], "n", how, share=20)
    want = df.join(groups, "k", how).select(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_sum_and_rank(spark):
    rows = [(k, float(v), 1 + v % 3) for k in "ab" for v in random.Random(1).sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    for descending in (False, True):
        got = {(r["k"], r["v"]): r["s"] for r in running_sum(df, ["k"], "v", "n", "s", descending).collect()}
        for k in "ab":
            total = 0
            for _, v, n in sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=descending):
                total += n
                assert got[k, v] == total
    ranked = rank_by_digest(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "id", "place").collect()
    for k in "ab":
        own = sorted((r for r in ranked if r["k"] == k), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, 301))
        d = [(hashlib.md5(str(r["id"]).encode()).hexdigest(), r["id"]) for r in own]
        assert d == sorted(d)
    assert running_sum(df.limit(0), ["k"], "v", "n", "s").count() == 0


def candidates(spark, sets):
    rows = [(i + 1, name, sorted(own)) for i, (name, own) in enumerate(sets)]
    return spark.createDataFrame(rows, "pos int, drug string, disease_ids array<string>")


@pytest.mark.parametrize("seed", range(3))
def test_combinations_against_brute_force(spark, seed):
    rng = random.Random(seed)
    targets = ["t0", "t1", "t2"]
    sets = [(f"d{i}", {t for t in targets if rng.random() < 0.5}) for i in range(7)]
    got = {r["set_id"]: (r["size"], r["covered"]) for r in C.combinations(candidates(spark, sets), targets, 3).collect()}
    want = {}
    for k in (1, 2, 3):
        for combo in itertools.combinations(sets, k):
            want["candidate-set:" + "+".join(n for n, _ in combo)] = (k, len(set().union(*[s for _, s in combo])))
    assert got == want


def test_budget():
    assert C.check_budget(114, 3) == 247_019
    with pytest.raises(ValueError):
        C.check_budget(115, 3)


def test_greedy_covers():
    sets = [("a", {"1"}), ("b", {"1", "2"}), ("c", {"3"}), ("d", {"3"})]
    assert C.greedy_cover(sets, ["1", "2", "3"], least=1.0) == ["b", "c"]
    assert C.greedy_cover(sets, ["1", "2", "3"], max_members=1, least=1.0) == ["b"]
    assert C.greedy_cover(sets, ["9"], least=1.0) == [] and C.greedy_cover([], ["1"]) == []
    wide = [("x", ["a", "b", "c"], {"1", "2", "3"}), ("y", ["a"], {"1"}), ("z", ["b"], {"2"})]
    assert C.greedy_set_cover(wide, ["1", "2", "3"], max_drugs=2, least=1.0) == ["y", "z"]
    assert C.greedy_set_cover(wide, ["1", "2", "3"], max_drugs=3, least=1.0) == ["x"]


def test_path_id(spark):
    text = json.dumps(["g", "Compound::1", "ctd", "Disease::2", "1"], separators=(",", ":"))
    want = "graph-path:" + hashlib.sha256(text.encode()).hexdigest()[:24]
    assert spark.range(1).select(G.path_id(F.lit("Compound::1"), F.lit("ctd"), F.lit("Disease::2"), "g", "1").alias("p")).first()["p"] == want


def test_search_and_resolve(spark):
    n = spark.createDataFrame([("D1", "gout", "disease"), ("D2", "gouty arthritis", "disease"), ("D3", "not gout", "disease"), ("D4", None, "disease"), ("C1", "gout", "compound")], "id string, name string, kind string")
    assert [(r["id"], r["relevance"]) for r in G.search(n, "disease", "Gout").collect()] == [("D1", 0), ("D2", 1), ("D3", 2)]
    assert G.search(n, "disease", "d2").first()["relevance"] == 3
    terms = spark.createDataFrame([(0, "GOUT"), (1, "d1"), (2, "x"), (3, "D3")], "pos int, term string")
    got = sorted((r["pos"], r["id"]) for r in G.resolve(terms, n.filter("kind = 'disease'")).collect())
    assert got == [(0, "D1"), (2, None), (3, "D3")]


EDGES = [("Compound::1", "cbg", "Gene::1"), ("Compound::2", "cbg", "Gene::1"), ("Compound::1", "crc", "Compound::2"), ("Compound::1", "cbg", "Gene::1"), ("Class::1", "pcic", "Compound::2"), ("Compound::1", "cug", "Gene::1"), ("Compound::1", "crc", "Compound::1")]


@pytest.mark.parametrize("seed", range(3))
def test_first_sets_and_counts_against_all_sets(spark, seed):
    from itertools import combinations

    rng = random.Random(seed)
    rows = [(i + 1, f"c{rng.randrange(1000)}x{i}", rng.choice([1, 2, 4, 3, 7] if seed else [1, 2])) for i in range(22)]
    df = spark.createDataFrame(rows, "pos long, drug string, mask long")
    every = []
    for k in (1, 2, 3):
        for c in combinations(rows, k):
            mask = c[0][2] | c[-1][2] | c[len(c) // 2][2]
            every.append((-mask.bit_count(), k, "candidate-set:" + "+".join(x[1] for x in c)))
    for n in (1, 7, 100, 5000):
        got = [(-r["covered"], r["size"], r["set_id"]) for r in C.best_sets(C.first_sets(df, 3, n), n).collect()]
        assert got == sorted(every)[:n]
    counts = {}
    for c, k, _ in every:
        counts[k, -c] = counts.get((k, -c), 0) + 1
    assert {(r["size"], r["covered"]): r["sets"] for r in C.set_counts(df, 3).collect()} == counts


def test_sets_of_nothing(spark):
    df = spark.createDataFrame([], "pos long, drug string, mask long")
    assert C.first_sets(df, 3).count() == 0 and C.set_counts(df, 3).count() == 0 and C.cover_by_classes(df, 3) == []


def test_cover_by_classes_is_the_greedy_cover(spark):
    rng = random.Random(4)
    rows = [(i + 1, f"c{i}", rng.randrange(1, 64)) for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, drug string, mask long")
    plain = C.greedy_cover([(d, {f"{i}" for i in range(6) if m >> i & 1}) for _, d, m in rows], [f"{i}" for i in range(6)], least=1.0)
    assert C.cover_by_classes(df, 6, least=1.0) == plain


def test_pages_are_clamped(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("rank"))
    of = lambda k: sorted(r["rank"] for r in C.page(df, k).collect())
    assert (of(2), of(99), of(-1)) == ([6, 7, 8, 9, 10], [11, 12], [1, 2, 3, 4, 5]) and C.page(df.limit(0), 1).count() == 0


def test_settings_have_defaults_and_limits():
    assert C.settings() == {"max_drugs": 3, "max_sets": 100, "coverage": 0.8}
    assert C.settings(0, -5, 7) == {"max_drugs": 1, "max_sets": 1, "coverage": 1.0} and C.settings(True, "x", float("nan"))["coverage"] == 0.8


def test_rankings_are_compared(spark):
    a, b = (spark.createDataFrame(x, "set_id string, rank int") for x in ([("a", 1), ("b", 2), ("c", 3)], [("a", 1), ("c", 2), ("d", 3)]))
    assert {r["set_id"]: r["change"] for r in C.compare_rankings(a, b).collect()} == {"a": "same", "b": "removed", "c": "moved", "d": "added"}


def test_small_functions(spark):
    assert files.without_keys({"a": 1, "b": [{"a": 2, "c": {"a": 3}}]}, {"a"}) == {"b": [{"c": {}}]} and files.without_keys(None, {"a"}) is None
    assert files.digest_id("model", {"a": 1, "b": 2}) == files.digest_id("model", {"b": 2, "a": 1}) != files.digest_id("model", {"a": 1})
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("",)], "s string").select(files.number("s").alias("n"))
    assert [r["n"] for r in df.collect()] == [1.5, None, None, None]


def test_unexpected_levels_are_refused(spark):
    df = spark.createDataFrame([("Major",), (" ",), (None,), ("Severe",)], "Level string")
    with pytest.raises(ValueError, match="severe"):
        P.require_levels(df)
    assert P.require_levels(df.filter("Level <> 'Severe'")).count() == 2


def test_mapping_is_validated(spark):
    df = spark.createDataFrame([("D1", "Exact_unique", None, "C", None), ("", "unmapped", None, None, None)], "ddinter_id string, mapping_status string, pubchem_cid long, smiles string, inchikey string")
    got = {r["check_name"]: r["violations"] for r in P.validate_mapping(df).collect()}
    assert got == {"accepted_without_cid": 1, "accepted_without_structure": 0, "accepted_without_key": 1, "blank_id": 1}
    with pytest.raises(ValueError, match="smiles"):
        P.validate_mapping(df.drop("smiles"))


def test_compatibility_forms_and_full_folding_are_mapped(spark):
    drugs = spark.createDataFrame([("d1", "Stra\u00dfen\u00a0Mix"), ("d2", "\uff21lpha")], "id string, name string")
    nodes = spark.createDataFrame([("c1", "strassen mix"), ("c2", "alpha")], "id string, name string")
    assert {r["id"]: r["compound"] for r in P.map_names(drugs, nodes).collect()} == {"d1": "c1", "d2": "c2"}


def test_compound_features(spark):
    e = spark.createDataFrame(EDGES, "source string, metaedge string, target string")
    got = {r["compound"]: r for r in X.compound_features(e).collect()}
    one, two = got["Compound::1"], got["Compound::2"]
    assert (one["degree"], one["bound_gene"], one["gene"], one["resemblance"]) == (5, 1, 1, 2)  # a loop counts once, a repeated row twice
    assert (two["degree"], two["pharmacologic_class"], two["resemblance"]) == (3, 1, 1)
    p = spark.createDataFrame([("Compound::1", "Compound::2"), ("Compound::2", "Compound::9")], "a string, b string")
    p = p.unionByName(spark.createDataFrame([(None, "Compound::1"), (None, None)], "a string, b string"))
    m = {(r["a"], r["b"]): r for r in X.graph_pair_features(p, e, Scratch(spark)).collect()}
    both, one, none = m["Compound::1", "Compound::2"], m["Compound::2", "Compound::9"], m[None, None]
    assert (both["bound_gene_jaccard"], both["gene_union_count"], both["side_effect_jaccard"], both["graph_graph_degree_mean"]) == (1.0, 1.0, 0.0, 4.0)
    assert (both["hetionet_available_count"], one["hetionet_available_count"], m[None, "Compound::1"]["hetionet_available_count"], none["hetionet_available_count"]) == (2, 1, 1, 0)
    assert one["bound_gene_jaccard"] is None and one["graph_graph_degree_mean"] is None and one["both_hetionet_available"] == 0
    joined = X.with_pair_features(p.withColumn("x", F.lit(1)), ("a", "b"), X.graph_pair_features(p, e, Scratch(spark)))
    assert joined.count() == 4 and joined.filter("hetionet_available_count is null").count() == 0


def test_exact_quantiles(spark):
    values = [random.Random(5).randrange(50) for _ in range(101)]
    h = spark.createDataFrame([(0, float(v)) for v in values], "k int, num double").groupBy("k", "num").agg(F.count(F.lit(1)).alias("n"))
    got = X.exact_quantiles(h, ["k"], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    s = sorted(values)
    assert (got["a"], got["b"], got["c"]) == (s[25], s[50], s[90])


# the confusion matrix and metrics that the reference publishes for its final model
MATRIX = {("Major", "Major"): 1312, ("Major", "Moderate"): 4067, ("Major", "Minor"): 4, ("Moderate", "Major"): 356, ("Moderate", "Moderate"): 18949, ("Moderate", "Minor"): 30, ("Minor", "Major"): 25, ("Minor", "Moderate"): 1065, ("Minor", "Minor"): 277}


def test_published_metrics(spark):
    rows = spark.createDataFrame([(t, p, n) for (t, p), n in MATRIX.items()], "truth string, predicted string, n int").select("truth", "predicted", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    classes = M.per_class(rows, ["Major", "Moderate", "Minor"])
    f1 = {r["class"]: round(r["f1"], 6) for r in classes.collect()}
    assert f1 == {"Major": 0.370831, "Moderate": 0.872904, "Minor": 0.330155}
    s = M.summary(classes).first()
    assert [round(s[k], 6) for k in ("macro_f1", "accuracy", "balanced_accuracy", "weighted_f1")] == [0.524630, 0.787349, 0.475467, 0.740851]


def test_auroc_and_precision_with_ties(spark):
    rows = [("c", 1, 0.9), ("c", 0, 0.9), ("c", 1, 0.5), ("c", 0, 0.1)]
    df = spark.createDataFrame(rows, "class string, positive int, score double")
    assert M.auroc(df).first()["auroc"] == pytest.approx(0.625)
    assert M.average_precision(df).first()["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


PAIRS = "row_id long, DDInterID_A string, DDInterID_B string, Drug_A string, Drug_B string, Level string, source_file string, atc_category string"


def test_pairs(spark):
    rows = [(1, "DDInter2", "DDInter1", "B", "A", "Major", "f2", "X"), (2, "DDInter1", "DDInter2", "A", "B", "major", "f1", "Y"), (3, "DDInter3", "DDInter1", "C", "A", "Unknown", "f1", None), (4, "DDInter1", "DDInter3", "A", "C", "Minor", "f1", None), (5, None, "DDInter1", "C", "A", "Minor", None, None)]
    p = P.canonical(spark.createDataFrame(rows, PAIRS))
    facts = {r["pair_id"]: r for r in P.pair_facts(p).collect()}
    assert facts["ddinter1|ddinter2"]["orders"] == 2 and facts["ddinter1|ddinter2"]["labels"] == 1
    assert facts["ddinter1|ddinter3"]["labels"] == 2  # unknown conflicts with a label
    d = P.deduplicated(p).collect()
    assert [(r["pair_id"], r["row_id"], r["source_files"], r["categories"]) for r in d] == [("ddinter1|ddinter2", 2, "f1;f2", "X;Y")]
    e = P.exact_repeats(p).first()
    assert (e["rows"], e["distinct_rows"], e["repeats"]) == (4, 3, 1)


def test_splits(spark):
    rows = [(i, c) for i, c in enumerate(c for c in ("Major", "Moderate", "Minor") for _ in range(20))]
    df = spark.createDataFrame(rows, "row_id long, label string")
    n = {(r["label"], r["split"]): r["count"] for r in P.stratified(df, "label", "row_id").groupBy("label", "split").count().collect()}
    assert all(n[c, "test"] == 4 and n[c, "train"] == 16 for c in ("Major", "Moderate", "Minor"))
    assert {r["count"] for r in P.folds(df, "label", "row_id").groupBy("label", "fold").count().collect()} == {4}


def test_file_sources(spark, tmp_path):
    text = "DDInterID_A,Drug_A,DDInterID_B,Drug_B,Level\nDDInter1,A,DDInter2,B,Major\nDDInter1,,DDInter3,C,Minor\n"
    (tmp_path / "ddinter_downloads_code_B.csv").write_text(text)
    digest = hashlib.sha256(text.encode()).hexdigest()
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "x", "download_page": "p", "license": "l", "retrieved_at": "t", "files": {"ddinter_downloads_code_B.csv": digest}}))
    good, bad = files.pair_files(spark, str(tmp_path), str(tmp_path / "m.json"))
    assert good.count() == 1 and bad.count() == 1 and good.first()["atc_category"] == "B"
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "x", "download_page": "p", "license": "l", "retrieved_at": "t", "files": {"ddinter_downloads_code_B.csv": "0"}}))
    with pytest.raises(ValueError):
        files.pair_files(spark, str(tmp_path), str(tmp_path / "m.json"))
    (tmp_path / "m.json").write_text("{}")
    with pytest.raises(ValueError):
        files.manifest(str(tmp_path / "m.json"))
    with gzip.open(tmp_path / "e.tsv.gz", "wt") as f:
        f.write("source\tmetaedge\ttarget\na\tCtD\tb\n")
    assert files.edge_file(spark, str(tmp_path / "e.tsv.gz"), 2).count() == 1
    (tmp_path / "n.tsv").write_text("id\tname\tkind\n1\ta\tx\n1\tb\tx\n")
    assert [tuple(r) for r in files.node_file(spark, str(tmp_path / "n.tsv")).collect()] == [("1", "b", "x")]


def test_cache_and_reports(spark, tmp_path):
    lines = [{"ddinter_id": "a", "http_status": 500}, {"ddinter_id": "a", "http_status": 200}, {"ddinter_id": "b", "http_status": 503}]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    cache = files.query_cache(spark, str(tmp_path / "c.jsonl"), "ddinter_id string, http_status int")
    assert {r["ddinter_id"]: r["http_status"] for r in cache.collect()} == {"a": 200, "b": 503}
    drugs = spark.createDataFrame([("a",), ("b",), ("c",)], "ddinter_id string")
    assert sorted(r[0] for r in files.pending(drugs, cache).collect()) == ["b", "c"]
    new = spark.createDataFrame([("b", 200), ("c", 404)], "ddinter_id string, http_status int")
    assert [tuple(r) for r in files.merge_cache(cache, new).collect()] == [("a", 200), ("b", 200), ("c", 404)]
    files.write_json_report({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]
    files.append_lines(new, str(tmp_path / "lines"))
    files.append_lines(new, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    assert files.text_sha256("a\r\nb") == files.text_sha256("a\nb")
    text = "# T\n| a | b |\n|---|---|\n| `x` | 1 |\n| y | 2 |\n\n| z |\n# U\nend"
    assert files.markdown_table(text, "| a |") == [["x", "1"], ["y", "2"]]
    assert files.markdown_section(text, "# U", "# V") == "end" and files.markdown_section(text, "# W", "#") == ""


def test_graph_sources(spark, tmp_path):
    n = spark.createDataFrame([("1", "a", "x"), ("1", "a", "x"), ("2", "b", "x")], "id string, name string, kind string")
    e = spark.createDataFrame([("1", "m", "2"), ("1", "m", "2"), ("1", "m", "3")], "source string, metaedge string, target string")
    nodes, edges, counts = files.strict_graph(n, e)
    assert counts == {"nodes": 2, "edges": 2}
    assert S.complete_edges(edges, nodes).count() == 1
    with pytest.raises(ValueError):
        files.strict_graph(n, e.unionByName(spark.createDataFrame([("", "m", "2")], e.schema)))
    S.save_graph(nodes, edges, str(tmp_path / "g"))
    plan = spark.read.parquet(str(tmp_path / "g/edges")).filter("metaedge = 'm'")
    assert plan.count() == 2 and "PartitionFilters: [isnotnull(metaedge" in plan._jdf.queryExecution().toString()


def test_models_refuse_what_changed(spark, data, tmp_path):
    from corvane.plans import model_queries as Q
    from corvane.sources.tables import FEATURES

    model, s, test = Q.trained(spark, data, "logistic")
    L.save(model, s, str(tmp_path / "m"))
    with pytest.raises(FileExistsError):
        L.save(model, s, str(tmp_path / "m"))
    again, scale = L.load(str(tmp_path / "m"), FEATURES)
    assert scale == {k: tuple(v) for k, v in s.items()}
    a, b = (L.predicted(m, test).select("row_id", "predicted").orderBy("row_id").collect() for m in (model, again))
    assert a == b
    with pytest.raises(ValueError):
        L.load(str(tmp_path / "m"), FEATURES[::-1])
    (tmp_path / "m/scale.json").write_text("{}")
    with pytest.raises(ValueError):
        L.load(str(tmp_path / "m"), FEATURES)


def test_stream_of_windows(spark, data, tmp_path):
    from corvane.sources.tables import table
    from corvane.streaming.windows import stream_of, window_counts

    events = table(spark, data, "events")
    for i in range(2):
        events.filter(F.col("event_id") % 2 == i).write.mode("append").parquet(str(tmp_path / "in"))
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes).replace("timestamp_ntz", "timestamp")
    got = window_counts(stream_of(spark, str(tmp_path / "in"), schema, 1), "1 day", 6)
    q = got.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("requests")).first()[0] == events.count()
    assert spark.table("w").count() == window_counts(events, "1 day", 6).count()


def test_fetch_by_name(spark):
    from corvane.sources.remote import fetch, lookup_path

    def ask(name):
        if name == "down":
            raise OSError("no route")
        return {"ok": (200, [{"CID": 1}]), "none": (404, []), "busy": (503, [])}[name]

    drugs = spark.createDataFrame([(n, None if n == "null" else n) for n in ("ok", "none", "busy", "down", "null")], "ddinter_id string, ddinter_name string")
    got = {r["ddinter_id"]: r for r in fetch(drugs, ask, 2, 0.0, 2, lambda s: None).collect()}
    assert {k: r["http_status"] for k, r in got.items()} == {"ok": 200, "none": 404, "busy": 503, "down": 0, "null": 404}
    assert json.loads(got["ok"]["properties"]) == [{"CID": 1}] and "no route" in got["down"]["error"]
    assert drugs.limit(1).select(lookup_path(F.lit("a b/c"))).first()[0] == "a%20b%2Fc"


def test_request():
    assert G.request([" a ", "", None, "b", "a"]) == ["a", "b"]
    for bad in ([], [" "], [str(i) for i in range(11)], ["x" * 201]):
        with pytest.raises(ValueError):
            G.request(bad)


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a")], "id int, c string")
    assert [tuple(r) for r in X.one_hot(df, "id", "c").orderBy("id").collect()] == [(1, 0, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0)]
    assert X.one_hot(df.limit(0), "id", "c").columns == ["id"]
    with pytest.raises(ValueError):
        X.one_hot(df, "id", "c", 1)
