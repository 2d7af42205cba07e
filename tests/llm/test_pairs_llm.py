"""Duplicates by formatting, survivors, and splits: against plain versions, and on odd rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.llm import formatting, splits, survivors
from corvane.session import Scratch

# --- formatting ---------------------------------------------------------------------------------------------------------


def collapse(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, k string, h string, row string, n int")  # h, row, n: names the operator uses itself
    groups, members = formatting.collapse(df, "id", [F.col("k")], **kw)
    return sorted((r["group_id"], r["copies"]) for r in groups.collect()), sorted((r["row_id"], r["group_id"]) for r in members.collect())


def test_ranges_of_filters_shuffle_no_more(spark):
    df = spark.range(20_000).select((F.col("id") % 19_000).cast("string").alias("k0")).withColumn("h", F.xxhash64("k0"))
    maybe, alone = formatting.split_by_repeats(df, formatting.filter_bits(20_000))
    assert maybe.count() + alone.count() == 20_000 and 2_000 <= maybe.count() < 2_600
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 19_000).cast("string").alias("k"))
    groups, members = formatting.collapse(rows, "row_id", [F.col("k")], max_bits=1 << 14)
    assert groups.count() == 19_000 and members.count() == 2_000 and groups.filter("copies = 2").count() == 1_000


@pytest.mark.parametrize("max_bits", [1 << 29, 1 << 13])  # the second takes ranges
def test_collapse_against_a_dict(spark, max_bits):
    rng = random.Random(1)
    keys = ["hot" if rng.random() < 0.4 else f"k{rng.randrange(4000)}" for _ in range(5000)]
    rows = [(i, k, "x", "y", 1) for i, k in enumerate(keys)]
    want = {}
    for i, k in enumerate(keys):
        want.setdefault(k, []).append(i)
    groups, members = collapse(spark, rows, max_bits=max_bits)
    assert groups == sorted((min(v), len(v)) for v in want.values())
    assert members == sorted((i, min(v)) for v in want.values() if len(v) > 1 for i in v)


def test_collapse_of_odd_rows(spark):
    assert collapse(spark, []) == ([], [])
    long = "x" * 300_000
    groups, members = collapse(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, long, None, None, None), (4, long, None, None, None), (5, "a", None, None, None)])
    assert groups == [(1, 2), (3, 2), (5, 1)] and members == [(1, 1), (2, 1), (3, 3), (4, 3)]


# --- survivors ----------------------------------------------------------------------------------------------------------

SCHEMA = "row_id long, g string, has_a boolean, has_b boolean, at timestamp, trust int, best string, cells int"
T = datetime(2025, 1, 1)


def day(n):
    return None if n is None else T.replace(day=n)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = survivors.survivors(df, ["g"], "row_id", {"a": F.col("has_a"), "b": F.col("has_b")}, "at", F.col("trust"), **kw)
    return {r["g"]: r for r in got.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_fields_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"g{rng.randrange(40)}", rng.random() < 0.5, rng.choice([True, False, None]), day(rng.choice([None, 1, 2, 3])), 0, "z", 0) for i in range(600)]
    got = run(spark, rows, policy=("recency",))
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        for name, k in (("a", 2), ("b", 3)):
            use = [r for r in own if r[k]]
            want = min(use, key=lambda r: (-(r[4] or datetime(1, 1, 1)).toordinal(), r[0]))[0] if use else None
            assert got[g][f"{name}_row_id"] == want
        assert got[g]["copies"] == len(own) and got[g]["group_row_id"] == min(r[0] for r in own)


def layers(own):
    """Layer of each record by peeling, on completeness, recency and trust."""
    left, at, out = list(own), 0, {}
    dims = lambda r: (bool(r[2]) + bool(r[3]), r[4] or datetime(1, 1, 1), r[5])
    while left:
        at += 1
        top = [r for r in left if not any(all(x >= y for x, y in zip(dims(o), dims(r))) and dims(o) != dims(r) for o in left)]
        for r in top:
            out[r[0]] = at
        left = [r for r in left if r not in top]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_layer_leads(spark, seed):
    rng = random.Random(10 + seed)
    rows = [(i, f"g{rng.randrange(25)}", rng.random() < 0.6, rng.random() < 0.4, day(rng.randrange(1, 6)), rng.randrange(3), "z", 0) for i in range(200)]
    got = run(spark, rows, policy=("completeness", "recency", "trust"), by="layer")
    for g in got:
        own = [r for r in rows if r[1] == g]
        at = layers(own)
        full = [r for r in own if at[r[0]] == 1 and r[2]]
        if full:  # a value of the first skyline is taken before any other
            assert at[got[g]["a_row_id"]] == 1
        assert (got[g]["a_row_id"] is None) == (not any(r[2] for r in own))


def test_odd_groups(spark):
    assert run(spark, []) == {}
    rows = [(1, None, True, None, None, 0, None, None), (2, None, None, None, None, 0, None, None), (3, "alone", True, True, T, 0, None, None), (4, "t", True, True, T, 0, None, None), (4, "t", True, True, T, 0, None, None)]
    got = run(spark, rows, policy=("recency",))
    assert set(got) == {None, "t"} and got[None]["a_row_id"] == 1 and got[None]["b_row_id"] is None and got["t"]["a_row_id"] == 4
    assert "alone" in run(spark, rows, policy=("recency",), single=True)


# --- splits -------------------------------------------------------------------------------------------------------------


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def union(edges):
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(5)
    edges = {"random": [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(260)], "path": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)], "star": [("hub", f"n{i}") for i in range(300)], "none": []}[kind]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["node"]: r["component"] for r in splits.components(df, Scratch(spark)).collect()}
    assert got == union(edges)


def tied(spark, rows, held):
    df = spark.createDataFrame(rows, "row_id long, a string, b string, x string, node string, component string")
    t, g = splits.tied_rows(df, "row_id", ["a", "b"], spark.createDataFrame(held, "h string"), s := Scratch(spark))
    return s.keep(t), g


def test_groups_stay_together_and_shares_hold(spark):
    rng = random.Random(9)
    rows = [(i, f"D{rng.randrange(900)}", " d7" if rng.random() < 0.1 else f"D{rng.randrange(900)}", None, None, None) for i in range(6000)]
    held = [(f" d{i} ",) for i in range(0, 60)] + [(None,), (" ",), ("D7",), ("nobody",)]
    t, g = tied(spark, rows, held)
    split = {r["row"]: r["split"] for r in splits.assign(t, g, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert len(split) == 6000
    comp = {r["row"]: r["component"] for r in t.collect()}
    for c in {c for c in comp.values() if c}:
        assert len({split[r] for r in comp if comp[r] == c}) == 1
    share = {s: sum(v == s for v in split.values()) / 6000 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    ids = {f"d{i}" for i in range(60)}
    edges = [[x for x in (r[1].strip().lower(), r[2].strip().lower()) if x in ids] for r in rows]
    want = union([(e[0], e[-1]) for e in edges if e])
    least = {}
    for r, e in zip(rows, edges):
        if e:
            least.setdefault(want[e[0]], r[0])
            assert comp[r[0]] == want[e[0]]
        else:
            assert comp[r[0]] is None
    assert {r["component"]: r["group_row_id"] for r in g.collect()} == least


def test_odd_ties(spark):
    t, g = tied(spark, [], [("d1",)])
    assert t.count() == 0 and splits.assign(t, g, {"train": 0.8, "test": 0.2}).count() == 0
    t, g = tied(spark, [(1, None, None, None, None, None), (2, "d1", "D1 ", None, None, None), (3, "", "d1", None, None, None), (4, "d2", "d3", None, None, None)], [("d1",), ("D1",), ("d9",)])
    assert {r["row"]: r["component"] for r in t.collect()} == {1: None, 2: "d1", 3: "d1", 4: None}
    assert [(r["group_row_id"], r["size"]) for r in g.collect()] == [(2, 2)]
    t, g = tied(spark, [(1, "d1", None, None, None, None)], [])
    assert [r["component"] for r in t.collect()] == [None]
