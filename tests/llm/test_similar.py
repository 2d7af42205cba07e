"""The set similarity join against all pairs, with every path of it forced."""

import itertools
import random

import pytest

from corvane.llm import similar


def brute(sets, t):
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if len(x & y) / len(x | y) >= t:
            out.add((a, b))
    return out


def made(seed, n=220, hot=0.9):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        if sets and rng.random() < 0.5:
            base = set(rng.choice(list(sets.values())))
            for _ in range(rng.randrange(4)):
                if base and rng.random() < 0.5:
                    base.discard(rng.choice(sorted(base)))
                else:
                    base.add(rng.randrange(400))
        else:
            base = {rng.randrange(400) for _ in range(min(int(rng.paretovariate(1.1)) + 1, 120))}
        if rng.random() < hot:
            base.add(1000)
        sets[f"s{i:03d}"] = base or {1}
    return sets


def rows_of(sets):
    return [(s, str(v % 7), str(v), "clash", "clash") for s, own in sets.items() for v in own]


SCHEMA = "source string, m string, t string, h string, id string"


def joined(spark, sets, t, extra=(), **kw):
    df = spark.createDataFrame(rows_of(sets) + list(extra), SCHEMA)
    pairs, members = similar.similar_sets(df, "source", ["m", "t"], t, **kw)
    return {tuple(r) for r in similar.expanded(pairs, members).collect()}, pairs, members


@pytest.mark.parametrize("seed,t,kw", [(1, 0.6, {}), (2, 0.6, {"fill": 0.05}), (3, 0.8, {}), (4, 0.35, {}), (5, 0.6, {"heavy": 12}), (6, 0.6, {"fill": 3.0})])
def test_against_all_pairs(spark, seed, t, kw):
    # fill 0.05: one segment a band, so that most sets must probe by values; heavy 12: large sets take their own join
    sets = made(seed)
    got, pairs, members = joined(spark, sets, t, **kw)
    assert got == brute(sets, t)
    assert all(r["source_a"] < r["source_b"] for r in pairs.collect())
    assert {r["source"] for r in members.collect()} == set(sets)


def test_many_copies_are_one_class(spark):
    sets = {f"c{i:03d}": {1, 2, 3} for i in range(120)} | {"x": {1, 2, 3, 4}, "y": {9}}
    got, pairs, members = joined(spark, sets, 0.6)
    assert got == brute(sets, 0.6) and pairs.count() == 1
    assert {r["class_source"] for r in members.filter("copies > 1").collect()} == {"c000"}


def test_large_by_repeated_rows_only(spark):
    sets = {"a": {1, 2, 3}, "b": {1, 2, 3, 4}, "c": {1, 2, 3}}
    extra = [("b", "1", "1", None, None)] * 40
    assert joined(spark, sets, 0.6, extra, heavy=12)[0] == brute(sets, 0.6)


def test_few_values_in_many_rows_are_no_large_set(spark):
    from corvane.session import Scratch

    rows = spark.createDataFrame(rows_of({"a": {1, 2}, "b": set(range(20))}) + [("a", "1", "1", None, None)] * 40, SCHEMA)
    large = similar.value_sets(rows, "source", ["m", "t"], Scratch(spark), 12)[2]
    assert [r["source"] for r in large.collect()] == ["b"]


def test_large_sets_with_empty_segments(spark):
    # heavy 1: all sets of two values or more take the join of large sets
    sets = {}
    for i in range(60):
        k = 100 * i
        sets |= {f"a{i:02d}": {k, k + 1}, f"b{i:02d}": {k, k + 1, k + 2}, f"c{i:02d}": {k + 10, k + 11, k + 12}, f"d{i:02d}": {k + x for x in range(10, 15)}}
    assert joined(spark, sets, 0.6, heavy=1)[0] == brute(sets, 0.6)


def test_odd_rows(spark):
    assert joined(spark, {}, 0.6)[0] == set()
    extra = [(None, "1", "1", None, None), ("a", "1", "1", None, None), ("a", "1", "1", None, None), ("b", "1", "1", None, None), ("b", None, "2", None, None), ("q", "2", None, None, None)]
    assert joined(spark, {"z": {7}}, 0.6, extra)[0] == {("a", "b")}


def test_bounds():
    for t in (0.5, 0.6, 0.8):
        for a in range(1, 40):
            for b in range(a, 70):
                most = max((a + b - 2 * o for o in range(a + 1) if o / (a + b - o) >= t), default=-1)
                assert similar.differ(t, a, b) == most


def test_sources_registered(spark, data):
    from compare import compare

    import __spark_entry__ as entry

    assert compare(spark, data, ["p1_found"], entry.queries(), entry.oracle_sql()) == []
