"""Profiles and rejected lines on literal rows, and against a plain parser."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.quality import profile as P, rejects as R


def parse(line):
    """A sign-by-sign reading of a line: (reason or None, fields)."""
    s = (line or "").removesuffix("\r")
    fields, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            out, i = "", i + 1
            while True:
                if i >= len(s):
                    return "quoting", []
                if s[i] == '"':
                    if i + 1 < len(s) and s[i + 1] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + s[i], i + 1
            if i < len(s) and s[i] != ",":
                return "quoting", []
            fields.append(out)
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            if '"' in s[i:j]:
                return "quoting", []
            fields.append(s[i:j])
            i = j
        if i >= len(s):
            break
        i += 1
    return (None if len(fields) == 5 else "column_count"), fields


CASES = ["a,b,c,d,e", "", None, "a,b,c,d,e\r", 'a,"b,x",c,d,e', 'a,"b""x",c,d,e', 'a,"b,c,d,e', 'a,b",c,d,e', 'a,"b"x,c,d,e', '"a","b\nc","c","d","e"\r', ",,,,", '"","","","",""', 'a,b,c,d', 'a,b,c,d,e,', '""""', '"a""",b,c,d,e', 'ä,"ö,ü",ß,€,😀', '"', '""', 'x""y,b,c,d,e', 'a,b,c,d,"e"\r\r']


def index(lines):
    fields, broken, width = R.index_lines(pa.array(lines, pa.string()), 5)
    return [("quoting" if b else "column_count" if w != 5 else None, [] if b or w != 5 else [f[i].as_py() for f in fields]) for i, (b, w) in enumerate(zip(broken, width))]


def test_index_of_cases():
    for line, got in zip(CASES, index(CASES)):
        why, fields = parse(line)
        assert got == (why, fields if why is None else []), line


def test_index_of_random_lines():
    rng = random.Random(7)
    lines = ["".join(rng.choice('ab",\r\n "",é') for _ in range(rng.randrange(14))) for _ in range(4000)]
    for line, got in zip(lines, index(lines)):
        why, fields = parse(line)
        assert got == (why, fields if why is None else []), repr(line)


def test_index_of_nothing():
    assert index([]) == []


SCHEMA = "row_id long, DDInterID_A string, DDInterID_B string, Drug_A string, Drug_B string, Level string, source_file string, reason string"


def test_reasons_come_in_order(spark):
    good = "ddinter_downloads_code_A.csv"
    rows = [(1, "DDInter1", "DDInter2", "a", "b", "Major", good), (2, None, "x", "a", "b", "?", None), (3, "DDInter", "DDInter2", "a", "b", "?", None), (4, "ddinter-1", "DDInter2", "a", "b", "severe", None), (5, "DDInter1", "DDInter2", "a", "b", " unknown\t", None), (6, "DDInter1", "DDInter2", "a", " \r\n", "Major", good), (7, "DDInter1", "DDInter2", "a", "b", "MINOR", " DDINTER_downloads_code_v.CSV ")]
    df = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).withColumn("reason", F.lit("clash"))
    got = {r["row_id"]: r["reason"] for r in R.check_rows(df).collect()}
    assert got == {1: None, 2: "missing_value", 3: "invalid_id", 4: "invalid_level", 5: "invalid_source_file", 6: "missing_value", 7: None}


def test_empty_lines(spark):
    df = spark.createDataFrame([], "line_id long, source_file string, raw_line string, loaded_at timestamp_ntz, extra int")
    assert R.load_lines(df).count() == 0


def test_long_line(spark):
    df = spark.createDataFrame([(1, None, '"' + "x," * 200_000 + '",b,c,d,e', None)], "line_id long, source_file string, raw_line string, loaded_at timestamp_ntz")
    row = R.load_lines(df).first()
    assert len(row["DDInterID_A"]) == 400_000 and row["reason"] == "invalid_id"


def test_profile_counts(spark):
    rows = [(1, 0.0, "Ab 12", None), (1, -0.0, "cd 34", "x"), (1, float("nan"), "", "y"), (1, 2.5, None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "load int, k double, text string, n string")  # names that the profile uses itself
    got = {(r["load"], r["feature"]): r for r in P.profile(df, "load", ["k", "text", "n"], {"k": P.Domain(0, 1)}).collect()}
    k = got[1, "k"]
    assert (k["rows"], k["nonmissing"], k["missing"], k["unique_values"], k["off_domain"], k["low"], k["high"]) == (4, 3, 1, 2, 1, 0.0, 2.5)
    assert k["missing_pct"] == 25.0 and k["zero_pct"] == pytest.approx(200 / 3)
    assert got[1, "text"]["masks"] == 3 and got[1, "text"]["unique_values"] == 3
    assert got[2, "k"]["zero_pct"] is None and got[2, "k"]["missing_pct"] == 100.0


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "load int, a double")
    assert P.profile(df, "load", ["a"]).count() == 0
    assert P.profile(df, "load", []).count() == 0


def test_rare_masks_and_divergence(spark):
    rows = [(1, f"AB{i:03d}") for i in range(500)] + [(1, "ab-1")] + [(2, f"x{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "load int, code string")
    assert [(r["load"], r["mask"], r["rows"]) for r in P.rare_masks(df, "load", ["code"]).collect()] == [(1, "a-9", 1)]
    before = spark.createDataFrame([(2, 1), (1, None), (3, 2)], "load int, previous_load int")
    got = P.mask_divergence(df, "load", ["code"], before).collect()
    assert len(got) == 1 and got[0]["divergence"] == pytest.approx(1.0)
    same = spark.createDataFrame([(1, 1)], "load int, previous_load int")
    assert P.mask_divergence(df, "load", ["code"], same).first()["divergence"] == pytest.approx(0.0)


def test_findings(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, None), (2, 5.0)], "load int, x_jaccard double")
    masks = P.mask_counts(df, "load", ["x_jaccard"], {"x_jaccard": P.Domain(0, 1)})
    stored = spark.createDataFrame([(1, None, "x_jaccard", 0.0, 50.0, 2), (1, None, "x_jaccard", 0.0, 50.0, 2), (2, 1, "x_jaccard", 50.0, None, 1), (3, 2, "x_jaccard", None, None, None)], "load int, previous_load int, feature string, missing_pct double, zero_pct double, unique_values long")
    got = sorted((r["load"], r["finding"]) for r in P.findings(P.profile_of(masks, ["x_jaccard"]), stored, P.divergence_of(masks, ["x_jaccard"], stored)).collect())
    assert got == [(2, "coverage_wrong"), (2, "invalid_value"), (2, "missing_shift"), (2, "zero_shift")]


VALUES = [0.0, -0.0, 0.3, 1.0, 1.5, 2.0, 3.0, 1e300, 1e-300, float("inf"), -0.4, -1.0, -2.5, -7.0, float("-inf")]


@pytest.mark.parametrize("domain", [P.Domain(0, 1), P.Domain(0, 1, True), P.Domain(0, 2, True), P.Domain(0), P.Domain(), P.Domain(-1.5, 2.5), P.Domain(None, 1)])
def test_masks_never_say_otherwise_than_values(spark, domain):
    df = spark.createDataFrame([(v,) for v in VALUES], "num double").withColumn("mask", P.number_mask(F.col("num"))).withColumn("k", F.lit(0))
    rows = df.select("num", "mask", P.off_domain(["x"], {"x": domain}).alias("by_mask"), domain.broken(F.col("num")).alias("by_value")).collect()
    assert all(r["by_mask"] == r["by_value"] for r in rows if abs(r["num"]) != float("inf") or not domain.whole), rows
    assert {r["mask"] for r in rows} == set(P.NUMBER_MASKS)


def test_masks_settle_most_values():
    assert [P.Domain(0, 1).of_mask(m) for m in ("0", "0.9", "9", "9.9", "-9")] == [False, False, None, True, True]
    assert [P.Domain(0, 2, True).of_mask(m) for m in ("0", "0.9", "9", "-0.9")] == [False, True, None, True]


def test_no_shift_is_below_the_least_divergence():
    import math

    rng = random.Random(1)
    for _ in range(3000):
        p, q = ([rng.random() ** 3 for _ in range(4)] for _ in range(2))
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        js = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2
        assert js >= P.least_divergence(100 * max(abs(x - y) for x, y in zip(p, q)))
