"""Leaks, packing, personal information."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import leaks, packing, personal

# --- leaks --------------------------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(60)]


def plain(docs, items, n=13):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for d, t in docs:
        w = split(t)
        for i, s in items:
            v = split(s)
            k = min(n, len(v))
            if k and grams(w, k) & grams(v, k):
                out.add((d, i))
    return out


def found(spark, docs, items, **kw):
    a, b = (spark.createDataFrame(x, "id long, text string") for x in (docs, items))
    got = leaks.leaks(a, b, **kw).filter("passage and same").select("doc_id", "item_id").distinct()
    return {tuple(r) for r in got.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_leaks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 9, 13, 14, 40])))) for i in range(30)]
    docs = []
    for d in range(80):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(200))]
        if rng.random() < 0.6:
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            w[5:5] = [x.upper() for x in part[a : a + rng.randrange(8, 20)]]
        docs.append((d, rng.choice([" ", "\n", ", ", " - "]).join(w)))
    assert found(spark, docs, items) == plain(docs, items)


def test_leaks_across_steps(spark, monkeypatch):
    text = " ".join(f"t{i}" for i in range(leaks.STEP + 500))
    at = leaks.STEP - 6
    assert found(spark, [(1, text)], [(7, " ".join(f"t{i}" for i in range(at, at + 13)))]) == {(1, 7)}


def test_leaks_of_odd_texts(spark):
    assert found(spark, [], [(1, "a b")]) == set() and found(spark, [(1, "a b")], []) == set()
    docs = [(1, None), (2, ""), (3, "... !"), (4, "one two three"), (5, "One; TWO_three"), (5, "One; TWO_three")]
    items = [(1, "one two three"), (2, None), (3, "--"), (4, "one two three")]
    assert found(spark, docs, items) == {(4, 1), (4, 4), (5, 1), (5, 4)}


def test_fingerprints_are_sums_of_words():
    rng = np.random.default_rng(0)
    bits, codes = rng.integers(0, 2, (50, 64)).astype(np.uint8), rng.integers(0, 50, 300)
    for n, fp in leaks.fingerprints(bits, codes, list(range(1, 14))).items():
        for k in (0, 7, len(fp) - 1):
            want = (bits[codes[k : k + n]].astype(int).sum(axis=0) > n // 2).astype(np.uint8)
            assert fp[k] == int.from_bytes(np.packbits(want).tobytes(), "big")


@pytest.mark.parametrize("radius", [3, 11])
def test_index_meets_every_fingerprint_within_the_radius_once(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 60).astype(np.uint64)
    b = a[rng.integers(0, 60, 4000)]
    for _ in range(radius + 3):
        b = b ^ (rng.integers(0, 2, 4000).astype(np.uint64) << rng.integers(0, 64, 4000).astype(np.uint64))
    at, win = leaks.Index([{"fp": int(x.astype(np.int64)), "words": []} for x in a], radius).meet(b)
    near = np.bitwise_count(b[:, None] ^ a[None, :]) <= radius
    assert sorted(zip(at.tolist(), win.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(near))))


def test_weighted_similarity():
    alike = lambda x, y: leaks.Index([{"fp": 0, "words": x.split()}], 0).similarity(0, y.split())
    assert [alike("a b c d e f", "a b c d e f"), alike("a b c d e f", "a b c d e g"), alike("a b", "a b"), alike("a b", "a c")] == [1.0, pytest.approx(1 / 3), 1.0, 0.0]
    assert alike("a a a a a a a", "a a a a a a") == pytest.approx(2 / 3)


@pytest.mark.parametrize("share, least", [(0.05, 0.95), (0.1, 0.8)])
def test_edited_items_are_found(spark, share, least):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(28, 110)))) for i in range(150)]
    docs = []
    for i, t in items:
        w = t.split()
        for k in rng.sample(range(len(w)), round(share * len(w))):
            w[k] = rng.choice(words)
        docs.append((i, " ".join([rng.choice(words) for _ in range(50)] + w + [rng.choice(words) for _ in range(50)])))
    a, b = (spark.createDataFrame(x, "id long, text string") for x in (docs, items))
    got = {r["doc_id"] for r in leaks.leaks(a, b).filter("doc_id = item_id").collect()}
    assert len(got) >= least * len(items)


def test_one_changed_word_is_found_at_own_size(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"x{rng.randrange(3000)}" for _ in range(rng.randrange(68, 110)))) for i in range(100)]
    docs = [(i, " ".join("changed" if k == 30 else w for k, w in enumerate(t.split()))) for i, t in items]
    a, b = (spark.createDataFrame(x, "id long, text string") for x in (docs, items))
    got = leaks.leaks(a, b).filter("not passage and doc_id = item_id and similarity >= 0.8")
    assert got.select("doc_id").distinct().count() >= 95


def test_alike_windows_have_a_run_in_common():
    rng = random.Random(3)
    assert all(leaks.common_run(n, 0.8) >= 13 for n in range(20, 3000))
    for _ in range(4000):
        n = rng.choice([20, 30, 45, 68])
        a = [f"w{i}" for i in range(n)]
        b = [f"x{rng.random()}" if rng.random() < rng.choice([0.01, 0.03]) else w for w in a]
        k = rng.choice([0, 0, rng.randrange(n)])
        b = b[k:] + b[:k] if rng.random() < 0.5 else b[k // 9 :] + [f"y{i}" for i in range(k // 9)]
        x, y = leaks.shingles(a), leaks.shingles(b)
        common = sum((x & y).values())
        if common / (2 * (n - 4) - common) >= 0.8:
            runs = {tuple(a[i : i + 13]) for i in range(n - 12)}
            assert any(tuple(b[i : i + 13]) in runs for i in range(n - 12))


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, f"one two three four word{i % 7}") for i in range(20)]
    docs = [(d, f"so one two three four word{d} end") for d in range(9)]
    want = found(spark, docs, items)
    monkeypatch.setattr(leaks, "BLOCK", 6)
    assert found(spark, docs, items) == want == plain(docs, items)


# --- packing ------------------------------------------------------------------------------------------------------------


def packed(spark, sizes, capacity, **kw):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    return packing.pack(df, capacity, **kw).collect()


@pytest.mark.parametrize("kind", ["mixed", "halves", "empty", "huge", "zeros"])
def test_every_item_is_packed_once(spark, kind):
    rng = random.Random(2)
    sizes = {"mixed": [int(rng.paretovariate(0.9) * 20) % 4000 for _ in range(3000)], "halves": [60] * 500, "empty": [], "huge": [1000, 99, 100, 101, 250], "zeros": [0] * 450 + [5]}[kind]
    capacity = 2048 if kind == "mixed" else 100
    rows = packed(spark, sizes, capacity)
    total, parts, places = {}, {}, {}
    for r in rows:
        total[r["container"]] = total.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part"], r["tokens"]))
        places.setdefault(r["container"], []).append(r["position"])
    assert set(parts) == set(range(len(sizes)))
    for d, own in parts.items():
        assert sum(t for _, t in own) == sizes[d] and sorted(p for p, _ in own) == list(range(len(own)))
        assert len(own) == 1 if sizes[d] <= capacity else len(own) == -(-sizes[d] // capacity)
    assert all(t <= capacity for t in total.values()) and all(sorted(p) == list(range(len(p))) and len(p) <= capacity for p in places.values())
    if kind == "mixed":
        assert len(total) <= sum(sizes) / capacity * 1.01 + 2
    if kind == "halves":  # nothing fits together
        assert len(total) == 500


def test_small_steps_leave_little_space(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(60, 90) for _ in range(1500)] + [rng.randrange(10, 40) for _ in range(1500)]
    rows = packed(spark, sizes, 100, step=150)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(sizes)))
    # no container holds two of the larger items, so that 1,500 are needed; without any merging there would be 3,000
    assert len({r["container"] for r in rows}) <= 1900


def test_best_fit_is_tight():
    item = lambda n, s: (s, [{"doc_id": n, "part": 0, "tokens": s}])
    got = packing.best_fit([item(i, s) for i, s in enumerate([6, 5, 4, 3, 2])], 10)
    assert sorted(s for s, _ in got) == [10, 10]


def test_token_counts(spark):
    import os

    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no tokenizer")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (4, "x " * 100_000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] >= 100_000 and got[5] > 1


# --- personal information -----------------------------------------------------------------------------------------------

# Invented people for these tests.
GIVEN = "Mara Tilo Jonas Ines Petra Lukas Elsa Noemi".split()
FAMILY = "Vandermolen Kestrelsohn Abelquist Thornfeld Ostlander Brixholm Wendelroth Falkenmoor".split()


def corpus(n, seed=0):
    """(texts, true spans): templates with slots, batch numbers of phone form among them."""
    rng = random.Random(seed)
    texts, truth = [], set()
    for d in range(n):
        name, phone = f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}", rng.choice([f"+1-415-555-{rng.randrange(1000, 9999)}", f"415-555-{rng.randrange(1000, 9999)}", f"415555{rng.randrange(1000, 9999)}"])
        slots = rng.choice([[("Reported by Dr. ", None), (name, "name"), (", who can be called under ", None), (phone, "phone"), (".", None)], [("Ask for ", None), (name, "name"), (" at ", None), (phone, "phone"), (" before noon.", None)], [("Batch ", None), (f"415-555-{rng.randrange(1000, 9999)}", None), (" was released in May.", None)], [("Write to ", None), (f"{name.split()[0].lower()}@mail.example", "email"), (" soon.", None)], [("She lives at ", None), (f"{rng.randrange(1, 99)} {rng.choice(FAMILY)} Street, Dunvale 12345", "address"), (".", None)], [("Insurance no. ", None), (rng.choice(["QQ 12 34 56 C", "000-12-3456", "1234/567/89012"]), "id_number"), (" was checked.", None)]])
        text = "The panel met. "
        for part, kind in slots:
            if kind:
                truth.add((d, kind, len(text), len(text) + len(part)))
            text += part
        texts.append((d, text + " The Harrow Valley cohort grew."))
    return texts, truth


def test_found_where_they_stand(spark):
    texts, truth = corpus(600)
    got = {(r["doc_id"], r["kind"], r["start_pos"], r["end_pos"]) for r in personal.personal_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95


def test_the_graph_decides_every_kind(spark):
    from corvane.session import Scratch

    texts, truth = corpus(400, 3)
    scratch = Scratch(spark)
    found = scratch.keep(personal.proposals(spark.createDataFrame(texts, "doc_id long, text string")))
    items, patterns = personal.spread(found, scratch)
    kinds = {r["kind"] for r in personal.judged(personal.weighed(found, items, patterns)).select("kind").distinct().collect()}
    assert kinds == set(personal.KINDS)
    without = personal.judged(personal.weighed(found, items.withColumn("weight", F.lit(0.0)), patterns.withColumn("weight", F.lit(0.0))))
    assert without.count() == 0


def test_patterns_bring_up_what_no_grammar_knows(spark):
    texts, _ = corpus(500, 7)
    rng = random.Random(9)
    hidden = set()
    for d in range(1000, 1040):
        name, street = f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}".lower(), f"{rng.randrange(2, 90)} {rng.choice(FAMILY)} Close"
        before, value, after, kind = rng.choice([("Then ask for ", name, " at once.", "name"), ("We heard she lives at ", street, ".", "address")])
        texts.append((d, before + value + after))
        hidden.add((d, kind, len(before), len(before) + len(value)))
    every = {t: {(k, a, b) for k, a, b, _, _ in personal.spans(t, personal.grammars())} for d, t in texts if d >= 1000}
    assert not any(h[1:] in every[t] for d, t in texts if d >= 1000 for h in hidden if h[0] == d)
    got = {(r["doc_id"], r["kind"], r["start_pos"], r["end_pos"]) for r in personal.personal_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got & hidden) >= 0.9 * len(hidden)


def test_blocks_of_patterns_give_the_same(spark, monkeypatch):
    texts, _ = corpus(200, 8)
    df = spark.createDataFrame(texts + [(900, "Ask for mara thornfeld at once.")], "doc_id long, text string")
    want = {tuple(r) for r in personal.personal_spans(df).drop("score").collect()}
    monkeypatch.setattr(personal, "BLOCK", 2)
    assert {tuple(r) for r in personal.personal_spans(df).drop("score").collect()} == want


def test_placeholders(spark):
    texts = [(1, "a@b.example 😀 +1-415-555-0100"), (2, None), (3, ""), (4, "nothing")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spans = spark.createDataFrame([(1, "email", 0, 11), (1, "phone", 14, 29)], "doc_id long, kind string, start_pos int, end_pos int")
    got = {r["doc_id"]: (r["text"], r["spans"]) for r in personal.redact(docs, spans).collect()}
    assert got == {1: ("[EMAIL] 😀 [PHONE]", 2), 2: (None, 0), 3: ("", 0), 4: ("nothing", 0)}


def test_odd_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal.personal_spans(df).count() == 0
    texts = [(1, None), (2, ""), (3, "x" * 200_000), (4, "1" * 100_000), (5, "A. " * 20_000), (6, "@" * 1000)]
    assert personal.personal_spans(spark.createDataFrame(texts, "doc_id long, text string")).filter("doc_id < 3").count() == 0


def test_settled_takes_one_of_overlapping(spark):
    rows = [(1, "name", 0, 10, 0.9), (1, "email", 5, 20, 1.0), (1, "phone", 20, 30, 0.6), (1, "id_number", 22, 30, 0.9), (2, "name", 0, 5, 0.7), (2, "name", 0, 9, 0.9)]
    got = personal.settled(spark.createDataFrame(rows, "doc_id long, kind string, start_pos int, end_pos int, score double"))
    assert {(r["doc_id"], r["kind"], r["start_pos"], r["end_pos"]) for r in got.collect()} == {(1, "email", 5, 20), (1, "id_number", 22, 30), (2, "name", 0, 9)}


def proposed(text, kind):
    return [text[a:b] for k, a, b, _, _ in personal.spans(text, personal.grammars()) if k == kind]


def test_grammars():
    assert proposed("x mailto:a.b@c.example, d [at] e[dot]test or f at g . invalid.", "email") == ["a.b@c.example", "d [at] e[dot]test", "f at g . invalid"]
    assert proposed("Write @846 in the field at 303.555.0155 now", "email") == []
    assert set(proposed("Am Hausplatz 12, 00973 Bexhollow; C/ Prado, 5. 12 bis, avenue Nord", "address")) == {"Am Hausplatz 12, 00973 Bexhollow", "C/ Prado, 5", "12 bis, avenue Nord"}
    assert "Mara L. Thornfeld" in proposed("Ask for Mara L. Thornfeld at once", "name") and "von Thornfeld, Mara" in proposed("by von Thornfeld, Mara.", "name")
    assert proposed("Patient mara thornfeld lives here", "name") == []  # patterns bring these up
    assert proposed("Then a dose was low and stayed so.", "name") == []
    assert proposed("Call +1 (415) 555‑0100 ext. 12 now", "phone") == ["+1 (415) 555‑0100 ext. 12"]


def test_redaction_of_spans_counts_code_points(spark, data):
    import __spark_entry__ as entry

    q = entry.queries()
    found = q["p10_found"](spark, data).filter("kind = 'email'").limit(50).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(re.search(r"@|at", texts[r["doc_id"]][r["start_pos"] : r["end_pos"]], re.I) for r in found)
    assert q["p10_redacted"](spark, data).count() == len(texts)
