"""All pairs of records whose sets of values overlap above a Jaccard threshold, exactly.

Sets of l and s values, l <= s, of Jaccard t or more differ in at most H = l + s - 2 ceil(t / (1 + t) (l + s)) values.
Lengths are cut into bands that grow by 1 / t, and each band splits the universe of values into as many segments as
its longest set has values. By the pigeonhole principle, if tolerances of segments (1 for an exact match, 2 for a
match up to one deletion) add up to H + 1, one of these segments matches. Every set is indexed in its own band, by its
exact segments and those of three values or more with one deleted; it probes its own band and the one below with
the cheapest segments that add up to H + 1, by the frequency of their rarest values. Signatures that meet have their
lengths and a 64-bit parity sketch compared, which only drops pairs that differ in more than H values; what is left is
verified on the whole sets.

Sets whose segments can't add up to H + 1 probe by their H + 1 rarest values instead. Signatures of frequent values only
are salted. Equal sets are one class, joined once. Sets of more than HEAVY distinct values never stand in one row: they
go through the same pigeonhole by grouping, in a join of their own, where only segments that hold values count; sets with
too few of these meet all sets of fitting sizes. Nothing is capped.

Rows with a null in their source or value and repeated rows are ignored, and so are records without a value. An empty table gives no pairs. Values are
64-bit hashes, which are checked for collisions over the whole universe and salted anew if there are any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.session import BROADCAST_ROWS, Scratch, attach

HEAVY = 20_000
SALTS = 16
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def differ(t: float, a: int, b: int) -> int:
    """How many values sets of these sizes and of Jaccard t or more differ in at most; -1 if they can't be that alike."""
    common = math.ceil(t / (1 + t) * (a + b) - 1e-9)
    return a + b - 2 * common if common <= min(a, b) else -1


@lru_cache(16)
def band_starts(t: float, longest: int) -> tuple[int, ...]:
    starts = [1]
    while starts[-1] <= longest:
        starts.append(max(starts[-1] + 1, math.ceil(starts[-1] / t - 1e-9)))
    return tuple(starts)


@lru_cache(1 << 16)
def needed(t: float, s: int, low: int, high: int) -> int:
    """The tolerance that a set of s values has to spread over its segments to meet all sets of low to high values."""
    return 1 + max((differ(t, s, n) for n in range(max(low, math.ceil(t * s - 1e-9)), min(high, s) + 1)), default=-1)


class Sets:
    """The sets of an Arrow batch (id, hs, ns), flat, with their segments in a band of lengths."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.id = batch.column("id").to_numpy(zero_copy_only=False)
        hs = batch.column("hs")
        self.size = np.diff(hs.offsets.to_numpy()).astype(np.int64)
        self.h = hs.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.n = batch.column("ns").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.rec = np.repeat(np.arange(len(self.size)), self.size)
        self.code = mix(self.h)
        bits = U(1) << (self.code & U(63))
        self.sketch = np.bitwise_xor.reduceat(bits, np.concatenate([[0], np.cumsum(self.size)[:-1]])) if len(bits) else np.zeros(0, np.uint64)

    def segments(self, band: np.ndarray, parts: np.ndarray, keep: np.ndarray) -> dict:
        """Per segment that holds values: its set, its sum of codes, its number of values, the two lowest frequencies."""
        use = keep[self.rec]
        rec, code, n = self.rec[use], self.code[use], self.n[use]
        own = band[rec].astype(np.uint64)
        seg = mix(code + own * U(0x9E3779B97F4A7C15)) % parts[rec].astype(np.uint64)
        order = np.lexsort((n, seg, rec))
        rec, seg, code, n, own = rec[order], seg[order], code[order], n[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], (rec[1:] != rec[:-1]) | (seg[1:] != seg[:-1])])) if len(rec) else np.zeros(0, int)
        count = np.diff(np.append(first, len(rec)))
        place = mix((own[first] << U(40)) + seg[first] + U(1))
        second = np.where(count > 1, n[np.minimum(first + 1, len(n) - 1)], 0) if len(n) else count
        return {"rec": rec[first], "sum": np.add.reduceat(code, first) if len(first) else code, "count": count, "least": n[first], "second": second, "place": place, "code": code, "owner": np.repeat(np.arange(len(first)), count), "rank": np.arange(len(rec)) - np.repeat(first, count)}


def signature(sums: np.ndarray, place: np.ndarray, deleted: bool) -> np.ndarray:
    return mix(sums + place + U(0x5851F42D4C957F2D if deleted else 0))


def with_deletion(g: dict, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, sum without one value, lowest frequency of the rest) for every value of the chosen segments."""
    use = chosen[g["owner"]]
    seg = g["owner"][use]
    return seg, g["sum"][seg] - g["code"][use], np.where(g["rank"][use] == 0, g["second"][seg], g["least"][seg])


def bands(s: Sets, t: float, longest: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.array(band_starts(t, longest))
    return starts, np.searchsorted(starts, s.size, "right") - 1


def probes(s: Sets, t: float, longest: int, fill: float, below: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Segments, which of them are probed exactly, which up to a deletion, and which sets can't probe enough of them."""
    starts, band = bands(s, t, longest)
    band = band - below
    need = np.array([needed(t, int(n), int(starts[b]), int(starts[b + 1]) - 1) if b >= 0 else 0 for n, b in zip(*(x.tolist() for x in (s.size, band)))], np.int64)
    parts = np.maximum(1, np.ceil((starts[np.maximum(band, 0) + 1] - 1) * fill)).astype(np.int64)
    g = s.segments(np.maximum(band, 0), parts, need > 0)
    two = np.flatnonzero(g["count"] > 1)
    unit_seg = np.concatenate([np.arange(len(g["rec"])), two])
    cost = np.concatenate([g["least"], g["second"][two]])
    more = np.concatenate([np.zeros(len(g["rec"]), np.int8), np.ones(len(two), np.int8)])
    rec = g["rec"][unit_seg]
    order = np.lexsort((unit_seg, more, cost, rec))
    sorted_rec = rec[order]
    begin = np.searchsorted(sorted_rec, sorted_rec)
    taken = order[np.arange(len(order)) - begin < need[sorted_rec]]
    short = np.bincount(rec, minlength=len(s.size)) < need
    exact, upto = np.zeros(len(g["rec"]), bool), np.zeros(len(g["rec"]), bool)
    exact[unit_seg[taken[more[taken] == 0]]] = True
    upto[unit_seg[taken[more[taken] == 1]]] = True
    return g, exact & ~short[g["rec"]], upto & ~short[g["rec"]], short


def emit(s: Sets, g: dict, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], hot: int, spread: bool) -> pa.RecordBatch:
    """Rows (sig, id, size, sketch). Signatures of frequent values only are salted: by set, or under every salt."""
    seg = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, int)
    sig = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
    common = (np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, int)) > hot
    rec = g["rec"][seg]
    if spread:
        sig = np.where(common, mix(sig + s.id[rec].astype(np.uint64) % U(SALTS) + U(1)), sig)
    elif common.any():
        times = np.where(common, SALTS, 1)
        salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        sig, rec, common = np.repeat(sig, times), np.repeat(rec, times), np.repeat(common, times)
        sig = np.where(common, mix(sig + salt.astype(np.uint64) + U(1)), sig)
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(s.id[rec]), pa.array(s.size[rec].astype(np.int32)), pa.array(s.sketch[rec].view(np.int64))], names=["sig", "id", "size", "sketch"])


SIGNATURES = "sig bigint, id bigint, size int, sketch bigint"


def signatures(sets: DataFrame, t: float, hot: int, fill: float, index: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = Sets(batch)
            if index:
                starts, band = bands(s, t, HEAVY)
                g = s.segments(band, np.maximum(1, np.ceil((starts[band + 1] - 1) * fill)).astype(np.int64), s.size > 0)
                seg, rest, least = with_deletion(g, g["count"] > 2)
                yield emit(s, g, [(np.arange(len(g["rec"])), signature(g["sum"], g["place"], False), g["least"]), (seg, signature(rest, g["place"][seg], True), least)], hot, True)
                continue
            for below in (0, 1):
                g, exact, upto, _ = probes(s, t, HEAVY, fill, below)
                a, b = np.flatnonzero(exact), np.flatnonzero(upto)
                seg, rest, least = with_deletion(g, upto)
                yield emit(s, g, [(a, signature(g["sum"][a], g["place"][a], False), g["least"][a]), (b, signature(g["sum"][b], g["place"][b], True), g["least"][b]), (seg, signature(rest, g["place"][seg], False), least)], hot, False)

    return sets.select("id", "hs", "ns").mapInArrow(run, SIGNATURES)


def short_of_segments(sets: DataFrame, t: float, fill: float) -> DataFrame:
    """(id, size, h): the size and the rarest values, H + 1 of them, of the sets that can't probe by segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sets(batch)
            ids, sizes, hs, starts = [], [], [], np.concatenate([[0], np.cumsum(s.size)])
            short = probes(s, t, HEAVY, fill, 0)[3] | probes(s, t, HEAVY, fill, 1)[3] if batch.num_rows else np.zeros(0, bool)
            for r in np.flatnonzero(short):
                n = needed(t, int(s.size[r]), 1, int(s.size[r]))
                own = slice(starts[r], starts[r + 1])
                rare = np.argsort(s.n[own], kind="stable")[:n]
                ids += [s.id[r]] * len(rare)
                sizes += [s.size[r]] * len(rare)
                hs += s.h[own][rare].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hs, pa.int64())], names=["id", "size", "h"])

    return sets.select("id", "hs", "ns").mapInArrow(run, "id bigint, size int, h bigint")


def sum_of(*c: str) -> Column:
    return F.col(c[0]) + F.col(c[1])


def within(t: float, small: str, large: str) -> Column:
    """At most so many values may differ: as differ()."""
    return F.col(small) + F.col(large) - 2 * F.ceil(F.lit(t / (1 + t)) * sum_of(small, large) - F.lit(1e-9))


def candidates(sets: DataFrame, t: float, hot: int, fill: float) -> DataFrame:
    """(a, b) with a < b: pairs of sets that may be alike, among them all that are."""
    idx = signatures(sets, t, hot, fill, True).select("sig", F.col("id").alias("a"), F.col("size").alias("la"), F.col("sketch").alias("ka"))
    probe = signatures(sets, t, hot, fill, False).select("sig", F.col("id").alias("b"), F.col("size").alias("lb"), F.col("sketch").alias("kb"))
    met = idx.join(probe, "sig").filter((F.col("la") <= F.col("lb")) & (F.col("a") != F.col("b")) & (F.col("la") >= F.lit(t) * F.col("lb") - F.lit(1e-9)))
    met = met.filter(F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))) <= within(t, "la", "lb"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    got = pairs.join(sets.select(F.col("id").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hs").alias("y")), "b")
    got = got.withColumn("common", F.size(F.array_intersect("x", "y"))).withColumn("union", F.size("x") + F.size("y") - F.col("common"))
    return got.filter(F.col("common") / F.col("union") >= t).select("a", "b", (F.col("common") / F.col("union")).alias("jaccard"))


def heavy_pairs(long: DataFrame, heavy: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """(source_a, source_b, jaccard) among large sets, none of which is ever gathered: segments are sums by grouping."""
    long = scratch.keep(long.join(heavy.select("source"), "source", "left_semi").select("source", "h").distinct())
    size = scratch.keep(long.groupBy("source").agg(F.count(F.lit(1)).alias("size")))
    band = F.floor(F.log("size") / F.lit(math.log(1 / t)) + F.lit(1e-9)).cast("int")
    with_band = long.join(size.withColumn("band", band), "source")

    def segments(below: int) -> DataFrame:
        x = with_band.withColumn("band", F.col("band") - below)
        top = F.pow(F.lit(1 / t), F.col("band") + 1)
        parts = F.ceil(top).cast("bigint") + 2
        return x.withColumn("seg", F.pmod(F.xxhash64("h", "band"), parts)).groupBy("source", "size", "band", "seg").agg(F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("sum"))

    own = scratch.keep(segments(0))
    probe = scratch.keep(own.unionByName(segments(1))).select(F.col("source").alias("source_b"), F.col("size").alias("lb"), "band", "seg", "sum")
    # H + 1 segments that hold values are needed: with H differing values one of them is the same on the other side
    most = F.floor((F.col("lb") + F.least(F.col("lb"), F.ceil(F.pow(F.lit(1 / t), F.col("band") + 1)) + 1)) * ((1 - t) / (1 + t)) + 1e-6)
    few = probe.groupBy("source_b", "lb", "band").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") <= most).select("source_b", "lb").distinct()
    all_of = size.select(F.col("source").alias("source_a"), F.col("size").alias("la")).join(few, (F.col("la") <= F.col("lb")) & (F.col("la") >= F.lit(t) * F.col("lb") - F.lit(1e-9)) & (F.col("source_a") != F.col("source_b")))
    met = own.select(F.col("source").alias("source_a"), F.col("size").alias("la"), "band", "seg", "sum").join(probe, ["band", "seg", "sum"])
    met = met.filter((F.col("la") <= F.col("lb")) & (F.col("source_a") != F.col("source_b")) & (F.col("la") >= F.lit(t) * F.col("lb") - F.lit(1e-9)))
    met = met.select("source_a", "source_b").unionByName(all_of.select("source_a", "source_b"))
    pairs = met.select(F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b")).distinct()
    both = pairs.join(long.withColumnRenamed("source", "source_a"), "source_a").join(long.withColumnRenamed("source", "source_b"), ["source_b", "h"])
    n = both.groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("common"))
    n = n.join(size.select(F.col("source").alias("source_a"), F.col("size").alias("la")), "source_a").join(size.select(F.col("source").alias("source_b"), F.col("size").alias("lb")), "source_b")
    j = F.col("common") / (F.col("la") + F.col("lb") - F.col("common"))
    return n.filter(j >= t).select("source_a", "source_b", j.alias("jaccard"))


def larger(long: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(source, size): the sets of `least` or more distinct values. Only sources of as many rows have these counted."""
    rows = scratch.keep(long.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least))
    if rows.isEmpty():
        return rows.select("source", F.col("rows").alias("size"))
    return long.join(rows.select("source"), "source", "left_semi").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)


def value_sets(rows: DataFrame, source: str, values: list[str], scratch: Scratch, heavy: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
    """(sets of fewer than `heavy` values as (source, hs, ns), (source, h) rows, sources of the heavier ones, rows in all)."""
    for seed in range(8):
        salt = [F.lit(f"{seed}")] if seed else []
        long = rows.select(F.col(source).alias("source"), F.xxhash64(*salt, *values).alias("h"), F.xxhash64(F.lit(f"other {seed}"), *values).alias("other"))
        counts = scratch.keep(long.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("x"), F.max("other").alias("y")))
        if counts.filter("x <> y").isEmpty():
            break
    total = counts.agg(F.sum("n")).first()[0] or 0
    long, counts = long.select("source", "h"), counts.select("h", "n")
    large = larger(long, heavy + 1, scratch)
    most = None
    light = long
    if not large.isEmpty():
        most = scratch.keep(large)
        light = long.join(most, "source", "left_anti")
    each = attach(light, counts, ["h"], "n").groupBy("source").agg(F.sort_array(F.collect_set(F.struct("n", "h"))).alias("x"))
    sets = each.select("source", F.col("x.h").alias("hs"), F.transform("x.n", lambda n: F.least(n, F.lit(2**31 - 1)).cast("int")).alias("ns"))
    return sets, long, most, total


def similar_sets(rows: DataFrame, source: str, values: list[str], t: float, fill: float = 1.0, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives with source_a < source_b and jaccard; members: source, class_source, copies).

    rows has one value a row. Sources of equal sets are members of the class of the first of them. For two tables, put
    them together under prefixed sources and keep the pairs between them.
    """
    scratch = Scratch(rows.sparkSession)
    keep = scratch.keep
    for c in (source, *values):
        rows = rows.filter(F.col(c).isNotNull())
    sets, long, large, total = value_sets(rows, source, values, scratch, heavy)
    print_of = lambda x: F.xxhash64(F.lit(x), F.size("hs"), F.sort_array("hs"))
    sets = keep(sets.withColumns({"f1": print_of("a"), "f2": print_of("b")}))
    several = keep(sets.groupBy("f1", "f2").agg(F.min("source").alias("class_source"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    if several.count() <= BROADCAST_ROWS:
        classed = sets.join(F.broadcast(several), ["f1", "f2"], "left")
    else:
        classed = attach(sets, several, ["f1", "f2"], "copies", "left")
    classed = classed.withColumns({"class_source": F.coalesce("class_source", "source"), "copies": F.coalesce("copies", F.lit(1))})
    reps = keep(classed.filter("source = class_source").select(F.monotonically_increasing_id().alias("id"), "source", "hs", "ns"))
    hot = total // 200 + 1000
    found = keep(candidates(reps, t, hot, fill))
    short = keep(short_of_segments(reps, t, fill))
    n_short = short.count()
    if n_short:
        mine = F.broadcast(short) if n_short <= BROADCAST_ROWS else short
        mine = mine.withColumnRenamed("size", "ls")
        other = reps.select(F.col("id").alias("o"), F.size("hs").alias("lo"), F.explode("hs").alias("h"))
        fit = F.least("ls", "lo") >= F.lit(t) * F.greatest("ls", "lo") - F.lit(1e-9)
        more = other.join(mine, "h").filter(fit & (F.col("o") != F.col("id"))).select(F.least("o", "id").alias("a"), F.greatest("o", "id").alias("b"))
        found = found.unionByName(more).distinct()
    good = verified(found, reps, t)
    name = reps.select("id", "source")
    pairs = good.join(name.select(F.col("id").alias("a"), F.col("source").alias("p")), "a").join(name.select(F.col("id").alias("b"), F.col("source").alias("q")), "b")
    pairs = pairs.select(F.least("p", "q").alias("source_a"), F.greatest("p", "q").alias("source_b"), "jaccard")
    members = classed.select("source", "class_source", "copies")
    if large is not None:
        # partners of large sets: all that are as large as t times the smallest of these; of light classes only the first
        own = long.join(large.select("source"), "source", "left_semi").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("size"))
        least = own.agg(F.min("size")).first()[0]
        near = larger(long, math.floor(t * least), scratch)
        near = keep(near.join(classed.filter("source <> class_source").select("source"), "source", "left_anti"))
        pairs = pairs.unionByName(heavy_pairs(long, near, t, scratch)).distinct()
        members = members.unionByName(large.select("source", F.col("source").alias("class_source"), F.lit(1).cast("bigint").alias("copies")))
    return keep(pairs), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of sources: between the members of classes that are alike, and within classes; large classes are spread under salts."""
    several = members.filter("copies > 1")
    many = several.select("class_source", "source")
    one = pairs.join(many.select(F.col("class_source").alias("source_a"), F.col("source").alias("a")), "source_a", "left").withColumn("a", F.coalesce("a", "source_a"))
    two = one.join(many.select(F.col("class_source").alias("source_b"), F.col("source").alias("b")), "source_b", "left").withColumn("b", F.coalesce("b", "source_b"))
    large = F.col("copies") > SALTS * SALTS
    left = several.select("class_source", F.col("source").alias("a"), F.when(large, F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    right = several.select("class_source", F.col("source").alias("b"), F.explode(F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    same = left.join(right, ["class_source", "salt"]).filter("a < b")
    return two.select(F.least("a", "b").alias("source_a"), F.greatest("a", "b").alias("source_b")).unionByName(same.select(F.col("a").alias("source_a"), F.col("b").alias("source_b"))).distinct()
