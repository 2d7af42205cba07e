"""Column profiles per load, from one pass over the rows, by masks of character classes.

Every value of every profiled column is counted per load (a map-side combined histogram) and generalised to its mask. Texts have
runs of letters and digits as A, a and 9; numbers have the mask of their plain notation, computed without spelling them: a sign if
negative, 0 or 9 for what stands before the point, .9 if anything follows it. Masks are rolled up to columns; dominant and rare masks,
values off their domain and the distance between two loads all come from that small table.

A mask tells for most values whether they are in their column's domain: it holds an interval of numbers that lies within the domain, or outside;
only values of masks that reach across a bound are compared themselves. Shares of missing and of zero values can differ between two loads
by no more than their masks do, so only columns whose masks diverge enough (Pinsker's bound) have them compared.

Nulls and NaN are missing. An empty table gives no rows. Empty strings are values with the mask ''. Very long texts are
masked over their whole length. Names of the profiled table can't clash with those of the result, since values travel in
columns of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Domain:
    """The values a column may have: between low and high, whole if whole is set; None: no bound."""

    low: float | None = None
    high: float | None = None
    whole: bool = False

    def broken(self, c: Column) -> Column:
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (c < F.lit(float(self.low)))
        if self.high is not None:
            bad = bad | (c > F.lit(float(self.high)))
        return bad | (c != F.floor(c)) if self.whole else bad

    def of_mask(self, mask: str) -> bool | None:
        """Whether all values of a number's mask are off the domain; None if only some are."""
        if self.whole and mask.endswith(".9"):
            return True
        size, inf = mask.lstrip("-"), float("inf")
        # the numbers of a mask: from a to b, ends that are whole included
        a, b = {"0": (0.0, 0.0), "0.9": (0.0, 1.0), "9": (1.0, inf), "9.9": (1.0, inf), "inf": (inf, inf)}[size]
        open_ends = size in ("0.9", "9.9")
        if mask.startswith("-"):
            a, b = -b, -a
        low, high = -inf if self.low is None else self.low, inf if self.high is None else self.high
        if low <= a and b <= high and (size != "inf" or self == Domain()):
            return False
        outside = (b <= low or a >= high) if open_ends else (b < low or a > high)
        return True if outside else None


NUMBER_MASKS = [sign + m for sign in ("", "-") for m in ("0", "0.9", "9", "9.9", "inf") if sign + m != "-0"]


def number_mask(c: Column) -> Column:
    """The mask of a number's plain notation; null for null."""
    size = F.abs(c)
    whole = size == F.floor(size)
    place = F.when(size == float("inf"), "inf").when(size == 0, "0").when(size < 1, "0.9").when(whole, "9").otherwise("9.9")
    return F.when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), place))


def feature_domain(name: str) -> Domain:
    """The domain that the name of a pair feature implies."""
    if name.endswith("_jaccard"):
        return Domain(0, 1)
    if name.startswith("both_"):
        return Domain(0, 1, True)
    if name.endswith("_available_count"):
        return Domain(0, 2, True)
    return Domain() if name == "logp_mean" else Domain(0)


def value_histogram(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(part, k, text, num, n): how often each value of columns[k] occurs within each value of by; text is null for floating columns.

    Columns are unfolded by an expansion of each row. Floating ones are counted by numbers alone, which makes their keys fixed in size.
    """
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), kinds[name]
        if kind.startswith("map"):
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.to_json(c) if kind.startswith(("array", "struct")) else c.cast("string")

    def is_number(name: str) -> bool:
        return kinds[name] in ("int", "bigint", "smallint", "tinyint") or kinds[name].startswith("decimal")

    floats = [k for k, name in enumerate(columns) if kinds[name] in ("double", "float")]
    others = [k for k in range(len(columns)) if k not in set(floats)]
    number = lambda c: F.when(~F.isnan(c), c.cast("double") + F.lit(0.0))
    wide = df.select(F.col(f"`{by}`").alias("part"), *[number(F.col(f"`{columns[k]}`")).alias(f"{k}") for k in floats])
    parts = []
    if floats:
        parts.append(wide.unpivot(["part"], [f"{k}" for k in floats], "k", "num").groupBy("part", "k", "num").agg(F.count(F.lit(1)).alias("n")).select("part", F.col("k").cast("int").alias("k"), F.lit(None).cast("string").alias("text"), "num", "n"))
    if others:
        texts = df.select(F.col(f"`{by}`").alias("part"), *[text(columns[k]).alias(f"{k}") for k in others]).unpivot(["part"], [f"{k}" for k in others], "k", "text")
        counted = texts.groupBy("part", "k", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.col("k").cast("int"))
        whole = [k for k in others if is_number(columns[k])]
        parts.append(counted.select("part", "k", "text", F.when(F.col("k").isin(whole), F.expr("try_cast(text as double)")).alias("num"), "n"))
    if not parts:
        return df.select(F.col(f"`{by}`").alias("part"), F.lit(-1).alias("k"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("num"), F.lit(1).cast("bigint").alias("n"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def off_domain(columns: list[str], domains: dict[str, Domain]) -> Column:
    """Whether the value of a row (k, mask, num) is off its column's domain, by its mask where that settles it."""
    bad = F.lit(False)
    of: dict[Domain, list[int]] = {}
    for k, name in enumerate(columns):
        if name in domains:
            of.setdefault(domains[name], []).append(k)
    for domain, own in of.items():
        settled = {verdict: [m for m in NUMBER_MASKS if domain.of_mask(m) is verdict] for verdict in (True, False)}
        mine = F.when(F.col("mask").isin(settled[True]), True).when(F.col("mask").isin(settled[False]), False).otherwise(domain.broken(F.col("num")))
        bad = F.when(F.col("k").isin(own), mine).otherwise(bad)
    return F.coalesce(bad, F.lit(False))


def mask_counts(df: DataFrame, by: str, columns: list[str], domains: dict[str, Domain] | None = None) -> DataFrame:
    """(part, k, mask, values, rows, broken, low, high) for each mask of each column; the mask of missing is null, that of zero is 0."""
    from corvane.functions.text import mask

    return (
        value_histogram(df, by, columns)
        .withColumn("mask", F.when(F.col("num").isNull(), mask("text")).otherwise(number_mask(F.col("num"))))
        .withColumn("off", off_domain(columns, domains or {}))
        .groupBy("part", "k", "mask")
        .agg(
            F.count(F.when(F.col("mask").isNotNull(), 1)).alias("values"),
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("off"), F.col("n")).otherwise(0)).alias("broken"),
            F.min("num").alias("low"),
            F.max("num").alias("high"),
        )
    )


def named(columns: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("k") + 1)


def profile(df: DataFrame, by: str, columns: list[str], domains: dict[str, Domain] | None = None, rare: float = 0.005) -> DataFrame:
    """As profile_of, of the masks of df."""
    return profile_of(mask_counts(df, by, columns, domains), columns, rare)


def profile_of(masks: DataFrame, columns: list[str], rare: float = 0.005) -> DataFrame:
    """One row per load and column: counts, percentages, range, dominant mask, rows under rare masks, rows off the domain.

    A mask is rare if it holds less than `rare` of the column's nonmissing rows and isn't its dominant mask; the
    dominant mask is the most frequent, of equals the first in order.
    """
    every = Window.partitionBy("part", "k")
    order = every.orderBy(F.col("mask").isNull(), F.desc("rows"), "mask")
    present = F.col("mask").isNotNull()
    masks = masks.withColumns({"total": F.sum(F.when(present, F.col("rows")).otherwise(0)).over(every), "place": F.row_number().over(order)})
    unusual = present & (F.col("place") > 1) & (F.col("rows") < rare * F.col("total"))
    return (
        masks.groupBy("part", "k")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(F.when(present, F.col("rows")).otherwise(0)).alias("nonmissing"),
            F.sum("values").alias("unique_values"),
            F.sum(F.when((F.col("mask") == "0") & F.col("low").isNotNull(), F.col("rows")).otherwise(0)).alias("zeros"),
            F.sum("broken").alias("off_domain"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.count(F.when(present, 1)).alias("masks"),
            F.max(F.when(F.col("place") == 1, F.col("mask"))).alias("dominant_mask"),
            F.max(F.when((F.col("place") == 1) & present, F.col("rows"))).alias("dominant_rows"),
            F.sum(F.when(unusual, F.col("rows")).otherwise(0)).alias("rare_mask_rows"),
        )
        .filter("k >= 0")
        .select(
            F.col("part").alias("load"),
            named(columns).alias("feature"),
            "rows",
            "nonmissing",
            (F.col("rows") - F.col("nonmissing")).alias("missing"),
            (100.0 * (F.col("rows") - F.col("nonmissing")) / F.col("rows")).alias("missing_pct"),
            F.when(F.col("nonmissing") > 0, 100.0 * F.col("zeros") / F.col("nonmissing")).alias("zero_pct"),
            "unique_values", "off_domain", "low", "high", "masks", "dominant_mask", "dominant_rows", "rare_mask_rows",
        )
    )


def rare_masks(df: DataFrame, by: str, columns: list[str], rare: float = 0.005) -> DataFrame:
    """(load, feature, mask, rows, share): the masks that less than `rare` of a column's nonmissing rows have."""
    masks = mask_counts(df, by, columns).filter("mask is not null")
    every = Window.partitionBy("part", "k")
    masks = masks.withColumns({"share": F.col("rows") / F.sum("rows").over(every), "place": F.row_number().over(every.orderBy(F.desc("rows"), "mask"))})
    return masks.filter((F.col("share") < rare) & (F.col("place") > 1)).select(F.col("part").alias("load"), named(columns).alias("feature"), "mask", "rows", "share")


def mask_divergence(df: DataFrame, by: str, columns: list[str], previous: DataFrame) -> DataFrame:
    """As divergence_of, of the masks of df."""
    return divergence_of(mask_counts(df, by, columns), columns, previous).drop("present")


def divergence_of(masks: DataFrame, columns: list[str], previous: DataFrame) -> DataFrame:
    """(load, previous_load, feature, divergence, present): Jensen-Shannon divergence, in bits, of the masks of a column in two loads.

    previous has (load, previous_load). For divergence missing counts as a mask of its own, so that a change in missing values shows;
    present is the divergence among nonmissing values, null where either load has none.
    Loads that have no rows give no result. 0: alike; 1: no mask in common.
    """
    every = Window.partitionBy("part", "k")
    own = F.when(F.col("mask").isNotNull(), F.col("rows"))
    shares = {"p": F.col("rows") / F.sum("rows").over(every), "v": F.coalesce(own / F.sum(own).over(every), F.lit(0.0))}
    p = masks.withColumns(shares).select("part", "k", F.coalesce("mask", F.lit("\0")).alias("mask"), "p", "v")
    pairs = previous.select("load", "previous_load").distinct().filter("previous_load is not null")
    loads = p.select(F.col("part").alias("load"), "k").distinct()
    both = pairs.join(loads, "load").join(loads.select(F.col("load").alias("previous_load"), "k"), ["previous_load", "k"])
    none = lambda *c: [F.lit(0.0).alias(x) for x in c]
    new = both.join(p.withColumnRenamed("part", "load"), ["load", "k"]).select("load", "previous_load", "k", "mask", "p", "v", *none("q", "w"))
    old = both.join(p.select(F.col("part").alias("previous_load"), "k", "mask", F.col("p").alias("q"), F.col("v").alias("w")), ["previous_load", "k"]).select("load", "previous_load", "k", "mask", *none("p", "v"), "q", "w")
    part = lambda x, y: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) * 2 / (F.col(x) + F.col(y)))).otherwise(0.0)
    present = F.when((F.sum("v") > 0) & (F.sum("w") > 0), F.sum(part("v", "w") + part("w", "v")) / 2)
    return (
        new.unionByName(old)
        .groupBy("load", "previous_load", "k", "mask").agg(*[F.sum(c).alias(c) for c in "pvqw"])
        .groupBy("load", "previous_load", "k").agg((F.sum(part("p", "q") + part("q", "p")) / 2).alias("divergence"), present.alias("present"))
        .select("load", "previous_load", named(columns).alias("feature"), "divergence", "present")
    )


def least_divergence(shift: float) -> float:
    """What the masks of two loads diverge by at least, in bits, where one mask's share differs by more than so many points."""
    return (shift / 100) ** 2 / (2 * math.log(2)) * (1 - 1e-6)


def findings(prof: DataFrame, stored: DataFrame, divergence: DataFrame, tolerance: float = 0.001, shift: float = 10.0) -> DataFrame:
    """(load, feature, finding): where a stored profile is wrong, values are off their domain, or a load differs from the one before.

    stored has load, previous_load, feature, missing_pct, zero_pct, unique_values; repeated rows count once, and of
    differing ones each is held against the rows. A stored row about a load without rows is wrong unless all of it is null.
    divergence, as of divergence_of, says which columns moved enough for a shift to be possible; these are compared exactly.
    """
    now = prof.select("load", "feature", "missing_pct", "zero_pct", "unique_values", "off_domain")
    one = now.select("load", "feature", *[F.col(c).alias(f"own_{c}") for c in ("missing_pct", "zero_pct", "unique_values")])

    def off(a: str, b: str, by: float) -> Column:
        return (F.col(a).isNull() != F.col(b).isNull()) | F.coalesce(F.abs(F.col(a) - F.col(b)) > by, F.lit(False))

    held = stored.select("load", "previous_load", "feature", "missing_pct", "zero_pct", "unique_values").distinct().join(one, ["load", "feature"], "left")
    wrong = off("missing_pct", "own_missing_pct", tolerance) | off("zero_pct", "own_zero_pct", tolerance) | off("unique_values", "own_unique_values", 0)
    before = now.select(F.col("load").alias("previous_load"), "feature", F.col("missing_pct").alias("old_missing"), F.col("zero_pct").alias("old_zero"))
    moved = held.select("load", "previous_load", "feature", "own_missing_pct", "own_zero_pct").distinct().join(before, ["previous_load", "feature"])
    moved = moved.join(divergence.filter(F.greatest("divergence", "present") >= least_divergence(shift)), ["load", "previous_load", "feature"])
    change = lambda a, b: F.round(F.abs(F.round(F.col(a), 6) - F.round(F.col(b), 6)), 4) > shift
    as_row = lambda df, name: df.select("load", "feature", F.lit(name).alias("finding"))
    return (
        as_row(held.filter(wrong), "coverage_wrong")
        .unionByName(as_row(now.filter("off_domain > 0"), "invalid_value"))
        .unionByName(as_row(moved.filter(change("own_missing_pct", "old_missing")), "missing_shift"))
        .unionByName(as_row(moved.filter(change("own_zero_pct", "old_zero")), "zero_shift"))
        .distinct()
    )
