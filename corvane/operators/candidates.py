"""Sets of candidates: the first ones in order, counts of all of them, enumeration within a stated budget, and greedy covers.

What a candidate covers is a mask, so that candidates fall into at most 2^targets classes. Counts of sets and greedy covers
come from these classes alone. The first n sets come from prefixes: an order of classes tells which candidates may begin a set, and of
these only the n first can begin one of the n first sets; the same holds for each further member. So no more than n prefixes of any order
of classes are ever kept, and every step is one pass over the candidates, whose number has no bound.
"""

from __future__ import annotations

from itertools import product
from math import comb

from pyspark.sql import DataFrame, Window, functions as F

BUDGET = 250_000


def check_budget(n: int, k: int, budget: int = BUDGET) -> int:
    """The number of sets of 1 to k of n candidates; raises beyond the budget, since sets are never left out."""
    work = sum(comb(n, i) for i in range(1, min(k, n) + 1))
    if work > budget:
        raise ValueError(f"{work} sets of up to {k} of {n} candidates exceed the budget of {budget}")
    return work


def with_mask(candidates: DataFrame, targets: list[str]) -> DataFrame:
    """candidates (pos, drug, disease_ids) with a bit for each target they cover."""
    mask = sum((F.when(F.array_contains("disease_ids", t), 1 << i).otherwise(0) for i, t in enumerate(targets)), F.lit(0))
    return candidates.select(F.col("pos").alias("last"), F.array("drug").alias("drugs"), mask.cast("bigint").alias("mask"))


def masked(treatments: DataFrame, targets: list[str]) -> DataFrame:
    """(pos, drug, mask) of candidates (pos, drug, disease_ids)."""
    return with_mask(treatments, targets).select(F.col("last").alias("pos"), F.element_at("drugs", 1).alias("drug"), "mask")


def combinations(candidates: DataFrame, targets: list[str], k: int, budget: int = BUDGET) -> DataFrame:
    """(set_id, drugs, size, covered, mask) of every set of 1 to k candidates, members in order of retrieval; raises beyond the budget."""
    check_budget(candidates.count(), k, budget)
    one = with_mask(candidates, targets)
    level, every = one, one
    for _ in range(k - 1):
        # candidates are at most some hundred rows here: the budget bounds them
        nxt = F.broadcast(one.select(F.col("last").alias("p"), F.col("drugs").alias("d"), F.col("mask").alias("m")))
        level = level.join(nxt, F.col("p") > F.col("last")).select(F.col("p").alias("last"), F.concat("drugs", "d").alias("drugs"), F.col("mask").bitwiseOR(F.col("m")).alias("mask"))
        every = every.unionByName(level)
    return named_sets(every)


def named_sets(sets: DataFrame) -> DataFrame:
    return sets.select(F.concat(F.lit("candidate-set:"), F.array_join("drugs", "+")).alias("set_id"), "drugs", F.size("drugs").alias("size"), F.bit_count("mask").alias("covered"), "mask")


def class_sizes(candidates: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Number, first and last place of the candidates of each mask; at most 2^targets rows."""
    got = candidates.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    return {r["mask"]: (r["n"], r["a"], r["b"]) for r in got}


def set_counts(candidates: DataFrame, k: int) -> DataFrame:
    """(size, covered, sets): how many of all sets of 1 to k candidates (pos, drug, mask) cover so many targets; none is enumerated."""
    sizes = {m: n for m, (n, _, _) in class_sizes(candidates).items()}
    every = 0
    for m in sizes:
        every |= m
    within = {}
    for m in range(every + 1):
        if m | every == every:
            within[m] = sum(n for c, n in sizes.items() if c | m == m)
    rows = {}
    for size in range(1, k + 1):
        exact: dict[int, int] = {}
        for m in sorted(within, key=lambda x: (x.bit_count(), x)):
            # sets within m, less those that are within a part of it
            exact[m] = comb(within[m], size) - sum(n for c, n in exact.items() if c | m == m)
            if exact[m]:
                rows[size, m.bit_count()] = rows.get((size, m.bit_count()), 0) + exact[m]
    return candidates.sparkSession.createDataFrame([(s, c, n) for (s, c), n in sorted(rows.items())], "size int, covered int, sets bigint")


def first_sets(candidates: DataFrame, k: int, n: int = 100) -> DataFrame:
    """(set_id, drugs, size, covered, mask) of the first n of all sets of 1 to k candidates (pos, drug, mask), in the order of best_sets.

    candidates should be a written table; ids hold no +.
    """
    spark = candidates.sparkSession
    sizes = class_sizes(candidates)
    orders: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    for size in range(1, k + 1):
        for order in product(sorted(sizes), repeat=size):
            mask = 0
            for m in order:
                mask |= m
            orders.setdefault((-mask.bit_count(), size), []).append(order)
    found, got = None, 0
    for group in sorted(orders):
        if got >= n:
            break
        part = prefixes(candidates, orders[group], sizes, n)
        if part is None:
            continue
        part = spark.createDataFrame(part.orderBy("key").limit(n - got).collect(), part.schema)  # at most n rows
        got += part.count()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "drugs array<string>, mask bigint, key string")
    return named_sets(found.select("drugs", "mask"))


def prefixes(candidates: DataFrame, orders: list[tuple[int, ...]], sizes: dict[int, tuple[int, int, int]], n: int) -> DataFrame | None:
    """(drugs, mask, key) of the first n sets of each order of classes."""
    spark = candidates.sparkSession
    length = len(orders[0])
    # ends[t][order]: where the member at t must stand at the latest, so that others can follow
    ends: list[dict[tuple[int, ...], int]] = [{} for _ in range(length)]
    ends[-1] = {o: sizes[o[-1]][2] for o in orders}
    for t in reversed(range(length - 1)):
        wanted = sorted({(o[t], ends[t + 1][o]) for o in orders if o in ends[t + 1]})
        if not wanted:
            return None
        last = candidates.agg(*[F.max(F.when((F.col("mask") == m) & (F.col("pos") < at), F.col("pos"))).alias(f"m{i}") for i, (m, at) in enumerate(wanted)]).first()
        place = {w: last[f"m{i}"] for i, w in enumerate(wanted)}
        ends[t] = {o: place[o[t], ends[t + 1][o]] for o in ends[t + 1] if place[o[t], ends[t + 1][o]] is not None}
    good = [o for o in orders if all(o in e for e in ends)]
    if not good:
        return None
    plan = [(i, t, o[t], ends[t][o]) for i, o in enumerate(good) for t in range(length)]
    steps = spark.createDataFrame(plan, "seq int, t int, mask bigint, latest bigint")
    kept = None
    for t in range(length):
        step = F.broadcast(steps.filter(F.col("t") == t).select("seq", F.col("mask").alias("m"), "latest"))  # a row for each order
        own = candidates.select("pos", "drug", "mask").join(step, (F.col("mask") == F.col("m")) & (F.col("pos") <= F.col("latest")))
        one = F.concat("drug", F.lit("+"))
        if kept is None:
            grown = own.select("seq", "pos", F.array("drug").alias("drugs"), F.col("mask"), one.alias("key"))
        else:
            before = F.broadcast(kept.select(F.col("seq").alias("s"), F.col("pos").alias("p"), F.col("drugs").alias("d"), F.col("mask").alias("b"), F.col("key").alias("k")))  # at most n rows an order
            grown = own.join(before, (F.col("seq") == F.col("s")) & (F.col("pos") > F.col("p"))).select("seq", "pos", F.concat("d", F.array("drug")).alias("drugs"), F.col("mask").bitwiseOR(F.col("b")).alias("mask"), F.concat("k", one).alias("key"))
        order = Window.partitionBy("seq").orderBy("key")
        kept = grown.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")
    return kept.select("drugs", "mask", "key")


def compare_rankings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(set_id, old_rank, new_rank, change) of two rankings (set_id, rank): shared sets are the same or moved, the others added or removed."""
    a, b = before.select("set_id", F.col("rank").alias("old_rank")), after.select("set_id", F.col("rank").alias("new_rank"))
    change = F.when(F.col("old_rank").isNull(), "added").when(F.col("new_rank").isNull(), "removed").when(F.col("old_rank") != F.col("new_rank"), "moved").otherwise("same")
    return a.join(b, "set_id", "full").withColumn("change", change)


def cover_by_classes(candidates: DataFrame, targets: int, max_members: int = 5, least: float = 0.8) -> list[str]:
    """As greedy_cover, of candidates (pos, drug, mask): a pick leaves nothing to gain in its class, so that the first of each class is enough."""
    first = sorted(((r["pos"], r["drug"], r["mask"]) for r in candidates.groupBy("mask").agg(F.min("pos").alias("pos"), F.min_by("drug", "pos").alias("drug")).collect()))
    names = {i: f"{i}" for i in range(targets)}
    return greedy_cover([(drug, {names[i] for i in names if m >> i & 1}) for _, drug, m in first], list(names.values()), max_members, least)


def settings(max_drugs: object = None, max_sets: object = None, coverage: object = None) -> dict[str, float]:
    """The limits of a request, with defaults: 3 drugs a set and 100 sets, at least one of each; a share of 0.8, within 0 and 1."""
    number = lambda x, default: default if x is None or isinstance(x, bool) or not isinstance(x, (int, float)) or x != x else x
    return {"max_drugs": max(1, int(number(max_drugs, 3))), "max_sets": max(1, int(number(max_sets, 100))), "coverage": min(1.0, max(0.0, float(number(coverage, 0.8))))}


def best_sets(sets: DataFrame, n: int = 100) -> DataFrame:
    """The first n sets: most covered, then smallest, then by id."""
    return sets.orderBy(F.desc("covered"), "size", "set_id").limit(n)


def rank(sets: DataFrame) -> DataFrame:
    return sets.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("covered"), "size", "set_id")))


def page(ranked: DataFrame, number: int, size: int = 5) -> DataFrame:
    """One page of rows with a rank from 1 on; numbers below the first page or behind the last one give that page."""
    last = ranked.agg(F.greatest(F.lit(1), F.ceil(F.max("rank") / size)).alias("last"))
    at = F.least(F.greatest(F.lit(number), F.lit(1)), F.coalesce("last", F.lit(1)))
    return ranked.join(F.broadcast(last), (F.col("rank") > (at - 1) * size) & (F.col("rank") <= at * size)).drop("last")  # one row


def greedy_cover(members: list[tuple[str, set[str]]], targets: list[str], max_members: int = 5, least: float = 0.8) -> list[str]:
    """Names whose sets cover the targets, the largest gain first, of equal gains the earlier; a plain loop over a few winners."""
    goal, covered, chosen = set(targets), set(), []
    left = list(members)
    while left and len(chosen) < max_members and len(covered) < least * len(goal):
        name, own = max(left, key=lambda m: len((m[1] & goal) - covered))
        if not (own & goal) - covered:
            break
        covered |= own & goal
        chosen.append(name)
        left = [m for m in left if m[0] != name]
    return chosen


def greedy_set_cover(sets: list[tuple[str, list[str], set[str]]], targets: list[str], max_drugs: int = 5, least: float = 0.8) -> list[str]:
    """The same over sets of drugs: those that would bring more than max_drugs drugs together aren't eligible; of equal
    gains the set with the larger cover, then with fewer drugs, then the earlier."""
    goal, covered, drugs, chosen = set(targets), set(), set(), []
    left = list(sets)
    while left and len(covered) < least * len(goal):
        fit = [s for s in left if len(drugs | set(s[1])) <= max_drugs]
        if not fit:
            break
        best = max(fit, key=lambda s: (len((s[2] & goal) - covered), len(s[2] & goal), -len(s[1])))
        if not (best[2] & goal) - covered:
            break
        chosen.append(best[0])
        covered |= best[2] & goal
        drugs |= set(best[1])
        left = [s for s in left if s[0] != best[0]]
    return chosen
