"""Splits in which rows that share an entity stay together.

Entities are the nodes of a graph, and each row that holds two of them is an edge; edges are distinct before anything else, so
that an entity on a third of all rows is no more than one node. Components come from alternating large-star and
small-star rounds, each a map-side combined minimum and one join; a star's centre is never collected. Rounds are written
to the shared folder. Rows then take the component of either of their entities.

Components are hashed into 4,096 ranges, whose sizes alone reach the driver. The largest components, at most
1,000 and each of more than 0.1 % of the rows, are placed first, each where most is missing; the ranges are then cut at
the remaining shares. A row without an entity is a component of its own.

Entities count trimmed and in any case; blank ones, and repeated ones, count once or not at all. Rows with null ids on
both sides are on their own. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import filled, folded
from corvane.session import Scratch, attach

BUCKETS, LARGE = 4096, 1000


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node; edges has a, b of one type that can be ordered."""
    e = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).filter("node is not null").distinct()

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        ways = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            ways = ways.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        near = attach(ways, least, ["u"], "n", total=total)
        # large star: bigger neighbours to the least one; small star: all smaller neighbours and the node itself
        moved = near.filter("v > u") if large else near.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        return scratch.keep(moved.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(rounds):
        # a large star has no more edges than it came from
        e = star(star(e, True, 2 * seen[0]), False, seen[0])
        # a forest of stars is what two rounds leave as it is
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def tied_rows(rows: DataFrame, row_id: str, sides: list[str], entities: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with row and component, null if it has no entity; component, group_row_id and its number of rows).

    entities has one column of ids; only those tie rows.
    """
    known = entities.select(filled(entities.columns[0]).alias("e")).filter("e is not null").select(F.lower("e").alias("e")).distinct().withColumn("one", F.lit(1))
    a, b = (folded(s) for s in sides)
    pairs = rows.select(F.col(row_id).alias("row"), a.alias("x"), b.alias("y"))
    pairs = mark(mark(pairs, "x", known), "y", known)
    pairs = scratch.keep(pairs)
    edges = pairs.filter("x is not null or y is not null").select(F.coalesce("x", "y").alias("a"), F.coalesce("y", "x").alias("b")).distinct()
    comp = scratch.keep(components(scratch.keep(edges), scratch))
    counted = pairs.filter("x is not null or y is not null").groupBy(F.coalesce("x", "y").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"))
    comp = scratch.keep(comp.join(counted, "node", "left").fillna(0, ["n"]))
    groups = scratch.keep(comp.groupBy("component").agg(F.min("least").alias("group_row_id"), F.sum("n").alias("size")))
    tied = attach(pairs.select("row", F.coalesce("x", "y").alias("node")), comp.select("node", "component", "n"), ["node"], "n", "left").select("row", "component")
    return tied, groups


def mark(pairs: DataFrame, side: str, known: DataFrame) -> DataFrame:
    """Nulls the side where its id isn't known. The known ids that occur often are met by a broadcast, the others by a shuffle."""
    often = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).join(known.withColumnRenamed("e", side), side)
    return attach(pairs, often, [side], "n", "left").select(*[F.when(F.col("one").isNotNull(), F.col(side)).alias(side) if c == side else F.col(c) for c in pairs.columns])


def place(sizes: list[tuple[int, int]], large: list[tuple[object, int]], shares: dict[str, float]) -> tuple[dict, list[str]]:
    """The split of each large component, and of each bucket, from the rows they hold."""
    total = sum(n for _, n in sizes) + sum(n for _, n in large)
    left = {s: share * total for s, share in shares.items()}
    put = {}
    for key, n in sorted(large, key=lambda x: (-x[1], str(x[0]))):
        s = max(left, key=lambda s: left[s])
        put[key], left[s] = s, left[s] - n
    by, count = [], dict(sizes)
    names = [s for s in shares if left[s] > 0] or [max(left, key=lambda s: left[s])]
    rest, k, used = sum(count.values()), 0, 0.0
    scale = rest / (sum(left[s] for s in names) or 1)
    for bucket in range(BUCKETS):
        n = count.get(bucket, 0)
        while k < len(names) - 1 and used + n / 2 > left[names[k]] * scale:
            k, used = k + 1, 0.0
        by.append(names[k])
        used += n
    return put, by


def assign(tied: DataFrame, groups: DataFrame, shares: dict[str, float], salt: str = "split") -> DataFrame:
    """(row, split)."""
    total = tied.count()
    bucket = lambda c: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(BUCKETS)).cast("int")
    key = F.when(F.col("component").isNotNull(), F.concat(F.lit("c"), F.col("component"))).otherwise(F.concat(F.lit("r"), F.col("row").cast("string")))
    large = groups.filter(F.col("size") * LARGE > total).select("component", "size").collect()  # at most LARGE rows
    names = [r["component"] for r in large]
    is_large: Column = F.col("component").isin(names) if names else F.lit(False)
    keyed = tied.withColumns({"large": F.coalesce(is_large, F.lit(False)), "bucket": bucket(key)})
    sizes = [(r["bucket"], r["n"]) for r in keyed.filter("not large").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most BUCKETS rows
    put, by = place(sizes, [(r["component"], r["size"]) for r in large], shares)
    split = F.element_at(F.array(*[F.lit(s) for s in by]), F.col("bucket") + 1)
    if put:
        split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in put.items() for x in kv]), F.col("component")), split)
    return keyed.select("row", split.alias("split"))
