"""One surviving record for each group of duplicates, value by value.

Each record of a group has, for each field, a usable value or none (together its completeness), a recency and a trust.
Records of one group with the same usable fields and the same trust form a cell, of which only the most recent, then the
smallest id, can be undominated or ever win. So groups are first reduced, map-side combined, to at most
2^fields x trust levels cells each, whatever their number of rows; the skyline and its further layers are then taken
over the cells. A cell is in layer 1 if no cell is at least as good in completeness, recency and trust and better in one;
layer 2 is the skyline of what is left, and so on.

Fields are filled under a policy, an order of the criteria (recency, trust, completeness) that always ends with the
smallest id. by="layer": layers come first, so a null of layer 1 is filled from layer 2. by="field": each field has a skyline
of its own, of the records with a usable value of that field that no other such record matches in completeness, recency, trust
and smallness of id; the policy chooses within it. So a field is never left null while any record has it, and what the policy
prefers first, the smaller id deciding, is never dominated if the policy begins with recency.

Null recency is older than any. Groups of one record are left out unless single is set. Fields without a usable
value give null. Rows with a null id are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cells(rows: DataFrame, group: list[str], row_id: str, usable: dict[str, Column], recency: str, trust: Column) -> DataFrame:
    """(group..., has, trust, best{recent, minus}, n): the best record of each combination within each group, and its size."""
    has = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(usable.values())), F.lit(0))
    kind = dict(rows.dtypes)[recency]
    oldest = F.lit("0001-01-01 00:00:00" if kind.startswith(("timestamp", "date")) else "-9000000000000000000").cast(kind)
    best = F.struct(F.coalesce(recency, oldest).alias("recent"), (-F.col(row_id)).alias("minus"))
    return rows.filter(F.col(row_id).isNotNull()).groupBy(*group, has.alias("has"), trust.cast("int").alias("trust")).agg(F.max(best).alias("best"), F.min(row_id).alias("first"), F.count(F.lit(1)).alias("n"))


def survivors(
    rows: DataFrame, group: list[str], row_id: str, usable: dict[str, Column], recency: str, trust: Column | None = None,
    policy: tuple[str, ...] = ("recency", "trust", "completeness"), by: str = "field", single: bool = False,
) -> DataFrame:
    """(group..., group_row_id, copies, layers, skyline, <field>_row_id...): the id of the record that gives each field, null if none.

    by="field" has no layers of whole records: layers is null, and skyline the number of cells in any field's skyline.
    """
    trust = F.lit(0) if trust is None else trust
    part = cells(rows, group, row_id, usable, recency, trust)
    item = F.struct("has", "trust", F.col("best.recent").alias("recency"), F.col("best.minus").alias("minus"), F.bit_count("has").alias("completeness"))
    g = part.groupBy(*group).agg(F.collect_list(item).alias("cells"), F.min("first").alias("group_row_id"), F.sum("n").alias("copies"))
    g = g if single else g.filter("copies > 1")

    def beats(a: Column, b: Column, on: tuple[str, ...]) -> Column:
        least, more = F.lit(True), F.lit(False)
        for k in on:
            least, more = least & (a[k] >= b[k]), more | (a[k] > b[k])
        return least & more

    every = ("completeness", "recency", "trust")
    # peel layer after layer: the cells that nothing left beats get the number of the round
    most = F.size("cells")
    kinds = "layer:int,has:int,trust:int,recency:{},minus:bigint,completeness:int".format(dict(rows.dtypes)[recency])
    start = F.struct(F.col("cells").alias("left"), F.expr(f"cast(array() as array<struct<{kinds}>>)").alias("done"))

    place = lambda x, k: F.struct(k.cast("int").alias("layer"), *[x[c].alias(c) for c in ("has", "trust", "recency", "minus", "completeness")])

    def peel(s: Column, k: Column) -> Column:
        beaten = lambda x: F.exists(s["left"], lambda y: beats(y, x, every))
        top = F.transform(F.filter(s["left"], lambda x: ~beaten(x)), lambda x: place(x, k))
        return F.when(F.size(s["left"]) == 0, s).otherwise(F.struct(F.filter(s["left"], beaten).alias("left"), F.concat(s["done"], top).alias("done")))

    layered = F.aggregate(F.sequence(F.lit(1), most), start, peel)["done"] if by == "layer" else F.transform("cells", lambda x: place(x, F.lit(1)))
    g = g.withColumn("ranked", layered)
    order = [*(["layer"] if by == "layer" else []), *policy, "minus"]
    out, skylines = {}, F.array().cast("array<bigint>")
    for i, name in enumerate(usable):
        own = F.filter("ranked", lambda x: x["has"].bitwiseAND(F.lit(1 << i)) != 0)  # noqa: B023
        # the field's skyline, then its best under the policy
        sky = F.filter(own, lambda x: ~F.exists(own, lambda y: beats(y, x, (*every, "minus")))) if by == "field" else own  # noqa: B023
        skylines = F.array_union(skylines, F.transform(sky, lambda x: x["minus"]))
        first = F.array_max(F.transform(sky, lambda x: F.struct(*[(-x[k] if k == "layer" else x[k]).alias(k) for k in order])))
        out[f"{name}_row_id"] = -first["minus"]
    layers = F.array_max(F.transform("ranked", lambda x: x["layer"])) if by == "layer" else F.lit(None).cast("int")
    top = F.size(F.filter("ranked", lambda x: x["layer"] == 1)) if by == "layer" else F.size(skylines)
    return g.withColumns(out).select(*group, "group_row_id", "copies", layers.alias("layers"), top.alias("skyline"), *out)
