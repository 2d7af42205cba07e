"""Running sums and ranks within few, large groups, without putting a group into one task.

Rows are cut into buckets that keep the order; sums of buckets (groups times buckets, a bounded number) give every
bucket its start, and only within a bucket are rows sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def started(df: DataFrame, keys: list[str], bucket: Column, value: Column) -> DataFrame:
    """df with __bucket, and in __before the sum of value over the group's earlier buckets."""
    x = df.withColumn("__bucket", bucket)
    sums = x.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    return x.join(F.broadcast(starts), [*keys, "__bucket"])


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, descending: bool = False, buckets: int = 64) -> DataFrame:
    """df with the sum of value up to and including each row; order must be unique and not null within a group."""
    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []))
    # no lambda here: the optimizer would infer a filter on the other side of the join from it, without its column
    place = sum(((F.col(order) > F.lit(float(c))).cast("int") for c in cuts), F.lit(0))
    x = started(df, keys, -place if descending else place, F.col(value))
    w = Window.partitionBy(*keys, "__bucket").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(name, F.col("__before") + F.sum(value).over(w)).drop("__bucket", "__before")


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with the row number of each row within its group; bucket must keep the order, and order be total."""
    x = started(df, keys, bucket, F.lit(1))
    w = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return x.withColumn(name, F.col("__before") + F.row_number().over(w)).drop("__bucket", "__before")


def rank_by_digest(df: DataFrame, keys: list[str], of: str, name: str) -> DataFrame:
    """df with the row number of each row by the digest of a column, then the column itself, within each group."""
    digest = F.md5(F.col(of).cast("string"))
    return rank_within(df, keys, F.substring(digest, 1, 2), [digest, F.col(of)], name)
