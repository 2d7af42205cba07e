"""Session defaults and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows beyond which a side is never broadcast by hand; a row is at most some 100 bytes where this is used.
BROADCAST_ROWS = 100_000


def local_session(app: str = "corvane", cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their Python workers need no path of their own."""
    context = spark.sparkContext
    if getattr(context, "_corvane_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/corvane.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"corvane/{p.relative_to(here)}")
    context.addPyFile(f"{folder}/corvane.zip")
    context._corvane_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and one machine does all."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, True)
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive the loss of any executor."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/corvane-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df as a written table, in a folder for each value of `by`. Its rows are computed once."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes the tables; at the end of the process, since lazily read results may still need them."""
        if "://" not in self.root or self.root.startswith("file:"):
            shutil.rmtree(self.root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            return
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may have ended first
            pass


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores, for work in Python: small inputs come in fewer, large ones in more and stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", share: int = 1000, total: int | None = None) -> DataFrame:
    """rows joined with one row per key of groups, whatever the skew of the keys in rows.

    groups has one row per key and in `size` the number of rows of that key. Keys of more than 1/share of all rows
    are at most `share` many, so that they can be broadcast; the other keys are joined by a shuffle in which no key
    is large. how: inner or left; rows with a null key have no partner. total: the sum of `size`, where it is known.
    """
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * share > total)
    value = [c for c in groups.columns if c not in keys]
    first = rows.join(F.broadcast(hot.select(*keys, F.struct(*value).alias("__hot"))), keys, "left")
    spread = F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")])
    names = [f"__k{i}" for i in range(len(keys))]
    cold = groups.filter(F.col(size) * share <= total).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.struct(*value).alias("__cold"), F.lit(0).cast("bigint").alias("__salt"))
    # a row that has its partner goes to any partition, under a salt that no cold key has
    first = first.withColumns({n: F.col(k) for k, n in zip(keys, names)} | {"__salt": F.when(F.col("__hot").isNull(), F.lit(0).cast("bigint")).when(spread == 0, 1).otherwise(spread)})
    joined = first.join(cold, [*names, "__salt"], "left")
    one = F.coalesce("__hot", "__cold")
    if how == "inner":
        joined = joined.filter(one.isNotNull())
    return joined.select(*rows.columns, *[one[c].alias(c) for c in value])


def pieces(a: DataFrame, b: DataFrame, keys: list[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns __i and __j: any two rows with equal keys meet once in a piece (keys, __i, __j) of about `most` by `most` rows.

    Each side is cut by hash and repeated for the other side's cuts, so that no frequent key is one task's burden. Rows with a null key are left out.
    """
    known = " and ".join(f"`{k}` is not null" for k in keys)
    a, b = a.filter(known), b.filter(known)
    n = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for df, c in ((a, "__na"), (b, "__nb"))]
    cuts = lambda c: F.ceil(F.col(c) / most).cast("int").alias(c)
    wide = n[0].join(n[1], keys).filter((F.col("__na") > most) | (F.col("__nb") > most)).select(*keys, (F.col("__na") + F.col("__nb")).alias("__n"), F.struct(cuts("__na"), cuts("__nb")).alias("__cuts"))
    wide = Scratch(a.sparkSession).keep(wide)
    if wide.isEmpty():
        return tuple(df.withColumns({"__i": F.lit(0), "__j": F.lit(0)}) for df in (a, b))

    def cut(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        rows = attach(df, wide, keys, "__n", "left")
        part = F.pmod(F.xxhash64(F.lit("cut"), *[c for c, kind in df.dtypes if not kind.startswith("map")]), F.coalesce(F.col("__cuts")[own], F.lit(1))).cast("int")
        return rows.select(*df.columns, part.alias(mine), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__cuts")[other], F.lit(1)) - 1)).alias(theirs))

    return cut(a, "__na", "__nb", "__i", "__j"), cut(b, "__nb", "__na", "__j", "__i")


def crossed(a: DataFrame, b: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """All pairs of rows with equal keys, as an inner join, by pieces()."""
    a, b = pieces(a, b, keys, most)
    return a.hint("merge").join(b, [*keys, "__i", "__j"]).drop("__i", "__j")


def is_missing(c: Column, kind: str) -> Column:
    """Null, or NaN in a floating column."""
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()
