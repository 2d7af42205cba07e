"""Classification metrics as plain aggregates over rows (truth, predicted, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.ordered import running_sum


def confusion(rows: DataFrame, classes: list[str]) -> DataFrame:
    """A row per true class, a column per predicted one; classes without rows are zero."""
    grid = rows.sparkSession.createDataFrame([(c,) for c in classes], "truth string")
    got = rows.groupBy("truth").agg(*[F.count(F.when(F.col("predicted") == c, 1)).alias(c.lower()) for c in classes])
    return grid.join(got, "truth", "left").fillna(0)


def per_class(rows: DataFrame, classes: list[str]) -> DataFrame:
    """(class, precision, recall, f1, support); a metric without a denominator is zero."""
    cells = rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    n, none = F.col("n"), F.lit(0).cast("bigint")
    # a cell counts for its true class and for its predicted one
    mine = F.struct(F.col("truth").alias("class"), F.when(F.col("truth") == F.col("predicted"), n).otherwise(none).alias("tp"), none.alias("p"), n.alias("support"))
    theirs = F.struct(F.col("predicted").alias("class"), none.alias("tp"), n.alias("p"), none.alias("support"))
    sums = cells.select(F.explode(F.array(mine, theirs)).alias("x")).groupBy("x.class").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "p", "support")])
    sums = grid.join(sums, "class", "left").fillna(0)
    precision, recall = F.coalesce(F.col("tp") / F.nullif("p", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("p") + F.col("support"), F.lit(0)), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp")


def summary(classes: DataFrame) -> DataFrame:
    n = F.sum("support")
    return classes.agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("balanced_accuracy"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), (F.sum("tp") / n).alias("accuracy"))


def auroc(rows: DataFrame) -> DataFrame:
    """(class, auroc) from (class, positive, score): rank sums, tied scores share their mean rank."""
    one = rows.groupBy("class", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("positive").alias("p"))
    upto = running_sum(one, ["class"], "score", "n", "upto")
    g = upto.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).groupBy("class").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.select("class", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auroc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(class, average_precision): recall steps at each distinct score."""
    one = rows.groupBy("class", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("positive").alias("p"))
    steps = running_sum(running_sum(one, ["class"], "score", "p", "tp", descending=True), ["class"], "score", "n", "all", descending=True)
    return steps.groupBy("class").agg((F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))
