"""Registered queries of models. Their results depend on training, so that no SQL is given."""

from __future__ import annotations

import contextlib
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import metrics as M, models as L, pairs as P
from corvane.session import shared_folder
from corvane.sources.tables import FEATURES, table


def rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "ddinter_severity_dataset").select("row_id", "ddi_severity", *FEATURES)
    return L.clean(s.filter(F.col("ddi_severity").isin(*L.CLASSES)), FEATURES)


def trained(spark: SparkSession, d: str, name: str):  # noqa: ANN201
    split = P.stratified(rows(spark, d), "ddi_severity", "row_id")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    s = L.scaling(train, FEATURES)
    return L.fit(name, L.scaled(train, s), FEATURES), s, L.scaled(test, s)


def report(spark: SparkSession, d: str, name: str) -> DataFrame:
    model, _, test = trained(spark, d, name)
    return M.per_class(L.predicted(model, test), L.CLASSES).drop("tp")


def train_lr(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d, "logistic")


def train_rf(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d, "forest")


def train_gbt_ovr(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d, "boosting")


def cv_report(spark: SparkSession, d: str) -> DataFrame:
    return L.cross_validate("logistic", rows(spark, d), FEATURES)


@contextlib.contextmanager
def stored(spark: SparkSession, d: str) -> Iterator[tuple]:
    """(the final forest, the same as it was written and loaded again, scaling, test rows); written to the shared folder, once."""
    model, s, test = trained(spark, d, "forest")
    folder = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:').rstrip('/')}/model-{uuid.uuid4().hex}"
    try:
        L.save(model, s, folder)
        again, scale = L.load(folder, FEATURES)
        yield model, again, scale, test
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def final_eval(spark: SparkSession, d: str) -> DataFrame:
    with stored(spark, d) as (_, model, _, test):
        return M.summary(M.per_class(L.predicted(model, test), L.CLASSES))


def predict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of all rows by the loaded model: applied with both feature sources, partial with one, not applied without any. Rows without both
    say why and never carry a severity."""
    with stored(spark, d) as (_, model, s, _):
        every = L.predicted(model, L.scaled(rows(spark, d), s))
    graph, structure = F.col("both_hetionet_available") == 1, F.col("both_structures_available") == 1
    ok = F.coalesce(graph & structure, F.lit(False))
    some = F.coalesce(F.col("hetionet_available_count") > 0, F.lit(False)) | F.coalesce(F.col("structure_available_count") > 0, F.lit(False))
    return every.select("row_id", F.when(ok, F.col("predicted")).alias("severity"), F.when(ok, "applied").when(some, "partial").otherwise("not_applied").alias("status"), F.when(~ok, "missing_feature_source").alias("reason"))


def parity_probe(spark: SparkSession, d: str) -> DataFrame:
    """How many predictions of a model change when it is saved, checked and loaded again."""
    with stored(spark, d) as (model, again, _, test):
        a, b = (L.predicted(m, test).select("row_id", F.col("predicted").alias(n)) for m, n in ((model, "p"), (again, "q")))
        n = a.join(b, "row_id").filter("p <> q").count()
    return spark.createDataFrame([(n,)], "changed long")


def predict_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """(status, severity, n) of the predictions."""
    return predict_pairs(spark, d).groupBy("status", "severity").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (train_lr, train_rf, train_gbt_ovr, cv_report, final_eval, predict_pairs, parity_probe, predict_status_counts)}
SQL: dict[str, str] = {}
