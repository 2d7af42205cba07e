"""Severity models on Spark ML: preparation, training, cross-validation, saving with digests, and prediction that refuses what it can't trust."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from corvane.operators import features as X, metrics as M, pairs as P
from corvane.quality import profile as R

CLASSES = ["Major", "Moderate", "Minor"]


def clean(df: DataFrame, names: list[str]) -> DataFrame:
    """NaN as null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def scaling(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Per feature the exact median and, after it fills what is missing, mean and population deviation; len(names) rows reach the driver."""
    h = R.value_histogram(train.withColumn("all", F.lit(1)), "all", names).filter("num is not null").select("k", "num", "n")
    medians = {names[r["k"]]: r["m"] for r in X.exact_quantiles(h, ["k"], {"m": 0.5}).collect()}
    filled = train.select(*[F.coalesce(c, F.lit(medians.get(c, 0.0))).alias(c) for c in names])
    one = filled.agg(*[F.avg(c).alias(f"a_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    return {c: (medians.get(c, 0.0), one[f"a_{c}"] or 0.0, one[f"s_{c}"] or 1.0) for c in names}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float, float]]) -> DataFrame:
    """df with x_<feature> for each, filled and scaled, and label, the index of its class."""
    cols = {f"x_{c}": (F.coalesce(c, F.lit(m)) - F.lit(a)) / F.lit(s) for c, (m, a, s) in scale.items()}
    label = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("ddi_severity")).cast("double") - 1
    return df.withColumns(cols).withColumn("label", label)


def specs(seed: int = 42) -> dict:
    """The approved models by name."""
    return {
        "logistic": lambda: LogisticRegression(maxIter=100, family="multinomial"),
        "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=8, seed=seed),
        "boosting": lambda: OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=4, seed=seed)),
    }


def fit(name: str, train: DataFrame, names: list[str]) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=[f"x_{c}" for c in names], outputCol="features"), specs()[name]()]).fit(train)


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with truth and predicted, as classes."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return model.transform(rows).withColumns({"truth": F.col("ddi_severity"), "predicted": F.element_at(names, F.col("prediction").cast("int") + 1)})


def cross_validate(name: str, rows: DataFrame, features: list[str], k: int = 5, key: str = "row_id") -> DataFrame:
    """(fold, macro_f1, accuracy) of k fits; filling and scaling are learnt within each fold's training rows."""
    split = P.folds(clean(rows, features), "ddi_severity", key, k)
    out = None
    for fold in range(k):
        train, test = split.filter(F.col("fold") != fold), split.filter(F.col("fold") == fold)
        s = scaling(train, features)
        got = M.summary(M.per_class(predicted(fit(name, scaled(train, s), features), scaled(test, s)), CLASSES)).select(F.lit(fold).alias("fold"), "macro_f1", "accuracy")
        out = got if out is None else out.unionByName(got)
    return out


def digests(folder: Path) -> dict[str, str]:
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(folder.rglob("*")) if p.is_file() and not p.name.startswith(".") and p.name != "manifest.json"}


def save(model: PipelineModel, scale: dict, folder: str) -> None:
    """Writes a model once; a folder that exists is refused."""
    root = Path(folder)
    if root.exists():
        raise FileExistsError(f"{folder} exists; a final model is written once")
    model.save(f"file://{root.resolve()}/model")
    (root / "scale.json").write_text(json.dumps(scale, indent=2, sort_keys=True))
    (root / "manifest.json").write_text(json.dumps({"features": list(scale), "files": digests(root)}, indent=2, sort_keys=True))


def load(folder: str, features: list[str]) -> tuple[PipelineModel, dict]:
    """A saved model, if its files are those that were written and its features are the expected ones, in order."""
    root = Path(folder)
    manifest = json.loads((root / "manifest.json").read_text())
    if manifest["files"] != digests(root):
        raise ValueError(f"files of {folder} aren't those of its manifest")
    if manifest["features"] != features:
        raise ValueError("features differ from those of the model")
    return PipelineModel.load(f"file://{root.resolve()}/model"), {k: tuple(v) for k, v in json.loads((root / "scale.json").read_text()).items()}
