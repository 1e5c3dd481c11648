"""Models on Spark: boosted trees, out-of-fold scores, external validation with a frozen threshold, search, PCA."""

from __future__ import annotations

import json
import random
import time

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators import enrich, metrics, sampling, tuning
from lociflow.operators.clean import align_features, check_classes
from lociflow.operators.scale import fit_impute, fit_scale, impute, scale
from lociflow.sources.shared import written

#: Defaults of the boosted trees.
TREES = {"maxIter": 100, "stepSize": 0.02, "maxDepth": 5, "minInstancesPerNode": 60, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
#: Weights of the search's objective.
OBJECTIVE = {"mcc": 0.50, "auroc": 0.25, "auprc": 0.15, "brier": -0.10}


class Scorer:
    """Imputation, scaling and trees, fitted on the training part; `validation` rows stop the boosting early."""

    def __init__(self, features: list[str], label: str, **params):
        self.features, self.label, self.params = features, label, TREES | params

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> Scorer:
        self.medians = fit_impute(train, self.features)
        self.scaling = fit_scale(impute(train, self.medians), self.features)
        rows = train.withColumn("_validation", F.lit(False))
        if validation is not None:
            rows = rows.unionByName(validation.withColumn("_validation", F.lit(True)), allowMissingColumns=True)
        trees = GBTClassifier(featuresCol="_x", labelCol="_y", **self.params)
        if validation is not None:
            trees = trees.setValidationIndicatorCol("_validation")
        self.model = trees.fit(self.prepared(rows).withColumn("_y", F.col(self.label).cast("double")).select("_x", "_y", "_validation"))
        return self

    def prepared(self, df: DataFrame) -> DataFrame:
        ready = scale(impute(df, self.medians), self.scaling)
        return VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(ready)

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, y, p)"""
        out = self.model.transform(self.prepared(df))
        return out.select(key, F.col(self.label).cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


def oof_predict(df: DataFrame, key: str, group: str, label: str, features: list[str], k: int = 5, **params) -> DataFrame:
    """(key, y, p, fold): each row scored once, by the model that did not see its group. A fold's parts are written, as dozens of jobs read them."""
    out = None
    for fold in range(k):
        parts = written(sampling.nested_split(df, group, label, fold, k), "parts")
        model = Scorer(features, label, **params).fit(parts.filter("part = 'train'"), parts.filter("part = 'validation'"))
        scored = model.predict(parts.filter("part = 'test'"), key).withColumn("fold", F.lit(fold))
        out = scored if out is None else out.unionByName(scored)
    return out


def deoverlap(external: DataFrame, internal: DataFrame, group: str, variant: list[str]) -> DataFrame:
    """External rows whose group, and whose variant where both sides have its columns, is not internal."""
    out = enrich.anti(external, internal, [group])
    if variant and all(c in external.columns and c in internal.columns for c in variant):
        out = enrich.anti(out, internal, variant)
    return out


def validate_external(train: DataFrame, external: DataFrame, key: str, group: str, label: str, features: list[str], variant: list[str] = [], **params) -> DataFrame:
    """Metrics of a disjoint external set at the threshold that the internal validation part chose."""
    external = deoverlap(external, train, group, variant)
    align_features(train, external, features)
    check_classes(external, label)
    parts = sampling.nested_split(train, group, label, 0)
    validation = parts.filter("part <> 'train'")
    model = Scorer(features, label, **params).fit(parts.filter("part = 'train'"), validation)
    threshold = metrics.select_threshold(model.predict(validation, key))
    return metrics.evaluate(model.predict(external, key), threshold)


def search(df: DataFrame, space: dict[str, list], n: int, key: str, group: str, label: str, features: list[str], k: int = 3, seed: int = 42, **fixed) -> DataFrame:
    """(trial, params, mcc, auroc, auprc, brier, objective, seconds) of n random settings, each by grouped cross-validation."""
    rng, rows = random.Random(seed), []
    for trial in range(n):
        chosen = {name: rng.choice(values) for name, values in sorted(space.items())}
        began = time.time()
        pred = oof_predict(df, key, group, label, features, k, **(fixed | chosen))
        m = metrics.evaluate(pred, metrics.select_threshold(pred)).first()
        objective = sum(w * (m[name] or 0.0) for name, w in OBJECTIVE.items())
        rows.append((trial, json.dumps(chosen), m["mcc"], m["auroc"], m["auprc"], m["brier"], objective, time.time() - began))
    return df.sparkSession.createDataFrame(rows, "trial int, params string, mcc double, auroc double, auprc double, brier double, objective double, seconds double")


def adaptive_search(df: DataFrame, space: dict, n: int, key: str, group: str, label: str, features: list[str], k: int = 3, seed: int = 42, parallel: int = 4, startup: int = tuning.STARTUP, **fixed) -> DataFrame:
    """(trial, params, mcc, auroc, auprc, brier, objective, seconds) of n settings that a Parzen sampler chooses, each by grouped cross-validation;
    `parallel` trials at a time, with the same history for a seed."""

    def measured(chosen: dict) -> tuple[float, dict]:
        pred = oof_predict(df, key, group, label, features, k, **(fixed | chosen))
        m = metrics.evaluate(pred, metrics.select_threshold(pred)).first()
        return sum(w * (m[name] or 0.0) for name, w in OBJECTIVE.items()), {name: m[name] for name in OBJECTIVE}

    rows = []
    for trial, params, objective, seconds, kept in tuning.tune(df.sparkSession, measured, space, n, seed, parallel, startup):
        m = json.loads(kept)
        rows.append((trial, params, m["mcc"], m["auroc"], m["auprc"], m["brier"], objective, seconds))
    return df.sparkSession.createDataFrame(rows, "trial int, params string, mcc double, auroc double, auprc double, brier double, objective double, seconds double")


def confirm(df: DataFrame, history: DataFrame, key: str, group: str, label: str, features: list[str], k: int = 5, **fixed) -> DataFrame:
    """Metrics by `setting`: the best of a search (the first trial of equals) and the defaults, each fitted and scored anew on k folds."""
    best = history.orderBy(F.col("objective").desc(), "trial").first()
    if best is None:
        raise ValueError("the search has no trial")
    every = None
    for name, params in (("default", fixed), ("best", fixed | json.loads(best["params"]))):
        pred = oof_predict(df, key, group, label, features, k, **params).withColumn("setting", F.lit(name))
        every = pred if every is None else every.unionByName(pred)
    return metrics.evaluate(every, metrics.select_threshold(every, ["setting"]), ["setting"])


def project(df: DataFrame, key: str, embedding: str, k: int = 2) -> DataFrame:
    """(key, x): principal components of all non-zero embeddings; `sampling.subsample` the rows first for a sample's."""
    rows = df.filter(F.exists(embedding, lambda v: v != 0)).select(key, array_to_vector(embedding).alias("_v"))
    if rows.isEmpty():
        return rows.select(key, F.array().cast("array<double>").alias("x"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).select(key, vector_to_array("_p").alias("x"))
