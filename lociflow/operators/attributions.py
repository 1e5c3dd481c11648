"""Attributions of boosted trees: each row's margin, shared out among the features (path-dependent tree Shapley values).

A tree says what it expects of a row when only some features are known: at a split on an unknown one it goes both ways, by the shares of training rows. A
feature's attribution is the Shapley value of that game. A leaf's part in it depends on the features on its path alone: for each, whether the row
agrees with all its splits there (a), and the share of training rows that does (b). Over d such features, coefficient k of the product of (b + a t)
over the others is the sum over all sets of k known ones, which weigh k! (d - 1 - k)! / d!. Leaves are worked off one by one, each for a whole
Arrow batch of rows; the model, a few thousand numbers a tree, goes to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators.models import Scorer
from lociflow.sources.shared import delete, new_folder


@dataclass
class Leaf:
    """A leaf's weighted value; by feature on its path the interval (low, high] that leads there and the share of rows that goes that way."""

    value: float
    cover: float
    spans: dict[int, tuple[float, float, float]]


def leaves_of(model) -> list[list[Leaf]]:
    """The leaves of each tree of a fitted boosted model, read from its saved form."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = new_folder(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # the model's nodes
    delete(spark, path)
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for tree, weight in zip((trees[i] for i in sorted(trees)), model.treeWeights):
        found: list[Leaf] = []
        total = float(tree[0]["rawCount"])

        def walk(at: int, spans: dict) -> None:
            node = tree[at]
            if node["leftChild"] < 0:
                found.append(Leaf(weight * node["prediction"], float(node["rawCount"]) / total, spans))
                return
            split = node["split"]
            if split["numCategories"] >= 0:
                raise ValueError("splits by categories have no attributions here")
            feature, threshold = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                low, high, share = spans.get(feature, (-np.inf, np.inf, 1.0))
                share *= float(tree[child]["rawCount"]) / float(node["rawCount"])
                walk(child, spans | {feature: (low, min(high, threshold), share) if left else (max(low, threshold), high, share)})

        walk(0, {})
        out.append(found)
    return out


def base_margin(trees: list[list[Leaf]]) -> float:
    """What the trees expect when nothing is known of a row."""
    return float(sum(leaf.value * leaf.cover for tree in trees for leaf in tree))


def shapley(trees: list[list[Leaf]], x: np.ndarray) -> np.ndarray:
    """Attributions of each row (rows, features) of x; they sum to the row's margin less base_margin."""
    out = np.zeros(x.shape)
    for leaf in (leaf for tree in trees for leaf in tree if leaf.spans):
        features, d = list(leaf.spans), len(leaf.spans)
        agrees = np.stack([(x[:, f] > leaf.spans[f][0]) & (x[:, f] <= leaf.spans[f][1]) for f in features]).astype(float)
        share = np.array([leaf.spans[f][2] for f in features])
        weight = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        for i, f in enumerate(features):
            product = np.zeros((d, len(x)))
            product[0] = 1.0
            for n, j in enumerate(j for j in range(d) if j != i):
                product[1 : n + 2] = product[1 : n + 2] * share[j] + product[: n + 1] * agrees[j]
                product[0] *= share[j]
            out[:, f] += leaf.value * (agrees[i] - share[i]) * (weight @ product)
    return out


def _attribute(trees, names: list[str], key: str):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
            values = shapley(trees.value, x)
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(batch.num_rows), len(names))))
            features = pa.array(names * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([keys, features, pa.array(values.ravel())], [key, "feature", "value"])

    return run


def attributions(scorer: Scorer, df: DataFrame, key: str) -> DataFrame:
    """(key, feature, value) of every row of df, one row a feature: how far it moves the margin from base_margin. Nothing is shuffled.

    The margin is half the logit of the model's probability.
    """
    trees = df.sparkSession.sparkContext.broadcast(leaves_of(scorer.model))
    kind = df.schema[key].dataType.simpleString()
    rows = scorer.prepared(df).select(F.col(key).alias("key"), vector_to_array("_x").alias("x"))
    return rows.mapInArrow(_attribute(trees, scorer.features, key), f"`{key}` {kind}, feature string, value double")
