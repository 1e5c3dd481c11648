"""Attributions and the search for settings."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lociflow.operators import attributions, models, tuning
from lociflow.plans import reports


@pytest.fixture(autouse=True)
def importable(spark):
    import os

    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(600).select("id", *[F.sin(F.col("id") * s).alias(n) for n, s in zip(FEATURES, (1.0, 2.3, 0.7, 5.1))])
    df = df.withColumn("y", ((F.col("a") * F.col("b") + F.col("c") > 0.1)).cast("int")).withColumn("d", F.when(F.col("id") % 9 > 0, F.col("d")))
    return df, models.Scorer(FEATURES, "y", maxIter=4, maxDepth=4, minInstancesPerNode=5, stepSize=0.3).fit(df)


def expected(leaves, x, known):
    """What a tree expects of a row of which some features are known: a leaf counts by agreement on those and by share on the others."""
    total = 0.0
    for leaf in leaves:
        part = leaf.value
        for f, (low, high, share) in leaf.spans.items():
            part *= float(low < x[f] <= high) if f in known else share
        total += part
    return total


def test_attributions_are_shapley_values(fitted):
    df, scorer = fitted
    trees = attributions.leaves_of(scorer.model)
    assert len(trees) == 4 and all(abs(sum(leaf.cover for leaf in t) - 1) < 1e-9 for t in trees)
    assert max(len(leaf.spans) for t in trees for leaf in t) > 2
    x = np.random.default_rng(1).normal(size=(12, 4))
    got = attributions.shapley(trees, x)
    for row, values in zip(x, got):
        game = {s: sum(expected(t, row, s) for t in trees) for n in range(5) for s in combinations(range(4), n)}
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(
                math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (game[tuple(sorted((*s, i)))] - game[s]) for n in range(4) for s in combinations(rest, n)
            )
            assert abs(values[i] - want) < 1e-9


def test_attributions_sum_to_the_margin(fitted):
    df, scorer = fitted
    base = attributions.base_margin(attributions.leaves_of(scorer.model))
    out = attributions.attributions(scorer, df.repartition(3), "id")
    assert out.columns == ["id", "feature", "value"] and out.count() == 2400
    margin = scorer.model.transform(scorer.prepared(df)).select("id", vector_to_array("rawPrediction")[1].alias("m"))
    apart = out.groupBy("id").agg(F.sum("value").alias("s")).join(margin, "id").agg(F.max(F.abs(F.col("s") + base - F.col("m")))).first()[0]
    assert apart < 1e-9
    assert {r.feature for r in reports.attribution_topk(out, 2).collect()} <= {"a", "b", "c"}
    assert attributions.attributions(scorer, df.limit(0), "id").count() == 0


SPACE = {"x": (-4.0, 4.0), "rate": (1e-4, 1.0, "log"), "kind": ["p", "q", "r", "s", "t", "u"]}


def known_function(p):
    return -((p["x"] - 1.3) ** 2) - (math.log10(p["rate"]) + 2) ** 2 + {"r": 1.0}.get(p["kind"], 0.0)


def test_search_beats_random(spark):
    """On average, and in most of 40 searches: one of them can be lucky either way."""
    n, gain = 48, []
    for seed in range(40):
        found = max(r[2] for r in tuning.tune(spark, known_function, SPACE, n, seed, parallel=4))
        rng = random.Random(seed)
        gain.append(found - max(known_function(tuning.suggest(SPACE, [], rng.randrange(10**9), t)) for t in range(n)))
    assert sum(g > 0 for g in gain) > 24 and np.mean(gain) > 0.1


def test_search_is_the_same_again(spark):
    def slow_now_and_then(p):
        import time

        time.sleep(random.random() * 0.02)
        return known_function(p), {"x": p["x"]}

    runs = [[(r[0], r[1], r[2], r[4]) for r in tuning.tune(spark, slow_now_and_then, SPACE, 21, 7, parallel=4)] for _ in range(2)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == list(range(21))
    assert tuning.suggest(SPACE, [({"x": 0.0, "rate": 0.1, "kind": "p"}, float("nan"))] * 20, 1, 1)["kind"] in SPACE["kind"]


def test_adaptive_search_on_a_model(spark):
    df = spark.range(120).select("id", (F.col("id") % 12).alias("g"), F.sin("id").alias("x"), (F.sin("id") > 0.2).cast("int").alias("y"))
    history = models.adaptive_search(df, {"maxDepth": [1, 2]}, 2, "id", "g", "y", ["x"], k=2, parallel=2, maxIter=2, minInstancesPerNode=2).collect()
    assert [r.trial for r in history] == [0, 1] and all(r.objective > 0.5 for r in history)


def test_folds_read_written_parts(spark, monkeypatch):
    """The split's joins run once a fold, not in each of the jobs that fit and score it."""
    plans = []

    class Recorder:
        def __init__(self, features, label, **params):
            pass

        def fit(self, train, validation):
            plans.extend(x._jdf.queryExecution().optimizedPlan().toString() for x in (train, validation))
            return self

        def predict(self, df, key):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return df.select(key, "y", F.lit(0.5).alias("p"))

    monkeypatch.setattr(models, "Scorer", Recorder)
    df = spark.range(60).selectExpr("id", "concat('g', id % 12) AS g", "cast(id % 3 = 0 AS int) AS y")
    out = models.oof_predict(df, "id", "g", "y", [], 3)
    assert len(plans) == 9 and not any("Join" in p for p in plans)
    assert sorted(r.id for r in out.collect()) == [*range(60)]
