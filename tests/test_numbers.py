"""Ranks, folds, sampling and metrics against direct computation."""

import math
import random

from pyspark.sql import functions as F

from lociflow.operators import metrics, models, ranks, sampling


def test_quantiles(spark):
    values = [1.0, 2.0, 3.0, 10.0, None, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert ranks.exact_quantiles(df, "x", [0.0, 0.5, 0.75, 1.0]) == [1.0, 3.0, 3.0, 10.0]
    assert ranks.exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_balance(spark):
    for classes in ({0: 5, 1: 40}, {0: 40, 1: 5}, {1: 7}):
        df = spark.createDataFrame([(i, y) for i, y in enumerate(y for y, n in classes.items() for _ in range(n))], "id int, y int")
        out = sampling.balance(df, "y", "id")
        assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == dict.fromkeys(classes, min(classes.values()))
        assert sorted(r.id for r in out.collect()) == sorted(r.id for r in sampling.balance(df.repartition(7), "y", "id").collect())


def test_folds(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, f"g{int(rng.random() ** 3 * 20)}", int(rng.random() < 0.3)) for i in range(400)], "id int, g string, y int")
    folds = sampling.group_folds(df, "g", "y", 5)
    assert folds.count() == folds.select("g").distinct().count() and {r.fold for r in folds.collect()} <= set(range(5))
    parts = sampling.nested_split(df, "g", "y", 0)
    assert parts.count() == 400 and parts.groupBy("g").agg(F.count_distinct("part").alias("n")).filter("n > 1").isEmpty()
    each = sampling.stratified_folds(df, "y", "id").groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in each)


def test_batches(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 6, 7, 70, 15_000, 40_000, 3000] * 30)], "id bigint, n bigint")
    out = sampling.pack_batches(df, "id", "n").groupBy("length_bucket", "batch").agg(F.count("*").alias("k"), F.sum(F.col("n") + 2).alias("cost")).collect()
    assert all(r.k <= 32 and (r.cost <= 16_000 or r.k == 1) for r in out)


def direct(rows, thr):
    tp = sum(y == 1 and p >= thr for y, p in rows)
    fp = sum(y == 0 and p >= thr for y, p in rows)
    fn = sum(y == 1 and p < thr for y, p in rows)
    return tp, fp, fn, len(rows) - tp - fp - fn


def test_metrics(spark):
    rng = random.Random(3)
    grid = metrics.grid()
    rows = [(int(rng.random() < 0.4), rng.choice([grid[rng.randrange(393)], round(rng.random(), 2)])) for _ in range(300)]
    pred = spark.createDataFrame(rows, "y int, p double").repartition(5)
    for r in metrics.threshold_counts(pred).collect():
        assert (r.tp, r.fp, r.fn, r.tn) == direct(rows, grid[r.i])

    def mcc(c):
        tp, fp, fn, tn = c
        d = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return (tp * tn - fp * fn) / d if d else 0.0

    ok = [t for t in grid if direct(rows, t)[0] >= 0.9 * sum(y for y, _ in rows)]
    best = max(ok, key=lambda t: (round(mcc(direct(rows, t)), 12), -t))
    assert abs(metrics.select_threshold(pred).first().thr - best) < 1e-12
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    found = metrics.ranking_scores(pred).first()
    assert abs(found.auroc - auc) < 1e-9
    flipped = metrics.ranking_scores(pred.withColumn("p", -F.col("p"))).first()
    assert abs(flipped.auroc + auc - 1) < 1e-9
    suite = metrics.evaluate(pred, metrics.select_threshold(pred)).first()
    assert (suite.tp, suite.fp, suite.fn, suite.tn) == direct(rows, best) and suite.mcc == round(mcc(direct(rows, best)), 4)


def test_mcnemar(spark):
    def pairs(n01, n10, both=5):
        return spark.createDataFrame([(1, 1, 0)] * n01 + [(1, 0, 1)] * n10 + [(1, 1, 1)] * both, "y int, a int, b int")

    assert metrics.mcnemar(pairs(0, 0)).first().p_value == 1.0
    small = metrics.mcnemar(pairs(1, 9)).first()
    assert small.p_value == round(2 * 11 / 2**10, 6) and small.winner == "b"
    large = metrics.mcnemar(pairs(30, 10)).first()
    assert large.statistic == 9.025 and large.winner == "a"


def test_temperature_and_calibration(spark):
    rng = random.Random(5)
    rows = [(z, int(rng.random() < 1 / (1 + math.exp(-z / 2)))) for z in (rng.gauss(0, 3) for _ in range(3000))]
    assert 1.5 < metrics.fit_temperature(spark.createDataFrame(rows, "z double, y int")) < 2.6
    tied = spark.createDataFrame([(0, 0.0)] * 50 + [(1, 1.0)] * 50, "y int, p double")
    assert sum(r.n for r in metrics.calibration_bins(tied).collect()) == 100


def test_view_has_all_rows(spark):
    vector = F.array(*[F.when(F.col("id") % 100 == 0, 0.0).otherwise(F.sin(F.col("id") * j)) for j in (1, 2, 3)])
    view = models.project(spark.range(9000).select("id", vector.alias("e")), "id", "e")
    assert sorted(r.id for r in view.select("id").collect()) == [i for i in range(9000) if i % 100]


def test_registered_trees_have_the_defaults(spark, monkeypatch):
    from lociflow.plans import catalogue

    given = []
    monkeypatch.setattr(models, "oof_predict", lambda *args, **params: given.append((len(args), params)))
    catalogue.QUERIES["oof_predict"](spark, "/root/testdata/sf0.001")
    assert given == [(5, {})]


def test_quantiles_with_outliers_and_infinities(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for values in ([1e12, *rng.uniform(0, 1, 3000)], [1e308, -1e308, *rng.normal(0, 1, 500)], [5.0] * 40, [0.1, 0.2], [7.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        shares = [0.0, 0.1, 0.5, 0.9, 1.0]
        assert np.allclose(ranks.exact_quantiles(df, "v", shares), np.quantile(values, shares), rtol=1e-12)
    inf = float("inf")
    df = spark.createDataFrame([(-inf,), (1.0,), (2.0,), (inf,), (inf,)], "v double")
    assert ranks.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]) == [-inf, 1.0, 2.0, inf]
    assert ranks.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
