"""Evaluation of (keys..., y, p) tables: thresholds, metric suite, curves, calibration, McNemar, temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.names import equal_keys, spare
from lociflow.operators.ranks import quantiles, running_by_range

#: Threshold grid, recall floor, beta, abstention margin.
GRID_LEAST, GRID_MOST, GRID_SIZE = 0.01, 0.99, 393
RECALL_FLOOR, BETA, MARGIN = 0.90, 2.0, 0.10


def grid() -> list[float]:
    step = (GRID_MOST - GRID_LEAST) / (GRID_SIZE - 1)
    return [GRID_LEAST + i * step for i in range(GRID_SIZE - 1)] + [GRID_MOST]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def grid_count(p: Column) -> Column:
    """How many grid values are at most p: a guess by division, set right against the grid's own values."""
    values = F.array(*[F.lit(x) for x in grid()])
    guess = F.greatest(F.lit(0), F.least(F.lit(GRID_SIZE), F.floor((p - GRID_LEAST) * (GRID_SIZE - 1) / (GRID_MOST - GRID_LEAST)) + 1)).cast("int")
    up = F.when(F.try_element_at(values, guess + 1) <= p, 1).otherwise(0)
    down = F.when((guess > 0) & (F.try_element_at(values, F.greatest(guess, F.lit(1))) > p), 1).otherwise(0)
    return guess + up - down


def threshold_counts(pred: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, i, thr, tp, fp, fn, tn) of every grid threshold, from at most 394 rows a key."""
    counts = pred.groupBy(*keys, grid_count(F.col("p")).alias("b")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    steps = counts.groupBy(*keys).agg(F.collect_list(F.struct("b", "pos", "neg")).alias("s"))  # 394 entries at most
    one = steps.select(*keys, "s", F.posexplode(F.array(*[F.lit(x) for x in grid()])).alias("i", "thr"))

    def total(field: str, reached: bool) -> Column:
        kept = F.filter("s", lambda x: (x["b"] > F.col("i")) if reached else (x["b"] <= F.col("i")))
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x[field])

    return one.select(*keys, "i", "thr", total("pos", True).alias("tp"), total("neg", True).alias("fp"), total("pos", False).alias("fn"), total("neg", False).alias("tn"))


def select_threshold(pred: DataFrame, keys: list[str] = [], floor: float = RECALL_FLOOR, beta: float = BETA) -> DataFrame:
    """(keys, thr, feasible): first largest MCC with recall of at least `floor`; first largest F-beta if there is none."""
    every = threshold_counts(pred, keys)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    b2 = beta * beta
    scored = every.withColumns({"ok": recall >= floor, "mcc": mcc(tp, fp, fn, tn), "fb": ratio((1 + b2) * precision * recall, b2 * precision + recall)})
    value = F.when(F.col("ok"), F.col("mcc")).otherwise(F.col("fb"))
    best = F.max_by(F.struct("thr", "ok"), F.struct("ok", value, -F.col("i"))).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("b.thr").alias("thr"), F.col("b.ok").alias("feasible"))


def curve_points(pred: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, p, pos, neg, tp, fp): cumulative counts at or above each distinct score; rows without a score come last, as one point."""
    points = pred.groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return running_by_range(points, keys, [F.col("p").desc_nulls_last()], {"tp": F.col("pos"), "fp": F.col("neg")})


def ranking_scores(pred: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, auroc, auprc): ties count one half; average precision without interpolation. NULL with one class."""
    points = curve_points(pred, keys)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    precise = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    n1, n0 = F.sum("pos"), F.sum("neg")
    out = points.groupBy(*keys).agg(won.alias("w"), precise.alias("a"), n1.alias("n1"), n0.alias("n0"))
    none = (F.col("n1") == 0) | (F.col("n0") == 0)
    return out.select(*keys, F.when(~none, F.try_divide("w", F.col("n1") * F.col("n0"))).alias("auroc"), F.try_divide("a", "n1").alias("auprc"))


def evaluate(pred: DataFrame, thresholds: DataFrame, keys: list[str] = []) -> DataFrame:
    """The metric suite of each key at its threshold (keys, thr), with the block of rows at least MARGIN away from it."""
    marked = pred.join(thresholds.select(*keys, "thr"), keys) if keys else pred.withColumn("thr", F.lit(thresholds.first()["thr"]))
    yes, up, sure = F.col("y") == 1, F.col("p") >= F.col("thr"), F.abs(F.col("p") - F.col("thr")) >= MARGIN
    cells = {"tp": yes & up, "fp": ~yes & up, "fn": yes & ~up, "tn": ~yes & ~up}
    counts = [F.count_if(c).alias(n) for n, c in cells.items()] + [F.count_if(c & sure).alias(f"s_{n}") for n, c in cells.items()]
    square = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    rows = marked.groupBy(*keys).agg(F.max("thr").alias("threshold"), F.avg(square).alias("brier"), F.count(F.lit(1)).alias("n"), *counts)
    rank = ranking_scores(pred, keys)
    rows = rows.join(rank, keys) if keys else rows.withColumns({c: F.lit(v) for c, v in rank.first().asDict().items()})

    def suite(prefix: str) -> dict[str, Column]:
        tp, fp, fn, tn = (F.col(prefix + c) for c in ("tp", "fp", "fn", "tn"))
        precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
        return {"mcc": F.round(mcc(tp, fp, fn, tn), 4), "precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 4)}

    block, n = suite("s_"), F.col("s_tp") + F.col("s_fp") + F.col("s_fn") + F.col("s_tn")
    both = ((F.col("s_tp") + F.col("s_fn")) > 0) & ((F.col("s_fp") + F.col("s_tn")) > 0)
    selective = F.when(
        n > 0,
        F.struct(
            F.round(n / F.col("n"), 4).alias("coverage"), F.when(both, block["mcc"]).alias("mcc"), block["recall"].alias("recall"), block["precision"].alias("precision")
        ),
    )
    main = suite("")
    return rows.select(
        *keys,
        F.round("threshold", 4).alias("threshold"),
        main["mcc"].alias("mcc"),
        F.round("auroc", 4).alias("auroc"),
        F.round("auprc", 4).alias("auprc"),
        F.round("brier", 6).alias("brier"),
        main["precision"].alias("precision"),
        main["recall"].alias("recall"),
        main["f1"].alias("f1"),
        "tp",
        "fp",
        "fn",
        "tn",
        selective.alias("selective"),
    )


def operating_point(pred: DataFrame, keys: list[str] = [], recall: float = RECALL_FLOOR) -> DataFrame:
    """The curve point nearest the recall, the highest score of equals, where the recall is reached at all."""
    points = curve_points(pred, keys)
    total = points.groupBy(*keys).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    points = points.join(total, keys) if keys else points.withColumns({c: F.lit(v) for c, v in total.first().asDict().items()})
    points = points.withColumns({"tpr": ratio(F.col("tp"), F.col("n1")), "fpr": ratio(F.col("fp"), F.col("n0"))})
    best = F.min_by(F.struct("p", "tpr", "fpr"), F.struct(F.abs(F.col("tpr") - recall), -F.col("p")))
    return points.groupBy(*keys).agg(F.max("tpr").alias("_m"), best.alias("b")).filter(F.col("_m") >= recall).select(*keys, "b.p", "b.tpr", "b.fpr")


def calibration_bins(pred: DataFrame, bins: int = 10, keys: list[str] = []) -> DataFrame:
    """(keys, bin, n, mean_p, rate): equal-frequency bins of each key by exact quantile edges; equal scores share a bin, rows without a score the first."""
    edge, *others = spare(pred, "_edges", *[f"_key{i}" for i in range(len(keys))])
    edges = quantiles(pred, keys, ["p"], [i / bins for i in range(1, bins)]).select(*[F.col(k).alias(o) for k, o in zip(keys, others)], F.col("values").alias(edge))
    marked = pred.join(edges, equal_keys(keys, others)) if keys else pred.withColumn(edge, F.lit((edges.first() or [[]])[0]))
    place = F.size(F.filter(edge, lambda e: e < F.col("p")))
    return marked.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def mcnemar_counts(pairs: DataFrame) -> DataFrame:
    """(n01, n10, statistic) of (y, a, b) with thresholded predictions a and b."""
    right_a, right_b = F.col("a") == F.col("y"), F.col("b") == F.col("y")
    out = pairs.agg(F.count_if(right_a & ~right_b).alias("n01"), F.count_if(~right_a & right_b).alias("n10"))
    n, apart = F.col("n01") + F.col("n10"), F.abs(F.col("n01") - F.col("n10")) - 1
    return out.withColumn("statistic", F.when(n < 25, F.least("n01", "n10").cast("double")).otherwise(ratio((apart * apart).cast("double"), n)))


def mcnemar(pairs: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """Counts, statistic, p-value (exact binomial under 25, chi-square with correction from there) and winner; one row."""
    row = mcnemar_counts(pairs).first()
    n01, n10, statistic = row["n01"], row["n10"], row["statistic"]
    n = n01 + n10
    if n == 0:
        p = 1.0
    elif n < 25:
        p = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(n01, n10) + 1)) / 2**n)
    else:
        p = math.erfc(math.sqrt(statistic / 2))
    winner = (second if n10 > n01 else first) if p < 0.05 else "tie"
    rows = [(n01, n10, round(statistic, 4), round(p, 6), winner)]
    return pairs.sparkSession.createDataFrame(rows, "n01 bigint, n10 bigint, statistic double, p_value double, winner string")


def log_losses(logits: DataFrame, temperatures: list[float]) -> DataFrame:
    """(temperature, loss): mean log-loss of (y, z) at each temperature, in one pass without a row for each."""

    def loss(t: float) -> Column:
        z = F.col("z") / F.lit(t)
        return F.avg(F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z))))

    row = logits.agg(F.array(*[F.struct(F.lit(t).alias("temperature"), loss(t).alias("loss")) for t in temperatures]).alias("x"))
    return row.select(F.inline("x"))


def fit_temperature(logits: DataFrame, least: float = 1.0, most: float = 5.0, steps: int = 40) -> float:
    """The temperature of least log-loss on a grid, refined once around the winner."""
    for _ in range(2):
        step = (most - least) / steps
        found = log_losses(logits, [least + i * step for i in range(steps + 1)]).orderBy("loss", "temperature").first()
        if found is None or found["loss"] is None:
            return 1.0
        least, most = max(1.0, found["temperature"] - step), found["temperature"] + step
    return float(found["temperature"])


def ensemble(members: DataFrame, key: str, temperature: float = 1.0) -> DataFrame:
    """(key, p): mean logit over the members, then the sigmoid."""
    from lociflow.functions.scalars import sigmoid

    return members.groupBy(key).agg(F.avg("z").alias("z")).select(key, sigmoid(F.col("z"), temperature).alias("p"))

