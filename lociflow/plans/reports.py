"""Tables behind the reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.names import equal_keys
from lociflow.operators import metrics
from lociflow.operators.ranks import quantiles


def label_evidence(df: DataFrame, source: str = "evidence_source", label: str = "label") -> DataFrame:
    """Rows by source and label, zero-filled, in fixed columns."""
    table = df.groupBy(source).pivot(label, [0, 1]).count().na.fill(0)
    return table.select(source, F.col("0").alias("benign"), F.col("1").alias("pathogenic"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of the lower triangle: one pass, rows with both values; NULL where one doesn't vary."""
    parts = []
    for a, b in combinations(columns, 2):
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
        parts.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.round(r, 6).alias("r")))
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def class_distribution(df: DataFrame, label: str, feature: str, missing: float = -1.0, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(label, n, mean, q25, ...) of a feature with `missing` read as NULL."""
    known = df.select(F.col(label), F.when(F.col(feature) != missing, F.col(feature).cast("double")).alias("_v"))
    found = quantiles(known, [label], ["_v"], list(shares)).select(F.col(label).alias("_label"), "values")
    means = known.groupBy(label).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    return means.join(found, equal_keys([label], ["_label"])).select(label, "n", "mean", *[F.col("values")[i].alias(f"q{int(s * 100)}") for i, s in enumerate(shares)])


def histogram(df: DataFrame, label: str, feature: str, lo: float, hi: float, bins: int) -> DataFrame:
    return df.groupBy(label, F.width_bucket(F.col(feature).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).count()


def attribution_topk(attributions: DataFrame, k: int = 20) -> DataFrame:
    """(feature, importance): largest mean absolute values of (row_id, feature, value)."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(k)


def metric_deltas(table: DataFrame, config: str, base: str, other: str, names: list[str]) -> DataFrame:
    """(metric, base, other, delta) out of one row a configuration."""
    long = table.select(config, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([config], names, "metric", "value")
    wide = long.groupBy("metric").pivot(config, [base, other]).agg(F.first("value"))
    return wide.select("metric", F.col(f"`{base}`").alias("base"), F.col(f"`{other}`").alias("other"), (F.col(f"`{other}`") - F.col(f"`{base}`")).alias("delta"))


def curves(pred: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, p, tpr, fpr, precision) of every distinct score."""
    points = metrics.curve_points(pred, keys)
    total = points.groupBy(*keys).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    points = points.join(total, keys) if keys else points.withColumns({c: F.lit(v) for c, v in total.first().asDict().items()})
    ratio = metrics.ratio
    return points.select(
        *keys, "p", ratio(F.col("tp"), F.col("n1")).alias("tpr"), ratio(F.col("fp"), F.col("n0")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision")
    )
