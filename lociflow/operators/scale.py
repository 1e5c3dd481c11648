"""Median imputation and standardising, fitted on one table and applied to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators.ranks import quantiles


def fit_impute(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact interpolated medians, of all columns at once."""
    found = {r["column"]: r["values"][0] for r in quantiles(train, [], columns, [0.5]).collect()} if columns else {}
    return {c: found.get(c) for c in columns}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in medians.items()})


def fit_scale(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation, 1 where that is zero."""
    row = train.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})
