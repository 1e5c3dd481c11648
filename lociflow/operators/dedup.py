"""Keep-best deduplication and priority unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.names import spare


def keep_best(df: DataFrame, keys: list[str], order: list[Column], total: bool = False) -> DataFrame:
    """The first row of each key in `order`; further ties are settled by all other columns that can be ordered, unless `order` is total."""
    (place,) = spare(df, "_place")
    ties = [F.col(f"`{f.name}`").asc_nulls_last() for f in df.schema if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *([] if total else ties)))
    return df.withColumn(place, first).filter(F.col(place) == 1).drop(place)


def union_by_priority(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name, absent columns NULL; of equal keys the row of the earlier table stays."""
    every = tables[0].limit(0)
    for t in tables:
        every = every.unionByName(t.limit(0), allowMissingColumns=True)
    (priority,) = spare(every, "_priority")
    every = None
    for i, t in enumerate(tables):
        one = t.withColumn(priority, F.lit(i))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return keep_best(every, keys, [F.col(priority).asc()]).drop(priority)


def best_per_group(df: DataFrame, key: str, priority: list[Column], columns: list[str]) -> DataFrame:
    """The columns of the row with the largest priority of each key; one aggregate, no sort."""
    best = F.max_by(F.struct(*columns), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)]))
    return df.groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in columns])
