"""Balancing, folds, subsamples and batch packing. Random order is a hash of (seed, key), the same however rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.ranks import hash_bucket, ranked, ranked_by_range


def shuffled(seed: int, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def balance(df: DataFrame, label: str, key: str, seed: int = 42, order: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """As many rows of each class as the smallest has: those first by hash, or in a given order with its bucket."""
    h = shuffled(seed, key) if order is None else order
    known = df.filter(F.col(label).isNotNull())
    least = known.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    placed = ranked(known, [label], hash_bucket(h) if bucket is None else bucket, [h, F.col(key)], "_rank")
    return placed.filter(F.col("_rank") <= least).drop("_rank")


def subsample(df: DataFrame, n: int, key: str, seed: int = 42, order: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """n rows without replacement, or all: the first by hash, or in a given order with its bucket."""
    h = shuffled(seed, key) if order is None else order
    return ranked(df, [], hash_bucket(h) if bucket is None else bucket, [h, F.col(key)], "_rank").filter(F.col("_rank") <= n).drop("_rank")


def deterministic_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffled(seed, key), key)


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, order: Column | None = None) -> DataFrame:
    """(group, positives, negatives, fold): no group in two folds, class counts even.

    Groups with and without positives are two strata; each is ordered by positives, negatives and key, and dealt
    out to and fro. Only the table of groups is ranked.
    """
    groups = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    groups = groups.withColumn("_stratum", (F.col("positives") > 0).cast("int"))
    placed = ranked_by_range(groups, ["_stratum"], [F.col("positives").desc(), F.col("negatives").desc(), (F.col(group) if order is None else order).asc_nulls_first()], "_rank")
    i = F.col("_rank") - 1
    fold = F.when(F.floor(i / k) % 2 == 0, i % k).otherwise(k - 1 - i % k)
    return placed.select(group, "positives", "negatives", fold.cast("int").alias("fold"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, order: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """df with a fold; each class is dealt out in the order of the hash, or in a given order with its bucket."""
    h = shuffled(seed, key) if order is None else order
    placed = ranked(df, [label], hash_bucket(h) if bucket is None else bucket, [h, F.col(key)], "_rank")
    return placed.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def nested_split(df: DataFrame, group: str, label: str, test_fold: int, k: int = 5, inner_order: Column | None = None) -> DataFrame:
    """df with `part`: test, validation (first fold of the rest, dealt anew) or train."""
    folds = group_folds(df, group, label, k).select(F.col(group).alias("_g"), "fold")
    # Every group has its fold; as a left join it never sends the rows to the driver for a broadcast.
    marked = df.join(folds, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    inner = group_folds(marked.filter(F.col("fold") != test_fold), group, label, k, F.xxhash64(F.lit(test_fold), F.col(group)) if inner_order is None else inner_order)
    inner = inner.select(F.col(group).alias("_g"), F.col("fold").alias("_inner"))
    marked = marked.join(inner, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    part = F.when(F.col("fold") == test_fold, "test").when(F.col("_inner") == 0, "validation").otherwise("train")
    return marked.withColumn("part", part).drop("_inner", "fold")


def pack_batches(df: DataFrame, key: str, length: str, max_items: int = 32, max_tokens: int = 16_000, width: int = 64) -> DataFrame:
    """df with `length_bucket` and `batch`: similar lengths together, never more than max_items or max_tokens (cost is
    length + 2); an item over max_tokens is a batch of its own."""
    bucket = F.floor((F.col(length) + 2) / width)
    most = F.greatest(F.lit(1), F.least(F.lit(max_items), F.floor(F.lit(max_tokens) / ((bucket + 1) * width)))).cast("bigint")
    marked = df.withColumn("length_bucket", bucket.cast("bigint"))
    placed = ranked_by_range(marked, ["length_bucket"], [F.col(key).asc_nulls_first()], "_rank")
    return placed.withColumn("batch", F.floor((F.col("_rank") - 1) / most).cast("bigint")).drop("_rank")
