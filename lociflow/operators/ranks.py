"""Two-level ranks, prefix sums and quantiles: no window ever holds a whole table or a whole class.

Rows go to buckets that follow their order; sums by bucket make a small table whose running totals give each bucket's
start; a window inside the bucket does the rest. Where the order is a hash, its upper bits are the bucket. Where it comes from the data, Spark's
range partitioner samples it, and the partitions, written with the rows, are the buckets: they hold about as many rows each whatever the values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.names import equal_keys, spare
from lociflow.sources.shared import written

#: Parts of a histogram, and values that are sorted in one place when a quantile's range has come down to so many.
BUCKETS, SMALL = 1024, 4096


def hash_bucket(h: Column) -> Column:
    """Top 12 bits of a 64-bit hash, in the order of the signed hash."""
    return F.shiftright(h, 52)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums {name: value} in `order` within `keys`, all in one pass; `bucket` must not fall along the order.

    Null keys and null buckets are values like any other; a null bucket comes before the others, so `order` must have nulls first as well.
    """
    b, at, *rest = spare(df, "_bucket", "_at", *[f"_key{i}" for i in range(len(keys))], *[f"_start{i}" for i in range(len(sums))], *sums)
    others, starts = rest[: len(keys)], rest[len(keys) : len(keys) + len(sums)]
    marked = df.withColumn(b, bucket)
    totals = marked.groupBy(*keys, b).agg(*[F.sum(v).alias(s) for s, v in zip(starts, sums.values())])
    before = Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    table = totals.select(*[F.col(k).alias(o) for k, o in zip(keys, others)], F.col(b).alias(at), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in starts])
    local = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Every bucket has its start; as a left join it never sends the rows to the driver for a broadcast.
    joined = marked.join(table, equal_keys([b, *keys], [at, *others]), "left")
    return joined.select(*df.columns, *[(F.col(s) + F.sum(v).over(local)).alias(n) for s, (n, v) in zip(starts, sums.items())])


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    return running(df, keys, bucket, order, {name: F.lit(1)})


def dealt_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df, written, with the number of each row's part under `name`: parts follow keys and order, and hold about as many rows each."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys], *order)
    return written(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def running_by_range(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`running` without a bucket: edges are sampled from the rows themselves. Rows that `order` doesn't tell apart share a bucket."""
    (part,) = spare(df, "_part")
    return running(dealt_by_range(df, keys, order, part, parts), keys, F.col(part), order, sums).drop(part)


def ranked_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    return running_by_range(df, keys, order, {name: F.lit(1)}, parts)


def quantiles(df: DataFrame, keys: list[str], columns: list[str], shares: list[float]) -> DataFrame:
    """(keys, column, n, values): interpolated quantiles, exact, of the values of each column that are neither NULL nor NaN, by key.

    A histogram of BUCKETS equal parts finds the part of each wanted rank; each of those is divided again between its own least
    and largest value, until it has one value or at most SMALL rows, which are sorted. A round is one job for all keys, columns and parts, counted before
    anything is shuffled; how many rounds there are depends on the values alone. Infinite ones are the largest and smallest. A column without a value has n = 0 and NULLs,
    and keys none of whose rows has a value in any column are still there.
    """
    k, inf = [f"k{i}" for i in range(len(keys))], float("inf")
    entry = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias("v")) for c in columns])
    every = df.select(*[F.col(f"`{name}`").alias(x) for name, x in zip(keys, k)], F.explode(entry).alias("e")).select(*k, "e.column", "e.v")
    finite = F.abs("v") < inf
    stats = every.groupBy(*k, "column").agg(F.count("v").alias("n"), F.count_if(F.col("v") == -inf).alias("low"), F.count_if(finite).alias("mid"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"))
    spots = F.array(*[F.lit(float(s)) * (F.col("n") - 1) for s in shares])
    places = F.array_distinct(F.flatten(F.transform(spots, lambda x: F.array(F.floor(x), F.least(F.floor(x) + 1, F.col("n") - 1)))))
    stats = written(stats.withColumn("places", F.when(F.col("n") > 0, places).otherwise(F.array().cast("array<bigint>"))), "quantiles")
    inside = lambda a, n: F.filter("places", lambda p: (p >= a) & (p < a + n))
    ranges = stats.filter("mid > 0").select(*k, "column", "lo", "hi", F.col("low").alias("before"), F.col("mid").alias("n"), inside(F.col("low"), F.col("mid")).alias("places")).filter(F.size("places") > 0)
    known = [
        stats.select(*k, "column", F.explode(F.filter("places", lambda p: p < F.col("low"))).alias("place"), F.lit(-inf).alias("value")),
        stats.select(*k, "column", F.explode(F.filter("places", lambda p: p >= F.col("low") + F.col("mid"))).alias("place"), F.lit(inf).alias("value")),
    ]
    names = [f"r_{x}" for x in [*k, "column"]]

    def rows_in(some: DataFrame) -> DataFrame:
        """The values in the ranges `some`, of which there are at most two a share for each key and column."""
        held = some.groupBy(*k, "column").agg(F.collect_list(F.struct("lo", "hi", "before", "places")).alias("held")).withColumnsRenamed(dict(zip([*k, "column"], names)))
        # A left join: an inner one may broadcast the values, by way of the driver.
        met = every.filter("v IS NOT NULL").join(held, equal_keys([*k, "column"], names), "left")
        return met.select(*k, "column", "v", F.get(F.filter("held", lambda r: F.col("v").between(r["lo"], r["hi"])), F.lit(0)).alias("r")).filter("r IS NOT NULL")

    while not (wide := ranges.filter((F.col("n") > SMALL) & (F.col("lo") < F.col("hi")))).isEmpty():
        span = F.col("r.hi") / 2 - F.col("r.lo") / 2
        b = F.least(F.floor((F.col("v") / 2 - F.col("r.lo") / 2) / span * BUCKETS), F.lit(BUCKETS - 1))
        counts = rows_in(wide).groupBy(*k, "column", "r", b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        earlier = Window.partitionBy(*k, "column", "r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
        counts = counts.withColumn("before", F.col("r.before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("places", F.col("r.places"))
        found = counts.select(*k, "column", "lo", "hi", "before", "n", inside(F.col("before"), F.col("n")).alias("places")).filter(F.size("places") > 0)
        ranges = written(ranges.filter((F.col("n") <= SMALL) | (F.col("lo") == F.col("hi"))).unionByName(found), "quantiles")
    known.append(ranges.filter("lo = hi").select(*k, "column", F.explode("places").alias("place"), F.col("lo").alias("value")))
    few = rows_in(ranges.filter("lo < hi")).groupBy(*k, "column", "r").agg(F.sort_array(F.collect_list("v")).alias("values"))
    known.append(few.select(*k, "column", F.explode(F.col("r.places")).alias("place"), "r", "values").select(*k, "column", "place", F.expr("values[place - r.before]").alias("value")))
    for more in known[1:]:
        known[0] = known[0].unionByName(more)
    at = known[0].groupBy(*k, "column").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at")).withColumnsRenamed(dict(zip([*k, "column"], names)))
    joined = stats.join(at, equal_keys([*k, "column"], names), "left")

    def value(x: Column) -> Column:
        a, b = (F.try_element_at("at", p) for p in (F.floor(x), F.least(F.floor(x) + 1, F.col("n") - 1)))
        return F.when((a == b) | (x == F.floor(x)), a).otherwise(a + (x - F.floor(x)) * (b - a))

    return joined.select(*[F.col(x).alias(name) for x, name in zip(k, keys)], "column", "n", F.transform(spots, value).alias("values"))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles of one column, as `quantiles` finds them."""
    row = quantiles(df, [], [column], shares).first()
    return [None] * len(shares) if row is None else list(row["values"])
