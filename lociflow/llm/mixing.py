"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

A document's expected copies are its source's target over its source's size. Within a source the documents
are put in the order of (size, doc_id, hash of text), expected copies are added up, one offset is added, and a
document is emitted once for each integer that its running sum crosses. In size order the words taken of a
source miss its target by no more than about one document.

Defined results: null or wordless text has size 0 and its copies, if any, carry no words; a source without
words has target 0 and gives nothing; null is a source of its own, after all others; repeated doc_ids are
separate rows; an empty table gives an empty mix. The plan of targets is one row a source in one task: sources are
meant to be names of collections, some thousands at most, not hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import SPACED_WORD, Scratch, row_hash, spare


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): words of each text; tie tells apart rows of the same id and size."""
    words = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", words.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, rate, target) of each source.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all words; a target stops at
    `most` times its source, and what is over goes to the others by weight until none is above. That fixed
    point is min(cap, level * weight): with the sources in the order of cap over weight, level is what the
    sources below leave over for the weights from here on, at the first source whose cap it doesn't exceed.
    """
    one = Window.partitionBy(F.lit(0))  # one row a source, not a document
    ordered = one.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    each = each.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = one.orderBy("ratio", F.col("source").isNull(), "source")
    below = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(one) * F.lit(float(share))
    level = (wanted - below) / onward
    each = each.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    held = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(one)["level"]
    each = each.withColumn("target", F.least(F.col("cap"), F.coalesce(held * F.col("weight"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return each.select("source", "source_size", "target", rate.alias("rate"))


def offset(source, seed: str):
    """A number from 0 to 1, one for each source and seed, in steps of 2**-32."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")), F.when(source.isNull(), F.lit(":null")).otherwise(F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(sized: DataFrame, scratch: Scratch, seed: str = "mix", **weighting) -> DataFrame:
    """sized with source_size, target and copies.

    The rank within a source takes two levels, as a source may hold a third of all rows: rows are dealt out by
    ranges of (source, size, doc_id, tie) and written with their part's number; counts by part and source give
    each part's first rank, and a window inside the part does the rest.
    """
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized.repartitionByRange(parts, F.col("source").asc_nulls_last(), "size", "doc_id", "tie").withColumn("part", F.spark_partition_id())
    dealt = scratch.write("dealt", dealt)
    counts = dealt.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    plan = first.alias("f").join(targets(sized, **weighting).alias("t"), F.expr("f.source <=> t.source")).select(
        F.col("f.part").alias("p"), F.col("f.source").alias("s"), "first", "source_size", "target", "rate"
    )
    # One row for each source and part that holds it: sources + parts rows at most.
    rows = dealt.join(plan, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    local = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id", "tie"))
    rank, start = F.col("first") + local, offset(F.col("source"), seed)
    crossed = F.floor(rank * F.col("rate") + start) - F.floor((rank - 1) * F.col("rate") + start)
    return rows.select("doc_id", "source", "size", "tie", "source_size", "target", crossed.cast("bigint").alias("copies"))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, scratch: Scratch) -> DataFrame:
    """df with each row's number among those of its key, from 1 on, in `order`: two levels, as a key may hold very many rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, first = spare(df, "_part"), spare(df, "_first")
    dealt = scratch.write(f"numbered{name}", df.repartitionByRange(parts, *keys, order).withColumn(part, F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(first)).withColumn(first, F.coalesce(F.sum(first).over(earlier), F.lit(0)))
    renamed = counts.select(*[F.col(k).alias(f"{k}_r") for k in [*keys, part]], first)
    same = F.lit(True)
    for k in [*keys, part]:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(order))
    return dealt.join(renamed, same).withColumn(name, F.col(first) + local).select(*df.columns, name)


def mix_sources(docs: DataFrame, seed: str = "mix", **weighting) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of `docs`.

    Rows of the same doc_id are told apart by their text; equal rows share the copies of their ranks in turn, in the order of
    their row hash. Whole texts meet the plan in one join; only rows of an id and text that stand there several times are numbered.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    d, s, t, tie, number, times, total, row = (spare(docs, f"_{x}") for x in ("d", "s", "t", "tie", "number", "times", "total", "row"))
    sized = scratch.write("sizes", sizes(docs))
    taken = copies(sized, scratch, seed, **weighting).groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("tie").alias(t))
    taken = scratch.write("taken", taken.agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(times)).filter(F.col(total) > 0))
    keyed = docs.withColumn(tie, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(tie) == F.col(t)))
    once = joined.filter(F.col(times) == 1).withColumn(number, F.col(total))
    several = joined.filter(F.col(times) > 1)
    if not taken.filter(F.col(times) > 1).isEmpty():
        placed = numbered(several.withColumn(row, row_hash(docs)), [d, s, t], row, number, scratch).drop(row)
        own = F.floor(F.col(number) * F.col(total) / F.col(times)) - F.floor((F.col(number) - 1) * F.col(total) / F.col(times))
        once = once.unionByName(placed.withColumn(number, own.cast("bigint")))
    often = once.filter(F.col(number) > 0)
    return often.withColumn(row, F.explode(F.array_repeat(F.lit(0), F.col(number).cast("int")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    scratch = Scratch(spark, "op5")
    sized = scratch.write("sizes", sizes(docs))
    taken = F.col("copies") * F.col("size")
    return copies(sized, scratch).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "copies")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE * 1.5 FROM r)
        - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
        row_number() OVER (ORDER BY ratio, source IS NULL, encode(source)) AS place FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM l WHERE level <= ratio) * weight, cap)) AS target FROM l),
k AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS rk,
        ('0x' || substr(md5('mix:' || coalesce(d.source, ':null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rk * rate + u) - floor((rk - 1) * rate + u))::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM c
"""
