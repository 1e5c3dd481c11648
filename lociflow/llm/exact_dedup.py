"""Exact dedup by a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after lower-casing A-Z. The index is an append-only table of one row per
digest, the keeper's id and the number of equal rows in the batch that brought it; its buckets are sorted by
digest, so that a new batch is compared by a sort-merge anti-join that leaves the index where it lies.

Defined results: null text counts as empty text; all empty texts are equal; repeated doc_ids are separate rows
of a group, and rows of one text under its largest doc_id leave one; a null doc_id comes before all others, and is kept where a
text has no other; an empty
batch changes nothing; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import Scratch, ascii_lower, one_of_each, scratch_root, spare

#: A group of at least this many rows, and of this share of all rows, is joined by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 5_000, 1e-4


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the lower-cased text."""
    return docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, kept as a bucketed Parquet table at `location` (a shared folder)."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.location = location or f"{scratch_root(spark)}/digest-index-{uuid.uuid4().hex}"
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.location).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Forget the index: its table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.location)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, digested: DataFrame) -> str:
        """Append the digests of a batch that the index lacks, each with its largest doc_id; returns the batch's name."""
        batch = uuid.uuid4().hex
        groups = digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # Dealt as the buckets are: the index side needs no exchange, and each task writes one bucket.
        dealt = groups.repartition(self.buckets, "digest")
        fresh = dealt.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return batch


def assign(digested: DataFrame, index: DataFrame) -> DataFrame:
    """Give each document its group's index row.

    Groups of a ten-thousandth of all rows or more (so at most ten thousand groups) are looked up by
    broadcast; what is left has no group that could fill a task, and is joined by sort-merge.
    """
    wanted = index.select("digest", "keep_id", "group_size")
    total = wanted.agg(F.sum("group_size")).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = wanted.filter(F.col("group_size") >= least).withColumn("hot", F.lit(True))
    marked = digested.select("doc_id", "digest").join(F.broadcast(hot), "digest", "left")
    cold = marked.filter(F.col("hot").isNull()).select("doc_id", "digest").join(wanted.filter(F.col("group_size") < least), "digest")
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    return marked.filter(F.col("hot")).select(columns).unionByName(cold.select(columns))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` to keep: the largest doc_id of each text that the index has not seen before, and the index extended by them.

    Rows of the same text and the same largest doc_id are one document: the one of the least row hash stays.
    """
    spark = docs.sparkSession
    digested = Scratch(spark, "exact-dedup").write("digests", digests(docs, id_col, text_col))
    batch = index.add(digested)
    keepers = index.rows().filter(F.col("batch") == batch).select(F.col("digest").alias("key"), "keep_id")
    often = digested.join(keepers, (F.col("digest") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "doc_id").count()
    digest, times, key, keeper = (spare(docs, name) for name in ("_digest", "_times", "_key", "_keeper"))
    marked = docs.withColumn(digest, digest_of(F.col(text_col)))
    kept = often.select(F.col("digest").alias(key), F.col("doc_id").alias(keeper), F.col("count").alias(times))
    rows = marked.join(kept, (F.col(digest) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(keeper))).drop(key, keeper)
    once = rows.filter(F.col(times) == 1).select(*docs.columns)
    again = one_of_each(rows.filter(F.col(times) > 1).drop(times), [digest]).select(*docs.columns)
    return once.unionByName(again)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digested = Scratch(spark, "op6").write("digests", digests(docs))
    index = DigestIndex(spark, buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    index.add(digested)
    return assign(digested, index.rows()).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP6_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
