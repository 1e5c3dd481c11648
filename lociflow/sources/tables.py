"""Delimited scans, Parquet stores and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.sources.snapshots import Snapshots


def read_table(spark: SparkSession, path: str, columns: dict[str, str] | None = None, sep: str = "\t", quoted: bool = True) -> DataFrame:
    """A delimited file with a header, all text, cut to `columns` ({header: new name}).

    Types are given by later casts: a schema on the reader would bind by position. gzip files are read by one
    task each, so the rows are dealt out right after the scan.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    df = (reader if quoted else reader.option("quote", "")).csv(path)
    if columns:
        df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", kind: str = "parquet", **options) -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).options(**options).format(kind).save(path)


def write_record(record: DataFrame, path: str) -> None:
    """One-row table of nested results as JSON."""
    record.coalesce(1).write.mode("overwrite").json(path)


def upsert_predictions(pred: DataFrame, path: str) -> None:
    """Replace the (config, model) partitions that pred holds, leave the others."""
    pred.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "model").parquet(path)


def upsert_versioned(pred: DataFrame, path: str) -> int:
    """Replace the (config, model) parts that pred holds, in one step; returns the version, which `Snapshots.read` takes."""
    return Snapshots(pred.sparkSession, path).replace(pred, ["config", "model"])


def read_checked(spark: SparkSession, path: str, sep: str = "\t", quoted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of delimited files with the same header each, all text: lines with more or fewer fields than the header has, or with a quote
    that doesn't end, are rejected as (file, record) and aren't rows. A record is a line."""
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    names = (reader if quoted else reader.option("quote", "")).csv(path).columns
    bad = "_record"
    while bad.lower() in {n.lower() for n in names}:
        bad = f"_{bad}"
    kinds = ", ".join("`" + n.replace("`", "``") + "` string" for n in [*names, bad])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad} | ({} if quoted else {"quote": ""})
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    fields = F.from_csv("value", kinds, options)
    parsed = lines.filter(F.col("value") != "").select("file", "value", fields.alias("f"))
    header = F.lit(True)
    for n in names:
        header = header & F.col(f"f.`{n}`").eqNullSafe(F.lit(n))
    parsed = parsed.filter(~header)
    good = F.col(f"f.`{bad}`").isNull()
    return parsed.filter(good).select(*[F.col(f"f.`{n}`").alias(n) for n in names]), parsed.filter(~good).select("file", F.col("value").alias("record"))


def quarantine(rejected: DataFrame, path: str) -> DataFrame:
    """Keep rejected records as a table, and count them by file."""
    rejected.write.mode("append").parquet(path)
    return rejected.sparkSession.read.schema(rejected.schema).parquet(path).groupBy("file").count()


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """A trial run's row cap; None is no cap."""
    return df if n is None else df.limit(n)
