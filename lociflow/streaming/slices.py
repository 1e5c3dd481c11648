"""Arriving files: the batch operators over a stream, with the same result however the files are cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from lociflow.operators.dedup import keep_best
from lociflow.sources.snapshots import Snapshots


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, name_filter: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    for option, value in (("maxFilesPerTrigger", files_per_batch), ("pathGlobFilter", name_filter)):
        reader = reader.option(option, value) if value else reader
    return reader.parquet(path)


def append_all(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Run a row-wise operator (labelling, cleaning, joins with static tables) over all there is, and append its rows."""
    query = operator(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_first(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """One row a key: the first that arrives. With an event time the state is bounded by how late rows may be."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def keep_best_arriving(stream: DataFrame, keys: list[str], order: list[Column], path: str, checkpoint: str, runs: int = 8) -> None:
    """The best row of each key among all that have arrived, as a versioned table; `best_so_far` reads it.

    A batch adds its own best rows as one more run, so its work grows with the batch, not with the table; from `runs` runs on they are merged
    into one. The version's manifest names the batch, so a batch that is run again after a crash changes nothing. What is best doesn't depend on
    how the rows arrive: `order` and then all columns settle it.
    """

    def put(batch: DataFrame, number: int) -> None:
        table = Snapshots(batch.sparkSession, path)
        if table.fact("batch", -1) >= number:
            return
        table.append(keep_best(batch, keys, order), batch=number)
        if len(table.manifest()["parts"]) >= runs:
            table.compact(lambda rows: keep_best(rows, keys, order))
        table.clean()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def best_so_far(spark: SparkSession, path: str, keys: list[str], order: list[Column]) -> DataFrame:
    return keep_best(Snapshots(spark, path).read(), keys, order)


def running_counts(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Totals by key, a new folder under `path` for each batch; `latest` reads them.

    The folder before stays until the next batch is whole, so a crash in between loses nothing, and a batch that
    is run again replaces its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:012d}")
        fs, whole = _whole(batch.sparkSession, path)
        for old in whole[:-2]:
            fs.delete(old, True)

    counts = stream.groupBy(*keys).count()
    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _whole(spark: SparkSession, path: str):
    """The file system of `path`, and its batches that are written to the end, oldest first."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted((s.getPath().getParent() for s in fs.globStatus(Path(f"{path}/*/_SUCCESS"))), key=lambda p: p.getName())


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The totals after the last whole batch of `running_counts`."""
    whole = _whole(spark, path)[1]
    if not whole:
        raise FileNotFoundError(f"no whole batch under {path}")
    return spark.read.parquet(whole[-1].toString())
