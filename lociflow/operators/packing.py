"""Greedy batches in a given order, exact: the next item opens a new batch if it doesn't fit.

Where a batch ends depends on where it begins, which is one chain through all items. A batch has at most max_items items, so
it ends among the next max_items places, and what a block of BLOCK places does to the chain is a table: for each of the max_items places at which the chain can
enter the block, where it enters the next one, and how many batches begin in between. Such tables are combined by pointer doubling, in as many rounds as
the number of blocks has binary digits; then each block knows its entry, and numbers its batches by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.names import spare
from lociflow.operators.ranks import running_by_range
from lociflow.sources.shared import written

BLOCK = 4096


def _successors(costs: np.ndarray, own: int, max_items: int, max_cost: int) -> np.ndarray:
    """For each of the first `own` places, where the batch that begins there ends."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(costs)])
    fits = np.searchsorted(upto, upto[:own] + max_cost, "right") - 1
    here = np.arange(own)
    return np.minimum(np.maximum(fits, here + 1), np.minimum(here + max_items, len(costs)))


def _tables(max_items: int, max_cost: int, size: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        place, cost = rows.column("place").to_numpy(), rows.column("cost").to_numpy()
        block = int(key[0].as_py())
        own = int(np.count_nonzero(place < (block + 1) * size))
        after = _successors(cost, own, max_items, max_cost)
        leaves, begun = np.zeros(own, np.int64), np.zeros(own, np.int64)
        for i in range(own - 1, -1, -1):
            j = int(after[i])
            leaves[i], begun[i] = (j - own, 1) if j >= own else (leaves[j], begun[j] + 1)
        # Places beyond the last item: nothing begins there.
        pad = max(0, max_items - own)
        exits = np.concatenate([leaves[:max_items], np.arange(own, own + pad) - own])
        counts = np.concatenate([begun[:max_items], np.zeros(pad, np.int64)])
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (after, exits, counts)]
        return pa.table([pa.array([block], pa.int64()), *lists], ["block", "after", "exits", "counts"])

    return run


def _numbered(batches):
    """The number of each place's batch within its block; -1 goes to the last batch of the blocks before."""
    for batch in batches:
        out = []
        for after, entry in zip(batch.column("after").to_pylist(), batch.column("entry").to_pylist()):
            own, i, number = np.full(len(after), -1, np.int64), entry, 0
            while i < len(after):
                own[i : after[i]] = number
                i, number = after[i], number + 1
            out.append(own.tolist())
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("before"), pa.array(out, pa.list_(pa.int64()))], ["block", "before", "numbers"])


def _entries(tables: DataFrame) -> DataFrame:
    """(block, entry, before): where the chain enters each block, and how many batches begin in the blocks before it."""
    last = tables.agg(F.max("block")).first()[0] or 0
    state, step = tables.select("block", "exits", "counts"), 1
    while step <= last:
        # Entry i of a block's table now goes through its last `step` blocks; put the `step` blocks before those in front.
        earlier = state.select((F.col("block") + step).alias("block"), F.col("exits").alias("e"), F.col("counts").alias("c"))
        joined = state.join(earlier, "block", "left")
        chained = F.transform("e", lambda x: F.element_at("exits", (x + 1).cast("int")))
        summed = F.transform(F.arrays_zip(F.col("e").alias("e"), F.col("c").alias("c")), lambda x: x["c"] + F.element_at("counts", (x["e"] + 1).cast("int")))
        joined = joined.select("block", F.when(F.col("e").isNull(), F.col("exits")).otherwise(chained).alias("exits"), F.when(F.col("e").isNull(), F.col("counts")).otherwise(summed).alias("counts"))
        state, step = written(joined, "chain"), step * 2
    following = state.select((F.col("block") + 1).alias("block"), F.get("exits", F.lit(0)).alias("entry"), F.get("counts", F.lit(0)).alias("before"))
    return tables.select("block").join(following, "block", "left").na.fill(0, subset=["entry", "before"])


def greedy_batches(df: DataFrame, order: list[Column], cost: Column, max_items: int = 32, max_cost: int = 16_000, name: str = "batch", block: int = BLOCK) -> DataFrame:
    """df with the number (from 0) of each row's batch: rows are taken in `order`, and one that would be the batch's item number max_items + 1 or bring its cost
    above max_cost opens the next. A row that costs more than max_cost is a batch of its own.

    `order` must tell all rows apart. Costs are whole numbers from 0 (null: 0). No task holds more than `block` + max_items rows.
    """
    if not 0 < max_items <= block:
        raise ValueError("a batch must fit in a block")
    place, own, at = spare(df, "_place", "_cost", "_block")
    ranked = running_by_range(df.withColumn(own, F.coalesce(cost.cast("bigint"), F.lit(0))), [], order, {place: F.lit(1)})
    rows = written(ranked.withColumn(place, F.col(place) - 1).withColumn(at, F.call_function("div", F.col(place), F.lit(block).cast("bigint"))), "placed")
    narrow = rows.select(F.col(at).alias("block"), F.col(place).alias("place"), F.col(own).alias("cost"))
    ahead = narrow.filter((F.col("place") % block < max_items) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    schema = "block bigint, after array<bigint>, exits array<bigint>, counts array<bigint>"
    tables = written(narrow.unionByName(ahead).groupBy("block").applyInArrow(_tables(max_items, max_cost, block), schema), "tables")
    entered = tables.select("block", "after").join(_entries(tables), "block")
    numbers = entered.mapInArrow(_numbered, "block bigint, before bigint, numbers array<bigint>").withColumnsRenamed({"block": "_b", "before": "_before", "numbers": "_numbers"})
    joined = rows.join(numbers, F.col(at) == F.col("_b"))
    number = F.col("_before") + F.element_at("_numbers", (F.col(place) % block + 1).cast("int"))
    return joined.select(*df.columns, number.alias(name))
