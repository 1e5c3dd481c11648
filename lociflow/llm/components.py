"""Connected components of a table of links, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import Scratch


#: A hub with this share of all edges or more (so there are 1 / HOT_SHARE of them at most) is looked up by broadcast.
HOT_EDGES, HOT_SHARE = 256, 1e-3


def _tied(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, k), where k is the number of u's edges: no hub's edges go to one task."""
    bound = max(HOT_EDGES, int(total * HOT_SHARE))
    marked = edges.join(F.broadcast(least.filter(F.col("k") >= bound).select("u", "m")), "u", "left")
    cold = marked.filter("m IS NULL").select("u", "v").join(least.filter(F.col("k") < bound).select("u", "m"), "u")
    return marked.filter("m IS NOT NULL").select("u", "v", "m").unionByName(cold.select("u", "v", "m"))


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    A large star ties each id's larger neighbours to its smallest one, a small star its smaller ones; both are
    a minimum per id joined back to the edges, and the few ids with very many edges are joined by broadcast, so no
    neighbourhood is gathered in one place. Each round is written and the one before it deleted; the rounds end when the edges are stars.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(f"{name}-0", edges)
    round_, before, total = 0, None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = _tied(both.filter("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(f"{name}-large-{round_}", large)
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = _tied(large, down, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.write(f"{name}-{round_ + 1}", small)
        state = tuple(nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{round_}", f"{name}-large-{round_}")
        edges, round_, total = nxt, round_ + 1, state[0]
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
