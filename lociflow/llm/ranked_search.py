"""Exact ranked lexical search: ball trees over sparse document vectors, searched best-first.

A document is a vector of saturated term counts, an item one of term weights, the score their inner product in whole numbers. Three passes:

1. Texts are parted once. A document keeps, of the terms that any item has, their places in the items' vocabulary and its own
   counts; this goes to a scratch table. N, L and the terms' document counts are Spark aggregates over all of it.
2. Each task gathers its documents to tiles of TILE_ENTRIES counts and builds a ball tree on each: a node has the centroid of its documents
   and the radius around it, near the leaves a radius for each of GROUPS groups of terms. No inner product inside is above q.c plus the sum
   of |q| r over the groups, so a node is passed over if that, rounded up, is below the score an item's last place has so far in the task. Nodes are taken best-first; at the leaves scores are made in 64-bit whole numbers. A task
   sends on at most `most` rows an item, whatever it has read.
3. The tasks' rows are ranked, first within SALT parts of each item, then of what is left of them.

A tree's space is scaled, coordinate by coordinate, which changes no inner product: terms that vary much and are seldom asked count less in the radius.

Items go to the tasks in blocks of BLOCK_BYTES of text, each block a pass. Broadcast is a block's vocabulary and weights, no more.

Defined results: null and termless texts have no terms and are found for nothing; items without a hit have no rows; rows of `docs` that
share a doc_id are documents of their own, null ids last among equal scores; equal rows of (item_id, text) are one item, rows of one item_id
with other texts items of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import WORD_BYTES, Scratch, list_array, slices, texts, word_runs

#: Bytes of text of the items that are searched for in one pass.
BLOCK_BYTES = 4 << 20
#: Counts and documents in a tile; documents of a leaf; numbers in the centroids of a tile, beyond which leaves get larger.
TILE_ENTRIES, TILE_DOCS, LEAF, CENTROIDS = 1 << 19, 1 << 13, 16, 8 << 20
#: Groups of terms, and at how many of the lowest levels they have radii of their own: higher up nodes hold about everything.
GROUPS, GROUPED = 1024, 3
#: Parts in which an item's candidates are ranked first.
SALT = 16
VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "item int, doc_id bigint, score bigint"


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded size: runs of ASCII letters, digits and everything above ASCII, A-Z lower-cased."""
    return word_runs(text.translate(WORD_BYTES)) if text else iter(())


# ---------------------------------------------------------------- first pass


def _vectors(vocabulary):
    def run(batches):
        place = vocabulary.value
        for batch in slices(batches):
            size, kinds, counts = [], [], []
            for text in texts(batch):
                n, parts = 0, []
                for words in terms(text):
                    n += len(words)
                    found = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
                    parts.append(np.unique(found[found >= 0], return_counts=True))
                if len(parts) > 1:
                    kind, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    parts = [(kind, np.bincount(at, np.concatenate([p[1] for p in parts])))]
                kind, count = parts[0] if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
                size.append(n)
                kinds.append(kind.astype(np.int32))
                counts.append(count.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), list_array(kinds, pa.int32()), list_array(counts, pa.int32())], ["doc_id", "n", "terms", "counts"]
            )

    return run


# ---------------------------------------------------------------- second pass


class Tree:
    """A complete binary tree of balls over documents with at least one term each; node i has the children 2i + 1 and 2i + 2.

    ids, absent: doc_ids, and where they are null; ends: where each document's entries end; term, value: the entries, terms ascending in
    a document. share: how often items ask for each term.
    """

    def __init__(self, ids: np.ndarray, absent: np.ndarray, ends: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray, share: np.ndarray):
        self.terms, local = np.unique(term, return_inverse=True)
        docs, width = len(ids), len(self.terms)
        own = value.astype(np.float64)
        mean, square = np.bincount(local, own, width) / docs, np.bincount(local, own * own, width) / docs
        spread = np.maximum(square - mean * mean, 1e-6 * square)
        self.scale = np.sqrt(np.maximum(weight[self.terms], 1)) * (np.maximum(share[self.terms], 1e-9) / spread) ** 0.25
        levels = 0
        while docs >> levels > LEAF and (4 << levels) * width <= CENTROIDS:
            levels += 1
        # The terms that matter most are groups of their own, the others share the rest.
        value_of = weight[self.terms] * share[self.terms]
        self.group = np.empty(width, np.int64)
        self.group[np.argsort(-value_of, kind="stable")] = np.where(np.arange(width) < GROUPS // 2, np.arange(width), GROUPS // 2 + np.arange(width) % (GROUPS // 2))
        node = np.zeros(docs, np.int64)
        row = np.repeat(np.arange(docs), np.diff(ends, prepend=0))
        x = own * self.scale[local]
        length = np.bincount(row, x * x, docs)
        self.levels = []
        for level in range(levels + 1):
            nodes = 1 << level
            size = np.bincount(node, minlength=nodes)
            centre = np.bincount(node[row] * width + local, x, nodes * width).reshape(nodes, width) / size[:, None]
            norm = (centre * centre).sum(1)
            apart = length - 2 * np.bincount(row, x * centre[node[row], local], docs) + norm[node]
            # What rounding can have taken away is far below a billionth of the two lengths.
            apart = np.maximum(apart, 0) + 1e-9 * (length + norm[node])
            if level > levels - GROUPED:
                self.levels.append((centre, self._group_radii(node, centre, row, local, x)))
            else:
                radius = np.zeros((nodes, 1))
                np.maximum.at(radius[:, 0], node, apart)
                self.levels.append((centre, np.sqrt(radius)))
            if level < levels:
                node = self._split(node, nodes, apart, row, local, x, length, width)
        self.first_leaf = (1 << levels) - 1
        order = np.argsort(node, kind="stable")
        begin = np.concatenate([np.zeros(1, np.int64), ends])[order]
        size = ends[order] - begin
        self.starts = np.cumsum(size) - size
        entries = np.repeat(begin - self.starts, size) + np.arange(len(term))
        self.local, self.value = local[entries], value[entries]
        self.ids, self.absent = ids[order], absent[order]
        self.leaves = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(node, minlength=1 << levels))])
        self.ask = np.zeros(width, np.int64)

    def _group_radii(self, node, centre, row, local, x) -> np.ndarray:
        """The radius of each node in each group of terms, a little rounded up."""
        nodes, docs = len(centre), len(node)
        norm = np.zeros((nodes, GROUPS))
        for group, part in zip(*self._grouped(centre * centre)):
            norm[:, group] = part
        key = row * GROUPS + self.group[local]
        own = np.bincount(key, x * x, docs * GROUPS).reshape(docs, GROUPS)
        apart = own - 2 * np.bincount(key, x * centre[node[row], local], docs * GROUPS).reshape(docs, GROUPS) + 1e-9 * own
        by = np.argsort(node, kind="stable")
        size = np.bincount(node, minlength=nodes)
        return np.sqrt(np.maximum(np.maximum.reduceat(apart[by], np.cumsum(size) - size) + norm * (1 + 1e-9), 0))

    def _grouped(self, table: np.ndarray):
        """(groups, their sums over the columns of a table)."""
        by = np.argsort(self.group, kind="stable")
        groups, first = np.unique(self.group[by], return_index=True)
        return groups.tolist(), np.add.reduceat(table[:, by], first, axis=1).T

    @staticmethod
    def _split(node, nodes, apart, row, local, x, length, width):
        """Each node's documents in two halves, along the line from the one farthest from the centre to the one farthest from that."""

        def farthest(far: np.ndarray) -> np.ndarray:
            by = np.lexsort((far, node))
            return by[np.cumsum(np.bincount(node, minlength=nodes)) - 1]

        def nearness(pivot: np.ndarray) -> np.ndarray:
            """Inner product of each document with its node's pivot."""
            of = np.full(len(length), -1)
            of[pivot] = np.arange(nodes)
            chosen = of[row] >= 0
            table = np.zeros((nodes, width))
            table[of[row[chosen]], local[chosen]] = x[chosen]
            return np.bincount(row, x * table[node[row], local], len(length))

        one = farthest(apart)
        to_one = nearness(one)
        two = farthest(length - 2 * to_one)
        by = np.lexsort((nearness(two) - to_one, node))
        size = np.bincount(node, minlength=nodes)
        place = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
        out = np.empty_like(node)
        out[by] = 2 * node[by] + (place >= (size[node[by]] + 1) // 2)
        return out

    def search(self, item: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offer `best` every document that can be among its highest scores."""
        at = np.searchsorted(self.terms, item)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == item[here]
        if not here.any():
            return
        at, own = at[here], weight[here]
        asked = own / self.scale[at]
        groups, which = np.unique(self.group[at], return_inverse=True)
        norms = np.sqrt(np.bincount(which, asked * asked))
        whole = math.sqrt(float(asked @ asked))
        parts = [c[:, at] @ asked + (r[:, groups] @ norms if r.shape[1] > 1 else r[:, 0] * whole) for c, r in self.levels]
        above = (np.concatenate(parts) * (1 + 1e-9) + 1).tolist()
        self.ask[at] = own
        queue = [(-above[0], 0)]
        while queue and -queue[0][0] >= best.floor:
            node = heapq.heappop(queue)[1]
            if node >= self.first_leaf:
                a, b = self.leaves[node - self.first_leaf : node - self.first_leaf + 2].tolist()
                begin, end = int(self.starts[a]), int(self.starts[b]) if b < len(self.starts) else len(self.local)
                scores = np.add.reduceat(self.value[begin:end] * self.ask[self.local[begin:end]], self.starts[a:b] - begin)
                best.offer(scores, self.ids[a:b], self.absent[a:b])
                continue
            for child in (2 * node + 1, 2 * node + 2):
                if above[child] >= best.floor:
                    heapq.heappush(queue, (-above[child], child))
        self.ask[at] = 0


class Best:
    """The highest scores of one item: at most `most`, equal ones by ascending doc_id, null ids last."""

    def __init__(self, most: int):
        self.most, self.floor = most, 1
        self.scores, self.ids, self.absent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        high = scores >= self.floor
        if not high.any():
            return
        every = [np.concatenate([a, b[high]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.absent, absent))]
        first = np.lexsort((every[1], every[2], -every[0]))[: self.most]
        self.scores, self.ids, self.absent = (x[first] for x in every)
        if len(first) == self.most:
            self.floor = int(self.scores[-1])


def saturated(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a document's score, before its weight."""
    return 1_000_000_000 * count // (1000 * count + 20 * m)


def _search(items, most: int, documents: int, length: int):
    def run(batches):
        wanted, weight, share = items.value
        best = [Best(most) for _ in wanted]
        held, entries, rows = [], 0, 0

        def tile() -> None:
            ids, absent, size, term, value = (np.concatenate(x) for x in zip(*held))
            tree = Tree(ids, absent, np.cumsum(size), term, value, weight, share)
            for own, found in zip(wanted, best):
                tree.search(own, weight[own], found)
            held.clear()

        for batch in batches:
            lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            term, n = lists.flatten().to_numpy(), batch.column("n").to_numpy()
            if 50 * int(n.max(initial=0)) * documents < 1 << 63:
                m = 50 + 50 * n * documents // length
            else:
                m = np.array([50 + 50 * x * documents // length for x in n.tolist()], np.int64)
            value = saturated(counts, np.repeat(m, size))
            ids = batch.column("doc_id")
            absent, full = ids.is_null().to_numpy(zero_copy_only=False), size > 0
            ids = ids.fill_null(0).to_numpy()
            ends = np.cumsum(size)
            part = np.diff((ends - size) // TILE_ENTRIES) + np.diff(np.arange(len(size)) // TILE_DOCS)  # a batch can be larger than a tile
            edges = [0, *(np.flatnonzero(part) + 1).tolist(), len(size)] if len(size) else [0]
            for a, b in zip(edges, edges[1:]):
                some = full[a:b]
                if not some.any():
                    continue
                first, last = int(ends[a] - size[a]), int(ends[b - 1])
                held.append((ids[a:b][some], absent[a:b][some], size[a:b][some], term[first:last], value[first:last]))
                entries, rows = entries + last - first, rows + int(some.sum())
                if entries >= TILE_ENTRIES or rows >= TILE_DOCS:
                    tile()
                    entries = rows = 0
        if held:
            tile()
        for i, found in enumerate(best):
            if len(found.scores):
                arrays = [pa.array(np.full(len(found.scores), i, np.int32)), pa.array(found.ids, mask=found.absent), pa.array(found.scores)]
                yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "score"])

    return run


# ---------------------------------------------------------------- the whole search


def blocks(benchmark: DataFrame, most: int) -> Iterator[list]:
    """Distinct (item_id, text) in lists of at most `most` bytes of text; a longer text stands in a list with few others or none."""
    items = benchmark.select("item_id", "text").distinct().withColumn("_place", F.xxhash64("item_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = 1 if total <= most else 2 * -(-total // most)
    if parts > 1:
        largest = lambda p: items.groupBy(F.pmod("_place", F.lit(p))).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n"))
        while parts < 1 << 20 and not largest(parts).filter((F.col("s") > most) & (F.col("n") > 1)).isEmpty():
            parts *= 2
    for part in range(parts):
        rows = (items if parts == 1 else items.filter(F.pmod("_place", F.lit(parts)) == part)).select("item_id", "text").collect()
        if rows:
            yield rows


def search(docs: DataFrame, benchmark: DataFrame, most: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's `most` highest-scoring documents with a score above 0."""
    kind = benchmark.schema["item_id"].dataType
    out = None
    for rows in blocks(benchmark, block_bytes):
        one = _search_block(docs, rows, kind, most)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return out


def _search_block(docs: DataFrame, rows: list, kind, most: int) -> DataFrame:
    spark = docs.sparkSession
    own = [{w for words in terms(r["text"].encode() if r["text"] is not None else None) for w in words} for r in rows]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*own)))}
    wanted = [np.sort(np.fromiter(map(vocabulary.__getitem__, x), np.int64, len(x))) for x in own]
    scratch = Scratch(spark, "search")
    vectors = scratch.write("vectors", docs.select("doc_id", "text").mapInArrow(_vectors(spark.sparkContext.broadcast(vocabulary)), VECTORS).filter("n > 0"))
    total = vectors.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
        held[term] = count
    weight = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * int(d) + 1))) for d in held], np.int64)
    share = np.bincount(np.concatenate(wanted), minlength=len(vocabulary)) / len(rows)
    items = spark.sparkContext.broadcast((wanted, weight, share))
    found = vectors.mapInArrow(_search(items, most, total["documents"], total["length"]), FOUND)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= most)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(DISTINCT doc_id) AS big_n, count(*) AS big_l FROM t),
d AS (SELECT doc_id, 50 + (50 * count(*) * big_n) // big_l AS m FROM t, g GROUP BY doc_id, big_n, big_l),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""
