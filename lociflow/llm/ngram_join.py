"""N-gram Jaccard self-join by signature trees.

Two texts link when their sets of 5-word shingles have a Jaccard index of at least 3/4. The result is exact:

1. Equal word sequences collapse to one class (128-bit digest); all further work is on classes, by the 64-bit hash of
   their words. No row number or doc_id stands for a text, so ids may repeat.
2. A set that links to x shares one of the first |x| - ceil(3|x|/4) + 1 shingles of x, in any order that is the
   same for all sets. The order puts frequent shingles last and is by hash otherwise, so passages that
   many texts share seldom bring them together. Frequent ones are found over all texts: each task lists what
   it has more than once, the lists are summed, and at most HEAVY shingles pass. What is found later to be among the
   first ones of more than SMALL_BLOCK texts is put last as well, and those texts choose anew: else such blocks,
   more of them the more texts there are, would tie all texts to one family.
3. Shingles that two classes or more have among their first make blocks; they are found by partial aggregates, so a
   shingle that a third of all texts share fills no task. Two sets that link share even more of them than one: with
   c common first shingles, at most c + ceil(3n/4) - 1 shingles of the larger set n are common at all. Pairs of
   blocks of up to SMALL_BLOCK texts are counted inside the tasks and summed, those that reach the least c are
   kept; larger blocks are kept as stars. The components of that graph are families: texts that link are in one family.
4. A family is searched by signature trees: a leaf is a set's token bitmap and size, a node the OR of its
   children's bitmaps and the range of their sizes. Two nodes are walked together from the roots; a pair is
   dropped when its sizes can't match, or when the bits in common can't reach the least overlap that its sizes
   ask for. A family of many texts is dealt out as tiles, each searched together with up to LEADERS texts that all
   tiles of the family share: near copies come together through those, and the work grows with the number of tiles.
   Only tiles of texts that are still apart are then searched pair by pair, a batch of pairs after another, so that
   the disk grows with the texts and not with the pairs of tiles.
5. Of the pairs that the tree lets through a spanning forest is checked on the whole texts, and every pair
   whose bitmaps leave it open. Should a pair of the forest fail, all pairs of its family are checked.

Defined results: null, empty and wordless texts have no shingles and link with nothing; a text of fewer than 5
words has its whole sequence as one shingle; repeated doc_ids are rows of their own, each with its text's component; a
text that stands only under null doc_ids is linked with its equals alone, and null is their component; an empty
table gives an empty result; other columns are carried by `keep_one_of_each`, none is read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.llm.common import Scratch, hashed, key_filter, list_array, passes, row_hash, shingles, signed, slices, spare, texts
from lociflow.llm.components import components

WORDS, NUM, DEN = 5, 3, 4
#: Most frequent shingles told apart: 32 MB of hashes go to each task.
HEAVY, SEGMENT = 1 << 22, 1 << 22
#: Keys are searched for shared ones in so many parts, one after another, to hold the shuffle of one part at a time.
KEY_PARTS = 4
#: Blocks up to this size are counted pair by pair; texts of larger ones choose other first shingles, so often at most.
SMALL_BLOCK, ROUNDS = 64, 4
#: A tile holds about so many texts, or shingles, at most; a node so many children.
TILE, TILE_SHINGLES, FAN = 1024, 500_000, 8
#: Texts of a large family that each of its tiles meets; a linked group of a quarter of a tile has tiles of its own.
LEADERS, PURE = 64, 4
#: Ids of documents in question are broadcast up to this many (16 MB), beyond it as a filter of a fixed size.
ID_BROADCAST = 1_000_000

FEATURES = "doc_id bigint, digest binary, rep bigint, n bigint, heavy array<bigint>, heavy_n array<bigint>"


def split(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def enough(common, a, b):
    """Jaccard of at least NUM / DEN, in whole numbers."""
    return DEN * common >= NUM * (a + b - common)


def least_overlap(a, b):
    return -(-NUM * (a + b) // (NUM + DEN))


# ---------------------------------------------------------------- step 1 and 2: features, order, first shingles


class HeavyCounts:
    """What is in each SEGMENT of shingles twice or more, and how often it was there."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, hashes: np.ndarray):
        self.parts.append(hashes)
        self.size += len(hashes)
        return self.take() if self.size >= SEGMENT else None

    def take(self):
        if not self.size:
            return None
        every, n = np.unique(np.concatenate(self.parts), return_counts=True)
        keep = n >= 2
        self.parts, self.size = [], 0
        return signed(every[keep]), n[keep].astype(np.int64)


def _features(batches):
    heavy = HeavyCounts()
    full = []
    for batch in slices(batches):
        docs, digest, rep, size = batch.column("doc_id").to_pylist(), [], [], []
        for text in texts(batch):
            words = split(text)
            own = shingles(hashed(words), WORDS)
            line = b" ".join(words)
            digest.append(xxhash.xxh3_128_digest(line) if words else None)
            rep.append(xxhash.xxh64_intdigest(line) - (1 << 63))
            size.append(len(own))
            if (found := heavy.add(own)) is not None:
                full.append(found)
        n = len(docs)
        lists = [pa.nulls(n, pa.list_(pa.int64()))] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(digest, pa.binary()), pa.array(rep, pa.int64()), pa.array(size, pa.int64()), *lists],
            FEATURE_NAMES,
        )
    if (found := heavy.take()) is not None:
        full.append(found)
    for hashes, n in full:  # rows without a digest or an n carry the counts
        one = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*one, list_array([hashes], pa.int64()), list_array([n], pa.int64())], FEATURE_NAMES)


FEATURE_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def heavy_shingles(features: DataFrame, scratch: Scratch) -> np.ndarray:
    """Hashes of frequent shingles, sorted: those that SMALL_BLOCK texts have are likely among them, however many texts there are; at most HEAVY,
    the most frequent ones.

    Each segment lists what it has twice or more, so of a shingle that c texts have, some c * (1 - exp(-c / segments)) are listed. Which shingles
    are found is no matter of right results.
    """
    lists = features.filter("n IS NULL")
    segments = max(1, lists.count())
    least = max(2, round(SMALL_BLOCK / 2 * -np.expm1(-SMALL_BLOCK / segments)))
    each = lists.select(F.explode(F.arrays_zip("heavy", "heavy_n")).alias("x")).select("x.heavy", "x.heavy_n")
    found = scratch.write("heavy", each.groupBy("heavy").agg(F.sum("heavy_n").alias("c")).filter(F.col("c") >= least))
    counts = sorted(found.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).count().collect(), reverse=True)  # 65,536 rows at most
    passed = np.cumsum([n for _, n in counts])
    if len(counts) and passed[-1] > HEAVY:
        found = found.filter(F.col("c") >= counts[max(0, int(np.searchsorted(passed, HEAVY, "right")) - 1)][0]).limit(HEAVY)
    return np.sort(found.select("heavy").toArrow().column("heavy").to_numpy().astype(np.int64).view(np.uint64))


def _first_shingles(heavy):
    def run(batches):
        known, seen = heavy.value, set()
        rare_bits = max(22, len(known).bit_length() + 3)
        may = np.zeros(1 << rare_bits, bool)
        may[(known & np.uint64((1 << rare_bits) - 1)).astype(np.int64)] = True
        for batch in slices(batches):
            keys, reps = [], []
            for text in texts(batch):
                words = split(text)
                if not words:
                    continue
                rep = xxhash.xxh64_intdigest(b" ".join(words))
                if rep in seen:  # a copy within the task
                    continue
                if len(seen) < 2_000_000:
                    seen.add(rep)
                own = shingles(hashed(words), WORDS)
                n = len(own)
                first = n - -(-NUM * n // DEN) + 1
                late = may[(own & np.uint64((1 << rare_bits) - 1)).astype(np.int64)]
                if late.any():
                    at = np.flatnonzero(late)
                    place = np.minimum(np.searchsorted(known, own[at]), len(known) - 1)
                    late[at] = known[place] == own[at]
                    own = np.concatenate([own[~late], own[late]])
                keys.append(own[:first])
                reps.append(np.full(first, rep - (1 << 63), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(reps))], ["key", "rep"])

    return run


# ---------------------------------------------------------------- step 3: families


def _count_pairs(batches):
    """Rows come sorted by key; pairs of each block whose sizes may match, with their number of blocks in this task."""
    held, held_key, out, size = [], None, [], 0

    def close():
        if not held:
            return 0
        doc, n = (np.concatenate(x) for x in zip(*held))
        i, j = np.triu_indices(len(doc), 1)
        ok = (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])) & (doc[i] != doc[j])
        i, j = i[ok], j[ok]
        swap = doc[i] > doc[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out.append(np.stack([doc[i], doc[j], n[i], n[j]], axis=1))
        return len(i)

    def take():
        rows = np.concatenate(out)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]) if len(rows) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(rows)))
        return pa.RecordBatch.from_arrays([*(pa.array(rows[at, k]) for k in range(4)), pa.array(count.astype(np.int64))], ["a", "b", "na", "nb", "c"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, n = (batch.column(c).to_numpy() for c in ("key", "doc", "n"))
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:]):
            if key[a] != held_key:
                size += close()
                held, held_key = [], key[a]
                if size > 2_000_000:
                    yield take()
                    out, size = [], 0
            held.append((doc[a:b], n[a:b]))
    size += close()
    if size:
        yield take()


def _passing(held, column: str):
    """Rows whose key may be in the filter; none of a null key."""

    def run(batches):
        for batch in batches:
            key = batch.column(column)
            yield batch.filter(pc.and_(pa.array(passes(held.value, pc.fill_null(key, 0).to_numpy())), key.is_valid()))

    return run


def shared_keys(first: DataFrame, scratch: Scratch) -> DataFrame:
    """(key) of the first shingles that two classes or more share. All keys are shuffled for it, but only a part of them at a time."""
    parts = [first.filter(F.pmod("key", F.lit(KEY_PARTS)) == i).groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")) for i in range(KEY_PARTS)]
    return functools.reduce(DataFrame.unionByName, [scratch.write(f"keys-{i}", part.filter("lo < hi").select("key")) for i, part in enumerate(parts)])


def _blocks(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.write(name, members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("a")))


def blocks_of(docs: DataFrame, classes: DataFrame, heavy: np.ndarray, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of the first shingles that two classes or more share, and (key, m, a): how many do, and the least of them.

    A key of more than SMALL_BLOCK classes that is not among the heavy shingles joins them, and the classes that have it choose their first shingles
    anew; the others' stay as they are, as what comes late now was not among theirs. Blocks that are large after that hold texts of heavy shingles.
    """
    sc = docs.sparkSession.sparkContext
    first = scratch.write("first", docs.mapInArrow(_first_shingles(sc.broadcast(heavy)), "key bigint, rep bigint"))
    keys = shared_keys(first, scratch)
    # Most keys stand in one text alone, and don't have to be shuffled to be left out.
    held = key_filter(keys, scratch, "keys-filter")
    members = scratch.write("members", first.mapInArrow(_passing(held, "key"), first.schema).join(keys, "key", "left_semi").distinct())
    held.destroy()
    scratch.drop(*(f"keys-{i}" for i in range(KEY_PARTS)))
    blocks, chosen = _blocks(members, scratch, "blocks"), [(first, [])]
    for round_ in range(ROUNDS):
        large = blocks.filter(F.col("m") > SMALL_BLOCK).select("key")
        most = np.sort(large.limit(HEAVY).toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))
        more = np.setdiff1d(most, heavy)[: max(0, HEAVY - len(heavy))]
        if not len(more):
            break
        heavy = np.union1d(heavy, more)
        touched = scratch.write(f"touched-{round_}", members.join(large, "key", "left_semi").select("rep").distinct())
        anew = in_question(docs, touched, classes, scratch, f"touched-{round_}-ids").mapInArrow(_first_shingles(sc.broadcast(heavy)), first.schema)
        anew = scratch.write(f"first-{round_}", anew.join(touched, "rep", "left_semi").select("key", "rep").distinct())
        held = key_filter(anew.select("key").distinct(), scratch, f"anew-{round_}")
        pool = [members]
        for choice, since in chosen:  # of each class the latest choice counts
            pool.append(functools.reduce(lambda x, t: x.join(t, "rep", "left_anti"), since, choice.mapInArrow(_passing(held, "key"), first.schema)))
            since.append(touched)
        pool = functools.reduce(DataFrame.unionByName, pool).join(touched, "rep", "left_anti").unionByName(anew).distinct()
        chosen.append((anew, []))
        pool = scratch.write(f"pool-{round_}", pool)
        shared = pool.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
        members = scratch.write(f"members-{round_}", pool.join(shared, "key", "left_semi"))
        blocks = _blocks(members, scratch, f"blocks-{round_}")
    return members, blocks


def families(members: DataFrame, blocks: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) out of blocks_of: groups of classes outside of which no link is possible; lone ones are left out."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = members.join(blocks.filter(F.col("m") <= SMALL_BLOCK).select("key", "a"), "key").join(classes.select("rep", "n"), "rep")
    # Blocks are dealt out by their least text: near copies share many first shingles, and most of those blocks meet in one task, so a pair has few rows.
    small = small.select("a", "key", F.col("rep").alias("doc"), "n").repartition(parts, "a").sortWithinPartitions("a", "key").drop("a")
    counted = small.mapInArrow(_count_pairs, "a bigint, b bigint, na bigint, nb bigint, c bigint")
    counted = counted.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    large = scratch.write("large", members.join(blocks.filter(F.col("m") > SMALL_BLOCK).select("key", "a"), "key").select("a", F.col("rep").alias("b")))
    # A pair may also meet in large blocks, at most as often as either of its texts is in one.
    often = scratch.write("large-counts", large.groupBy("b").agg(F.count(F.lit(1)).alias("l")))
    for side in "ab":
        counted = counted.join(often.select(F.col("b").alias(side), F.col("l").alias(f"l{side}")), side, "left")
    both = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    wanted = F.ceil(F.lit(NUM) * (F.col("na") + F.col("nb")) / (NUM + DEN))
    most = F.col("c") + both + F.ceil(F.lit(NUM) * F.greatest("na", "nb") / DEN) - 1
    edges = scratch.write("edges", counted.filter(most >= wanted).select("a", "b").unionByName(large.filter("a <> b").distinct()))
    scratch.drop("large", "large-counts")
    return components(edges, scratch, "families")


# ---------------------------------------------------------------- step 4: signature trees


class Tree:
    """Levels of nodes from the leaves up: OR of bitmaps, size range, most shingles that share a bit with another."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, lost: np.ndarray):
        self.levels = [(bits, size, size, lost)]
        while len(self.levels[-1][1]) > FAN:
            bits, low, high, lost = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at))
            )

    def grow(self, height: int) -> None:
        """Single nodes on top, so that the tree is as high as another."""
        while len(self.levels) < height:
            bits, low, high, lost = self.levels[-1]
            if len(low) <= FAN:
                self.levels.append((np.bitwise_or.reduce(bits, axis=0)[None], low.min()[None], high.max()[None], lost.max()[None]))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and one past the last, a level below."""
        return node * FAN, np.minimum(node * FAN + FAN, len(self.levels[level - 1][1]))


def promising(a: Tree, b: Tree, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of nodes may hold a pair of leaves with enough overlap, and how many bits those have in common."""
    bits_a, low_a, high_a, lost_a = a.levels[level]
    bits_b, low_b, high_b, lost_b = b.levels[level]
    at = np.flatnonzero((high_a[x] * DEN >= NUM * low_b[y]) & (high_b[y] * DEN >= NUM * low_a[x]))
    kept, common = [], []
    step = max(1, (1 << 21) // max(1, bits_a.shape[1]))
    for k in range(0, len(at), step):
        i = at[k : k + step]
        n = np.bitwise_count(bits_a[x[i]] & bits_b[y[i]]).sum(1, dtype=np.int64)
        ok = n + np.minimum(lost_a[x[i]], lost_b[y[i]]) >= least_overlap(low_a[x[i]], low_b[y[i]])
        kept.append(i[ok])
        common.append(n[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *kept]), np.concatenate([none, *common])


def walk(a: Tree, b: Tree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves (of a, of b) that pass every test on the way down, and their common bits; with one tree, each pair once."""
    own, b = b is None, b or a
    top = max(len(a.levels), len(b.levels)) - 1
    a.grow(top + 1)
    b.grow(top + 1)
    x, y = (i.ravel() for i in np.meshgrid(np.arange(len(a.levels[top][1])), np.arange(len(b.levels[top][1])), indexing="ij"))
    for level in range(top, -1, -1):
        if own:
            keep = x < y if level == 0 else x <= y
            x, y = x[keep], y[keep]
        ok, common = promising(a, b, level, x, y)
        x, y = x[ok], y[ok]
        if level == 0 or not len(x):
            return x, y, common
        (ax, az), (bx, bz) = a.children(level, x), b.children(level, y)
        nx, ny = [], []
        for i in range(FAN):
            for j in range(FAN):
                live = (ax + i < az) & (bx + j < bz)
                nx.append((ax + i)[live])
                ny.append((bx + j)[live])
        x, y = np.concatenate(nx), np.concatenate(ny)
    return x, y, common


def search_family(doc: np.ndarray, size: np.ndarray, tile: np.ndarray, bitmaps: list[bytes], whole: bool) -> list[tuple[int, int, bool]]:
    """(a, b, sure) of pairs that may link, only across if there are two tiles: a spanning forest of those that link by
    their tokens (sure), and those that may link although their tokens don't say so; all pairs, not sure, if `whole`."""
    _, once = np.unique(np.stack([doc, tile], axis=1), axis=0, return_index=True)  # a text may come more than once
    doc, size, tile, bitmaps = doc[once], size[once], tile[once], [bitmaps[i] for i in once.tolist()]
    sets = [np.frombuffer(b, np.uint32) for b in bitmaps]
    width = np.array([len(x) for x in sets])
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1  # a token of one set is in no overlap
    shared = often[number] > 1
    bit, owner = rank[number[shared]], np.repeat(np.arange(len(sets)), width)[shared]
    bits = np.zeros((len(sets), int(rank[-1]) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    lost = size - width
    # Neighbours in the order of size and first token are likely alike, which keeps the upper bitmaps sparse.
    order = np.lexsort((np.array([x[0] for x in sets]), size))
    left, right = order[tile[order] == tile.min()], order[tile[order] != tile.min()]
    trees = [Tree(bits[at], size[at], lost[at]) for at in (left, right) if len(at)]
    x, y, common = walk(*trees)
    x, y = left[x], (right if len(right) else left)[y]
    links = enough(common, size[x], size[y])
    if whole:
        return [(min(p), max(p), False) for p in zip(doc[x].tolist(), doc[y].tolist()) if p[0] != p[1]]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for sure in (True, False):
        at = links == sure
        for i, j in zip(x[at].tolist(), y[at].tolist()):
            r, q = root(i), root(j)
            if r != q:
                if sure:
                    parent[r] = q
                if doc[i] != doc[j]:
                    found.append((min(int(doc[i]), int(doc[j])), max(int(doc[i]), int(doc[j])), sure))
    return found


def new_texts(batch: pa.RecordBatch, seen: set):
    """(rep, words) of the batch's texts that have words and were not seen in this task."""
    for text in texts(batch):
        words = split(text)
        rep = xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)
        if words and rep not in seen:
            if len(seen) < 2_000_000:
                seen.add(rep)
            yield rep, words


def _tokens(batches):
    """The set's bitmap as the sorted numbers of its bits, 32 bits of each shingle's hash."""
    seen: set = set()
    for batch in slices(batches):
        rep, size, bitmap = [], [], []
        for r, words in new_texts(batch, seen):
            own = shingles(hashed(words), WORDS)
            rep.append(r)
            size.append(len(own))
            bitmap.append(np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(size, pa.int64()), pa.array(bitmap, pa.binary())], ["doc", "n", "tokens"])


def _lines(batches):
    """(rep, line): the words of each text, parted by blanks."""
    seen: set = set()
    for batch in slices(batches):
        rows = [(r, b" ".join(words)) for r, words in new_texts(batch, seen)]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["rep", "line"])


def _search(whole: bool):
    """Rows come sorted by (family, tile_a, tile_b); a group may run over several batches, and is at most two tiles."""

    def close(held):
        table = pa.Table.from_batches(held)
        found = search_family(*(table.column(c).to_numpy() for c in ("doc", "n", "tile")), table.column("tokens").to_pylist(), whole)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["a", "b", "sure"])

    def run(batches):
        held, held_key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("family", "tile_a", "tile_b")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                key = tuple(keys[a].tolist())
                if held and key != held_key:
                    yield close(held)
                    held = []
                held_key = key
                held.append(batch.slice(a, b - a))
        if held:
            yield close(held)

    return run


def in_question(docs: DataFrame, reps: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of (doc_id, text) under the ids of the classes in reps (rep); other texts of those ids come along, and few of others. No text is shuffled."""
    ids = scratch.write(name, classes.join(reps, "rep", "left_semi").select(F.col("doc").alias("doc_id")).distinct())
    docs = docs.select("doc_id", "text")
    if ids.count() <= ID_BROADCAST:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.mapInArrow(_passing(key_filter(ids, scratch, f"{name}-filter"), "doc_id"), docs.schema)


def _searched(dealt: DataFrame, whole: bool, table: str, scratch: Scratch, mode: str = "overwrite") -> DataFrame:
    """(a, b, sure) out of rows (family, tile_a, tile_b, tile, doc, n, tokens)."""
    key = ["family", "tile_a", "tile_b"]
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    found = dealt.mapInArrow(_search(whole), "a bigint, b bigint, sure boolean")
    return scratch.write(table, found.groupBy("a", "b").agg(F.max("sure").alias("sure")), mode)


def _in_batches(dealt: DataFrame, batches: int, whole: bool, table: str, scratch: Scratch) -> DataFrame:
    """_searched, so many batches one after another: the pairs of tiles may be many, the disk for a batch of them is not."""
    batch = F.pmod(F.xxhash64("family", "tile_a", "tile_b"), F.lit(batches))
    for i in range(batches):
        found = _searched(dealt.filter(batch == i), whole, table, scratch, "append")
    return found


def tokens_of(docs: DataFrame, classes: DataFrame, family: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc, n, tokens, family, tiles) of the texts of families (id, component)."""
    each = in_question(docs, family.select(F.col("id").alias("rep")), classes, scratch, f"{name}-ids").mapInArrow(_tokens, "doc bigint, n bigint, tokens binary")
    each = each.join(family, F.col("doc") == F.col("id")).drop("id").withColumnRenamed("component", "family")
    each = scratch.write(f"{name}-tokens", each)
    count = each.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    return each.join(scratch.write(f"{name}-tiles", count), "family")


def _place(column: str, n) -> Column:
    return F.pmod(F.xxhash64(column), n).cast("int")


def search(each: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, sure) of all families, each tile by itself and with the leaders of its family."""
    own = each.withColumn("tile_a", _place("doc", F.col("tiles")))
    many = each.filter("tiles > 1")
    slot = F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(LEADERS)).alias("slot")
    leaders = scratch.write("leaders", many.groupBy("family", slot).agg(F.min("doc").alias("doc")).select("family", "doc"))
    led = many.join(leaders, ["family", "doc"]).withColumn("tile_a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = own.unionByName(led.select(own.columns)).withColumn("tile_b", F.col("tile_a")).withColumn("tile", F.lit(0))
    return _searched(dealt, False, "forest-pairs", scratch)


def search_apart(each: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(a, b, sure) across the linked groups of families of many tiles; None if no such family is in parts.

    A group of a PURE-th of a tile or more has tiles of its own, the others share the mixed ones; two tiles of one
    group need no search.
    """
    many = each.filter("tiles > 1").select("doc", "n", "tokens", "family")
    if many.isEmpty():
        return None
    known = components(links.join(many.select(F.col("doc").alias("a")), "a", "left_semi"), scratch, "apart")
    many = scratch.write("apart-texts", many.join(known, F.col("doc") == F.col("id"), "left").withColumn("part", F.coalesce("component", "doc")).drop("id", "component"))
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    parts = many.groupBy("family", "part").agg(F.count(F.lit(1)).alias("k"), chunks.alias("chunks"), F.sum("n").alias("n"))
    apart = parts.groupBy("family").count().filter("count > 1").select("family")
    parts = scratch.write("apart-parts", parts.join(apart, "family", "left_semi"))
    if parts.isEmpty():
        return None
    pure = parts.filter((F.col("k") >= TILE // PURE) | (F.col("n") >= TILE_SHINGLES // PURE)).select("family", "part", "chunks")
    texts_ = many.join(apart, "family", "left_semi").join(pure.select("family", "part", F.lit(True).alias("pure")), ["family", "part"], "left")
    mixed = texts_.filter("pure IS NULL").groupBy("family").agg(chunks.alias("chunks")).select("family", F.lit(None).cast("bigint").alias("part"), "chunks")
    sides = scratch.write("apart-sides", pure.unionByName(mixed))
    a, b = (sides.select("family", F.col("part").alias(f"part_{x}"), F.col("chunks").alias(f"chunks_{x}")) for x in "ab")
    both = a.join(b, "family").filter("part_a < part_b OR part_b IS NULL")  # groups, not texts; the mixed ones meet all, themselves too
    both = both.withColumn("chunk_a", F.explode(F.sequence(F.lit(0), F.col("chunks_a") - 1))).withColumn("chunk_b", F.explode(F.sequence(F.lit(0), F.col("chunks_b") - 1)))
    both = both.filter("part_a IS NOT NULL OR chunk_a <= chunk_b")
    both = scratch.write("apart-pairs-of-tiles", both.select("*", F.xxhash64("part_a", "chunk_a").alias("tile_a"), F.xxhash64("part_b", "chunk_b").alias("tile_b")))
    placed = texts_.withColumn("part", F.when(F.col("pure"), F.col("part"))).join(sides.select("family", F.col("part").alias("_part"), "chunks").alias("s"), "family")
    placed = placed.filter(F.col("part").eqNullSafe(F.col("_part"))).withColumn("chunk", _place("doc", F.col("chunks"))).select("family", "part", "chunk", "doc", "n", "tokens")
    dealt = None
    for tile, x in enumerate("ab"):
        pairs = both if x == "a" else both.filter("tile_a <> tile_b")
        pairs = pairs.select("family", F.col(f"part_{x}").alias("_part"), F.col(f"chunk_{x}").alias("_chunk"), "tile_a", "tile_b")
        side = placed.join(pairs.withColumnRenamed("family", "_family"), (F.col("family") == F.col("_family")) & F.col("part").eqNullSafe(F.col("_part")) & (F.col("chunk") == F.col("_chunk")))
        side = side.select("family", "tile_a", "tile_b", F.lit(tile).alias("tile"), "doc", "n", "tokens")
        dealt = side if dealt is None else dealt.unionByName(side)
    # A text goes to as many pairs of tiles as there are tiles: one batch of them after another, each of about as many rows as there are texts.
    return _in_batches(dealt, max(1, -(-2 * TILE * both.count() // max(1, many.count()))), False, "apart-pairs", scratch)


def search_whole(each: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, not sure) of all pairs that may link: every tile with every other."""
    tiled = each.withColumn("tile", _place("doc", F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("tile_a", F.least("tile", "other")).withColumn("tile_b", F.greatest("tile", "other"))
    return _in_batches(tiled.drop("other", "tiles"), each.agg(F.max("tiles")).first()[0] or 1, True, "whole-pairs", scratch)


# ---------------------------------------------------------------- exact check


def _verify(batches):
    for batch in slices(batches, "line_a"):
        keep, last, own = [], None, None
        for a, b in zip(texts(batch, "line_a"), texts(batch, "line_b")):
            if a != last:
                last, own = a, shingles(hashed(a.split(b" ")), WORDS)
            other = shingles(hashed(b.split(b" ")), WORDS)
            keep.append(enough(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose whole texts link. The texts of the classes in question are set apart first."""
    reps = scratch.write(f"{name}-reps", pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    lines = in_question(docs, reps, classes, scratch, f"{name}-verify").mapInArrow(_lines, "rep bigint, line binary")
    lines = scratch.write(f"{name}-texts", lines.join(reps, "rep", "left_semi").dropDuplicates(["rep"]))
    left = lines.select(F.col("rep").alias("a"), F.col("line").alias("line_a"))
    right = lines.select(F.col("rep").alias("b"), F.col("line").alias("line_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "line_a", "line_b")
    links = scratch.write(f"{name}-links", both.mapInArrow(_verify, "a bigint, b bigint").distinct())
    scratch.drop(f"{name}-texts")
    return links


# ---------------------------------------------------------------- the join


def labelled(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n) of every row of (doc_id, text), and (digest, component_id, stays) of every class: the smallest
    doc_id that its links reach, and whether the class is the one that stands for them (the smallest digest under that id)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    features = scratch.write("features", docs.mapInArrow(_features, FEATURES))
    heavy = heavy_shingles(features, scratch)
    known = features.filter("digest IS NOT NULL").groupBy("digest")
    classes = scratch.write("classes", known.agg(F.min("doc_id").alias("doc"), F.min("rep").alias("rep"), F.min("n").alias("n")))
    named = classes.filter("doc IS NOT NULL")

    members, blocks = blocks_of(docs, named, heavy, scratch)
    scratch.drop("heavy", "first", *(f"{x}-{i}" for i in range(ROUNDS) for x in ("first", "pool")))
    family = scratch.write("family", families(members, blocks, named, scratch))
    scratch.drop("members", "blocks", *(f"{x}-{i}" for i in range(ROUNDS) for x in ("members", "blocks", "touched")))
    each = tokens_of(docs, named, family, scratch, "forest")
    pairs = search(each, scratch)
    links = verified(pairs, docs, named, scratch, "forest")
    apart = search_apart(each, links, scratch)
    if apart is not None:
        pairs = pairs.unionByName(apart)
        links = links.unionByName(verified(apart, docs, named, scratch, "apart"))
    scratch.drop("forest-tokens", "leaders", "apart-texts")
    failed = pairs.filter("sure").join(links, ["a", "b"], "left_anti").select(F.col("a").alias("id")).join(family, "id").select("component").distinct()
    failed = scratch.write("failed", failed)
    if not failed.isEmpty():
        every = tokens_of(docs, named, family.join(failed, "component", "left_semi").select("id", "component"), scratch, "whole")
        links = links.unionByName(verified(search_whole(every, scratch), docs, named, scratch, "whole"))

    linked = classes.join(components(links, scratch, "components"), F.col("rep") == F.col("id"))
    linked = scratch.write("linked", linked.select("digest", "doc", "component"))
    best = linked.groupBy("component").agg(F.min("doc").alias("least"))
    heads = linked.join(best, "component").filter("doc = least").groupBy("component").agg(F.min("digest").alias("head"), F.min("least").alias("least"))
    of = linked.join(heads, "component").select("digest", F.col("least").alias("component_id"), (F.col("digest") == F.col("head")).alias("stays"))
    lone = classes.join(of, "digest", "left")
    labels = lone.select("digest", F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("stays", F.lit(True)).alias("stays"))
    return features.filter("n IS NOT NULL").select("doc_id", "digest", "n"), scratch.write("labels", labels)


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    rows, labels = labelled(docs, scratch)
    out = rows.join(labels, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _digested(batches):
    for batch in slices(batches):
        words = [split(t) for t in texts(batch)]
        digest = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, digest], [*batch.schema.names, "digest"])


def without(docs: DataFrame, ids: DataFrame, own: Column, scratch: Scratch) -> DataFrame:
    """The rows of docs whose id is not in ids (one column, joined by `own`). Texts are shuffled only of the rows that pass a filter of the ids,
    and only if those are too many to broadcast."""
    if ids.count() <= ID_BROADCAST:
        return docs.join(F.broadcast(ids), own, "left_anti")
    held = key_filter(ids, scratch, "gone-filter")

    @F.arrow_udf("boolean")
    def may_go(key: pa.Array) -> pa.Array:
        return pa.array(passes(held.value, key.to_numpy(zero_copy_only=False)))

    mark = spare(docs, "may_go")
    marked = docs.withColumn(mark, may_go(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint"))) | F.col("doc_id").isNull())
    return marked.filter(~F.col(mark)).drop(mark).unionByName(marked.filter(F.col(mark)).drop(mark).join(ids, own, "left_anti"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row of the smallest doc_id (of different texts under it the one of the smallest digest, of equal
    ones the one of the least row hash); rows without words all stay.

    Where an id has one row, the id tells what goes. Rows of repeated and null ids are told by their texts.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows, labels = labelled(docs, scratch)
    other = spare(docs, "other_id")
    goes = F.col("digest").isNotNull() & ~(F.col("stays") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    by_id = rows.join(labels, "digest", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(goes).alias("gone"))
    by_id = scratch.write("by-id", by_id.filter("n > 1 OR gone > 0 OR doc_id IS NULL").withColumnRenamed("doc_id", other))
    own = F.col("doc_id").eqNullSafe(F.col(other))
    kept = without(docs, by_id.select(other), own, scratch)
    several = by_id.filter((F.col("n") > 1) | F.col(other).isNull()).select(other)
    if several.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    told = docs.join(several, own, "left_semi").select(row, row_hash(docs).alias("hash"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    told = told.mapInArrow(_digested, T.StructType([*told.schema.fields, T.StructField("digest", T.BinaryType())])).drop("text")
    told = told.join(labels, "digest", "left").filter(~goes)
    wordless = told.filter("digest IS NULL").select("row.*")
    return kept.unionByName(wordless).unionByName(told.filter("digest IS NOT NULL").groupBy("digest").agg(F.min_by("row", "hash").alias("row")).select("row.*"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Scratch(spark, "op3"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p, w FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS t FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, near) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.near = e.a),
c AS (SELECT id, least(id, min(near)) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
"""
