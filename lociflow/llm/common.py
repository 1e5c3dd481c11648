"""Shared plumbing of the corpus operators: scratch tables, word hashing, winnowing, label folds."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space, as Java and DuckDB regular expressions read it.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a word for winnowing and classifiers: digits, lower-case letters and everything above ASCII; the rest becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lociflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside give back their shuffle files when they end. Else those stay until the driver happens to collect its garbage, and
    a job of many steps holds the shuffles of all of them."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Tables written in the shared folder: they cut lineage, and survive a lost executor. The shuffles of a table go when it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        with shuffles_dropped(self.spark):
            df.write.mode(mode).parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables whose readers have all run; without names, everything."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for at in [self.path(t) for t in tables] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


# ---------------------------------------------------------------- expressions


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows of the same one are equal but for their maps."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the one of the least row_hash; pre-aggregated before it is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(*keys, row, row_hash(df).alias("hash")).groupBy(*keys).agg(F.min_by("row", "hash").alias("row")).select("row.*")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; other text is translated letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def likely_least(h: Column, most: int, count) -> Column:
    """Whether a 64-bit hash is low enough to be among the `most` least of `count`: some four times as many rows pass, so that
    what is sorted in one place doesn't grow with the rows."""
    share = F.least(F.lit(1.0), F.lit(4.0 * most + 100) / F.greatest(F.lit(1.0), F.lit(count) if isinstance(count, int) else count))
    return h <= (share * 2.0 - 1.0) * float(1 << 63)


#: A text takes a sixteenth of a sample's bytes at most: of a longer one the head stands for it.
HEADS = 16


def charged(text: Column, most_bytes: int) -> Column:
    """The bytes that a text takes of a sample."""
    return F.coalesce(F.least(F.octet_length(text), F.lit(most_bytes // HEADS)), F.lit(0))


def head(text: Column, most_bytes: int) -> Column:
    """The text, or of one that is too long for a sample so many code points as surely fit."""
    return F.when(F.octet_length(text) > most_bytes // HEADS, F.substring(text, 1, max(1, most_bytes // HEADS // 4))).otherwise(text)


def bounded_sample(docs: DataFrame, marked: DataFrame, mark: str, limits: dict, most_bytes: int) -> DataFrame:
    """Whole rows of `docs` with the column `mark`: for each value of it at most limits[value] different (doc_id, text), those with
    the least hash of their id, as far as their texts together have most_bytes; of texts beyond a sixteenth of that only the head.

    marked: (doc_id, mark). Rows of one id and text count once. Neither rows nor bytes can go beyond the limits, whatever
    ids repeat, so the sample may be broadcast or sent to the driver.
    """
    tkey, size, place, upto = (spare(docs, f"_{x}") for x in ("tkey", "size", "place", "upto"))
    sized = docs.select("doc_id", F.xxhash64("text").alias(tkey), charged(F.col("text"), most_bytes).alias(size)).join(marked, "doc_id")
    sized = sized.groupBy("doc_id", tkey, mark).agg(F.max(size).alias(size)).withColumn(place, F.xxhash64("doc_id"))
    order, chosen, counts = [place, "doc_id", tkey], None, dict(sized.groupBy(mark).count().collect())  # one row a value of limits
    for value, most in sorted(limits.items()):
        part = sized.filter((F.col(mark) == value) & likely_least(F.col(place), most, counts.get(value, 0))).orderBy(*order).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    so_far = Window.partitionBy(mark).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # the limits' rows at most
    chosen = chosen.withColumn(upto, F.sum(size).over(so_far)).filter(F.col(upto) <= most_bytes).select("doc_id", tkey, mark)
    rows = docs.withColumn(tkey, F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", tkey]).withColumn("text", head(F.col("text"), most_bytes))
    return one_of_each(rows, ["doc_id", tkey, mark]).drop(tkey)


#: Bits of a key filter: some KEY_BITS a key, as a power of two; at most 16 MB, which go to each task.
KEY_BITS, FILTER_MOST = 16, 1 << 27


def _bits_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each key, end to end."""
    h = mix(keys.astype(np.int64).view(np.uint64))
    mask = np.uint64(bits - 1)
    return np.concatenate([h & mask, (h >> np.uint64(32)) & mask])


def key_filter(keys: DataFrame, scratch: Scratch, table: str):
    """A Bloom filter of one column of different longs, broadcast. A key that isn't there passes in some 1.5 % of all cases up to 8 million keys,
    more of them beyond; none that is there is left out, so an exact join may follow on what passes."""
    bits = min(FILTER_MOST, 1 << max(10, (KEY_BITS * keys.count() - 1).bit_length()))

    def words(batches):
        for batch in batches:
            at = np.unique(_bits_of(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(signed(np.uint64(1) << (at & np.uint64(63))))], ["w", "b"])

    known = scratch.write(table, keys.mapInArrow(words, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
    scratch.drop(table)
    held = np.zeros(bits // 64, np.uint64)
    held[known.column("w").to_numpy()] = known.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(held)


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    at = _bits_of(keys, 64 * len(held))
    hit = (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return hit[: len(keys)] & hit[len(keys) :]


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


# ---------------------------------------------------------------- inside tasks


#: The C library's call that gives back free memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about `limit` bytes of text (a longer text stands alone).

    After each batch what Arrow and the C library keep for later goes back to the system: workers share an executor's memory.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        del batch, size, part
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def word_runs(text: bytes, most: int = 2 << 20) -> Iterator[list[bytes]]:
    """The words of a text whose only white space is blanks, in lists of about `most` bytes, so that no very long one is held."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + most) if len(text) - at > most else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


#: What each kind of task remembers in a Python worker, by name: how to forget it.
_MEMORIES: dict = {}
_holder = [""]


def remember(name: str, forget) -> None:
    _MEMORIES[name] = forget


def claim(name: str) -> None:
    """A worker serves many kinds of tasks in turn; only one of them keeps its memory at a time."""
    if _holder[0] != name:
        for other, forget in _MEMORIES.items():
            if other != name:
                forget()
        _holder[0] = name


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to `limit` words in each Python worker."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


_HASHES = WordHashes()
remember("hashes", _HASHES.clear)


def hashed(words: list[bytes]) -> np.ndarray:
    claim("hashes")
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def hash_all(word_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts end to end, and where each text begins (one more entry: the end)."""
    ends = np.zeros(len(word_lists) + 1, np.int64)
    np.cumsum([len(w) for w in word_lists], out=ends[1:])
    flat = np.empty(int(ends[-1]), np.uint64)
    for words, a, b in zip(word_lists, ends[:-1].tolist(), ends[1:].tolist()):
        if b > a:
            flat[a:b] = hashed(words)
    return flat, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def grams(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions run over the end and must be ignored."""
    padded, by = np.concatenate([flat, np.zeros(k - 1, np.uint64)]), odd_multipliers(k, 17)
    total = np.zeros(len(flat), np.uint64)
    for j in range(k):
        total += padded[j : j + len(flat)] * by[j]
    return mix(total)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of k-word shingles of one text; the whole sequence if it is shorter; none if empty."""
    if not len(words):
        return words
    if len(words) < k:
        # The length goes in, so that no short text equals the beginning of a longer one.
        total = (words * odd_multipliers(k, 17)[: len(words)]).sum(keepdims=True, dtype=np.uint64)
        return mix(total + odd_multipliers(len(words), 23)[-1:])
    found = np.sort(grams(words, k)[: len(words) - k + 1])
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def winnow(keys: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: int) -> np.ndarray:
    """Which positions hold the minimum of some run of `window` keys inside [start, stop); the right one of equals.

    Sorted positions come back. Any span that covers `window` keys has a chosen position inside, whatever
    stands around it, so two texts that share the span choose the same one.
    """
    n = len(keys)
    if n < window:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    at = np.arange(n, dtype=np.uint64)
    least = (keys & ~low) | (low - (at & low))
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: n - window + 1], least[window - span : window - span + n - window + 1])
    inside = np.zeros(n + 1, np.int64)
    ok = stops - starts >= window
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, stops[ok] - window + 1, -1)
    first = np.flatnonzero(np.cumsum(inside)[: n - window + 1] > 0)
    place = (low - (least[first] & low)).astype(np.int64)
    return np.unique(first + ((place - first) & int(low)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column out of one numpy array a row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
