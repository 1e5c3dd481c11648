"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every sliding window; with k = 5 and 6 hashes a window, every run of
10 equal words has a fingerprint in common. Fingerprints that meet are extended word by word to the whole
equal run, and a run counts from 10 words on. An item of fewer than 10 words is one window of its own: its
length is then the k, with a window of one hash.

A benchmark of up to BLOCK_BYTES is sent to the tasks, which scan the documents once. A larger one stays where it is:
fingerprints of both sides are joined, and the texts of the pairs that meet are extended in tasks dealt by item.
Neither side goes through the driver then, and a fingerprint that many texts share is a hot key of a plain join.

Defined results: null and wordless texts have no words and are never hit; wordless items have no windows;
items of the same id count once, other equal items each; every row of `docs` has a row in the result, whatever ids or
texts repeat or are null, and whichever way is taken; an empty benchmark leaves everything clean; other columns are
carried by `decontaminate`, whatever their names, none is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import WORD_BYTES, Scratch, grams, hash_all, list_array, one_of_each, signed, slices, spare, texts, winnow

WINDOW, GRAM = 10, 5
#: Texts of a benchmark that is sent to the tasks: 2 million words at most, 32 MB of word hashes and about as much of fingerprints.
BLOCK_BYTES = 4 << 20
SPANS = "doc_id bigint, n_words bigint, lo array<bigint>, hi array<bigint>, items array<string>"
#: What `split` takes for words.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def split(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Items:
    """Fingerprints of a block of items, sorted for look-up, and the items' word hashes for extension."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        words = [split(t.encode() if t is not None else None) for _, t in rows]
        self.names = [str(i) for i, _ in rows]
        self.flat, self.ends = hash_all(words)
        sizes = np.diff(self.ends)
        keys, at = [], []
        if len(self.flat):
            long = sizes >= window
            starts, stops = self.ends[:-1][long], self.ends[1:][long] - gram + 1
            hashes = grams(self.flat, gram)
            chosen = winnow(hashes, starts, stops, window - gram + 1)
            keys.append(hashes[chosen])
            at.append(chosen)
        self.keys, self.at = self._sorted(keys, at)
        #: By length: hash of the whole short item and where it begins.
        self.short = {}
        for n in sorted(set(sizes[(sizes > 0) & (sizes < window)].tolist())):
            begin = self.ends[:-1][sizes == n]
            self.short[n] = self._sorted([grams(self.flat, n)[begin]], [begin])
        self.owner = np.repeat(np.arange(len(rows)), sizes)

    @staticmethod
    def _sorted(keys: list[np.ndarray], at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        a = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(k, kind="stable")
        return k[order], a[order]


def meet(keys: np.ndarray, positions: np.ndarray, own: np.ndarray, at: np.ndarray):
    """(document position, item position) pairs with equal fingerprints."""
    left, right = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
    hit = np.flatnonzero(right > left)
    for i in hit.tolist():
        for j in range(left[i], right[i]):
            yield int(positions[i]), int(at[j])


def spans(flat: np.ndarray, ends: np.ndarray, items: Items) -> dict[int, list[tuple[int, int, int]]]:
    """By document: (first word, end word, item) of every equal run that holds a window."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    if not len(flat):
        return found
    reached: dict[tuple[int, int], int] = {}  # (document, item position - document position): where the last run ended

    def extend(p: int, q: int, least: int) -> None:
        doc = int(np.searchsorted(ends, p, "right")) - 1
        if reached.get((doc, q - p), -1) > p:
            return
        item = int(items.owner[q])
        back = min(p - ends[doc], q - items.ends[item])
        ahead = min(ends[doc + 1] - p, items.ends[item + 1] - q)
        before = flat[p - back : p][::-1] != items.flat[q - back : q][::-1]
        after = flat[p : p + ahead] != items.flat[q : q + ahead]
        lo = p - (int(before.argmax()) if before.any() else int(back))
        hi = p + (int(after.argmax()) if after.any() else int(ahead))
        reached[(doc, q - p)] = hi
        if hi - lo >= least:
            found.setdefault(doc, []).append((lo - int(ends[doc]), hi - int(ends[doc]), item))

    if len(items.keys):
        hashes = grams(flat, items.gram)
        chosen = winnow(hashes, ends[:-1], ends[1:] - items.gram + 1, items.window - items.gram + 1)
        for p, q in meet(hashes[chosen], chosen, items.keys, items.at):
            extend(p, q, items.window)
    for n, (keys, at) in items.short.items():
        inside = np.flatnonzero(np.arange(len(flat)) + n <= np.repeat(ends[1:], np.diff(ends)))
        for p, q in meet(grams(flat, n)[inside], inside, keys, at):
            extend(p, q, n)
    return found


def merged(runs: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    lo: list[int] = []
    hi: list[int] = []
    for a, b, _ in sorted(runs):
        if hi and a <= hi[-1]:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a)
            hi.append(b)
    return lo, hi


def _scan(items):
    def run(batches):
        for batch in slices(batches):
            flat, ends = hash_all([split(t) for t in texts(batch)])
            found = spans(flat, ends, items.value)
            lo, hi, names = [], [], []
            for d in range(batch.num_rows):
                a, b = merged(found.get(d, []))
                lo.append(np.array(a, np.int64))
                hi.append(np.array(b, np.int64))
                names.append(sorted({items.value.names[i] for _, _, i in found.get(d, [])}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(ends), pa.int64()),
                    list_array(lo, pa.int64()),
                    list_array(hi, pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "lo", "hi", "items"],
            )

    return run


def small_enough(benchmark: DataFrame, most: int) -> Broadcast | None:
    """The items as a broadcast if their texts have `most` bytes or less."""
    items = benchmark.select("item_id", "text")
    if (items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0) > most:
        return None
    return items.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in items.collect()]))


def hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, lo, hi, items) of every document: merged spans of word positions, and the items' ids, sorted."""
    items = small_enough(benchmark, block_bytes)
    if items is not None:
        return docs.select("doc_id", "text").mapInArrow(_scan(items), SPANS)
    found = joined_hits(docs, benchmark, Scratch(docs.sparkSession, "decontam"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), words)
    found = found.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    whole = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")), "left")
    none = F.array().cast("array<bigint>")
    return whole.select("doc_id", "n_words", F.coalesce("lo", none).alias("lo"), F.coalesce("hi", none).alias("hi"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


# ---------------------------------------------------------------- large benchmarks: fingerprints are joined


def _fingerprints(lengths: list[int] | None):
    """(key, k, id, text_key): k is the length of a short item, 0 for the fingerprints of long ones; documents look for `lengths`."""

    def run(batches):
        for batch in slices(batches):
            flat, ends = hash_all([split(t) for t in texts(batch)])
            sizes = np.diff(ends)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            kinds = [0] if len(flat) else []
            if lengths is None:
                kinds += sorted(set(sizes[(sizes > 0) & (sizes < WINDOW)].tolist()))
            else:
                kinds += [k for k in lengths if k and len(flat)]
            for k in kinds:
                hashes = grams(flat, k or GRAM)
                if not k:
                    at = winnow(hashes, ends[:-1], ends[1:] - GRAM + 1, WINDOW - GRAM + 1)
                elif lengths is None:
                    at = ends[:-1][sizes == k]
                else:
                    at = np.flatnonzero(np.arange(len(flat)) + k <= ends[1:][row])
                if not len(at):
                    continue
                pairs = np.unique(np.stack([signed(hashes[at]), row[at]], axis=1), axis=0)
                own = pa.array(pairs[:, 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(np.full(len(pairs), k), pa.int32()), batch.column("id").take(own), batch.column("text_key").take(own)], ["key", "k", "id", "text_key"]
                )

    return run


def _extend(batches):
    """Rows come sorted by item: the spans of each (document, item) pair."""
    last, items = None, None
    for batch in slices(batches):
        for i, (name, text, item_text) in enumerate(zip(batch.column("name").to_pylist(), texts(batch), texts(batch, "item_text"))):
            if items is None or last != (name, item_text):
                last, items = (name, item_text), Items([(name, item_text.decode())])
            lo, hi = merged(spans(*hash_all([split(text)]), items).get(0, []))
            if lo:
                own = [batch.column(c).slice(i, 1).take(pa.array([0] * len(lo))) for c in ("doc_id", "text_key", "name")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["doc_id", "text_key", "name", "lo", "hi"])


def joined_hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, lo, hi, items) of the texts that hold a window of an item."""
    key, own = F.xxhash64("text").alias("text_key"), ["doc_id", "text_key"]
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), key, "text").filter("text IS NOT NULL")
    prints = "key bigint, k int, id {}, text_key bigint"
    wanted = scratch.write("item-prints", items.mapInArrow(_fingerprints(None), prints.format("string")).withColumnsRenamed({"id": "name", "text_key": "item_key"}))
    lengths = [r[0] for r in wanted.select("k").distinct().collect()]  # WINDOW values at most
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), key, "text")
    seen = rows.mapInArrow(_fingerprints(lengths), prints.format("bigint")).withColumnRenamed("id", "doc_id")
    met = scratch.write("met", seen.join(wanted, ["key", "k"]).select(*own, "name", "item_key").distinct())
    texts_of = rows.withColumnRenamed("id", "doc_id").join(met.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left_semi")
    texts_of = scratch.write("texts", one_of_each(texts_of, own)).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    item_texts = one_of_each(items, ["id", "text_key"]).select(F.col("id").alias("_n"), F.col("text_key").alias("_i"), F.col("text").alias("item_text"))
    pairs = met.join(texts_of, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))).join(item_texts, F.col("name").eqNullSafe(F.col("_n")) & (F.col("item_key") == F.col("_i")))
    pairs = pairs.select(*own, F.coalesce("name", F.lit("None")).alias("name"), "text", "item_text").sortWithinPartitions("name")
    runs = scratch.write("runs", pairs.mapInArrow(_extend, "doc_id bigint, text_key bigint, name string, lo bigint, hi bigint"))
    order = Window.partitionBy(*own).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = marked.groupBy(*own, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    joined = joined.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs")).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    names = runs.groupBy(*own).agg(F.array_sort(F.collect_set("name")).alias("items"))
    whole = names.join(joined, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))
    return whole.select(*own, "runs.lo", "runs.hi", "items")


def report(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("lo", "hi", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    names = F.array_join("items", ",").cast("binary")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _clean(items):
    def run(batches):
        for batch in slices(batches):
            found = spans(*hash_all([split(t) for t in texts(batch)]), items.value)
            yield batch.filter(pa.array([d not in found for d in range(batch.num_rows)], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark window, all columns kept."""
    items = small_enough(benchmark, block_bytes)
    if items is not None:
        return docs.mapInArrow(_clean(items), docs.schema)
    doc_id, text_key = spare(docs, "_doc_id"), spare(docs, "_text_key")
    found = joined_hits(docs, benchmark, Scratch(docs.sparkSession, "decontam")).select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(text_key))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(text_key)), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = (
    "WITH i AS (SELECT item_id, coalesce(" + _WORDS.format(text="text") + ", []) AS w FROM benchmark),\n"
    "d AS (SELECT doc_id, coalesce(" + _WORDS.format(text="text") + ", []) AS w FROM documents),\n"
    """g AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p, w FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS t FROM g),
ks AS (SELECT DISTINCT k FROM iw),
dp AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d JOIN ks ON len(w) >= k),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS t FROM dp),
h AS (SELECT doc_id, item_id, p, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.t = iw.t),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
)
