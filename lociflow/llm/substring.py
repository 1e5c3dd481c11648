"""Substring dedup by content-defined chunking with a gear rolling hash.

Texts are cut into pieces of whole words (lower-cased ASCII, parted by ASCII white space). The gear hash takes
in one word a step, h = (h << 16) + gear[word] in 64 bits, so it depends on the last four words alone; a piece
ends where the mixed hash is the least of WINDOW neighbours. Cuts move with the content: an insertion changes
the pieces that it touches and no others. A chunk begins with each piece and takes in as many as make MIN_WORDS
words; equal chunks are found by a 128-bit digest, and the first by (doc_id, text hash, position) stays.

A repeated chunk is a span, so a span is a copy of words that stand in its source in one stretch. Chunks that
overlap or touch become one span where they do in the source as well. A passage of 51 words has a cut after its
4th to 15th word and one in its last 12, so at least 25 of its words lie in whole pieces, and these hold a chunk:
every such passage that occurs twice is found. Of shorter ones those that hold a chunk are.

Defined results: null and empty texts have no chunks; a repeat within one text counts like one in another;
repeated doc_ids are told apart by the hash of their text, and equal rows beyond that by nothing: they count
as one; null is a doc_id like others, after all; an empty table has no spans; other columns are carried by
`remove_repeats`, whatever their names, none is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import Scratch, hash_all, mix, odd_multipliers, signed, slices, spare, texts, winnow

WINDOW, REACH, MIN_WORDS = 12, 4, 24
CHUNKS = "doc_id bigint, text_key bigint, at bigint, d1 bigint, d2 bigint"
#: Bits of `at` that hold a chunk's number of words, below its first word's number.
LENGTH_BITS = 12


def cuts(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends, over texts laid end to end; each text's end is one."""
    gear = np.concatenate([np.zeros(REACH - 1, np.uint64), flat])
    n = len(flat)
    h = np.zeros(n, np.uint64)
    for j in range(REACH):
        h += gear[REACH - 1 - j : REACH - 1 - j + n] << np.uint64(16 * j)
    sizes = np.diff(ends)
    starts = np.minimum(ends[:-1] + REACH - 1, ends[1:])
    inside = winnow(mix(h), starts, ends[1:], WINDOW) + 1
    return np.unique(np.concatenate([inside, ends[1:][sizes > 0]]))


def powers(base: int, n: int) -> np.ndarray:
    each = np.full(n, base, np.uint64)
    each[:1] = 1
    return np.multiply.accumulate(each)


def chunks(flat: np.ndarray, ends: np.ndarray, min_words: int):
    """Chunks over texts laid end to end: text, first word in it, words, and two 64-bit digests."""
    stop = cuts(flat, ends)
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    text = np.searchsorted(ends, start, "right") - 1
    last = np.searchsorted(stop, start + min_words)
    inside = np.flatnonzero(last < len(stop))
    inside = inside[stop[last[inside]] <= ends[text[inside] + 1]]
    start, text, stop = start[inside], text[inside], stop[last[inside]]
    digests = []
    for seed in (101, 202):
        # Prefix sums of word * base**place; the difference at a chunk's ends, moved to its beginning, hashes its words.
        base = int(odd_multipliers(1, seed)[0]) | 4
        power, back = (powers(b, len(flat) + 1) for b in (base, pow(base, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(seed)) * power[:-1], dtype=np.uint64)])
        digests.append(mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64)))
    return text, start - ends[text], stop - start, *digests


def _chunk(min_words: int):
    def run(batches):
        for batch in slices(batches):
            flat, ends = hash_all([t.lower().split() if t else [] for t in texts(batch)])
            if not len(flat):
                continue
            text, first, size, d1, d2 = chunks(flat, ends, min_words)
            own = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()).take(own),
                    batch.column("text_key").take(own),
                    pa.array(first << LENGTH_BITS | size),
                    pa.array(signed(d1)),
                    pa.array(signed(d2)),
                ],
                ["doc_id", "text_key", "at", "d1", "d2"],
            )

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, first_word, end_word, n_words, source_doc_id, source_first_word): stretches of repeated chunks.

    The digests of each task are pre-aggregated before they are shuffled, and the joins back are plain
    sort-merges whose hot digests the adaptive plan splits. Only repeated chunks go on from there.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    each = scratch.write("chunks", keyed.mapInArrow(_chunk(min_words), CHUNKS))
    digest, least = ["d1", "d2"], F.min(F.struct("text_key", "at")).alias("o")
    firsts = each.groupBy(*digest).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("source_doc_id")).filter("n > 1")
    firsts = scratch.write("firsts", firsts.select(*digest, "source_doc_id"))
    again = scratch.write("again", each.join(firsts, digest))
    scratch.drop("chunks")
    # Which of the source document's own chunks comes first is settled among the repeated ones alone.
    origin = again.filter("doc_id <=> source_doc_id").groupBy(*digest).agg(least).select(*digest, F.col("o.text_key").alias("o_key"), F.col("o.at").alias("o_at"))
    repeats = again.join(scratch.write("origin", origin), digest).filter("NOT (doc_id <=> source_doc_id AND text_key = o_key AND at = o_at)")
    start, size = (lambda at: F.shiftright(at, LENGTH_BITS)), F.col("at").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
    repeats = repeats.select("doc_id", "text_key", "source_doc_id", "o_key", start("at").alias("lo"), (start("at") + size).alias("hi"), start("o_at").alias("o_lo"))
    own = ["doc_id", "text_key"]
    order = Window.partitionBy(*own).orderBy("lo")
    before = F.lag(F.struct("source_doc_id", "o_key", "o_lo", "lo", "hi")).over(order)
    joined = F.col("source_doc_id").eqNullSafe(before["source_doc_id"]) & (F.col("o_key") == before["o_key"]) & (F.col("lo") <= before["hi"])
    joined = joined & (F.col("o_lo") - before["o_lo"] == F.col("lo") - before["lo"])
    runs = repeats.dropDuplicates([*own, "lo"]).withColumn("fresh", F.when(joined, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*own, "run").agg(
        F.min("lo").alias("first_word"), F.max("hi").alias("end_word"), F.min("source_doc_id").alias("source_doc_id"), F.min("o_lo").alias("source_first_word")
    )
    spans = spans.withColumn("n_words", F.col("end_word") - F.col("first_word"))
    return spans.select(*own, "first_word", "end_word", "n_words", "source_doc_id", "source_first_word")


def _cut_out(names: list[str], lo: str, hi: str):
    def run(batches):
        for batch in slices(batches):
            kept = []
            for text, first, end in zip(batch.column("text").to_pylist(), batch.column(lo).to_pylist(), batch.column(hi).to_pylist()):
                if text is None or not first:
                    kept.append(text)
                    continue
                words = text.encode().split()
                gone = np.zeros(len(words), bool)
                for a, b in zip(first, end):
                    gone[a:b] = True
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without the words of repeated spans; a text that loses some has single blanks between the rest."""
    spans = repeated_spans(docs, Scratch(docs.sparkSession, "substring"), min_words)
    d, k, lo, hi = (spare(docs, x) for x in ("_d", "_k", "_lo", "_hi"))
    lists = spans.groupBy(F.col("doc_id").alias(d), F.col("text_key").alias(k)).agg(F.collect_list("first_word").alias(lo), F.collect_list("end_word").alias(hi))
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k)), "left").drop(d, k)
    return joined.mapInArrow(_cut_out(docs.columns, lo, hi), docs.schema)


def stretches(spans: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, n_words, n_spans, source_doc_id, source_first_word, source_words): spans of a text that
    overlap or touch as one row, with the place of the longest of them (of equals the first) in its source."""
    own = ["doc_id", "text_key"]
    order = Window.partitionBy(*own).orderBy("first_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(F.col("first_word") <= reach, 0).otherwise(1))
    marked = marked.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    longest = F.max(F.struct("n_words", -F.col("first_word"), "source_doc_id", "source_first_word")).alias("s")
    out = marked.groupBy(*own, "stretch").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.count(F.lit(1)).alias("n_spans"), longest)
    return out.select(
        "doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "n_spans", "s.source_doc_id", "s.source_first_word", F.col("s.n_words").alias("source_words")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return stretches(repeated_spans(docs, Scratch(spark, "op10")))
