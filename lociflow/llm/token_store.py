"""Token ids as Parquet list columns, in ascending doc_id order, with metadata beside them.

Layout of a store: `tokens/` holds one file for each range of doc_ids, rows ascending, columns (part, doc_id,
local_start, n_tokens, ids); ids are dictionary-encoded with delta-packed fallbacks, row groups and pages are
small and carry page indexes, so a reader that wants some doc_ids or only the metadata touches those pages
alone. `manifest/` has a row for each file: its ids, and how many come before it.

Texts are encoded word for word by a tokenizer whose definition shows that words parted by ASCII white space never
share a token, so equal words are encoded once per worker; by any other tokenizer text for text. Each document
ends with `end_id`.

Defined results: null is empty text, of the end id alone; rows of the same doc_id lie side by side in order of
their text's hash; an empty table makes an empty store; other columns are not written.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain, repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import Scratch, claim, remember, slices

TOKENS = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
#: Row groups of 16 MB, pages of 64 KB, version 2 pages with delta encodings where a dictionary doesn't pay.
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 64 << 10,
    "parquet.page.row.count.limit": 1000,
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
}
#: Fixed value: pre-tokens of the tokenizers that encode word by word.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of words, kept for about `limit` words: beyond it the half that was used last stays.

    A text is lower-cased, parted and its words numbered by Arrow; only the distinct words of a batch are looked up
    here. `index` numbers the known words, `pool` has their ids end to end, `size` how many each has.
    """

    limit = 600_000
    tails = ".,;:!?"

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id = load(path), end_id
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clock = 0
        self.clear()

    def clear(self) -> None:
        """Word 0 is empty, word 1 (no text holds it) is the end."""
        self.index: dict[bytes, int] = {b"": 0, b" ": 1}
        self.pool, self.size = np.array([self.end_id], np.int32), np.array([0, 1], np.int32)
        self.used = np.zeros(2, np.int32)

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words end to end, and how many each has."""
        size = self.size[number]
        start = np.cumsum(self.size, dtype=np.int32) - self.size
        full = size > 0
        first, length = start[number[full]], size[full]
        if not len(first):
            return self.pool[:0], size
        step = np.ones(int(length.sum()), np.int32)  # the running sum of steps walks through the pool
        begin = np.cumsum(length, dtype=np.int32) - length
        step[0] = first[0]
        step[begin[1:]] = first[1:] - first[:-1] - length[:-1] + 1
        return self.pool[np.cumsum(step, dtype=np.int32)], size

    def _add(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.pool, self.size = np.concatenate([self.pool, ids]), np.concatenate([self.size, size.astype(np.int32)])
        self.used = np.concatenate([self.used, np.full(len(words), self.clock, np.int32)])

    def _encode(self, new: list[bytes]) -> None:
        """Words that are not cut any further. Letters alone are one pre-token: many such words are one text, parted at the closing tokens."""
        plain = [w for w in new if w.isalpha() and w.islower()]  # ASCII letters, normal as they are: for the bare model
        rest = [w.decode() for w in {*new}.difference(plain)]
        wide = [w for w in rest if w.isalpha()]
        each = [w for w in rest if not w.isalpha()]
        for tokenizer, words in ((self.bare, plain), (self.tokenizer, [w.encode() for w in wide])):
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.closes[ids]) + 1
            if len(last) == len(words):
                self._add(words, ids, np.diff(last, prepend=0))
            else:
                each += [w.decode() for w in words]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(each, add_special_tokens=False)] if each else []
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._add([w.encode() for w in each], np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size)

    def _core(self, word: bytes, core: bytes) -> bytes:
        """Letters or digits, and the sentence marks after them, are different pre-tokens: `core`, or the word if it can't be cut there."""
        # Some letters end in a combining mark once they are normalised, and such a mark is one pre-token with what follows.
        cut = core and (core[-1:].isalnum() or (core[-1] >= 0x80 and normalize("NFC", core.decode()).lower()[-1:].isalnum()))
        return core if cut else word

    def learn(self, words: list[bytes]) -> None:
        trimmed = pc.utf8_rtrim(pa.array(words, pa.large_binary()).cast(pa.large_string()), characters=self.tails).cast(pa.large_binary())
        marked = np.fromiter(map(len, words), np.int64, len(words)) > pc.binary_length(trimmed).to_numpy()
        core = {words[i]: self._core(words[i], c) for i, c in zip(np.flatnonzero(marked).tolist(), trimmed.filter(pa.array(marked)).to_pylist())}
        cut = [(w, c, w[len(c) :]) for w, c in core.items() if len(c) < len(w)]
        self._encode(list({*chain.from_iterable(x[1:] for x in cut)}.union(words).difference((x[0] for x in cut), self.index)))
        if cut:
            ids, size = self.ids(np.array([(self.index[c], self.index[t]) for _, c, t in cut], np.int32).ravel())
            self._add([x[0] for x in cut], ids, size.reshape(-1, 2).sum(1))

    def _forget(self) -> None:
        keep = self.used >= np.median(self.used)
        keep[:2] = True
        kept = np.flatnonzero(keep)
        if 2 * len(kept) > self.limit + len(keep):  # one huge text used them all
            self.clear()
            return
        ids, size = self.ids(kept)
        words = list(self.index)
        self.index = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.pool, self.size, self.used = ids, size, self.used[kept]

    def encode(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow text column end to end, and where each text's ids begin (one more entry: the end)."""
        batch = batch.take(pa.array(range(len(batch))))  # a slice by itself: Arrow's lower-casing misreads slices of an array
        batch = pc.fill_null(batch.cast(pa.large_binary()), b"")
        # The tokenizer lower-cases all but its special tokens, after NFC: beside combining marks (U+0300 to U+037F) the order tells.
        as_is = pc.or_(pc.match_substring(batch, b"<|"), pc.or_(pc.match_substring(batch, b"\xcc"), pc.match_substring(batch, b"\xcd")))
        text = batch.cast(pa.large_string())
        lists = pc.ascii_split_whitespace(pc.if_else(as_is, text, pc.ascii_lower(text)))
        ends, parts = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        words = parts.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.index) > self.limit:
            self._forget()
        self.clock += 1
        number = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            self.learn([words[i] for i in missing])
            number[missing] = [self.index[words[i]] for i in missing]
        self.used[number] = self.clock
        flat, size = self.ids(np.insert(number[parts.indices.to_numpy()], ends[1:] - ends[0], 1))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)])
        return flat, at[ends - ends[0] + np.arange(len(ends))]


class TextEncoder:
    """For any other tokenizer: text by text."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = load(path), end_id

    def encode(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast([t or "" for t in batch.to_pylist()], add_special_tokens=False)]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(list(map(len, each)), dtype=np.int64)])
        return np.fromiter(chain.from_iterable(each), np.int32, int(ends[-1])), ends


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_wise(path: str) -> bool:
    """Whether the tokenizer is known to encode word by word: what WordEncoder relies on is read off its definition."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    steps, parts = (known.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    splits = [x.get("pattern", {}).get("Regex") for x in parts.get("pretokenizers", [])]
    special = all("<|" in x["content"] and not (x["lstrip"] or x["rstrip"] or x["normalized"] or set(x["content"]) & set(" \t\n\v\f\r")) for x in known["added_tokens"])
    return (
        special
        and [x["type"] for x in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and steps["normalizers"][1].get("content") == " "
        and splits == [WORD_PATTERN, None]
        and parts["pretokenizers"][1]["type"] == "ByteLevel"
        and not parts["pretokenizers"][1]["add_prefix_space"]
        and known["model"].get("end_of_word_suffix") == "</w>"
        and known["post_processor"] is None
    )


_ENCODERS: dict[tuple[str, int], WordEncoder | TextEncoder] = {}
remember("tokens", _ENCODERS.clear)


def encoder(path: str, end_id: int) -> WordEncoder | TextEncoder:
    claim("tokens")
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = (WordEncoder if word_wise(path) else TextEncoder)(path, end_id)
    return _ENCODERS[path, end_id]


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, start, words = TaskContext.get().partitionId(), 0, encoder(path, end_id)
        for batch in slices(batches, limit=4 << 20):
            flat, ends = words.encode(batch.column("text"))
            size = np.diff(ends)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            first = start + ends[:-1]
            start += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(size), part), pa.int32()), batch.column("doc_id").cast(pa.int64()), pa.array(first), pa.array(size), ids],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, parts: int | None = None) -> None:
    """Encode whole texts and write a store under `path`.

    Documents are dealt by ranges of doc_id before they are encoded, so that each text is encoded once and by
    the task that writes it.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", tie)
    dealt.mapInArrow(_encode(tokenizer or tokenizer_path(), end_id), TOKENS).write.mode("overwrite").options(
        **{k: str(v) for k, v in LAYOUT.items()}
    ).parquet(f"{path}/tokens")
    files = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("part_tokens"), F.count(F.lit(1)).alias("part_rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)))
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without touching the ids."""
    rows = spark.read.parquet(f"{path}/tokens").select("part", "doc_id", "local_start", "n_tokens")
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids), of a range of doc_ids: row groups and pages outside it are skipped."""
    rows = spark.read.parquet(f"{path}/tokens")
    if first_id is not None:
        rows = rows.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.filter(F.col("doc_id") <= last_id)
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "ids")


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # The manifest has a row a file; a file holds many documents.
    files = spark.read.parquet(f"{path}/manifest").select(F.col("part").alias("_part"), "part_start")
    return rows.join(F.broadcast(files), F.col("part") == F.col("_part")).withColumn("start", F.col("part_start") + F.col("local_start"))


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) out of the ids read back."""
    return read_tokens(spark, path).select("doc_id", "start", "ids").mapInArrow(
        _checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op4").path("store")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return checksums(spark, path)
