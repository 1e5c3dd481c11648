"""Token counts by byte-pair merging over a heap and a linked list: no ids are made.

A pre-token's symbols stand in a linked list; a heap has each adjacent pair that can be merged by (rank, place). The least
is popped, its two symbols become one, and the pairs that this makes on both sides go into the heap; an entry whose
pair has changed meanwhile is passed over. A pre-token has as many tokens as initial symbols less merges.

The normaliser and the cut into pre-tokens are the tokenizers library's own, as the definition file has them; merging and
counting are done here. With a tokenizer that works word by word (token_store.word_wise) a text is parted at ASCII white
space and each distinct word is looked at once a batch; with any other, pre-tokens are. Counts of up to LIMIT words are kept in a
worker. Special strings inside texts count as one token, as by the library's default.

Defined results: null is empty text, with 0 bytes and 0 tokens; every row has its own result row, whatever ids or texts repeat; an
empty table has none; other columns are not read, whatever their names. A very long text is counted in stretches: memory
grows with its distinct words, and a single run of letters takes some 60 bytes for each of its own.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import claim, remember, slices
from lociflow.llm.token_store import load, tokenizer_path, word_wise

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"
#: Words remembered by a worker, and the longest of them in bytes.
LIMIT, LONGEST = 400_000, 256
#: Words beyond this many bytes are taken in pieces, so that no list of their pre-tokens gets long.
STRETCH = 64 << 10
#: A place in such a word where pre-tokens always part: before a digit, or after a letter before a mark that neither a contraction nor a special string has.
_PARTS = re.compile(rb"[0-9]|(?<=[A-Za-z])[!-&(-/:-@\[-`{}~]")


#: Words of visible ASCII, and what the word-wise tokenizers' pattern (token_store.WORD_PATTERN) finds in them in lower case.
_PLAIN = re.compile(rb"[!-~]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Remembered:
    """Counts by key: those used among the last LIMIT / 2 new ones or so; the others go, a generation at a time."""

    def __init__(self):
        self.young, self.old = {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def put(self, key, value: int) -> None:
        if len(key) <= LONGEST:
            self.young[key] = value

    def age(self) -> None:
        if len(self.young) > LIMIT // 2:
            self.old, self.young = self.young, {}


class Merges:
    """Symbols and merge ranks of a BPE definition."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-pair models are counted here")
        self.vocabulary, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {self.vocabulary[a] << 32 | self.vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        self.result = [self.vocabulary[a + b] for a, b in pairs]
        self.known = Remembered()

    def count(self, piece: str) -> int:
        """Tokens of one pre-token, spelled in the model's symbols."""
        found = self.known.get(piece)
        if found is None:
            found = self.merged([*map(self.vocabulary.__getitem__, piece[:-1]), self.vocabulary[piece[-1] + self.suffix]])
            self.known.put(piece, found)
        return found

    def merged(self, symbol: list[int]) -> int:
        """How many symbols are left when no pair can be merged."""
        n, rank = len(symbol), self.rank.get
        heap = [r << 32 | i for i, pair in enumerate(zip(symbol, symbol[1:])) if (r := rank(pair[0] << 32 | pair[1])) is not None]
        heapq.heapify(heap)
        links = list if n < 4096 else lambda places: array("i", places)  # long ones compact
        before, after, left = links(range(-1, n)), links(range(1, n + 1)), n
        symbol.append(-1)  # an end that merges with nothing
        while heap:
            least = heapq.heappop(heap)
            r, i = least >> 32, least & 0xFFFFFFFF
            j, own = after[i], symbol[i]
            if own < 0 or rank(own << 32 | symbol[j]) != r:
                continue  # one of the pair has been merged meanwhile
            own = symbol[i] = self.result[r]
            symbol[j] = -1
            left -= 1
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            if (r := rank(own << 32 | symbol[k])) is not None:
                heapq.heappush(heap, r << 32 | i)
            if h >= 0 and (r := rank(symbol[h] << 32 | own)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return left


class Counter:
    """Tokens of texts by one definition file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            definition = json.load(file)
        added = definition["added_tokens"]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("special strings that take in what stands around them are not counted here")
        if definition["post_processor"] and definition["post_processor"]["type"] != "ByteLevel":
            raise ValueError("tokens that are added around a text are not counted here")
        self.merges, self.by_word = Merges(definition["model"]), word_wise(path)
        tokenizer = load(path)
        self.normal, self.cut = tokenizer.normalizer, tokenizer.pre_tokenizer
        longest_first = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.known = Remembered()

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in filter(None, parts):
            plain = self.normal.normalize_str(part) if self.normal else part
            total += sum(self.merges.count(piece) for piece, _ in self.cut.pre_tokenize_str(plain) if piece)
        return total

    def word(self, word: bytes) -> int:
        """Tokens of a word without white space, by a tokenizer that works word by word."""
        found = self.known.get(word)
        if found is None:
            if len(word) <= STRETCH and _PLAIN.fullmatch(word) and b"<|" not in word:
                found = sum(map(self.merges.count, _PIECES.findall(word.decode().lower())))
            else:
                found = sum(self.count(x.decode()) for x in stretches(word))
            self.known.put(word, found)
        return found

    def batch(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow column without nulls."""
        self.known.age()
        self.merges.known.age()
        if not self.by_word:
            return np.fromiter(map(self.count, column.to_pylist()), np.int64, len(column))
        lists = pc.ascii_split_whitespace(column.cast(pa.large_string()))
        ends, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        each = np.fromiter(map(self.word, words.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(words.dictionary))
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(each[words.indices.to_numpy()])])
        return np.diff(upto[ends - ends[0]])


def stretches(word: bytes) -> Iterator[bytes]:
    """A word, cut where its pre-tokens part if it is very long."""
    at = 0
    while len(word) - at > STRETCH and (cut := _PARTS.search(word, at + STRETCH)):
        yield word[at : cut.start()]
        at = cut.start()
    yield word[at:]


_COUNTERS: dict[str, Counter] = {}
remember("counts", _COUNTERS.clear)


def counter(path: str) -> Counter:
    claim("counts")
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _count(path: str):
    def run(batches):
        for batch in slices(batches):
            text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").cast(pa.large_string())
            text = text.take(pa.array(range(len(text))))  # an array of its own, not a slice
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pc.binary_length(text).cast(pa.int64()), pa.array(counter(path).batch(text))], ["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; nothing is shuffled."""
    return docs.select("doc_id", "text").mapInArrow(_count(tokenizer or tokenizer_path()), COUNTS)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
