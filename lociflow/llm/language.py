"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The
piece probabilities are fitted by expectation-maximisation over the same lattices, on a bounded sample:
DOCS_PER_LANG documents of each language with SAMPLE_BYTES of text at most, those with the least hash of their id; of texts beyond a sixteenth of SAMPLE_BYTES the head.
Words are letters with their combining marks; pieces that no such word can hold are left out.

Defined results: null text, and text without a letter, is `und` with score 0; so is everything when no row has
a label; a tie goes to the first language by name; words of over MAX_WORD letters are cut into runs of that
length; very long texts are scored whole; rows of repeated doc_ids are rows of their own; other columns are carried by
`keep_identified`, none is read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import charged, claim, fold, head, likely_least, mix, one_of_each, remember, slices, texts

DOCS_PER_LANG, SAMPLE_BYTES, EM_ROUNDS, MAX_WORD = 300, 8 << 20, 3, 40
#: Probability of a letter that no piece covers, the same in all languages.
UNKNOWN, SMOOTHING = 1e-6, 0.1
#: ASCII letters in lower case, everything above ASCII as it is, blanks for the rest.
_LETTER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in every if p and all(lettered(c) for c in p.lower()[p.startswith("▁") :]) and len(p) <= MAX_WORD + 1})


def lettered(c: str) -> bool:
    """A letter, or a combining mark that belongs to one."""
    return c.isalpha() or (c > "\u02ff" and unicodedata.category(c)[0] == "M")


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Vocabulary:
    """Piece numbers of all substrings of many words at once, by a polynomial hash and two address tables."""

    bits = 19

    def __init__(self, names: list[str]):
        self.size = len(names)
        self.hashes = np.zeros(len(names), np.uint64)
        lengths = np.array([len(n) for n in names])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            self.hashes[rows] = self._prefixes(_codes([names[i] for i in rows]))[:, -1]
        self.longest = int(lengths.max(initial=1))
        self.tables: list[np.ndarray] = []
        left = np.unique(self.hashes, return_index=True)[1]
        while len(left):  # each table takes one piece a slot; what doesn't fit goes to the next
            slot = self._slot(self.hashes[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << self.bits, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _slot(self, hashes: np.ndarray, turn: int) -> np.ndarray:
        return (mix(hashes + np.uint64(turn)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i]
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        for turn, table in enumerate(self.tables):
            candidate = table[self._slot(hashes, turn)]
            ok = (candidate >= 0) & (self.hashes[candidate] == hashes)
            found[ok] = candidate[ok]
        return found

    def lattice(self, words: list[str]):
        """(begin, end, rows, piece numbers) of every span of equal-length words that is a piece, by end."""
        prefix = self._prefixes(_codes(words))
        power = [np.uint64(1)]
        for _ in range(self.longest):
            power.append(np.uint64((int(power[-1]) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF))
        for end in range(1, prefix.shape[1]):
            for begin in range(max(0, end - self.longest), end):
                found = self.find(prefix[:, end] - prefix[:, begin] * power[end - begin])
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield begin, end, rows, found[rows]


def by_length(words: list[str]):
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for part in np.array_split(rows, -(-len(rows) // 20_000)):
            yield part, [words[i] for i in part]


class Lattice:
    """All piece spans of a set of words of one length, for repeated passes."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.length, self.n = len(words[0]), len(words)
        self.spans: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.length + 1)]
        for begin, end, rows, piece in vocabulary.lattice(words):
            self.spans[end].append((begin, rows.astype(np.int32), piece.astype(np.int32)))

    def alphas(self, chance: np.ndarray) -> np.ndarray:
        alpha = np.zeros((self.length + 1, self.n, chance.shape[1]))
        alpha[0] = 1.0
        for end in range(1, self.length + 1):
            alpha[end] = alpha[end - 1] * UNKNOWN  # a letter by itself is always possible
            for begin, rows, piece in self.spans[end]:
                alpha[end][rows] += alpha[begin][rows] * chance[piece]
        return alpha

    def expected(self, chance: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Add each piece's expected number of uses, by forward and backward sums, words weighted by counts."""
        alpha = self.alphas(chance)
        beta = np.zeros_like(alpha)
        beta[-1] = counts / alpha[-1]
        for end in range(self.length, 0, -1):
            beta[end - 1] += beta[end] * UNKNOWN
            for begin, rows, piece in self.spans[end]:
                flow = beta[end][rows] * chance[piece]
                beta[begin][rows] += flow
                for k in range(into.shape[1]):
                    into[:, k] += np.bincount(piece, alpha[begin][rows, k] * flow[:, k], len(into))


def log_chances(vocabulary: Vocabulary, chance: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns), over all segmentations."""
    out = np.zeros((len(words), chance.shape[1]))
    for rows, group in by_length(words):
        out[rows] = np.log(Lattice(vocabulary, group).alphas(chance)[-1])
    return out


def spelled(word: bytes) -> list[str]:
    """The letters of a blank-free stretch of text as marked words; none if it has no letter."""
    text = "".join(c for c in word.decode().lower() if lettered(c))
    if not any(map(str.isalpha, text)):
        return []
    return ["▁" + text[i : i + MAX_WORD] for i in range(0, len(text), MAX_WORD)]


class Model:
    """Languages and piece probabilities."""

    def __init__(self, languages: list[str], names: list[str], chance: np.ndarray):
        self.languages, self.names, self.chance = languages, names, chance

    def score(self, batch: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        claim("language")
        if _MEMORY.get("model") is not self:
            _MEMORY.clear()
            _MEMORY.update(model=self, words=ScoredWords(self))
        return _MEMORY["words"].score(batch)


#: The model in use in this Python worker, and the words that it has scored.
_MEMORY: dict = {}
remember("language", _MEMORY.clear)


class ScoredWords:
    """Log probabilities of the words met so far, up to about `limit`."""

    limit = 300_000

    def __init__(self, model: Model):
        self.languages, self.chance, self.vocabulary = model.languages, model.chance, Vocabulary(model.names)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        #: A word's log probabilities, and in the last column whether it has a letter.
        self.rows = [np.zeros((0, len(self.languages) + 1))]

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        units = [spelled(w) for w in new]
        flat = list({u for us in units for u in us})
        number = {u: i for i, u in enumerate(flat)}
        scores = log_chances(self.vocabulary, self.chance, flat) if flat else np.zeros((0, len(self.languages)))
        owner = np.array([i for i, us in enumerate(units) for _ in us], np.int64)
        which = np.array([number[u] for us in units for u in us], np.int64)
        rows = np.zeros((len(new), len(self.languages) + 1))
        np.add.at(rows[:, :-1], owner, scores[which])
        rows[owner, -1] = 1
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.rows.append(rows)

    def score(self, batch: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        lists = [t.translate(_LETTER_BYTES).split() if t else [] for t in batch]
        if len(self.index) > self.limit:
            self.clear()
        self.learn(set().union(*lists))
        self.rows = [np.concatenate(self.rows)]
        sizes = np.array([len(x) for x in lists])
        entry = np.fromiter((self.index[w] for x in lists for w in x), np.int64, int(sizes.sum()))
        total = np.zeros((len(lists), len(self.languages) + 1))
        full = np.flatnonzero(sizes)
        if len(full):
            total[full] = np.add.reduceat(self.rows[0][entry], (np.cumsum(sizes) - sizes)[full])
        logs, letters = total[:, :-1], total[:, -1]
        odds = np.exp(logs - logs.max(1, keepdims=True))
        best = odds.argmax(1)
        chance = np.where(letters > 0, odds.max(1) / odds.sum(1), 0.0)
        return [self.languages[k] if n else "und" for k, n in zip(best.tolist(), letters.tolist())], chance


def _count_words(batches):
    for batch in slices(batches):
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
            for w in text.translate(_LETTER_BYTES).split() if text else []:
                counts[lang, w] = counts.get((lang, w), 0) + 1
        spelt: dict[tuple[str, str], int] = {}
        for (lang, w), n in counts.items():
            for u in spelled(w):
                spelt[lang, u] = spelt.get((lang, u), 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in spelt], pa.string()), pa.array([k[1] for k in spelt], pa.string()), pa.array(list(spelt.values()), pa.int64())],
            ["lang", "word", "n"],
        )


def fit(labelled: DataFrame, vocabulary_path: str | None = None, docs_per_lang: int = DOCS_PER_LANG, rounds: int = EM_ROUNDS) -> Model | None:
    """A model out of (doc_id, text, lang) rows; None if none has text and lang."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    tkey = F.xxhash64("text")
    sized = known.select("lang", "doc_id", tkey.alias("tkey"), charged(F.col("text"), SAMPLE_BYTES).alias("size")).distinct()
    counts = sized.groupBy(F.col("lang").alias("_lang")).count()
    sized = sized.join(counts, F.col("lang") == F.col("_lang")).filter(likely_least(F.xxhash64("doc_id"), docs_per_lang, F.col("count"))).drop("_lang", "count")
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "tkey")
    chosen = sized.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= docs_per_lang)
    upto = F.sum("size").over(least.rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("_upto", upto).filter(F.col("_upto") <= SAMPLE_BYTES).select("lang", "doc_id", "tkey")
    # docs_per_lang rows and SAMPLE_BYTES a language.
    sample = known.select("lang", "doc_id", head(F.col("text"), SAMPLE_BYTES).alias("text"), tkey.alias("tkey")).join(F.broadcast(chosen), ["lang", "doc_id", "tkey"])
    sample = one_of_each(sample, ["lang", "doc_id", "tkey"]).select("lang", "text")
    rows = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    langs, words, n = (rows.column(c).to_pylist() for c in ("lang", "word", "n"))
    languages, every = sorted(set(langs)), sorted(set(words))
    number, column = {w: i for i, w in enumerate(every)}, {k: i for i, k in enumerate(languages)}
    counts = np.zeros((len(every), len(languages)))
    np.add.at(counts, ([number[w] for w in words], [column[k] for k in langs]), n)
    names = pieces(vocabulary_path or piece_model_path())
    vocabulary = Vocabulary(names)
    lattices = [(rows, Lattice(vocabulary, group)) for rows, group in by_length(every)]
    # To begin with, a piece is as likely as it is often found, wherever it stands.
    chance = np.full((len(names), len(languages)), SMOOTHING)
    for at, lattice in lattices:
        for spans in lattice.spans:
            for _, hit, piece in spans:
                for k in range(len(languages)):
                    chance[:, k] += np.bincount(piece, counts[at][hit, k], len(names))
    chance /= chance.sum(0)
    for _ in range(rounds):
        uses = np.full_like(chance, SMOOTHING)
        for at, lattice in lattices:
            lattice.expected(chance, counts[at], uses)
        chance = uses / uses.sum(0)
    return Model(languages, names, chance)


def _predict(model):
    def run(batches):
        for batch in slices(batches):
            langs, score = model.value.score(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [*batch.select([n for n in batch.schema.names if n != "text"]).columns, pa.array(langs, pa.string()), pa.array(score)],
                [*[n for n in batch.schema.names if n != "text"], "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, lang_pred string, score double")


def _keep(model):
    def run(batches):
        for batch in slices(batches):
            langs, _ = model.value.score(texts(batch))
            yield batch.filter(pa.array([lang != "und" for lang in langs], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """Documents whose language is found, all columns kept; without a model those with a letter."""
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(fold(F.col("doc_id"), 4) != 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
