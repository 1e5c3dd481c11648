"""Toxicity by a convolutional text classifier, trained in numpy.

A word is two hashed embeddings side by side: one of the word, one of its first four letters. Filters of one,
two and three words run over the text, each keeps its maximum, and a logistic unit scores the maxima. Scores
are set so that 0.3 is the threshold of best F1 on the validation part, every VALIDATION-th of all labelled rows by
the hash of their id: these are scored by Spark and counted by language, score and label, so that thresholds rest on
all of them and on the labels' own mix. Beside it, each language has a threshold of its own where at least LEAST
validation rows of either class carry that language (the score itself never sees it).

Training takes a bounded sample of the other labelled rows: POSITIVES and NEGATIVES of them at most, with SAMPLE_BYTES
of text each at most, those with the least hash of their id, whole; only their words' bucket numbers come to the
driver. Only the pooled position of each filter gets a gradient, so a step costs little more than the forward pass.

Defined results: null and wordless texts are scored as an empty text; without labelled rows of both classes to train on
every score is 0; without both among the validation rows all labelled rows set the thresholds; a label given twice counts
as the larger; rows of repeated doc_ids are rows of their own; further columns are ignored; very long texts are
read whole, a stretch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import WORD_BYTES, bounded_sample, claim, fold, remember, slices, texts, word_runs

POSITIVES, NEGATIVES, SAMPLE_BYTES = 3_000, 6_000, 16 << 20
WORD_BUCKETS, PREFIX_BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 1 << 15, 8, 8, (1, 2, 3)
EPOCHS, STEPS, BATCH, RATE, VALIDATION, CUT = 6, 800, 32, 0.02, 4, 0.3
#: Weight decay of filters and of the last unit.
DECAY = (1e-5, 1e-4)
#: Least rows of a class for a language's own threshold; score bins to a unit of log-odds, and their range.
LEAST, BINS, RANGE = 10, 64, 40
#: Words that go through the filters at a time.
STRETCH = 1 << 16
#: Blank rows after each text, so that no filter reaches into the next one.
PAD = max(WIDTHS) - 1


class Buckets(dict):
    """Packed bucket numbers of a word and of its first four letters, remembered for up to `limit` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        first = word.decode()[:4].encode()
        value = (xxhash.xxh3_64_intdigest(word) % WORD_BUCKETS) << 20 | xxhash.xxh3_64_intdigest(first) % PREFIX_BUCKETS
        if len(self) < self.limit:
            self[word] = value
        return value


_BUCKETS = Buckets()
remember("buckets", _BUCKETS.clear)


def encode(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed buckets of all words with PAD blanks (-1) after each text, and where each text begins."""
    claim("buckets")
    parts, ends, blank = [], np.zeros(len(batch) + 1, np.int64), np.full(PAD, -1, np.int64)
    for i, text in enumerate(batch):
        size = PAD
        for words in word_runs((text or b"").translate(WORD_BYTES)):
            parts.append(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)))
            size += len(words)
        parts.append(blank)
        ends[i + 1] = ends[i] + size
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), ends


class Network:
    """Parameters and the forward pass."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.word = rng.normal(0, 0.05, (WORD_BUCKETS, DIM)).astype(np.float32)
        self.prefix = rng.normal(0, 0.05, (PREFIX_BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, 2 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.shift, self.thresholds = 0.0, {}

    def embed(self, flat: np.ndarray) -> np.ndarray:
        seen = np.maximum(flat, 0)
        rows = np.concatenate([self.word[seen >> 20], self.prefix[seen & 0xFFFFF]], axis=1)
        rows[flat < 0] = 0
        return rows

    def respond(self, rows: np.ndarray, blank: np.ndarray) -> list[np.ndarray]:
        """Responses of each width's filters at each word; at blanks only the bias."""
        found = []
        for filters, bias in zip(self.filters, self.bias):
            total = rows @ filters[0]
            for j in range(1, len(filters)):
                total[:-j] += rows[j:] @ filters[j]
            total[blank] = 0
            found.append(np.maximum(total + bias, 0))
        return found

    def logits(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-odds of each text, as `encode` gives them. Words go through the filters STRETCH at a time, so a very long text takes
        no more than a short one; responses are never negative, and a text's peak is the largest of its stretches'."""
        pooled = np.zeros((len(ends) - 1, len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(flat), STRETCH):
            b = min(a + STRETCH, len(flat))
            part = flat[a : b + max(WIDTHS) - 1]
            first, last = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b)
            cuts = np.maximum(ends[first:last], a) - a
            peaks = [np.maximum.reduceat(f[: b - a], cuts) for f in self.respond(self.embed(part), part < 0)]
            pooled[first:last] = np.maximum(pooled[first:last], np.concatenate(peaks, axis=1))
        return pooled @ self.out + self.out_bias[0] + self.shift

    def scores(self, batch: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*encode(batch)).astype(np.float64), -60, 60)))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list) -> None:
        """A gradient is an array, or (rows, values) of the rows that have one."""
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, m, v, g in zip(self.params, self.m, self.v, grads):
            at = slice(None)
            if isinstance(g, tuple):
                at, place = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(at), p.shape[1]), p.dtype)
                np.add.at(total, place, g[1])
                g = total
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            p[at] -= scale * m[at] / (np.sqrt(v[at]) + 1e-8)


def train(docs: list[np.ndarray], labels: list[int], seed: int = 7) -> Network | None:
    """A network from texts (as `encode` gives them, one by one) and their labels; None if one class is missing.

    There are EPOCHS rounds over the rows, more if they make fewer than STEPS steps.
    """
    if len(set(labels)) < 2:
        return None
    net, rng = Network(seed), np.random.default_rng(seed)
    label, order = np.array(labels, np.float32), np.arange(len(docs))
    adam = Adam([net.word, net.prefix, *net.filters, *net.bias, net.out, net.out_bias], RATE)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(docs)))):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            step(net, adam, [(docs[i], label[i]) for i in order[at : at + BATCH].tolist()])
    return net


def step(net: Network, adam: Adam, docs: list[tuple[np.ndarray, float]]) -> None:
    adam.step(gradients(net, docs)[1])


def gradients(net: Network, docs: list[tuple[np.ndarray, float]]) -> tuple[float, list]:
    """Mean log-loss (without the decay terms), and the gradients in the order of the optimiser's parameters."""
    flat = np.concatenate([d for d, _ in docs])
    ends = np.concatenate([[0], np.cumsum([len(d) for d, _ in docs])])
    rows = net.embed(flat)
    found = net.respond(rows, flat < 0)
    peak = [np.stack([a + f[a:b].argmax(0) for a, b in zip(ends[:-1], ends[1:])]) for f in found]
    pooled = np.concatenate([f[p, np.arange(FILTERS)] for f, p in zip(found, peak)], axis=1)
    z = pooled @ net.out + net.out_bias[0]
    label = np.array([y for _, y in docs], np.float32)
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(docs)
    down = error[:, None] * net.out * (pooled > 0)
    filter_grads, bias_grads, where, what = [], [], [], []
    for k, (filters, p) in enumerate(zip(net.filters, peak)):
        own = down[:, k * FILTERS : (k + 1) * FILTERS]  # document by filter
        grad = np.zeros_like(filters)
        for j in range(len(filters)):
            at = np.minimum(p + j, len(flat) - 1)
            live = own * (flat[p] >= 0) * (p + j < len(flat))
            grad[j] = np.einsum("dfe,df->ef", rows[at], live)
            where.append(at.ravel())
            what.append((live[:, :, None] * filters[j].T[None]).reshape(-1, 2 * DIM))
        filter_grads.append(grad + DECAY[0] * filters)
        bias_grads.append(own.sum(0))
    where, what = np.concatenate(where), np.concatenate(what)
    seen = (flat[where] >= 0) & what.any(1)
    packed, what = flat[where[seen]], what[seen]
    grads = [(packed >> 20, what[:, :DIM]), (packed & 0xFFFFF, what[:, DIM:]), *filter_grads, *bias_grads, pooled.T @ error + DECAY[1] * net.out, error.sum(keepdims=True)]
    return float(np.mean(np.logaddexp(0, z) - label * z)), grads


def best_cut(bins: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> float:
    """The log-odds of best F1 out of counts by score bin: halfway between the bins that it parts."""
    order = np.argsort(-bins, kind="stable")
    bins, hits, all_rows = bins[order], np.cumsum(hits[order]), np.cumsum((hits + misses)[order])
    f1 = 2 * hits / (all_rows + hits[-1])
    k = int(f1.argmax())
    below = bins[k + 1] + 1 if k + 1 < len(bins) else bins[k] - BINS
    return float(bins[k] + below) / 2 / BINS


def calibrate(net: Network, rows: DataFrame) -> bool:
    """Set shift and thresholds from labelled rows (text, lang, _y), counted by language and score bin; False without both classes."""
    scored = rows.select("text", "lang", F.col("_y").cast("int").alias("y")).mapInArrow(_bins(rows.sparkSession.sparkContext.broadcast(net)), "lang string, bin int, y int")
    counts = scored.groupBy("lang", "bin").agg(F.count_if(F.col("y") == 1).alias("hits"), F.count_if(F.col("y") == 0).alias("misses")).collect()  # 2 * RANGE * BINS rows a language at most

    def summed(chosen: list) -> np.ndarray:
        total: dict[int, list[int]] = {}
        for r in chosen:
            own = total.setdefault(r["bin"], [0, 0])
            own[0], own[1] = own[0] + r["hits"], own[1] + r["misses"]
        return np.array([[b, *own] for b, own in total.items()], np.float64).reshape(-1, 3)

    every = summed(counts)
    if not (every[:, 1].sum() and every[:, 2].sum()):
        return False
    net.shift = float(np.log(CUT / (1 - CUT)) - best_cut(*every.T))
    for lang in sorted({r["lang"] for r in counts} - {None}):
        own = summed([r for r in counts if r["lang"] == lang])
        if min(own[:, 1:].sum(0)) >= LEAST:
            net.thresholds[lang] = float(1 / (1 + np.exp(-(best_cut(*own.T) + net.shift))))
    return True


def _bins(net):
    def run(batches):
        for batch in slices(batches, limit=1 << 20):
            z = net.value.logits(*encode(texts(batch))).astype(np.float64)
            bins = np.floor(np.clip(z, -RANGE, RANGE) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(bins), batch.column("y")], ["lang", "bin", "y"])

    return run


def _encoded(batches):
    for batch in slices(batches, limit=1 << 20):
        flat, ends = encode(texts(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "y", "words"])


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from documents (doc_id, text, lang) and labels (doc_id, toxic)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    validation = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(VALIDATION)) == 0
    sample = bounded_sample(docs, known.filter(~validation), "_y", {0: NEGATIVES, 1: POSITIVES}, SAMPLE_BYTES)
    sample = sample.select("doc_id", F.col("_y").cast("int").alias("y"), "text").mapInArrow(_encoded, "doc_id bigint, y int, words array<bigint>")
    rows = sample.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()  # bounded, see bounded_sample
    net = train([x.values.to_numpy() for x in rows.column("words")], rows.column("y").to_pylist())
    if net is not None and not calibrate(net, docs.join(known.filter(validation), "doc_id")):
        calibrate(net, docs.join(known, "doc_id"))
    return net


def _score(net):
    def run(batches):
        for batch in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("lang"), pa.array(net.value.scores(texts(batch)))], ["doc_id", "lang", "score"]
            )

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score, threshold, flagged) of every row of (doc_id, text, lang); lang only picks the threshold."""
    if net is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(CUT).alias("threshold"), F.lit(False).alias("flagged"))
    scored = docs.select("doc_id", "text", "lang").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(net)), "doc_id bigint, lang string, score double")
    threshold = F.lit(CUT)
    for lang, value in sorted(net.thresholds.items()):
        threshold = F.when(F.col("lang") == lang, F.lit(value)).otherwise(threshold)
    return scored.select("doc_id", "score", threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 4) != 2)
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )
