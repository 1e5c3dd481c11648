"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network that minimises the non-negative unbiased risk
(Kiryo et al. 2017): prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), with the sigmoid loss. The class prior
is estimated as the share of positives among the rows that carry a label. A text is described by counts over
its characters, words and lines, gathered with numpy.

Training takes POSITIVES trusted and UNLABELLED web documents at most, those with the least hash of their id, whole.
The cut, which scores one half, is set on all documents: where their log-odds, counted in BINS bins, are thinnest within
NEAR of the prior's quantile. That the prior is the labels' own share supposes that labels were drawn at random.

Defined results: null and empty texts have all counts 0 and are scored like any other; without positives every
score is 0.5; without unlabelled rows the positives stand in for them; rows of repeated doc_ids are rows of their own;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import Scratch, bounded_sample, fold, likely_least, slices, texts

POSITIVES, UNLABELLED = 4_000, 8_000
SAMPLE_BYTES, BINS, NEAR = 256 << 20, 4096, 0.03
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 256, 0.01

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LOWER = (_BYTES >= 0x61) & (_BYTES <= 0x7A)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_WIDE = _BYTES >= 0x80
_BLANK = (_BYTES == 0x20) | ((_BYTES >= 9) & (_BYTES <= 13))
_MARK = ~(_UPPER | _LOWER | _DIGIT | _WIDE | _BLANK)
#: What each byte counts towards: letters in upper and lower case, digits, bytes above ASCII, blanks, line ends, sentence marks, other marks.
_KINDS = np.stack(
    [_UPPER, _LOWER, _DIGIT, _WIDE, _BLANK, _BYTES == 10, np.isin(_BYTES, [ord(c) for c in ".,;:?'\""]), _MARK & ~np.isin(_BYTES, [ord(c) for c in ".,;:?'\""])]
).astype(np.float64)
N_FEATURES = 20


def describe(text: bytes | None) -> np.ndarray:
    """The counts of one text as N_FEATURES bounded numbers."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    upper, lower, digit, wide, blank, line, stop, mark = (_KINDS @ histogram) / len(text)
    share = histogram[histogram > 0] / len(text)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x]
    out[:10] = upper, lower, digit, wide, blank, line, stop, mark, -(share * np.log2(share)).sum() / 8, np.log1p(n) / 10
    if n:
        lengths = np.fromiter(map(len, words), np.float64, n)
        distinct = len(set(words))
        repeats = sum(a == b for a, b in zip(words, words[1:])) / n
        marked = sum(not w.isalnum() and w[-1:] not in b".,;:?'\"" and w.isascii() for w in words) / n
        caps = sum(w.isupper() and len(w) > 2 for w in words) / n
        bare = sum(not any(0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 for c in w[:4]) for w in words) / n
        out[10:20] = (
            lengths.mean() / 10,
            lengths.std() / 10,
            (lengths <= 3).mean(),
            distinct / n,
            distinct / np.sqrt(n) / 20,
            repeats,
            marked,
            caps,
            bare,
            1 - len(set(lines)) / max(1, len(lines)),
        )
    return out


def describe_all(batch: list[bytes | None]) -> np.ndarray:
    return np.stack([describe(t) for t in batch]) if batch else np.zeros((0, N_FEATURES))


class Scorer:
    """Standardised features, one hidden layer, a logistic score."""

    def __init__(self, mean, scale, hidden, bias, out, out_bias, prior):
        self.mean, self.scale, self.hidden, self.bias, self.out, self.out_bias, self.prior = mean, scale, hidden, bias, out, out_bias, prior

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.hidden + self.bias) @ self.out + self.out_bias


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11, epochs: int = EPOCHS) -> Scorer:
    """Minimise the non-negative risk by Adam; where the negative part falls below zero, its ascent is taken instead."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    params = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    for _ in range(epochs):
        order_u = rng.permutation(len(u))
        for at in range(0, len(u), BATCH):
            xu, xp = u[order_u[at : at + BATCH]], p[rng.integers(0, len(p), min(BATCH, len(p)))]
            _, grads = pu_risk(params, xp, xu, prior)
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Scorer(mean, scale, *params, prior)


def risk(params: list[np.ndarray], x: np.ndarray, sign: int, weight: float) -> tuple[float, list[np.ndarray]]:
    """Mean sigmoid loss of calling x `sign`, and its gradient."""
    h = np.tanh(x @ params[0] + params[1])
    loss = 1 / (1 + np.exp(np.clip(sign * (h @ params[2] + params[3]), -60, 60)))
    dz = -sign * loss * (1 - loss) * weight / len(x)
    dh = dz[:, None] * params[2] * (1 - h * h)
    return float(weight * loss.mean()), [x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]


def pu_risk(params: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk, and the direction to leave: its gradient, or where its negative part is below zero that part's ascent."""
    r_up, up = risk(params, xp, 1, prior)
    r_u, down_u = risk(params, xu, -1, 1.0)
    r_p, down_p = risk(params, xp, -1, prior)
    negative = [a - b for a, b in zip(down_u, down_p)]
    return r_up + max(0.0, r_u - r_p), [a + b for a, b in zip(up, negative)] if r_u >= r_p else [-b for b in negative]


def fit(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """A scorer from documents (doc_id, text) and labels (doc_id, quality): 1 is trusted, others only enter the prior."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_y"))
    prior = known.agg(F.avg((F.col("_y") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    trusted = bounded_sample(docs, known.filter(F.col("_y") == 1).select("doc_id", F.lit(1).alias("p")), "p", {1: POSITIVES}, SAMPLE_BYTES)
    # The web as it is, positives among it: of all ids those with the least hash.
    some = docs.filter(likely_least(F.xxhash64("doc_id"), UNLABELLED, docs.count())).select("doc_id").distinct().withColumn("p", F.lit(0))
    web = bounded_sample(docs, some, "p", {0: UNLABELLED}, SAMPLE_BYTES)
    # POSITIVES + UNLABELLED rows at most; the tasks send back N_FEATURES numbers of each.
    rows = trusted.unionByName(web).select("doc_id", "p", "text").mapInArrow(_describe, "doc_id bigint, p int, x array<double>").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    x, p = np.array([r[2] for r in rows]).reshape(-1, N_FEATURES), np.array([r[1] for r in rows])
    positive, rest = x[p == 1], x[p == 0]
    if not len(positive):
        return None
    return train(positive, rest if len(rest) else positive, min(float(prior), 0.98))


def _describe(batches):
    for batch in slices(batches):
        x = describe_all(texts(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("p").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "p", "x"]
        )


def _logits(scorer):
    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scorer.value.logits(describe_all(texts(batch))))], ["doc_id", "z"])

    return run


def thinnest(logits: DataFrame, prior: float) -> float:
    """The middle of the emptiest bins of z near the quantile that leaves `prior` of the rows above."""
    lo, hi = logits.agg(F.min("z"), F.max("z")).first()
    if lo is None or lo == hi:
        return lo or 0.0
    place = F.least(F.floor((F.col("z") - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("int")
    counts = np.zeros(BINS, np.int64)
    for b, n in logits.groupBy(place).count().collect():  # BINS rows at most
        counts[b] = n
    upto = np.cumsum(counts)
    first, last = (int(np.searchsorted(upto, np.clip(1 - prior + d, 0, 1) * upto[-1])) for d in (-NEAR, NEAR))
    near = counts[first : min(last, BINS - 1) + 1]
    ends = np.flatnonzero(np.diff(np.concatenate([[0], near == near.min(), [0]])))
    a, b = max(zip(ends[::2], ends[1::2]), key=lambda e: (e[1] - e[0], -e[0]))
    return float(lo + (first + (a + b) / 2) * (hi - lo) / BINS)


def score(docs: DataFrame, scorer: Scorer | None, seen: Column | None = None) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text). The cut is set on rows whose doc_id meets `seen`, or on all."""
    if scorer is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    spark = docs.sparkSession
    logits = docs.select("doc_id", "text").mapInArrow(_logits(spark.sparkContext.broadcast(scorer)), "doc_id bigint, z double")
    logits = Scratch(spark, "quality").write("logits", logits)
    cut = thinnest(logits if seen is None else logits.filter(seen), scorer.prior)
    return logits.select("doc_id", (1 / (1 + F.exp(-F.least(F.greatest(F.col("z") - cut, F.lit(-60.0)), F.lit(60.0))))).alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen = fold(F.col("doc_id"), 3) != 1
    scorer = fit(docs.filter(seen), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(seen))
    return score(docs, scorer, seen).select("doc_id", (~seen).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
