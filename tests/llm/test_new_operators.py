"""Fill-in-the-middle, ranked search and token counts against brute force, and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociflow.llm import fill_middle, ranked_search, token_counts
from lociflow.llm.token_store import tokenizer_path

SCHEMA = "doc_id bigint, text string"
ODD = [None, "", " ", " \n\t ", "one", "one ", " two words", "a<P>b c", "Ünïcödé Ωμέγα 漢字", "🙂 !!! ---", "x y　z", "a " * 3000, "<<S", "p <S", "tail <"]


@pytest.fixture(autouse=True)
def importable(spark):
    import os

    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def frame(spark, rows):
    """Rows of (doc_id, text) beside columns whose names the operators use themselves."""
    clash = {"n": 1, "form": "x", "output": "y", "score": 2, "rank": 3, "item": 4, "terms": "t", "n_tokens": 5, "lang": "en", "source": None}
    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in clash.items()})


def spaced(rng, n):
    return "".join(rng.choice(["ab", "ç", "漢", " ", "  ", "\n", "\t", ".", "<"]) for _ in range(n))


# ---------------------------------------------------------------- fill-in-the-middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_regex(doc_id, text):
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_against_regex(spark):
    rng = random.Random(3)
    shared = spaced(rng, 4000)
    texts = ODD + [spaced(rng, rng.choice([1, 5, 300, 5000])) for _ in range(120)] + [spaced(rng, k) + shared + spaced(rng, k) for k in (3, 700, 2000)]
    rows = [*enumerate(texts), (None, "no id at all"), (3, "same id"), (3, "same id"), (None, None)]
    found = fill_middle.fill_in_middle(frame(spark, rows))
    found = found.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == Counter((i, *by_regex(i, t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.restored) for r in found) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_every_cut_and_chunks():
    rng = random.Random(4)
    for text in [spaced(rng, 6000), " " * 3000, "x" * 30000, "a b" * 4000, "", " "]:
        data, known = text.encode(), fill_middle.Summaries()
        document, units = fill_middle.Document(data, known), TOKEN.findall(text)
        assert document.n == len(units)
        chars = size = 0
        for k in range(len(units) + 1):
            assert document.cut(k) == (size, chars)
            if k < len(units):
                chars, size = chars + len(units[k]), size + len(units[k].encode())
        ends = fill_middle.chunk_ends(np.frombuffer(data, np.uint8))
        sizes = np.diff([0, *ends])
        assert (not data and not ends) or (ends[-1] == len(data) and max(sizes) <= fill_middle.MOST and min(sizes[:-1], default=fill_middle.LEAST) >= fill_middle.LEAST)


def test_chunks_are_shared_after_an_insertion():
    rng = random.Random(5)
    text, known = " ".join(str(rng.random()) for _ in range(4000)).encode(), fill_middle.Summaries()
    first = fill_middle.Document(text, known)
    before = len(known)
    second = fill_middle.Document(b"put in front " + text, known)
    assert before > 30 and len(known) - before <= 3 and second.n == first.n + 3


# ---------------------------------------------------------------- ranked search


def brute_search(rows, items, most):
    split = lambda t: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    docs = [(i, Counter(split(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total = sum(n for _, _, n in docs)
    held = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, n in docs:
            m = 50 + 50 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * held[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(split(text)) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:most])]
    return Counter(out)


def prose(rng, n, vocabulary):
    return " ".join(vocabulary[min(int(rng.expovariate(0.02)), len(vocabulary) - 1)] for _ in range(n))


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_ranked_search(spark, block_bytes):
    rng = random.Random(6)
    vocabulary = [f"{c}{i}" for i in range(150) for c in ("w", "É", "Z")]
    rows = [(i, prose(rng, rng.choice([2, 30, 200]), vocabulary)) for i in range(400)]
    rows += [(900 + i, rows[7][1]) for i in range(70)] + [(5, "one of two of an id w3"), (None, rows[7][1]), (None, "w3 w4"), (801, None), (802, ""), (803, "...")]
    items = [(k, prose(rng, 12, vocabulary)) for k in range(12)] + [(3, rows[7][1]), (3, rows[7][1]), (20, None), (21, ""), (22, "nowhere"), (None, "w1 w2 w2")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    for most in (50, 5):
        found = ranked_search.search(frame(spark, rows).repartition(3), benchmark, most, block_bytes)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, found.collect())) == brute_search(rows, items, most)


def test_ranked_search_empty(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b")])
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(some, items.limit(0)).dtypes == ranked_search.search(some, items).dtypes
    assert ranked_search.search(some, items.limit(0)).count() == 0
    assert ranked_search.search(frame(spark, [(1, None), (2, "--")]), items).count() == 0


@pytest.mark.parametrize("leaf, centroids", [(1, 8 << 20), (4, 8 << 20), (4, 3000)])
def test_tree_bounds_hold(monkeypatch, leaf, centroids):
    """No node's bound is below the best score inside, whatever the tree, and near copies are passed over together."""
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    monkeypatch.setattr(ranked_search, "CENTROIDS", centroids)
    rng = np.random.default_rng(leaf)
    width, docs = 300, 500
    weight, share = rng.integers(0, 9000, width), rng.random(width)
    rows = [np.unique(rng.integers(0, width, rng.integers(1, 40))) for _ in range(docs - 100)]
    rows += [rows[0]] * 100
    values = [rng.integers(1, 900_000, len(r)) if i < docs - 100 else np.full(len(r), 77) for i, r in enumerate(rows)]
    tree = ranked_search.Tree(np.arange(docs), np.zeros(docs, bool), np.cumsum([len(r) for r in rows]), np.concatenate(rows), np.concatenate(values), weight, share)
    assert sorted(tree.ids.tolist()) == list(range(docs)) and (centroids > 3000 or tree.first_leaf < 63)
    for _ in range(20):
        item = np.unique(rng.integers(0, width + 50, 30))
        exact = {i: int(sum(int(v) * int(weight[t]) for t, v in zip(rows[i], values[i]) if t in item)) for i in range(docs)}
        best = ranked_search.Best(10)
        seen = []
        best.offer = lambda s, i, a, keep=best.offer: (seen.extend(i.tolist()), keep(s, i, a))
        tree.search(item, np.concatenate([weight, np.zeros(50, np.int64)])[item], best)
        want = sorted(((-s, i) for i, s in exact.items() if s > 0))[:10]
        assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want
        assert len(seen) == len(set(seen)) and (centroids == 3000 or len(seen) < docs)


# ---------------------------------------------------------------- token counts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_against_the_library(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(public_tokenizers.path(name)), random.Random(7)
    pool = [chr(rng.randrange(1, 0x3000)) for _ in range(200)] + [*"aAbBsStT'<|>019 \n\t!?.ßİΣς\x1c"] + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "é", "हिन्दी", "中文"]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += ["".join(rng.choice(pool).strip() for _ in range(60_000)), "abcdefghij" * 9000, "7" * 90_000, "a!" * 50_000, "<|endoftext|>" * 9000]
    rows = [*enumerate(texts), (3, "twice"), (3, "twice"), (None, "no id")]
    found = token_counts.token_counts(frame(spark, rows).repartition(4), public_tokenizers.path(name)).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == Counter((i, len((t or "").encode()), size(t)) for i, t in rows)
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_counts_after_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "LIMIT", 20)
    counter = token_counts.Counter(tokenizer_path())
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé.1") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(60)]
    fresh = token_counts.Counter(tokenizer_path())
    assert [int(counter.batch(pa.array([t]))[0]) for t in texts] == fresh.batch(pa.array(texts)).tolist()
    assert len(counter.known.young) + len(counter.known.old) < 120


def test_merging_takes_the_least_rank_first():
    """Against merging by rescanning, with ranks at random, on words of one letter and of many."""
    rng = random.Random(9)
    letters = "abc"
    for _ in range(40):
        vocabulary, merges = [*letters], []
        for _ in range(12):
            a, b = rng.choice(vocabulary), rng.choice(vocabulary)
            if a + b not in vocabulary:
                vocabulary.append(a + b)
                merges.append([a, b])
        ids = {w: i for i, w in enumerate(vocabulary)}
        own = token_counts.Merges({"type": "BPE", "vocab": ids, "merges": merges})
        for word in ["a" * 30, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(20))]:
            left = [*word]
            while True:
                ranks = [(merges.index([x, y]), i) for i, (x, y) in enumerate(zip(left, left[1:])) if [x, y] in merges]
                if not ranks:
                    break
                i = min(ranks)[1]
                left[i : i + 2] = [left[i] + left[i + 1]]
            assert own.count(word) == len(left)


# ---------------------------------------------------------------- nothing goes by its size


def test_an_oversized_text_does_not_empty_its_class(spark, monkeypatch):
    from lociflow.llm import common, language, toxicity

    rows = [(i, ("scum " if i % 2 else "fine ") * 20 + str(i)) for i in range(40)]
    first = min((i for i in range(40) if i % 2), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("bigint"))).first()[0])
    rows[first] = (first, "scum " * 60_000)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en"))
    known = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("_y"))
    sample = common.bounded_sample(docs, known, "_y", {0: 30, 1: 30}, 16_000).collect()
    assert Counter(r._y for r in sample) == {0: 20, 1: 20}
    assert sum(len(r.text) for r in sample if r._y) <= 16_000 and next(len(r.text) for r in sample if r.doc_id == first) == 250
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 16_000)
    assert toxicity.fit(docs, known.withColumnRenamed("_y", "toxic")) is not None
    monkeypatch.setattr(language, "SAMPLE_BYTES", 16_000)
    two = docs.filter("doc_id % 2 = 0").unionByName(docs.filter(f"doc_id = {first}").withColumn("lang", F.lit("xx")))
    assert language.fit(two).languages == ["en", "xx"]


def test_hot_groups_of_null_ids(spark, monkeypatch):
    from lociflow.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    rows = [(None, "same")] * 5 + [(1, "other"), (None, "other"), (None, "lone"), (7, "seven"), (8, "Seven"), (9, "SEVEN"), (9, "seven")]
    digested = exact_dedup.digests(spark.createDataFrame(rows, SCHEMA))
    index = exact_dedup.DigestIndex(spark, buckets=2)
    index.add(digested)
    found = exact_dedup.assign(digested, index.rows())
    got = Counter((r.doc_id, r.keep_id, r.group_size) for r in found.collect())
    index.drop()
    assert got == Counter([(None, None, 5)] * 5 + [(1, 1, 2), (None, 1, 2), (None, None, 1), (7, 9, 4), (8, 9, 4), (9, 9, 4), (9, 9, 4)])
