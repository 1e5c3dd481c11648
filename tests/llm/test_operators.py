"""The corpus operators against brute force, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociflow.llm import common, components, decontam, exact_dedup, language, licenses, mixing, ngram_join, quality, substring, token_store, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \n\t ", "one", "two words", "Ünïcödé Ωμέγα 漢字", "🙂 !!! ---", "a " * 3000]


@pytest.fixture(autouse=True)
def importable(spark):
    import os

    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("key", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("score", F.lit(0)) if extra else df


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 40, 90]))) for _ in range(n)]
    for k in range(n // 2):  # near copies with some words changed
        own = texts[rng.randrange(n)].split()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    return texts + texts[:5] + ODD


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed, small, tile", [(1, 64, 1024), (2, 2, 3)])
def test_ngram_join(spark, monkeypatch, seed, small, tile):
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", small)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    texts = corpus(seed)
    found = ngram_join.near_duplicates(frame(spark, texts, extra=True), common.Scratch(spark, "t"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts)


def test_ngram_join_empty_and_stage(spark):
    assert ngram_join.near_duplicates(frame(spark, []), common.Scratch(spark, "t")).count() == 0
    df = frame(spark, ["a b c d e f", "a b c d e f", None, "", "x"])
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def repeated(spark):
    """Repeated and null ids, with the same and with other texts."""
    rows = [(3, "w"), (3, "w"), (3, "W "), (7, "w z"), (7, "unrelated"), (7, None), (9, "W"), (None, "w z"), (None, "only here"), (None, "only here"), (2, "Unrelated"), (5, ""), (5, "")]
    return spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA)


def test_ngram_join_repeated_ids(spark):
    df = repeated(spark).withColumn("other_id", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("hash", F.lit(2))
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text.strip().lower() if r.text else r.text) for r in kept.collect() if r.text)
    assert got == [(False, 2, "unrelated"), (False, 3, "w"), (False, 7, "w z"), (True, 0, "only here")]
    assert kept.filter("text IS NULL OR text = ''").count() == 3
    found = ngram_join.near_duplicates(df, common.Scratch(spark, "t")).collect()
    assert len(found) == 13 and sorted((r.doc_id, r.component_id) for r in found if r.doc_id in (7, 9, 2)) == [(2, 2), (7, 2), (7, 7), (7, 7), (9, 3)]


def test_large_family_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "LEADERS", 4)
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", 8)
    rng = random.Random(21)
    # Three bodies that share a beginning, so that they are one family but three components; some texts stand alone.
    start = [f"s{i}" for i in range(60)]
    bodies = [start + [f"b{k}_{i}" for i in range(60)] for k in range(3)]
    texts = []
    for n in range(240):
        own = list(bodies[n % 3])
        own[rng.randrange(len(own))] = f"x{n}"
        if n % 40 == 0:
            own = start + [f"y{n}_{i}" for i in range(45)]
        texts.append(" ".join(own))
    scratch = common.Scratch(spark, "t")
    found = ngram_join.near_duplicates(frame(spark, texts), scratch)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts)
    assert spark.read.parquet(scratch.path("apart-pairs-of-tiles")).count()  # tiles of groups that are still apart were searched


def test_signature_tree_finds_all(spark):
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(5)]
    sets = [np.unique(np.concatenate([rng.choice(b, rng.integers(40, len(b)), replace=False), rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for b in base for _ in range(30)]
    tokens = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
    size = np.array([len(s) for s in sets])
    found = ngram_join.search_family(np.arange(len(sets)), size, np.zeros(len(sets), np.int64), tokens, True)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.enough(len(np.intersect1d(sets[i], sets[j])), size[i], size[j])}
    assert want <= {(a, b) for a, b, _ in found}


@pytest.mark.parametrize("hot", [256, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_EDGES", hot)
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 230)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), common.Scratch(spark, "t")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[a] == found[b] <= min(a, b) for a, b in edges if a != b)


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER)))


@pytest.mark.parametrize("block", [10**6, 12])  # sent to the tasks, and joined
def test_decontamination(spark, block):
    rng = random.Random(5)
    items = [" ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(n)) for n in (3, 10, 14, 30, 30, 1)] + [None, "!!"]
    texts = ODD + [" ".join(["z1"] * a + items[i].upper().split()[b:c] + ["y,y"] * a) for i in range(6) for a, b, c in ((0, 0, 99), (3, 0, 99), (2, 0, 10), (4, 1, 10), (1, 5, 16))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.report(decontam.hits(frame(spark, texts, extra=True), bench, block)).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        w, hit, names = words_of(t), set(), set()
        for i, item in enumerate(items):
            v = words_of(item)
            k = min(10, len(v))
            windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1):
                if v and tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    names.add(str(i))
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    clean = decontam.decontaminate(frame(spark, texts), bench, block)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, r in got.items() if not r.contaminated)
    assert decontam.report(decontam.hits(frame(spark, texts), bench.limit(0))).filter("contaminated").isEmpty()
    # Repeated and null ids: each row has its result, however the benchmark is met.
    own = f"z {items[1]} z"
    rows = [(1, own), (1, own), (1, "clean words"), (None, own), (None, own), (2, None), (None, "clean")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("text_key", F.lit(1)).withColumn("_doc_id", F.lit(1))
    out = decontam.report(decontam.hits(df, bench, block)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in out) == [(0, 1, 0, False), (0, 12, 10, True), (0, 12, 10, True), (1, 2, 0, False), (1, 12, 10, True), (1, 12, 10, True), (2, 0, 0, False)]
    clean = decontam.decontaminate(df, bench, block)
    assert clean.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in clean.collect() if r.text) == [(0, "clean"), (1, "clean words")]


def test_token_store(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.tokenizer_path())
    texts = ODD + ["It's a test, isn't it? <|endoftext|>! <|ENDOFTEXT|>.", "3.14, x !? …. é. İstanbul ΣΑΣ. naïvé nb\x1c\x85z", "don't. a's. word.'s"] * 3
    path = common.Scratch(spark, "t").path("store")
    token_store.write_tokens(frame(spark, texts, extra=True).repartition(5), path, parts=3)
    got, start = {r.doc_id: r for r in token_store.checksums(spark, path).collect()}, 0
    for d, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [list(r.ids) for r in token_store.read_tokens(spark, path, 3, 3).collect()] == [tok.encode("one").ids + [1]]
    assert token_store.read_metadata(spark, path).count() == len(texts)


def test_words_that_normalise_to_marks():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.tokenizer_path())
    words = ["\u09b9\u09df,", "\u092a\u0947\u095c,", "\u092a\u0947\u0921\u093c,", "\u09aa\u09c7\u09dc.", "AL\u0130.", "\u0130?!", "\u00e9,", "ΣΑΣ.", "H\u0331a", "T\u0308,", "T\u0344 J\u030c"]
    flat, ends = token_store.WordEncoder(token_store.tokenizer_path(), 1).encode(pa.array(words))
    for w, a, b in zip(words, ends, ends[1:]):
        assert flat[a:b].tolist() == tok.encode(w, add_special_tokens=False).ids + [1], ascii(w)


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(60))) or None, "en", rng.choice(["a", "b", "c", "d", None]), 0) for i in range(500)]
    rows += [(500, "twice here", "en", "a", 0)] * 4
    df = spark.createDataFrame(rows, SCHEMA)
    scratch = common.Scratch(spark, "t")
    sized = scratch.write("sizes", mixing.sizes(df))
    out = mixing.copies(sized, scratch).collect()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(k for k in size if k is not None) + [None]
    weight = {k: [5, 2, 1][i % 3] for i, k in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:  # the iterative rule
        share = {k: left * weight[k] / sum(weight[f] for f in free) for k in free}
        over = {k for k in free if share[k] > 2 * size[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 2.0 * size[k]
            left -= target[k]
        free -= over
    for k in names:
        own = [r for r in out if r.source == k]
        assert all(abs(r.target - target[k]) < 1e-6 and r.source_size == size[k] and 0 <= r.copies <= 2 for r in own)
        assert abs(sum(r.copies * r["size"] for r in own) - target[k]) <= 61
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    clash = df.unionByName(spark.createDataFrame([(None, "no id", "en", "a", 0)] * 3, SCHEMA)).selectExpr("*", "1 AS _tie", "2 AS _n", "3 AS _number", "4 AS _part")
    sized = scratch.write("clash", mixing.sizes(clash))
    want = {(r.doc_id, r.source): n for (r, n) in ((r, r.n) for r in mixing.copies(sized, scratch).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()) if n}
    mixed = mixing.mix_sources(clash)
    assert mixed.columns == clash.columns and {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()} == want


def test_exact_dedup_index(spark):
    texts = ["Same", "same", "SAME ", None, "", "É", "é"]
    df = frame(spark, texts, extra=True)
    index = exact_dedup.DigestIndex(spark, buckets=4)
    kept = exact_dedup.exact_dedup(df, index)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6]
    again = exact_dedup.exact_dedup(frame(spark, ["same", "new", "new"]), exact_dedup.DigestIndex(spark, index.location, 4))
    assert [r.doc_id for r in again.collect()] == [2]
    assert exact_dedup.exact_dedup(df.limit(0), index).count() == 0
    rows = spark.createDataFrame([(5, "A", 1), (5, "B", 1), (9, "b", 2), (9, "B", 2), (9, "c", 3), (None, "n", 4)], "doc_id bigint, text string, _digest int")
    kept = exact_dedup.exact_dedup(rows, exact_dedup.DigestIndex(spark, buckets=2))
    assert kept.columns == rows.columns and sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect()) == [(0, "n"), (5, "a"), (9, "b"), (9, "c")]
    plan = exact_dedup.DigestIndex(spark, index.location, 4).rows().groupBy("digest").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # the buckets are used where they lie


def test_substring(spark):
    rng = random.Random(8)
    word = lambda: f"x{rng.randrange(10**6)}"
    shared = [word() for _ in range(51)]
    texts = [" ".join([word() for _ in range(rng.randrange(5, 80))] + shared + [word() for _ in range(rng.randrange(5, 80))]) for _ in range(12)]
    texts += [" ".join(word() for _ in range(100)) + " a short shared line of nine words is left" for _ in range(12)] + ODD[:-1]
    df = frame(spark, texts, extra=True)
    spans = substring.repeated_spans(df, common.Scratch(spark, "t")).collect()
    assert {r.doc_id for r in spans} == set(range(1, 12)) and {r.source_doc_id for r in spans} == {0}
    for r in spans:
        own = texts[r.doc_id].split()[r.first_word : r.end_word]
        assert own == shared[shared.index(own[0]) :][: len(own)] and r.n_words >= 24
    rest = {r.doc_id: r.text for r in substring.remove_repeats(df.withColumn("_lo", F.lit(1))).collect()}
    assert rest[0] == texts[0] and len(rest) == len(texts) and all(len(rest[d].split()) <= len(texts[d].split()) - 24 for d in range(1, 12))
    assert substring.repeated_spans(df.limit(0), common.Scratch(spark, "t")).count() == 0


def test_substring_against_all_repeats(spark):
    """On whole documents: a span stands in its source word for word, and each run of 51 words that occurs twice meets a span."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(10**9, " ".join(f"q{i % 60}" for i in range(200))), (None, "n " + " ".join(f"q{i % 60}" for i in range(60)))], "doc_id bigint, text string")
    )
    words = {r.doc_id: [w.decode() for w in (r.text or "").encode().lower().split()] for r in df.collect()}
    found = substring.repeated_spans(df, common.Scratch(spark, "t"))
    spans = found.collect()
    covered = {}
    for r in spans:
        own = words[r.doc_id][r.first_word : r.end_word]
        assert len(own) == r.n_words >= 24 and own == words[r.source_doc_id][r.source_first_word :][: len(own)]
        covered.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    joined = [(d, i) for r in substring.stretches(found).collect() for d, i in ((r.doc_id, i) for i in range(r.first_word, r.end_word))]
    assert len(joined) == len(set(joined)) and set(joined) == {(d, i) for d, own in covered.items() for a, b in own for i in range(a, b)}
    places = {}
    for d in sorted(words, key=lambda d: (d is None, d)):
        for i in range(len(words[d]) - 50):
            places.setdefault(tuple(words[d][i : i + 51]), []).append((d, i))
    repeated_places = [p for ps in places.values() for p in ps[1:]]
    assert len(repeated_places) > 1000
    assert all(any(a < i + 51 and i < b for a, b in covered.get(d, [])) for d, i in repeated_places)


def test_licenses(spark):
    grant = next(t for k, n, t in licenses.TEMPLATES if (k, n) == ("MIT", "grant"))
    texts = [*ODD, "x\nReleased under the MIT License.\ny", grant.replace("hereby ", ""), "intro\n\n" + grant.replace(", ", ",\n") + "\n\nend", "the license of a licensed license is released"]
    texts += ["Our tool is great. Released under the MIT License. Enjoy it, and tell others!", "// SPDX-License-Identifier: BSD-3-Clause\nint main;", "x. Licensed under CC BY 4.0. y; Licensed under CC BY-SA 4.0. z"]
    tie = [("B", "one", "Alpha beta gamma delta."), ("A", "two", "Alpha beta gamma delta."), ("A", "one", "Alpha beta gamma delta.")]
    assert [tuple(r)[1:3] for r in licenses.scan(frame(spark, ["alpha beta gamma delta"]), tie).collect()] == [("A", "one")]
    assert licenses.scan(frame(spark, texts), []).count() == 0 and licenses.scan(frame(spark, [])).count() == 0
    got = {(r.doc_id, r.license_id) for r in licenses.scan(frame(spark, texts, extra=True)).collect()}
    n = len(ODD)
    assert got == {(n, "MIT"), (n + 1, "MIT"), (n + 2, "MIT"), (n + 4, "MIT"), (n + 5, "BSD-3-Clause"), (n + 6, "CC-BY-4.0"), (n + 6, "CC-BY-SA-4.0")}
    for _, _, text in licenses.TEMPLATES:  # every match holds an anchor
        own, chosen = licenses.bigrams_of(text), licenses.anchors(text, licenses.LEAST)
        without = [b for b in own if not set(b.split()) & set(chosen)]
        assert 2 * len(without) / (len(without) + len(own)) < licenses.LEAST


def test_licenses_in_wrapped_lines(spark):
    import textwrap

    text = {(k, n): t for k, n, t in licenses.TEMPLATES}
    wrapped = {key: textwrap.wrap(t, 60) for key, t in text.items()}
    grant, header, warranty = wrapped["MIT", "grant"], wrapped["GPL-3.0", "header"], wrapped["MIT", "warranty"]
    texts = [
        "\n".join(grant),
        "some code\n" + "\n".join(grant) + "\nmore code here",
        "/*\n * " + "\n * ".join(["Copyright (c) 2020 Someone", "", *grant, "", *warranty]) + "\n */",
        "# a\n# " + "\n# ".join(header) + "\n#\nx = 1",
        "\n".join(grant) + "\n\nend",
        "Released under the MIT License.\nyes",
        "\n".join(wrapped["Apache-2.0", "header-1"]),
        "\n".join(grant[:3]) + "\n" + "other words only\n" * 40,
    ]
    got = {r.doc_id: (r.license_id, r.template_id, r.dice, r.n_segments) for r in licenses.scan(frame(spark, texts, extra=True)).collect()}
    assert got[0] == got[1] == ("MIT", "grant", 1.0, 1)
    assert got[2][0] == "MIT" and got[2][2:] == (1.0, 2)
    assert got[3] == ("GPL-3.0", "header", 1.0, 1)
    assert got[4] == ("MIT", "grant", 1.0, 1)  # the paragraph has it already
    assert got[5] == ("MIT", "notice", 1.0, 1)
    assert got[6][:3] == ("Apache-2.0", "header-1", 1.0)
    assert 7 not in got


def synthetic(rng, lang):
    letters = {"en": "aeiouthns", "xx": "kqzwyáíóú"}[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(40))


def test_language(spark):
    rng = random.Random(3)
    rows = [(i, synthetic(rng, k), k, "s", 0) for i, k in enumerate(["en", "xx"] * 60)]
    rows += [(1000 + i, t, None, "s", 0) for i, t in enumerate([None, "", "123 !?", "漢" * 3000])]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(language.training_rows(df))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k, _, _ in rows if k)
    assert [got[1000 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[1003].lang_pred in ("en", "xx")
    assert language.fit(df.filter("lang IS NULL")) is None
    kept = language.keep_identified(df.withColumn("score", F.lit("own")), model)
    assert kept.columns == [*df.columns, "score"] and {r.doc_id for r in kept.collect()} >= set(range(120))
    assert language.keep_identified(df.limit(0), model).count() == 0
    assert {r.doc_id for r in language.keep_identified(df, None).collect()} == set(range(120)) | {1003}
    twice = df.unionByName(df.filter("doc_id < 20").withColumn("lang", F.lit("yy"))).unionByName(df.filter("doc_id = 3"))
    assert language.fit(twice, docs_per_lang=5).languages == ["en", "xx", "yy"]
    one = language.Model(["aa", "bb"], model.names, np.repeat(model.chance[:, :1], 2, axis=1))  # a tie goes to the first by name
    assert {r.lang_pred for r in language.identify(df.filter("doc_id < 9"), one).collect()} == {"aa"}


def test_marks_stay_within_words():
    assert language.spelled("हिन्दी,".encode()) == ["▁हिन्दी"] and language.spelled("\u0301\u0301".encode()) == [] and language.spelled(b"a1b") == ["▁ab"]
    names = language.pieces(language.piece_model_path())
    assert max(map(len, names)) > 8 and "▁" in names and not any(c.isdigit() for n in names for c in n)


def test_forward_sums_all_segmentations():
    names = ["▁", "a", "b", "ab", "▁a", "ba"]
    vocabulary, chance = language.Vocabulary(names), np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.25]])
    p = dict(zip(names, chance[:, 0]))

    def total(text):
        if not text:
            return 1.0
        return sum((p.get(text[:k], 0) + (language.UNKNOWN if k == 1 else 0)) * total(text[k:]) for k in range(1, len(text) + 1))

    words = ["▁ab", "▁aba", "▁bb", "▁c", "▁abab"]
    assert np.allclose(np.exp(language.log_chances(vocabulary, chance, words))[:, 0], [total(w) for w in words])


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(400)]
    bad = {i for i in range(400) if i % 4 == 0}
    texts = [t + " scum" if i in bad else t for i, t in enumerate(texts)] + ODD
    df = frame(spark, texts, extra=True)
    known = spark.createDataFrame([(i, int(i in bad)) for i in range(0, 400, 1) if i % 3], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, known)).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([(got[i].score >= toxicity.CUT) == (i in bad) for i in range(0, 400, 3)]) > 0.95
    assert toxicity.score(df, toxicity.fit(df, known.filter("toxic = 0"))).filter("score > 0").isEmpty()
    empty = toxicity.score(df.limit(0), toxicity.fit(df, known))
    assert empty.count() == 0 and toxicity.fit(df.limit(0), known) is None
    # Ids that repeat stay within the sample's bound, and give a row each.
    many = df.filter("doc_id < 8").crossJoin(spark.range(50).select(F.lit(0).alias("x"))).drop("x")
    sample = common.bounded_sample(many, known.withColumnRenamed("toxic", "_y"), "_y", {0: 3, 1: 2}, 10**6)
    assert sample.count() == 4 and toxicity.score(many, toxicity.fit(df, known)).count() == 400
    assert common.bounded_sample(df, known.withColumnRenamed("toxic", "_y"), "_y", {0: 30, 1: 20}, 500).agg(F.sum(F.length("text"))).first()[0] <= 1000


def test_toxicity_gradients():
    rng = np.random.default_rng(5)
    net = toxicity.Network(3)
    flat, ends = toxicity.encode([b"one two three four", b"five", b"six two one one seven", b""])
    docs = [(flat[a:b], y) for a, b, y in zip(ends, ends[1:], (1.0, 0.0, 1.0, 0.0))]
    params = [net.word, net.prefix, *net.filters, *net.bias, net.out, net.out_bias]
    for p in params[:2]:
        p *= 20  # far from the kinks of the maximum
    for p in net.bias:
        p += rng.uniform(0.05, 0.2, len(p)).astype(np.float32)
    toxicity.DECAY, kept = (0.0, 0.0), toxicity.DECAY
    try:
        _, grads = toxicity.gradients(net, docs)
        for p, g in zip(params, grads):
            if isinstance(g, tuple):
                whole = np.zeros_like(p)
                np.add.at(whole, g[0], g[1])
                g, places = whole, [(int(r), int(c)) for r in np.unique(g[0])[:4] for c in range(2)]
            else:
                places = [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)]
            for at in places:
                was, step = p[at], np.float32(1e-3)
                p[at] = was + step
                up, _ = toxicity.gradients(net, docs)
                p[at] = was - step
                down, _ = toxicity.gradients(net, docs)
                p[at] = was
                assert abs((up - down) / (2 * float(step)) - g[at]) < 2e-3 + 0.02 * abs(g[at]), at
    finally:
        toxicity.DECAY = kept


@pytest.mark.parametrize("stretch", [1, 2, 5, 1 << 17])
def test_forward_pass_by_words(monkeypatch, stretch):
    """Scores against a plain reading of the network, word by word, however long the stretches are."""
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    net = toxicity.Network(4)
    batch = [b"Alpha beta, gamma delta", b"beta", b"", None, b"one two"]
    flat, ends = toxicity.encode(batch)
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        rows = [np.concatenate([net.word[x >> 20], net.prefix[x & 0xFFFFF]]) if x >= 0 else np.zeros(2 * toxicity.DIM) for x in flat[a:b].tolist()]
        pooled = []
        for filters, bias in zip(net.filters, net.bias):
            found = [np.maximum((sum(rows[i + j] @ filters[j] for j in range(len(filters)) if i + j < len(rows)) if flat[a + i] >= 0 else 0) + bias, 0) for i in range(len(rows))]
            pooled.append(np.max(found, axis=0))
        z = np.concatenate(pooled) @ net.out + net.out_bias[0]
        assert abs(net.scores(batch)[k] - 1 / (1 + np.exp(-z))) < 1e-5


def test_word_runs():
    for text in (b"", b"   ", b"a", b"ab cde f  gh ", b"one" * 50 + b" two"):
        for most in (1, 3, 4, 1000):
            assert [w for run in common.word_runs(text, most) for w in run] == text.split()


def test_best_cut_and_thinnest(spark):
    bins, hits, misses = np.array([5, -3, 2, 9]), np.array([4, 0, 1, 3]), np.array([0, 6, 5, 0])
    assert toxicity.best_cut(bins, hits, misses) == (5 + 3) / 2 / toxicity.BINS  # F1 is best from bin 5 up
    z = spark.createDataFrame([(float(x),) for x in [*np.linspace(0, 1, 70), *np.linspace(5, 6, 30)]], "z double")
    assert 1 < quality.thinnest(z, 0.3) < 5 and quality.thinnest(z.limit(0), 0.3) == 0.0 and quality.thinnest(z.limit(1), 0.5) == 0.0


def test_pu_risk_and_gradient():
    rng = np.random.default_rng(1)
    n = quality.N_FEATURES
    params = [rng.normal(0, 0.3, (n, 5)), rng.normal(0, 0.1, 5), rng.normal(0, 0.5, 5), np.zeros(1)]
    xp, xu = rng.normal(0.3, 1, (20, n)), rng.normal(-0.1, 1, (40, n))

    def plain(prior):
        score = lambda x: np.tanh(x @ params[0] + params[1]) @ params[2] + params[3]
        loss = lambda z: float(np.mean(1 / (1 + np.exp(z))))
        return prior * loss(score(xp)), loss(-score(xu)) - prior * loss(-score(xp))

    for prior in (0.3, 5.0):  # with the larger prior the negative part is below zero
        risk, grads = quality.pu_risk(params, xp, xu, prior)
        up, negative = plain(prior)
        assert abs(risk - (up + max(0, negative))) < 1e-12 and (negative >= 0) == (prior < 1)
        for k, p in enumerate(params):
            for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
                was = p[at]
                p[at] = was + 1e-5
                a = plain(prior)
                p[at] = was - 1e-5
                b = plain(prior)
                p[at] = was
                slope = sum(a) - sum(b) if negative >= 0 else b[1] - a[1]
                assert abs(slope / 2e-5 - grads[k][at]) < 1e-6


def test_quality(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["the", "small", "river", "runs", "over", "stones."]) for _ in range(rng.randrange(30, 200))) for _ in range(400)]
    texts = [t if i % 5 else " ".join(w.upper() + "!!" for w in t.split()) for i, t in enumerate(good)] + ODD
    df = frame(spark, texts, extra=True)
    known = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 400, 2)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, known)).collect()}
    assert len(got) == len(texts) and np.mean([(got[i] >= 0.5) == (i % 5 > 0) for i in range(1, 400, 2)]) > 0.95
    assert quality.fit(df, known.limit(0)) is None and quality.score(df, None).count() == len(texts)
    many = df.filter("doc_id < 8").crossJoin(spark.range(50).select(F.lit(0).alias("x"))).drop("x")
    assert quality.score(many, quality.fit(many, known)).count() == 400 and quality.score(df.limit(0), quality.fit(df, known)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, synthetic(rng, k), k, f"s{i % 3}", 0) for i, k in enumerate(["en", "xx"] * 30)] + [(900, None, "en", "s0", 0), (901, "", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[5][1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
    ids = {r.doc_id for r in docs.collect()}
    assert ids and not ids & {5, 900, 901}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids and min(r.start for r in out) == 0
