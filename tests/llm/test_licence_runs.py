"""Runs of lines in licence scans: against a brute-force search, and in very long files."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociflow.llm import licenses

SCHEMA = "doc_id bigint, text string"


def plain(text):
    return " ".join(licenses.words_of(text))


def bigrams(text):
    return set(licenses.bigrams_of(text))


def brute_runs(text, templates, least):
    """Greedy choice among all matching runs, by quality; then those of several lines that are no paragraph."""
    lines = [p for p in map(plain, text.split("\n")) if p]
    every = [(k, n, bigrams(t)) for k, n, t in templates if bigrams(t)]
    most_of = lambda t: int((2 - least) / least * len(t) + 1e-9)
    longest = 2 * max(most_of(t) for _, _, t in every) + 1
    hits = []
    for licence, name, t in every:
        for i in range(len(lines)):
            for k in range(1, len(lines) - i + 1):
                own = lines[i : i + k]
                words = " ".join(own).split()
                if any(len(x.split()) > longest for x in own) or (k > 1 and len(words) > 2 * most_of(t) + 1):
                    break
                found, first = bigrams(" ".join(own)), bigrams(" ".join(lines[i : i + 2]))
                dice = 2 * len(found & t) / (len(found) + len(t)) if found else 0
                if dice >= least and len(found) <= most_of(t) and first & t:
                    hits.append((-dice, k, licence, name, i))
    chosen = []
    for d, k, licence, name, i in sorted(hits):
        if all(i + k <= b or b + m <= i for _, m, _, _, b in chosen):
            chosen.append((d, k, licence, name, i))
    blank = re.split("\n[ \t\r]*\n", text)
    paragraphs = {plain(p) for p in blank if "\n" in p} if len(blank) > 1 else set()
    return Counter((licence, name, round(-d, 9)) for d, k, licence, name, i in chosen if k > 1 and " ".join(lines[i : i + k]) not in paragraphs)


def found_runs(spark, texts, templates, least):
    rows = [(k, n, licenses.bigrams_of(t)) for k, n, t in templates]
    known = spark.createDataFrame(rows, "license_id string, template_id string, template array<string>")
    anchor = sorted({a for _, _, t in templates for a in licenses.anchors(t, least)})
    most = max(int((2 - least) / least * len(b) + 1e-9) for _, _, b in rows)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    out = licenses.runs(docs, known, anchor, sorted({b for _, _, t in rows for b in t}), least, most)
    got = {i: Counter() for i in range(len(texts))}
    for r in out.collect():
        got[r.doc_id][r.license_id, r.template_id, round(-r.d, 9)] += 1
    return got


@pytest.mark.parametrize("block", [2, 256])
def test_runs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(licenses, "BLOCK", block)
    templates = [("A", "one", "alpha beta gamma delta epsilon zeta"), ("A", "two", "eta theta iota kappa alpha beta"), ("B", "one", "lambda mu nu xi alpha beta gamma")]
    rng, words = random.Random(11), "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi other words".split()
    texts = ["", "\n", "alpha beta", "alpha beta\ngamma delta\nepsilon zeta", None]
    for _ in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            text = rng.choice([t for _, _, t in templates]).split()
            if rng.random() < 0.6:
                text[rng.randrange(len(text))] = rng.choice(words)
            own += text if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randrange(1, 30))]
        joined = ""
        for w in own:
            joined += w + rng.choice([" ", " ", "\n", "\n", "\n# \n", "\n\n", ".\n"])
        texts.append(joined)
    got = found_runs(spark, texts, templates, licenses.LEAST)
    want = {i: brute_runs(t or "", templates, licenses.LEAST) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 20


def test_very_long_files(spark):
    import textwrap

    grant = next(t for k, n, t in licenses.TEMPLATES if (k, n) == ("MIT", "grant"))
    head = "/*\n * " + "\n * ".join(textwrap.wrap(grant, 60)) + "\n */\n"
    code = "".join(f"value_{i} = compute(item_{i % 97});\n" for i in range(100_000))
    anchored = "".join(f"software without permission {i}\n" for i in range(10_000))
    notices = "Released under the MIT License.\n" * 10_000
    wide = "x" * 50 + " lorem ipsum dolor" * 1_500_000  # one line of 27 MB
    texts = [head + code, head + anchored, notices, head + wide + "\n" + head]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    got = {r.doc_id: (r.license_id, r.template_id, r.dice, r.n_segments) for r in found}
    assert got == {0: ("MIT", "grant", 1.0, 1), 1: ("MIT", "grant", 1.0, 1), 2: ("MIT", "notice", 1.0, 10_000), 3: ("MIT", "grant", 1.0, 2)}


def test_repeated_rows_and_ids(spark):
    import textwrap

    wrapped = "\n".join(textwrap.wrap(next(t for k, n, t in licenses.TEMPLATES if (k, n) == ("MIT", "grant")), 50))
    rows = [(1, wrapped), (1, wrapped), (1, "nothing\nhere"), (2, "a\n" + wrapped), (None, wrapped), (3, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"t": F.lit(1), "i": F.lit(2), "lines": F.lit("x"), "hit": F.lit(0)})
    got = Counter((r.doc_id, r.license_id, r.dice) for r in licenses.scan(docs).collect())
    assert got == {(1, "MIT", 1.0): 1, (2, "MIT", 1.0): 1, (None, "MIT", 1.0): 1}
