"""What the n-gram join keeps on disk: shuffles go with their step, common phrases make no families, tiles are searched a batch at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import common, ngram_join
from tests.llm.test_operators import brute_components, corpus, frame, importable, repeated  # noqa: F401


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f.rsplit("/", 1)[-1] for f in files.split("\n") if "/shuffle_" in f}


def test_a_table_leaves_no_shuffle(spark):
    scratch, before = common.Scratch(spark, "t"), shuffle_files(spark)
    table = scratch.write("x", spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert table.agg(F.sum("count")).first()[0] == 10_000


def found_by(spark, texts, scratch):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, texts), scratch).collect()}


def test_common_phrases_make_no_family(spark, monkeypatch):
    """Phrases that too many texts have for a small block, though they were not told as frequent beforehand."""
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "heavy_shingles", lambda *_: np.zeros(0, np.uint64))
    rng = random.Random(5)
    phrases = [[f"p{k}_{i}" for i in range(5)] for k in range(30)]
    texts = []
    for n in range(150):
        own = [f"x{n}_{i}" for i in range(30)]
        for k in rng.sample(range(30), 4):
            at = rng.randrange(len(own))
            own = own[:at] + phrases[k] + own[at:]
        texts.append(" ".join(own))
    texts += [texts[0] + " more", "before " + texts[1], *(" ".join(p) for p in phrases[:2])]
    scratch = common.Scratch(spark, "t")
    assert found_by(spark, texts, scratch) == brute_components(texts)
    sizes = [r["count"] for r in spark.read.parquet(scratch.path("family")).groupBy("component").count().collect()]
    assert max(sizes) <= 8


def test_frequent_shingles_are_told_in_few_segments(spark):
    """A shingle that twice SMALL_BLOCK texts have is told as frequent, though it is in few texts of each of many segments."""
    lists = [(None, None, None, None, [7], [2])] * 12 + [(None, None, None, None, [9], [2])] + [(None, None, None, None, [], [])] * 500
    features = spark.createDataFrame([*lists, (1, b"x", 1, 1 << 33, None, None)], ngram_join.FEATURES)
    args = (features, common.Scratch(spark, "t")) if ngram_join.heavy_shingles.__code__.co_argcount == 2 else (features,)
    assert ngram_join.heavy_shingles(*args).tolist() == [7]


def test_no_more_than_the_most_frequent_are_told(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    lists = [(None, None, None, None, [1, 2, 3, 4, 5], [90, 80, 70, 60, 60])]
    told = ngram_join.heavy_shingles(spark.createDataFrame([*lists, (1, b"x", 1, 9, None, None)], ngram_join.FEATURES), common.Scratch(spark, "t"))
    assert told.tolist() == [1, 2, 3]


def test_tiles_are_searched_a_batch_at_a_time(spark, monkeypatch):
    """Of a family whose texts stay apart no step deals out many more rows than it has texts."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", 4)
    rows, searched = [], ngram_join._searched
    monkeypatch.setattr(ngram_join, "_searched", lambda dealt, *a: (rows.append(dealt.count()), searched(dealt, *a))[1])
    start = [f"s{i}" for i in range(60)]
    texts = [" ".join(start + [f"y{n}_{i}" for i in range(12)]) for n in range(100)]
    assert found_by(spark, texts, common.Scratch(spark, "t")) == brute_components(texts)
    assert sum(rows) > 500 and max(rows) <= 250


@pytest.mark.parametrize("most", [1 << 27, 1 << 10])
def test_key_filter_loses_none(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FILTER_MOST", most)
    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 5000)
    held = common.key_filter(spark.createDataFrame([(int(k),) for k in keys[:1000]], "k bigint"), common.Scratch(spark, "t"), "f").value
    found = common.passes(held, keys)
    assert found[:1000].all() and (most < 1 << 20 or found[1000:].mean() < 0.05)
    assert not common.passes(common.key_filter(spark.createDataFrame([], "k bigint"), common.Scratch(spark, "t"), "f").value, keys).any()


def test_texts_in_question_by_filter(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ID_BROADCAST", 0)
    texts = corpus(3)
    assert found_by(spark, texts, common.Scratch(spark, "t")) == brute_components(texts)


def test_stage_shuffles_no_text(spark, monkeypatch):
    """The rows that go are told by their ids alone, few or many; the others' texts stay where they are."""
    df = repeated(spark).unionByName(frame(spark, corpus(4)).withColumn("doc_id", F.col("doc_id") + 100))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one_of_each(df)
        unique = ngram_join.keep_one_of_each(df.filter("doc_id >= 100"))
        assert "SortMergeJoin" not in unique._jdf.queryExecution().executedPlan().toString()
        want = sorted(map(str, kept.collect()))
        monkeypatch.setattr(ngram_join, "ID_BROADCAST", 0)
        assert sorted(map(str, ngram_join.keep_one_of_each(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
