"""The token store: other tokenizers, forgetting, encodings, and reads that leave pages alone."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lociflow.llm import token_store

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(autouse=True)
def importable(spark):
    import os

    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def library_ids(path, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def test_which_tokenizers_work_word_by_word():
    import public_tokenizers

    assert token_store.word_wise(public_tokenizers.path("word_bpe_49k.json")) and not token_store.word_wise(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_tokenizer_that_is_not_word_wise(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two  three\n", None, "", "Ünïcödé 漢字 'll", "<|endoftext|> x", "a " * 2000]
    rows = [*enumerate(texts), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit(1), "start": F.lit(2), "part": F.lit("x")})
    token_store.write_tokens(docs.repartition(3), str(tmp_path / "s"), path, end_id=7, parts=3)
    found = token_store.read_tokens(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((i, library_ids(path, t, 7)) for i, t in rows)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()] and [r.doc_id for r in found] == sorted(i for i, _ in rows)


@pytest.mark.parametrize("limit", [5, 60])
def test_forgetting_changes_nothing(limit):
    path, rng = token_store.tokenizer_path(), random.Random(limit)
    words = ["".join(rng.choice("abcdeéß1.") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", "!?"]) for _ in range(400)]
    batches = [[" ".join(rng.choice(words) for _ in range(30)) for _ in range(4)] for _ in range(40)]
    small, plain = token_store.WordEncoder(path, 1), token_store.TextEncoder(path, 1)
    small.limit = limit
    forgot = 0
    for batch in batches:
        before = len(small.index)
        ids, ends = small.encode(pa.array(batch))
        want, want_ends = plain.encode(pa.array(batch))
        assert ids.tolist() == want.tolist() and ends.tolist() == want_ends.tolist()
        forgot += len(small.index) < before
    assert forgot > 5


def test_layout_and_selective_reads(spark, tmp_path):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "s")
    token_store.write_tokens(docs, path, parts=2)
    files = sorted(glob.glob(f"{path}/tokens/*.parquet"))
    assert len(files) == 2
    for file in files:
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        kinds = {k.split(".")[0]: set(c.encodings) for k, c in columns.items()}
        assert kinds["ids"] & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} and kinds["doc_id"] & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"}
    some = token_store.read_tokens(spark, path, 1000, 1009)
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,1000)" in plan and "LessThanOrEqual(doc_id,1009)" in plan
    whole = {r.doc_id: (r.start, r.ids) for r in token_store.read_tokens(spark, path).filter("doc_id BETWEEN 1000 AND 1009").collect()}
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == whole and len(whole) == 10
    assert "ids" not in token_store.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
