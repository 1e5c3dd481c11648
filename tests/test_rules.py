"""Hand-written rows for cleaning, labelling, joins and dedup."""

import pytest
from pyspark.sql import functions as F

from lociflow.functions import scalars as S
from lociflow.functions.arrays import explode_packed
from lociflow.operators import clean, dedup, enrich, labels


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_numbers(spark):
    texts = [".", "..", "", "NA", "nan", "1.0d", "inf", " 1 ", "100", "100.01", "-1", "-1.0", None, "1e1", "abc"]
    df = clean.numeric(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), ["x"])
    assert {r.i: r.x for r in df.collect() if r.x is not None} == {7: 1.0, 8: 100.0, 13: 10.0}


def test_nan_becomes_null(spark):
    df = clean.nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None)], "i int, x double"))
    assert rows(df, "i") == [(1, None), (2, 3.0), (3, None)]


@pytest.mark.parametrize("mode, want", [("paired", [(1, "a", "x"), (1, "b", "y"), (1, "c", None), (2, None, "z")]), ("cross", 7)])
def test_explode(spark, mode, want):
    df = spark.createDataFrame([(1, "a; b ;c", "x;y"), (2, None, "z")], "i int, a string, b string")
    out = explode_packed(df, ["a", "b"], mode)
    assert out.count() == want if mode == "cross" else rows(out, "i", F.col("a").asc_nulls_last()) == want
    one, two = explode_packed(df.filter("i = 1"), ["a", "b"], mode), explode_packed(df.filter("i = 2"), ["a", "b"], mode)
    assert sorted(map(str, rows(one.union(two)))) == sorted(map(str, rows(out)))


def test_consequence(spark):
    cases = [("A", "A", "p.fs", "synonymous"), ("A", "B", "p.X1fsTer", "frameshift"), ("A", "*", None, "nonsense"), ("A", "X", "", "nonsense"), ("A", "B", None, "missense"), (None, None, None, "missense"), ("A", "B", "p.R2Ter", "nonsense")]
    df = spark.createDataFrame(cases, "r string, a string, h string, want string")
    assert df.filter(labels.consequence(F.col("r"), F.col("a"), F.col("h")) != F.col("want")).count() == 0


def test_clinical_text(spark):
    df = spark.createDataFrame([("Pathogenic",), ("Likely_benign",), ("Conflicting_pathogenic",), ("Benign/Pathogenic",), (None,)], "c string")
    assert [(r[1], r[2]) for r in labels.clinical_flags(df, "c").collect()] == [(True, False), (False, True), (False, False), (True, True), (False, False)]


def test_evidence(spark):
    schema = "id int, is_hotspot int, clinvar_path boolean, clinvar_benign boolean, recurrence int, is_cancer_gene int, consequence string, is_tsg int, is_civic int, af double"
    base = dict(is_hotspot=0, clinvar_path=False, clinvar_benign=False, recurrence=0, is_cancer_gene=0, consequence="missense", is_tsg=0, is_civic=0, af=None)
    cases = [
        (dict(clinvar_path=True, af=0.01), -1, "None"),
        (dict(clinvar_path=True, clinvar_benign=True), 1, "clinvar_pathogenic"),
        (dict(clinvar_benign=True), 0, "clinvar_benign"),
        (dict(af=0.001), 0, "gnomad_common"),
        (dict(af=0.0009), -1, "None"),
        (dict(is_hotspot=1, is_civic=1), 1, "known_hotspot"),
        (dict(recurrence=10, is_cancer_gene=1), 1, "cosmic_driver"),
        (dict(consequence="nonsense", is_tsg=1), 1, "lof_tsg_driver"),
        (dict(is_civic=1), 1, "civic_clinical"),
        (dict(is_civic=None), -1, "None"),
    ]
    df = spark.createDataFrame([tuple([i, *(base | c).values()]) for i, (c, _, _) in enumerate(cases)], schema)
    out = labels.label_by_evidence(df).orderBy("id").collect()
    assert [(r.label, r.evidence_source) for r in out] == [(a, b) for _, a, b in cases]
    rescue = labels.rescue_reason(spark.createDataFrame([(50, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0)], "recurrence int, is_hotspot int, is_civic int"))
    assert [r.rescue_reason for r in rescue.collect()] == ["COSMIC", "Hotspot", "CIViC", "None"]


def test_keep_best_whatever_the_partitions(spark):
    df = spark.createDataFrame([(1, 5.0, "b"), (1, 5.0, "a"), (1, None, "c"), (2, None, "d")], "k int, s double, t string")
    for n in (1, 7):
        assert rows(dedup.keep_best(df.repartition(n), ["k"], [F.col("s").desc_nulls_last()]), "k") == [(1, 5.0, "a"), (2, None, "d")]


def test_intervals_and_sites(spark):
    df = spark.createDataFrame([(i, "g", p) for i, p in enumerate([9, 10, 70, 71, 12])] + [(9, "h", 10)], "id int, gene string, pos int")
    spans = spark.createDataFrame([("g", 10, 70, 0, "first"), ("g", 11, 20, 1, "second")], "gene string, lo int, hi int, ord int, name string")
    out = enrich.interval_annotate(df, spans, "gene", "pos", "id", "inside", "name")
    assert [(r.inside, r.name) for r in out.orderBy("id").collect()] == [(0, None), (1, "first"), (1, "first"), (0, None), (1, "first"), (0, None)]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    sites = spark.createDataFrame([("g", 8), ("g", 10), ("g", 300)], "gene string, site int")
    near = enrich.nearest_distance(df.union(spark.createDataFrame([(10, "g", 180)], df.schema)), sites, "gene", "pos", "d").orderBy("id").collect()
    assert [r.d for r in near] == [1, 0, 60, 61, 2, 100, 100]


def test_reference_and_crop(spark):
    df = spark.createDataFrame([(p, r) for p, r in [(0, "A"), (1, "A"), (5, "E"), (6, "E"), (2, "X"), (None, "A")]], "pos int, aa string")
    assert [r[0] for r in df.select(S.reference_matches(F.lit("ABCDE"), F.col("pos"), F.col("aa"))).collect()] == [False, True, True, False, False, False]
    text = "".join(chr(65 + i % 26) for i in range(300))
    df = spark.createDataFrame([(text, p) for p in (1, 40, 150, 290, 300)], "s string, pos int").select("s", "pos", S.centred_crop(F.col("s"), F.col("pos"), 100, 250).alias("c"))
    for r in df.collect():
        assert len(r.c.crop) == 100 and r.c.crop[r.c.local_pos - 1] == r.s[r.pos - 1]


def test_columns(spark):
    df = spark.createDataFrame([("U", "x", None), ("U", "y", "U")], "a string, b string, c string")
    assert clean.drop_constant_columns(df, "U").columns == ["b"]
    assert clean.drop_incomplete(df, ["c"]).count() == 2 and clean.drop_incomplete(df).count() == 1
    with pytest.raises(ValueError):
        clean.require_columns(df, ["z"])
