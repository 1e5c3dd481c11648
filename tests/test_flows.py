"""The flows from raw annotations to metrics, external validation and search on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lociflow.operators import enrich, models
from lociflow.plans import pipelines
from lociflow.sources import proteins
from lociflow.streaming import slices

ANNOTATION = "chr string, pos int, ref string, alt string, genename string, aapos string, aaref string, aaalt string, hgvsp string, ac string, an string, joint_af double, clinvar_clnsig string, revel string, sift string, polyphen string"
PACKED, NUMBERS = ["genename", "aapos", "hgvsp"], ["revel", "sift", "polyphen"]


def dims(spark):
    keys = lambda *genes: spark.createDataFrame([(g,) for g in genes], "genename string")
    counts = spark.createDataFrame([("KIN", 7, 6, 100), ("KIN", 7, 5, 90), (None, 7, 99, 1)], "genename string, aapos int, sampled int, tested int")
    return {"gene_sets": {"is_cancer_gene": keys("KIN"), "is_tsg": keys("SUP"), "is_civic": keys()}, "recurrence": counts, "hotspots": {"HOT": [12]}}


def annotation(spark):
    return spark.createDataFrame(
        [
            ("1", 1, "A", "C", "HOT;HOT2", "12;3", "G", "D", "p.Gly12Asp", "1", "100000", None, None, "0.9", "0.0", "1.0"),
            ("1", 2, "A", "C", "KIN", "7", "V", "E", ".", "0", "100000", None, ".", ".", ".", "."),
            ("1", 3, "A", "C", "SUP", "9", "R", "X", "p.Arg9Ter", "1", "100000", None, "Conflicting_pathogenic", ".", ".", "."),
            ("1", 4, "A", "C", "OTH", "4", "L", "P", ".", "5", "1000", None, "Benign", "0.1", "1.0", "0.0"),
            ("1", 5, "A", "C", "OTH", "5", "L", "P", ".", "1", "0", 0.5, ".", ".", ".", "."),
            ("1", 6, "A", "C", "OTH", "6", "L", "P", ".", ".", ".", None, ".", ".", ".", "."),
            ("1", 7, "A", "C", "OTH", "8", "L", "P", ".", "1", "100000", None, "Pathogenic", "0.8", ".", "."),
        ],
        ANNOTATION,
    )


def test_label_annotations(spark):
    rows = pipelines.label_annotations(annotation(spark), PACKED, NUMBERS, dims(spark)).collect()
    found = {(r.pos, r.genename): (r.label, r.evidence_source) for r in rows}
    assert found == {
        (1, "HOT"): (1, "known_hotspot"),
        (2, "KIN"): (1, "cosmic_driver"),  # 6 + 5 samples
        (3, "SUP"): (1, "lof_tsg_driver"),
        (4, "OTH"): (0, "gnomad_common"),
        (5, "OTH"): (0, "gnomad_common"),  # no denominator, so the joint frequency
        (7, "OTH"): (1, "clinvar_pathogenic"),
    }
    hot = next(r for r in rows if r.pos == 1)
    assert (hot.is_hotspot, hot.rescue_reason, hot.is_rescue) == (1, "Hotspot", 1) and abs(hot.consensus - 0.94) < 1e-6  # scores are floats
    assert abs(next(r for r in rows if r.pos == 7).consensus - (0.48 + 0.1 + 0.1)) < 1e-6  # scores are floats
    table = pipelines.model_table(spark.createDataFrame(rows + rows, pipelines.label_annotations(annotation(spark), PACKED, NUMBERS, dims(spark)).schema), ["hgvsp", "joint_af", "clinvar_clnsig", "revel", "sift", "polyphen", "af"])
    assert sorted(r.pos for r in table.collect()) == [1, 2, 3, 4, 5, 7]


def protein_table(spark):
    return spark.createDataFrame(
        [
            ("P1", "G", "M" + "A" * 9, ("f", 0, 2), [("DOMAIN", 2, 5, "one", 0), ("DOMAIN", 4, 8, "two", 1), ("ACT_SITE", 7, None, "", 2), ("TRANSMEM", 9, 10, "", 3)]),
            ("P2", "G", "MKKK", ("f", 0, 1), [("DOMAIN", 1, 10, "other", 0)]),
        ],
        "accession string, gene string, sequence string, input_seq struct<path: string, start: bigint, id: bigint>, features array<struct<kind: string, start: int, end: int, name: string, ord: int>>",
    )


def test_annotate_positions_and_sequences(spark):
    residues = spark.createDataFrame([("P1", 7, 10.0, 0.1, 90.0)], "accession string, res_no int, sasa double, relative_sasa double, plddt double")
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate([("G", 4), ("G", 7), ("G", 10), ("H", 4), ("G", None)])], "id int, genename string, aapos int")
    out = {r.id: r for r in pipelines.annotate_positions(df, protein_table(spark), residues, "id").collect()}
    assert len(out) == 5
    assert [(out[i].is_in_domain, out[i].domain_name, out[i].is_transmembrane, out[i].is_active_site, out[i].distance_to_active_site) for i in range(5)] == [
        (1, "one", 0, 0, 3),
        (1, "two", 0, 1, 0),
        (0, None, 1, 0, 3),
        (0, None, 0, 0, 100),
        (0, None, 0, 0, 100),
    ]
    assert [out[i].sasa for i in range(5)] == [-1.0, 10.0, -1.0, -1.0, -1.0]
    named = spark.createDataFrame([("G", 1, "M", "V"), ("G", 2, "K", "V"), ("G", 2, "A", "V"), ("G", 9, "K", "V")], "genename string, aapos int, aaref string, aaalt string")
    kept = pipelines.attach_sequences(named, protein_table(spark)).collect()  # P2 comes first in the file
    assert sorted((r.aa_pos, r.aa_ref, r.crop, r.local_pos) for r in kept) == [(1, "M", "MKKK", 1), (2, "K", "MKKK", 2)]


def test_records_in_file_order(spark, tmp_path):
    record = "ID   R{0}_X\nAC   A{0};\nGN   Name=G{1};\nSQ   S\n     {2}\n//\n"
    (tmp_path / "a.dat").write_text("".join(record.format(i, i % 7, "M" * (i + 1)) for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")  # many splits
    try:
        df = proteins.parse(proteins.read_records(spark, str(tmp_path / "a.dat")))
        assert df.rdd.getNumPartitions() > 3
        places = {r.accession: r.input_seq for r in proteins.in_order(df).collect()}
        first = {r.gene: r.sequence for r in proteins.first_sequence(df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert places == {f"A{i}": i + 1 for i in range(200)}
    assert first == {f"G{g}": "M" * (g + 1) for g in range(7)}


@pytest.mark.parametrize("none,most", [(999, 100), (999, 10), (5, 10)])
def test_nearest_distance_against_brute_force(spark, none, most):
    sites = [("a", s) for s in (1, 2, 40, 41, 500)] + [("b", -3), ("c", None)]
    rows = [(i, k, p) for i, (k, p) in enumerate((k, p) for k in ("a", "b", "c", "d", None) for p in (-20, 0, 3, 19, 21, 45, 490, 9999, None))]
    df, table = spark.createDataFrame(rows, "id int, k string, p int"), spark.createDataFrame(sites, "k string, site int")
    got = {r.id: r.d for r in enrich.nearest_distance(df, table, "k", "p", "d", none, most).collect()}
    for i, k, p in rows:
        own = [abs(s - p) for x, s in sites if x == k and s is not None and p is not None]
        assert got[i] == max(0, min(most, min(own, default=none))), (k, p)


def test_external_set(spark):
    rows = annotation(spark).select("chr", "pos", "ref", "alt", "genename", F.col("aapos").try_cast("int").alias("aapos"), "aaref", "aaalt")
    clinical = spark.createDataFrame([("1", 2, "A", "C", "Benign"), ("1", 4, "A", "C", "Pathogenic"), ("1", 5, "A", "C", "Conflicting")], "chr string, pos int, ref string, alt string, significance string")
    scan = spark.createDataFrame([("OTH", 4, "L", "P", 5.0), ("OTH", 5, "L", "P", -1.0), ("OTH", 6, "L", "P", 3.0)], "genename string, aapos int, aaref string, aaalt string, dms_score double")
    found = {r.pos: r.label for r in pipelines.external_set(rows, clinical, scan).collect()}
    assert found == {2: 0, 4: 1, 5: 1, 6: 1}  # 4 by its clinical label; the scan's median is 3


def model_rows(spark, n=240, shift=0):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    df = spark.range(n).withColumn("id", F.col("id") + shift).withColumn("g", F.concat(F.lit("g"), (F.col("id") % 24).cast("string")))
    return df.withColumn("y", (h > 0.5).cast("int")).withColumn("x", h).withColumn("z", F.when(F.col("id") % 5 > 0, F.sin("id")))


SMALL = {"maxIter": 3, "minInstancesPerNode": 2}


def test_train_evaluate_and_external(spark):
    df = model_rows(spark)
    pred, result = pipelines.train_and_evaluate(df, "id", "g", "y", ["x", "z"], k=2, **SMALL)
    assert pred.count() == pred.select("id").distinct().count() == 240
    assert result.first().auroc > 0.95 and result.first().mcc > 0.9
    outside = model_rows(spark, 120, 1000).withColumn("g", F.concat(F.lit("o"), F.col("g")))
    overlap = model_rows(spark, 24)  # groups of the training set: left out
    metrics = models.validate_external(df, outside.unionByName(overlap), "id", "g", "y", ["x", "z"], **SMALL).first()
    assert metrics.tp + metrics.fp + metrics.fn + metrics.tn == 120 and metrics.mcc > 0.9
    with pytest.raises(ValueError):
        models.validate_external(df, outside.filter("y = 1"), "id", "g", "y", ["x", "z"], **SMALL)
    with pytest.raises(ValueError):
        models.validate_external(df, outside.drop("z"), "id", "g", "y", ["x", "z"], **SMALL)


def test_search_and_confirm(spark):
    df = model_rows(spark, 120)
    space = {"maxDepth": [1, 2]}
    history = models.search(df, space, 2, "id", "g", "y", ["x"], k=2, **SMALL)
    rows = history.collect()
    assert [r.trial for r in rows] == [0, 1] and all(json.loads(r.params)["maxDepth"] in (1, 2) for r in rows)
    for r in rows:
        assert abs(r.objective - (0.5 * r.mcc + 0.25 * r.auroc + 0.15 * r.auprc - 0.1 * r.brier)) < 1e-9
    confirmed = {r.setting: r for r in models.confirm(df, history, "id", "g", "y", ["x"], k=2, **SMALL).collect()}
    assert set(confirmed) == {"best", "default"} and confirmed["best"].mcc > 0.8


def test_counts_keep_the_last_whole_batch(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 3).alias("k"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = slices.file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    slices.running_counts(stream, ["k"], str(tmp_path / "out"), str(tmp_path / "state"))
    (tmp_path / "out" / "000000000099").mkdir()  # a batch that never ended
    assert sorted(tuple(r) for r in slices.latest(spark, str(tmp_path / "out")).collect()) == [(0, 20), (1, 20), (2, 20)]
    assert len([p for p in (tmp_path / "out").iterdir() if (p / "_SUCCESS").exists()]) == 2
    with pytest.raises(FileNotFoundError):
        slices.latest(spark, str(tmp_path / "none"))
