"""Readers, structures, pipelines and streams on small files."""

import math
import random

from pyspark.sql import functions as F

from lociflow.operators import dedup
from lociflow.sources import proteins, structures, tables
from lociflow.streaming import slices

RECORDS = """ID   A_HUMAN
AC   P1; P9;
GN   Name=GENE1 {x};
FT   DOMAIN          5..20
FT   ACT_SITE        7
FT   BINDING         ?..9
SQ   SEQUENCE
     MKV LLA
     QQ
//
ID   B_HUMAN
AC   P2;
GN   Name=GENE1;
SQ   SEQUENCE
     MMM
//
"""


def test_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('#chr\tGERP++_RS\n1\t"x\nX\ty\n')
    df = tables.read_table(spark, str(tmp_path / "a.tsv"), {"#chr": "chr", "GERP++_RS": "gerp"}, quoted=False)
    assert [tuple(r) for r in df.collect()] == [("1", '"x'), ("X", "y")]
    pred = spark.createDataFrame([("c", "m", 1, 0.5), ("c", "n", 1, 0.25)], "config string, model string, id int, p double")
    tables.upsert_predictions(pred, str(tmp_path / "p"))
    tables.upsert_predictions(pred.filter("model = 'm'").withColumn("p", F.lit(0.75)), str(tmp_path / "p"))
    assert {(r.model, r.p) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("m", 0.75), ("n", 0.25)}


def test_proteins(spark, tmp_path):
    (tmp_path / "p.dat").write_text(RECORDS)
    df = proteins.parse(proteins.read_records(spark, str(tmp_path / "p.dat"))).cache()
    one = df.filter("accession = 'P1'").first()
    assert (one.entry, one.gene, one.sequence) == ("A_HUMAN", "GENE1", "MKVLLAQQ")
    assert [(f.kind, f.start, f.end) for f in one.features] == [("DOMAIN", 5, 20), ("ACT_SITE", 7, 7)]
    known = spark.createDataFrame([("P1",)], "accession string")
    assert proteins.best_protein(df, known).first().accession == "P1"
    assert proteins.best_protein(df, known.limit(0)).first().accession == "P2"


def atom(serial, res, x, y, z):
    return f"ATOM  {serial:5d}  CA  ALA A{res:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00{50.0:6.2f}"


def test_accessibility(spark, tmp_path):
    lines = [atom(1, 1, 0, 0, 0), atom(2, 2, 50, 0, 0), atom(3, 3, 51.5, 0, 0)]
    (tmp_path / "AF-P1-F1-model_v4.pdb").write_text("\n".join(lines))
    found = {r.res_no: r for r in structures.accessibility(structures.read_atoms(spark, str(tmp_path))).collect()}
    whole = 4 * math.pi * (1.7 + 1.4) ** 2
    assert abs(found[1].sasa - whole) < 0.01 and found[1].plddt == 50.0 and found[1].relative_sasa == round(round(whole, 10) / 121, 4)
    # Two spheres of radius R whose centres are d apart show 2 pi R (R + d / 2) each.
    assert abs(found[2].sasa - 2 * math.pi * 3.1 * (3.1 + 0.75)) < 0.05 * whole
    paths = spark.createDataFrame([("x/AF-P1-F2-model_v4.pdb",), ("x/AF-P1-F1-model_v4.cif",), ("x/AF-P1-F1-model_v4.pdb",), ("x/other.pdb",)], "path string")
    assert [tuple(r) for r in structures.structure_catalog(paths).collect()] == [("P1", "x/AF-P1-F1-model_v4.pdb")]


def test_accessibility_of_crowded_atoms_against_brute_force(spark, monkeypatch):
    """Several blocks a cell, atoms on one spot, two of one serial, a lone one without a serial; what is shuffled has a row an atom, not one a pair."""
    monkeypatch.setattr(structures, "BLOCK", 16)
    rng = random.Random(3)
    atoms = [("S", i, i // 5, "ALA", rng.choice(["CA", "N", "O", "SG", "XX"]), *[round(rng.gauss(0, 7), 3) for _ in "xyz"], 1.0) for i in range(150)]
    atoms += [("S", 200, 40, "GLY", *atoms[0][4:]), ("S", 201, 40, "GLY", *atoms[1][4:]), ("S", 7, 41, "GLY", "CA", 30.0, 0.0, 0.0, 1.0), ("S", None, 42, "GLY", *atoms[0][4:]), ("T", 1, 1, "ALA", *atoms[0][4:])]
    df = spark.createDataFrame(atoms, "accession string, serial int, res_no int, res_name string, atom string, x double, y double, z double, bfactor double")
    for points in (100, 40):
        want, ball = {}, structures.sphere(points)
        for acc, serial, res, _, name, x, y, z, _ in atoms:
            r = structures.RADII.get(name[0], 1.8) + structures.PROBE
            near = [(n[5:8], structures.RADII.get(n[4][0], 1.8) + structures.PROBE) for n in atoms if n[0] == acc and None not in (n[1], serial) and n[1] != serial]
            seen = sum(not any((x + r * p[0] - c[0]) ** 2 + (y + r * p[1] - c[1]) ** 2 + (z + r * p[2] - c[2]) ** 2 < s * s for c, s in near) for p in ball)
            want[acc, res] = want.get((acc, res), 0) + seen * 4 * math.pi / points * r * r
        found = {(r.accession, r.res_no): r.sasa for r in structures.accessibility(df, points=points).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-3 for k in want)
    assert "collect_list(near" not in structures.accessibility(df)._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = slices.file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    slices.append_all(stream, lambda d: d.filter("k > 2"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "out")).count() == df.filter("k > 2").count()
    again = slices.file_stream(spark, str(tmp_path / "in"), df.schema, 2)
    slices.append_all(slices.keep_first(again, ["k"]), lambda d: d.select("k"), str(tmp_path / "first"), str(tmp_path / "state2"))
    assert spark.read.schema("k bigint").parquet(str(tmp_path / "first")).count() == 7


def test_union_by_priority(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "b", 9), (2, "b", 8)], "k int, x string, y int")
    assert [tuple(r) for r in dedup.union_by_priority([a, b], ["k"]).orderBy("k").collect()] == [(1, "a", None), (2, "b", 8)]
