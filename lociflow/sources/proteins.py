"""Protein flat files: one record a row, parsed with text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.ranks import ranked

#: Kinds of feature lines that are kept.
KINDS = ("DOMAIN", "ACT_SITE", "BINDING", "TRANSMEM", "SIGNAL")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(input_seq, record): records end with a line that begins with two slashes; input_seq (path, start, id) sorts them as the files do.

    Lines end in either way; in a record they end with a line feed.
    """
    rows = spark.read.option("lineSep", "\n//").text(path)
    # What follows the slashes on their line stands in front of the next record.
    rows = rows.withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r(?=\n|$)", ""), "^\n", ""))
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    seq = F.struct(*place, F.monotonically_increasing_id().alias("id"))
    return rows.select(seq.alias("input_seq"), F.col("value").alias("record")).filter(F.length(F.trim("record")) > 0)


def parse(records: DataFrame) -> DataFrame:
    """(entry, accession, gene, sequence, input_seq, features); the last gene and first accession of a record count."""
    text = F.col("record")
    lines = F.split(text, "\n")
    kinds = "|".join(KINDS)
    marked = F.filter(lines, lambda x: x.rlike(rf"^FT\s+({kinds})\s+\d"))
    features = F.transform(
        marked,
        lambda x, i: F.struct(
            F.regexp_extract(x, rf"^FT\s+({kinds})\s", 1).alias("kind"),
            F.regexp_extract(x, r"^FT\s+\S+\s+(\d+)", 1).cast("int").alias("start"),
            F.regexp_extract(x, r"^FT\s+\S+\s+(?:\d+\.\.)?(\d+)(?:\D|$)", 1).try_cast("int").alias("end"),
            F.substring(F.trim(F.regexp_extract(x, r'^FT\s+\S+\s+\d+(?:\.\.\d+)?\s*(?:/note=)?"?([^"]*)', 1)), 1, 50).alias("name"),
            i.cast("int").alias("ord"),
        ),
    )
    body = F.filter(lines, lambda x: x.rlike(r"^\s"))
    sequence = F.regexp_replace(F.array_join(body, ""), r"\s", "")
    genes = F.regexp_extract_all(text, F.lit(r"(?m)^GN .*?Name=([^;{\s]+)"), 1)
    return records.select(
        F.regexp_extract(text, r"(?m)^ID\s+(\S+)", 1).alias("entry"),
        F.regexp_extract(text, r"(?m)^AC\s+([^;\s]+)", 1).alias("accession"),
        F.try_element_at(genes, F.lit(-1)).alias("gene"),
        sequence.alias("sequence"),
        "input_seq",
        features.alias("features"),
    )


def feature_rows(proteins: DataFrame) -> DataFrame:
    """(gene, accession, kind, lo, hi, ord, name) for the interval and site joins."""
    return proteins.select("gene", "accession", F.explode("features").alias("f")).select(
        "gene", "accession", "f.kind", F.col("f.start").alias("lo"), F.coalesce("f.end", "f.start").alias("hi"), "f.ord", "f.name"
    )


def best_protein(proteins: DataFrame, structures: DataFrame) -> DataFrame:
    """(gene, accession, sequence): the protein with a structure before those without, then the largest accession."""
    known = structures.select("accession").distinct().withColumn("_s", F.lit(1))
    marked = proteins.filter(F.col("gene").isNotNull()).join(known, "accession", "left")
    best = F.max_by(F.struct("accession", "sequence"), F.struct(F.coalesce("_s", F.lit(0)), F.col("accession")))
    return marked.groupBy("gene").agg(best.alias("b")).select("gene", "b.accession", "b.sequence")


def first_sequence(proteins: DataFrame) -> DataFrame:
    """(gene, sequence) of the first record of each gene that has one."""
    named = proteins.filter(F.col("gene").isNotNull() & (F.length("sequence") > 0))
    return named.groupBy("gene").agg(F.min_by("sequence", "input_seq").alias("sequence"))


def in_order(proteins: DataFrame) -> DataFrame:
    """The input_seq of read_records as numbers from 1; a window holds one split of a file at most."""
    split = F.struct("input_seq.path", "input_seq.start")
    return ranked(proteins, [], split, [F.col("input_seq")], "_place").withColumn("input_seq", F.col("_place")).drop("_place")
