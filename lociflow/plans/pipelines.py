"""The three flows: raw annotations to a model table, an external set, training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.arrays import explode_packed
from lociflow.functions.scalars import centred_crop, consensus_score, guarded_ratio, to_number
from lociflow.operators import clean, dedup, enrich, labels, metrics, models, sampling
from lociflow.sources import proteins as P
from lociflow.sources import structures as S

VARIANT = ["chr", "pos", "ref", "alt"]
#: Columns that would leak the label, and identifiers.
LEAKAGE = ["evidence_source", "rescue_reason", "is_rescue", "clinvar_path", "clinvar_benign", "clinvar_clnsig", "is_hotspot", "recurrence"]


def label_annotations(annotation: DataFrame, packed: list[str], numbers: list[str], dims: dict, rules: labels.EvidenceRules = labels.EvidenceRules()) -> DataFrame:
    """Explode, clean, join the evidence tables, label, keep what has a label.

    `numbers` are scores and frequencies, cleaned and held to their range; the counts ac and an are only parsed.
    dims: gene_sets {flag: table of genename}, recurrence (genename, aapos, sampled, tested), hotspots {gene: positions}.
    """
    df = clean.numeric(explode_packed(annotation, packed), numbers)
    df = df.withColumn("af", F.coalesce(guarded_ratio(to_number(F.col("ac")), to_number(F.col("an"))), F.col("joint_af")))
    df = df.withColumn("aapos", F.col("aapos").try_cast("int"))
    df = enrich.membership_flags(df, "genename", dims["gene_sets"])
    counts = enrich.recurrence(dims["recurrence"], ["genename", "aapos"], "sampled", "tested")
    counts = counts.select("genename", "aapos", F.col("sampled").alias("recurrence"))
    df = enrich.join_dimension(df, counts, ["genename", "aapos"], {"recurrence": 0})
    df = labels.hotspot_flag(df, dims["hotspots"], "genename", "aapos")
    df = labels.clinical_flags(df, "clinvar_clnsig")
    df = df.withColumn("consequence", labels.consequence(F.col("aaref"), F.col("aaalt"), F.col("hgvsp")))
    df = df.withColumn("consensus", consensus_score(F.col("revel"), F.col("sift"), F.col("polyphen")))
    return labels.labelled(labels.rescue_reason(labels.label_by_evidence(df, rules), rules))


def model_table(labelled: DataFrame, exempt: list[str]) -> DataFrame:
    """Complete rows, the best of each variant."""
    return dedup.keep_best(clean.drop_incomplete(labelled, exempt), VARIANT, [F.col("consensus").desc_nulls_last()])


def annotate_positions(df: DataFrame, proteins: DataFrame, residues: DataFrame, row_id: str, gene: str = "genename", pos: str = "aapos") -> DataFrame:
    """Domain, membrane, active and binding sites, and structure features of each protein position."""
    best = P.best_protein(proteins, residues).withColumnRenamed("gene", gene)
    features = P.feature_rows(proteins).withColumnRenamed("gene", gene).join(best.select(gene, "accession"), [gene, "accession"], "left_semi")
    sites = features.filter("kind IN ('ACT_SITE', 'BINDING')").select(gene, "kind", F.col("lo").alias("site"))
    df = enrich.interval_annotate(df, features.filter("kind = 'DOMAIN'"), gene, pos, row_id, "is_in_domain", "domain_name")
    df = enrich.interval_annotate(df, features.filter("kind = 'TRANSMEM'"), gene, pos, row_id, "is_transmembrane", "_tm").drop("_tm")
    df = enrich.site_flag(df, sites.filter("kind = 'ACT_SITE'"), gene, pos, "is_active_site")
    df = enrich.site_flag(df, sites.filter("kind = 'BINDING'"), gene, pos, "is_binding_site")
    df = enrich.nearest_distance(df, sites.filter("kind = 'ACT_SITE'"), gene, pos, "distance_to_active_site")
    placed = df.join(best.select(gene, "accession"), gene, "left")
    return S.join_residues(placed, residues.withColumnRenamed("res_no", pos), ["accession", pos])


def finish(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Without leaking and constant columns and structure-less rows, classes balanced."""
    df = clean.drop_sentinel(clean.drop_constant_columns(clean.drop_columns(df, LEAKAGE), "U"), "sasa")
    return sampling.balance(df, label, row_id)


def attach_sequences(df: DataFrame, proteins: DataFrame, gene: str = "genename") -> DataFrame:
    """The gene's first sequence, rows whose reference residue agrees, and the crop around it."""
    named = df.withColumnsRenamed({"aapos": "aa_pos", "aaref": "aa_ref", "aaalt": "aa_alt"})
    sequences = P.first_sequence(proteins).select(F.col("gene").alias(gene), F.col("sequence").alias("protein_sequence"))
    checked = clean.check_reference(named.join(sequences, gene))
    crop = centred_crop(F.col("protein_sequence"), F.col("aa_pos"))
    return checked.withColumn("_c", crop).withColumns({"crop": F.col("_c.crop"), "local_pos": F.col("_c.local_pos")}).drop("_c")


def external_set(annotation: DataFrame, clinical: DataFrame, scan: DataFrame) -> DataFrame:
    """Variants with a clinical label or a scan score, the clinical source first.

    clinical: (chr, pos, ref, alt, significance); scan: (genename, aapos, aaref, aaalt, dms_score).
    """
    flags = labels.clinical_flags(clinical, "significance").filter("clinvar_path <> clinvar_benign")
    one = annotation.join(flags.select(*VARIANT, F.col("clinvar_path").cast("int").alias("label")), VARIANT)
    change = ["genename", "aapos", "aaref", "aaalt"]
    two = annotation.join(labels.median_split(scan, "dms_score").select(*change, "label"), change)
    return dedup.union_by_priority([dedup.keep_best(one, VARIANT, []), dedup.keep_best(two, VARIANT, [])], VARIANT)


def train_and_evaluate(df: DataFrame, key: str, group: str, label: str, features: list[str], k: int = 5, **params) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and their metrics at the threshold chosen on them."""
    pred = models.oof_predict(df, key, group, label, features, k, **params)
    return pred, metrics.evaluate(pred, metrics.select_threshold(pred))
