"""Rule-based labelling: consequence classes, clinical flags, evidence labels with their source. Rules are data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.names import spare
from lociflow.functions.scalars import contains_any


@dataclass(frozen=True)
class EvidenceRules:
    """Thresholds, and the evidence by name in the order of precedence; each is a condition over the table's columns."""

    common_af: float = 0.001
    recurrence: int = 10
    rescue_recurrence: int = 50
    path: tuple[tuple[str, str], ...] = field(
        default=(
            ("known_hotspot", "is_hotspot = 1"),
            ("clinvar_pathogenic", "clinvar_path"),
            ("cosmic_driver", "recurrence >= {recurrence} AND is_cancer_gene = 1"),
            ("lof_tsg_driver", "consequence IN ('nonsense', 'frameshift') AND is_tsg = 1"),
            ("civic_clinical", "is_civic = 1"),
        )
    )
    benign: tuple[tuple[str, str], ...] = field(default=(("gnomad_common", "af >= {common_af}D"), ("clinvar_benign", "clinvar_benign")))

    def conditions(self, which: str) -> list[tuple[str, Column]]:
        values = {"recurrence": self.recurrence, "common_af": self.common_af}
        return [(n, F.coalesce(F.expr(c.format(**values)), F.lit(False))) for n, c in getattr(self, which)]


def consequence(ref: Column, alt: Column, hgvsp: Column) -> Column:
    """synonymous before frameshift before nonsense before missense."""
    nonsense = F.coalesce(alt.isin("*", "X"), F.lit(False)) | F.coalesce(hgvsp.rlike(r"Ter|\*"), F.lit(False))
    return (
        F.when(F.coalesce(ref == alt, F.lit(False)), "synonymous").when(contains_any(hgvsp, "fs"), "frameshift").when(nonsense, "nonsense").otherwise("missense")
    )


def clinical_flags(df: DataFrame, column: str) -> DataFrame:
    """clinvar_path and clinvar_benign; `conflict` excludes both, and both can hold."""
    clear = ~contains_any(F.col(column), "conflict")
    return df.withColumns({"clinvar_path": clear & contains_any(F.col(column), "pathogenic"), "clinvar_benign": clear & contains_any(F.col(column), "benign")})


def label_by_evidence(df: DataFrame, rules: EvidenceRules = EvidenceRules()) -> DataFrame:
    """label 1, 0 or -1, and the evidence source that won (first match)."""
    path, benign = spare(df, "_path", "_benign")
    df = df.withColumns({path: _first(rules.conditions("path")), benign: _first(rules.conditions("benign"))})
    common = F.coalesce(F.col("af") >= F.lit(rules.common_af), F.lit(False))
    label = F.when(F.col(path).isNotNull() & ~common, 1).when(F.col(benign).isNotNull() & F.col(path).isNull(), 0).otherwise(-1)
    source = F.when(F.col("label") == 1, F.col(path)).when(F.col("label") == 0, F.col(benign)).otherwise("None")
    return df.withColumn("label", label).withColumn("evidence_source", source).drop(path, benign)


def _first(conditions: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, or NULL; each is looked at once."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in conditions], F.lit(None).cast("string"))


def rescue_reason(df: DataFrame, rules: EvidenceRules = EvidenceRules()) -> DataFrame:
    """Recurrent mutation before hotspot before clinical evidence."""
    reason = F.when(F.col("recurrence") >= rules.rescue_recurrence, "COSMIC").when(F.col("is_hotspot") == 1, "Hotspot").when(F.col("is_civic") == 1, "CIViC")
    return df.withColumn("rescue_reason", reason.otherwise("None")).withColumn("is_rescue", (F.col("rescue_reason") != "None").cast("int"))


def hotspot_flag(df: DataFrame, hotspots: dict[str, list[int]], gene: str, pos: str, name: str = "is_hotspot") -> DataFrame:
    """1 where (gene, position) is in the literal table: a map look-up, so no join."""
    if not hotspots:
        return df.withColumn(name, F.lit(0))
    table = F.create_map(*[x for g, ps in hotspots.items() for x in (F.lit(g), F.array(*[F.lit(int(p)) for p in ps]))])
    hit = F.array_contains(F.try_element_at(table, F.col(gene)), F.col(pos).cast("int"))
    return df.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int"))


def median_split(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """1 at or below the exact median. The median is one row."""
    from lociflow.operators.ranks import exact_quantiles

    middle = exact_quantiles(df, column, [0.5])[0]
    return df.withColumn(name, F.when(F.col(column) <= F.lit(middle), 1).otherwise(0))


def labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") != -1)
