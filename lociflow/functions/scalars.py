"""Column functions: cleaning, ratios, scores, text and sequence helpers. Missing is NULL; NaN never leaves the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean missing.
NULL_TOKENS = (".", "nan", "")
NUMERIC_NULL_TOKENS = (".", "..", "", "NA", "nan")
#: Largest solvent-accessible area of each residue, in square angstrom; 200 for anything else.
MAX_SASA = {
    "ALA": 121, "ARG": 265, "ASN": 187, "ASP": 187, "CYS": 148, "GLN": 214, "GLU": 214, "GLY": 97, "HIS": 216, "ILE": 195,
    "LEU": 191, "LYS": 230, "MET": 203, "PHE": 228, "PRO": 154, "SER": 143, "THR": 163, "TRP": 264, "TYR": 255, "VAL": 165,
}
DEFAULT_SASA = 200
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def null_token(c: Column, tokens=NULL_TOKENS) -> Column:
    return F.when(F.trim(c).isin(*tokens), None).otherwise(F.trim(c))


def to_number(c: Column) -> Column:
    """Double, or NULL for anything that isn't a plain decimal number (no suffixes, no inf)."""
    text = F.trim(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def sanitize(c: Column, hi: float = 100.0, sentinel: float = -1.0) -> Column:
    """Values over `hi`, NaN and the sentinel become NULL."""
    return F.when(~F.isnan(c) & (c <= hi) & (c != sentinel), c)


def guarded_ratio(numerator: Column, denominator: Column, fallback: Column | None = None) -> Column:
    ratio = F.when(denominator > 0, numerator / denominator)
    return ratio if fallback is None else F.coalesce(ratio, fallback)


def consensus_score(revel: Column, sift: Column, polyphen: Column) -> Column:
    """0.6 revel + 0.2 (1 - sift) + 0.2 polyphen, 0.5 for what is missing."""
    half = F.lit(0.5)
    return 0.6 * F.coalesce(revel, half) + 0.2 * (1 - F.coalesce(sift, half)) + 0.2 * F.coalesce(polyphen, half)


def contains_any(c: Column, *parts: str) -> Column:
    """Case-insensitive; NULL text contains nothing."""
    low = F.lower(c)
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(low, F.lit(p.lower()))
    return F.coalesce(found, F.lit(False))


def reference_matches(sequence: Column, pos: Column, residue: Column) -> Column:
    """Whether residue number pos (from 1) of the sequence is `residue`; false out of bounds or for NULL."""
    inside = (pos >= 1) & (pos <= F.length(sequence))
    return F.coalesce(F.when(inside, F.substring(sequence, pos, F.lit(1)) == residue), F.lit(False))


def centred_crop(sequence: Column, pos: Column, window: int = 1022, least: int = 2500) -> Column:
    """struct(crop, local_pos): a window around pos for sequences longer than `least`, the whole one else."""
    length = F.length(sequence)
    start = F.greatest(F.lit(0), pos - 1 - window // 2)
    end = F.least(length, start + window)
    start = F.when(end == length, F.greatest(F.lit(0), end - window)).otherwise(start)
    long = length > least
    crop = F.when(long, F.substring(sequence, start + 1, end - start)).otherwise(sequence)
    return F.struct(crop.alias("crop"), F.when(long, pos - start).otherwise(pos).alias("local_pos"))


def sigmoid(z: Column, temperature: float | Column = 1.0) -> Column:
    return 1 / (1 + F.exp(-z / temperature))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def any_nonzero(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def max_sasa(residue: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MAX_SASA.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(residue)), F.lit(DEFAULT_SASA))


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def short_text(c: Column, n: int = 50) -> Column:
    return F.substring(c, 1, n)
