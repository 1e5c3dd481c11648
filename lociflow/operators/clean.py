"""Projection, cleaning and row predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.functions import scalars as S


def require_columns(df: DataFrame, columns: list[str], soft: bool = False) -> bool:
    missing = [c for c in columns if c not in df.columns]
    if missing and not soft:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return not missing


def resolve_column(df: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """The first of the candidate headers that is there, under `name`."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, name)
    raise ValueError(f"none of the columns {', '.join(candidates)} is there")


def null_tokens(df: DataFrame, columns: list[str], tokens=S.NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: S.null_token(F.col(c), tokens) for c in columns})


def numeric(df: DataFrame, columns: list[str], hi: float = 100.0, sentinel: float = -1.0) -> DataFrame:
    """Dirty text to float: null tokens, parsing, range."""
    return df.withColumns({c: S.sanitize(S.to_number(S.null_token(F.col(c), S.NUMERIC_NULL_TOKENS)), hi, sentinel).cast("float") for c in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def drop_incomplete(df: DataFrame, exempt: list[str] = ()) -> DataFrame:
    """Rows without a NULL in any column that isn't exempt."""
    return df.na.drop("any", subset=[c for c in df.columns if c not in exempt])


def drop_columns(df: DataFrame, *groups: list[str]) -> DataFrame:
    return df.drop(*[c for g in groups for c in g])


def drop_constant_columns(df: DataFrame, value: str) -> DataFrame:
    """Without the text columns whose only value is `value`; one aggregate over all of them."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    row = df.agg(*[x for i, c in enumerate(names) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    return df.drop(*[c for i, c in enumerate(names) if row[f"lo{i}"] == row[f"hi{i}"] == value])


def drop_sentinel(df: DataFrame, column: str, sentinel=-1) -> DataFrame:
    return df.filter(F.col(column).isNull() | (F.col(column) != sentinel))


def select_features(df: DataFrame, exclude: list[str] = (), prefixes: tuple[str, ...] = ("emb_",)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude and not f.name.startswith(prefixes)]


def align_features(train: DataFrame, other: DataFrame, features: list[str]) -> DataFrame:
    """`other` cut to the features of `train`; raises if one is missing."""
    require_columns(train, features)
    require_columns(other, features)
    return other.select(*features)


def check_classes(df: DataFrame, label: str) -> None:
    if df.select(label).na.drop().distinct().limit(2).count() < 2:
        raise ValueError("only one class")


def floats(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def check_reference(df: DataFrame, sequence: str = "protein_sequence", pos: str = "aa_pos", residue: str = "aa_ref") -> DataFrame:
    return df.filter(S.reference_matches(F.col(sequence), F.col(pos), F.col(residue)))


def valid_embeddings(df: DataFrame, score: str, embedding: str) -> DataFrame:
    return df.filter(S.finite(F.col(score)) & S.any_nonzero(F.col(embedding)))


def is_disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key), key, "left_semi").isEmpty()


def audit(df: DataFrame, name: str, **conditions) -> tuple[DataFrame, object]:
    """df unchanged and an observation of its rows, and of the rows that meet each condition, filled by the next action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]]
    return df.observe(seen, *counts), seen
