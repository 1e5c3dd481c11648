"""Packed fields: split, paired explode with padding, cross explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.scalars import null_token


def unpack(c: Column, sep: str = ";") -> Column:
    """Elements of packed text with null tokens as NULL; NULL text has one NULL element."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), sep, -1), lambda x: null_token(x))


def explode_packed(df: DataFrame, columns: list[str], mode: str = "paired", sep: str = ";") -> DataFrame:
    """One row for each element of the packed columns.

    paired: the columns go in step, shorter ones are padded with NULL. cross: one column after another, all
    combinations. Either way the rule is each row's own, whatever rows stand beside it.
    """
    if mode == "cross":
        for c in columns:
            df = df.withColumn(c, F.explode(unpack(F.col(c), sep)))
        return df
    rest = [c for c in df.columns if c not in columns]
    zipped = F.arrays_zip(*[unpack(F.col(c), sep).alias(c) for c in columns])
    out = df.select(*rest, F.explode(zipped).alias("_z"))
    return out.select(*[F.col(f"_z.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
