"""Column names that a table does not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spare(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores put in front until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def equal_keys(keys: list[str], others: list[str]) -> Column:
    """Null-safe equality of columns of two tables of different names; without keys always true."""
    on = F.lit(True)
    for a, b in zip(keys, others):
        on = on & F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return on
