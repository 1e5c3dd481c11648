"""Structure files: catalogue by name, atoms by column, accessible surface by a grid join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.scalars import max_sasa

_NAME = r"AF-([^-/]+)-(F\d+)-model_v(\d+)\.(pdb|cif)(?:\.gz)?$"
#: Van der Waals radii in angstrom by element, others 1.8; probe radius.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "H": 1.2, "P": 1.8}
PROBE, POINTS = 1.4, 100
#: Atoms that a block has on average, at most.
BLOCK = 256


def structure_catalog(paths: DataFrame, column: str = "path") -> DataFrame:
    """(accession, path): text files before others, first fragment before others, then the lower fragment."""
    p = F.col(column)
    named = paths.select(p.alias("path"), *[F.regexp_extract(p, _NAME, i).alias(n) for i, n in enumerate(("accession", "fragment", "version", "kind"), 1)])
    named = named.filter(F.col("accession") != "")
    number = F.substring("fragment", 2, 9).cast("int")
    order = F.struct((F.col("kind") == "pdb"), (F.col("fragment") == "F1"), -number, F.col("version").cast("int"), F.col("path"))
    return named.groupBy("accession").agg(F.max_by("path", order).alias("path"))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(accession, serial, res_no, res_name, atom, x, y, z, bfactor) of ATOM lines, by their fixed columns."""
    rows = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", _NAME, 1).alias("accession"), "value").filter(F.col("value").startswith("ATOM"))
    cut: Column = lambda a, n, kind: F.trim(F.substring("value", a, n)).try_cast(kind)
    return rows.select(
        "accession",
        cut(7, 5, "int").alias("serial"),
        cut(23, 4, "int").alias("res_no"),
        cut(18, 3, "string").alias("res_name"),
        cut(13, 4, "string").alias("atom"),
        cut(31, 8, "double").alias("x"),
        cut(39, 8, "double").alias("y"),
        cut(47, 8, "double").alias("z"),
        cut(61, 6, "double").alias("bfactor"),
    )


def neighbours(points: DataFrame, group: str, key: str, radius: float, carried: list[str] = []) -> DataFrame:
    """(group, key, other, distance) of points of a group at most `radius` apart, and `near`: the other point's x, y, z and carried columns, if any are.

    Points go to cells as wide as the radius; each looks into the 27 cells around, so the join is an equi-join
    on group and cell.
    """
    cell = [F.floor(F.col(c) / radius) for c in "xyz"]
    own = points.select(group, key, "x", "y", "z", *carried, *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    step = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    looking = own.withColumn("s", F.explode(step)).select(
        F.col(group).alias("_g"), F.col(key).alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *([F.struct("x", "y", "z", *carried).alias("near")] if carried else []), *[(F.col(f"c{i}") + F.col(f"s.{n}")).alias(f"d{i}") for i, n in enumerate("ijk")]
    )
    at = (F.col(group) == F.col("_g")) & (F.col("c0") == F.col("d0")) & (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col(key) != F.col("other"))
    apart = F.sqrt(sum((F.pow(F.col(c) - F.col(f"o{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return own.join(looking, at).withColumn("distance", apart).filter(F.col("distance") <= radius).select(group, key, "other", "distance", *(["near"] if carried else []))


def sphere(n: int) -> list[tuple[float, float, float]]:
    """n points spread over the unit sphere along a golden spiral."""
    golden = math.pi * (3 - math.sqrt(5))
    rows = []
    for i in range(n):
        z = 1 - 2 * (i + 0.5) / n
        r = math.sqrt(1 - z * z)
        rows.append((r * math.cos(golden * i), r * math.sin(golden * i), z))
    return rows


def accessibility(atoms: DataFrame, probe: float = PROBE, points: int = POINTS) -> DataFrame:
    """(accession, res_no, res_name, sasa, relative_sasa, plddt): rolling-probe surface (Shrake and Rupley 1973).

    An atom's share is 4 pi R^2 / n for each point of its sphere that no neighbour's sphere covers. Which points are covered is a row of bits by
    atom, combined by OR where blocks of atoms meet, so what is shuffled grows with the atoms and not with the pairs of neighbours.
    """
    table = F.create_map(*[F.lit(v) for pair in RADII.items() for v in pair])
    reach = F.coalesce(F.try_element_at(table, F.substring("atom", 1, 1)), F.lit(1.8)) + probe
    own = atoms.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("r", reach)
    widest, key = 2 * (max(RADII.values()) + probe), ["accession", "serial", "x", "y", "z", "r"]
    met = meeting_blocks(own.filter("accession IS NOT NULL AND serial IS NOT NULL"), widest)
    words = [f"w{i}" for i in range(-(-points // 64))]
    kind = own.schema["serial"].dataType.simpleString()
    bits = met.mapInArrow(_covered(sphere(points)), f"accession string, serial {kind}, x double, y double, z double, r double, " + ", ".join(f"{w} bigint" for w in words))
    covered = bits.groupBy(*key).agg(*[F.bit_or(w).alias(w) for w in words])
    joined = own.join(covered, key, "left")
    n_open = F.lit(points) - sum((F.coalesce(F.bit_count(w), F.lit(0)) for w in words), F.lit(0))
    area = n_open * (4 * math.pi / points) * F.col("r") * F.col("r")
    residues = joined.withColumn("area", area).groupBy("accession", "res_no").agg(
        F.min_by("res_name", "serial").alias("res_name"), F.sum("area").alias("sasa"), F.min_by("bfactor", "serial").alias("plddt")
    )
    relative = F.when(F.col("sasa") > 0, F.round(F.col("sasa") / max_sasa(F.col("res_name")), 4)).otherwise(F.lit(-1.0))
    return residues.select("accession", "res_no", "res_name", F.round("sasa", 4).alias("sasa"), relative.alias("relative_sasa"), "plddt")


def meeting_blocks(own: DataFrame, radius: float) -> DataFrame:
    """(accession, mine, others): blocks of some BLOCK atoms of a cell as wide as `radius`, each with every block of the 27 cells around it.

    A block is a list of (serial, x, y, z, r). A cell has as many blocks as its atoms need, and atoms go to them by hash.
    """
    cell = ["c0", "c1", "c2"]
    placed = own.select("accession", "serial", "x", "y", "z", "r", *[F.floor(F.col(c) / radius).alias(n) for c, n in zip("xyz", cell)])
    counts = placed.groupBy("accession", *cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = placed.join(counts, ["accession", *cell]).withColumn("block", F.pmod(F.xxhash64("serial", "x", "y", "z"), F.col("blocks")))
    blocks = dealt.groupBy("accession", *cell, "block").agg(F.collect_list(F.struct("serial", "x", "y", "z", "r")).alias("mine"))
    steps = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    looking = blocks.select("accession", *cell, F.col("mine").alias("others"))
    for n in cell:
        looking = looking.withColumn("s", F.explode(steps)).withColumn(n, F.col(n) + F.col("s")).drop("s")
    # Blocks around are 27 times the atoms, whatever Spark estimates, so never broadcast.
    return blocks.join(looking.hint("merge"), ["accession", *cell]).select("accession", "mine", "others")


def _covered(ball: list[tuple[float, float, float]]):
    """Rows of `meeting_blocks` to (accession, serial, x, y, z, r, words): the points of mine that a sphere of another atom covers, as bits.

    A point u of a unit sphere is covered if 2 r d.u < s^2 - r^2 - d.d, where d is the way from the other centre, of radius s; where both
    sides are nearly equal the distance itself is compared, in the order of terms that the query's SQL has.
    """
    import numpy as np
    import pyarrow as pa

    unit = np.array(ball)
    n_words = -(-len(ball) // 64)

    def bits(mine: np.ndarray, others: np.ndarray, same: np.ndarray) -> np.ndarray:
        out = np.zeros((len(mine), n_words), np.int64)
        apart = sum((mine[:, None, c] - others[None, :, c]) ** 2 for c in range(3))
        i, j = np.nonzero((apart < (mine[:, None, 3] + others[None, :, 3]) ** 2 * 1.000001) & ~same)
        for at in range(0, len(i), 4096):
            a, b = mine[i[at : at + 4096]], others[j[at : at + 4096]]
            d, r, s = a[:, :3] - b[:, :3], a[:, 3], b[:, 3]
            slack = (s * s - r * r - (d * d).sum(1))[:, None] - (2 * r[:, None] * d) @ unit.T
            hit = slack > 0
            p, q = np.nonzero(np.abs(slack) < 1e-6)
            if len(p):
                t = [(a[p, c] + r[p] * unit[q, c]) - b[p, c] for c in range(3)]
                hit[p, q] = t[0] * t[0] + t[1] * t[1] + t[2] * t[2] < s[p] * s[p]
            packed = np.zeros((len(a), 8 * n_words), np.uint8)
            packed[:, : -(-len(ball) // 8)] = np.packbits(hit, axis=1, bitorder="little")
            first = np.flatnonzero(np.diff(i[at : at + 4096], prepend=-1))
            out[i[at + first]] |= np.bitwise_or.reduceat(packed.view("<i8"), first, axis=0)
        return out

    def table(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = column.flatten()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(column.value_lengths().to_numpy())])
        return np.stack([flat.field(c).to_numpy() for c in ("x", "y", "z", "r")], axis=1), flat.field("serial").to_numpy(), ends

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                (mine, own, at), (others, ids, to) = table(batch.column("mine")), table(batch.column("others"))
                words = [bits(mine[a:b], others[c:d], own[a:b, None] == ids[None, c:d]) for a, b, c, d in zip(at, at[1:], to, to[1:])]
                found = np.concatenate(words) if words else np.zeros((0, n_words), np.int64)
                some = np.flatnonzero(found.any(axis=1))
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))[some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("accession").take(pa.array(row)), pa.array(own[some]), *[pa.array(mine[some, c]) for c in range(4)], *[pa.array(found[some, w]) for w in range(n_words)]],
                    ["accession", "serial", "x", "y", "z", "r", *[f"w{w}" for w in range(n_words)]],
                )

    return run


def join_residues(df: DataFrame, residues: DataFrame, keys: list[str]) -> DataFrame:
    """Structure features at (accession, res_no); -1 where there are none."""
    return df.join(residues.select(*keys, "sasa", "relative_sasa", "plddt"), keys, "left").na.fill(-1.0, subset=["sasa", "relative_sasa", "plddt"])
