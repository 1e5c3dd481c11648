"""Joins that add evidence: dimensions, flags, intervals, nearest sites, look-ups; and group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.names import spare
from lociflow.functions.scalars import clip
from lociflow.operators.ranks import dealt_by_range, ranked_by_range

#: Width of the smallest bins, and how many of them make one of the next level.
BIN, FANOUT = 64, 8
#: Levels that a 64-bit position can need.
LEVELS = 20


def join_dimension(df: DataFrame, dim: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Left join with defaults for what has no match; size decides between broadcast and sort-merge at run time."""
    return df.join(dim, keys, "left").na.fill(defaults)


def membership_flags(df: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """A 0/1 column for each key set: the sets become one table of flags, joined once."""
    flags = None
    for name, keys in sets.items():
        one = keys.select(F.col(key), *[F.lit(1 if n == name else 0).alias(n) for n in sets])
        flags = one if flags is None else flags.unionByName(one)
    table = flags.groupBy(key).agg(*[F.max(n).alias(n) for n in sets])
    return df.join(table, key, "left").na.fill(0, subset=list(sets))


def recurrence(df: DataFrame, keys: list[str], sampled: str, tested: str) -> DataFrame:
    """Sum and largest by key, and their ratio with 0 tested read as 1; rows without a key are left out."""
    known = df.na.drop(subset=keys)
    out = known.groupBy(*keys).agg(F.sum(sampled).alias("sampled"), F.max(tested).alias("tested"))
    return out.withColumn("frequency", F.col("sampled") / F.when(F.col("tested") == 0, 1).otherwise(F.col("tested")))


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in `keys`; rows with a NULL key stay."""
    return df.join(keys.select(*on), on, "left_anti")


def interval_annotate(df: DataFrame, intervals: DataFrame, key: str, pos: str, row_id: str, flag: str, name: str) -> DataFrame:
    """flag and name of the first interval (by ord, equal ones by name) that holds the position.

    intervals: (key, lo, hi, ord, name). They become `first_by_step`, and a position takes the step that it stands on, so it meets one
    value however many intervals hold it. row_id tells rows apart; rows of the same one share the first of all their intervals.
    Intervals without a key or an end, or that end before they begin, hold nothing.
    """
    (row,) = spare(df, "_row")
    known = intervals.filter(F.col(key).isNotNull() & (F.col("lo") <= F.col("hi")))
    known = known.select(F.col(key).alias("k"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), F.struct(F.col("ord").alias("ord"), F.col("name").alias("name")).alias("v"))
    places = df.select(F.col(key).alias("k"), F.col(pos).cast("bigint").alias("at"), F.col(row_id).alias("row")).na.drop()
    hits = on_steps(places, first_by_step(known)).groupBy("row").agg(F.min("v").alias("v"))
    hits = hits.select(F.col("row").alias(row), F.col("v.name").alias(name), F.lit(1).alias(flag))
    return df.join(hits, F.col(row_id) == F.col(row), "left").drop(row).na.fill({flag: 0})


def first_by_step(intervals: DataFrame) -> DataFrame:
    """(k, at, v) of intervals (k, lo, hi, v): from `at` to the next one of its key, the least v of the intervals there, NULL where there is none.

    An interval is cut into blocks of 1, 4, 16, ... positions, the largest that lie in it, at most six of a size, and a block keeps its least v. A step begins
    where an interval begins or has ended, and looks into the block of each size around its first position.
    """
    least, most = -(1 << 63), (1 << 63) - 1
    halves = F.explode(F.array(F.struct("lo", F.least("hi", F.lit(-1)).alias("hi")), F.struct(F.greatest("lo", F.lit(0)).alias("lo"), "hi"))).alias("h")  # a length is a bigint on either side of 0
    sided = intervals.select("k", "v", halves).select("k", "v", "h.*").filter("lo <= hi")
    sided = sided.withColumn("length", F.col("hi") - F.col("lo"))
    sided = sided.withColumn("top", sum(((F.col("length") >= F.lit(4 ** (i + 1) - 1)).cast("int") for i in range(31)), F.lit(0)))
    shifted = lambda way, x, bits: F.call_function(way, x, bits)

    def inside(level: Column) -> tuple[Column, Column]:
        """First and last block of a size that lie in the interval; its length is no less."""
        beyond = F.least(shifted("shiftleft", F.lit(1).cast("bigint"), 2 * level) - 1, F.col("length"))
        return shifted("shiftright", F.col("lo") + beyond, 2 * level), shifted("shiftright", F.col("hi") - beyond, 2 * level)

    upto = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
    a, b = inside(F.col("level"))
    # Blocks of the next size, where there are some, take the middle.
    larger = F.when(F.col("level") < F.col("top"), F.struct(*[x.alias(n) for x, n in zip(inside(F.col("level") + 1), "ab")]))
    sized = sided.select("*", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")).select("k", "v", "level", a.alias("a"), b.alias("b"), larger.alias("up"))
    rest = F.concat(upto(F.col("a"), F.try_subtract(F.col("up.a") * 4, F.lit(1))), upto(F.try_add(F.col("up.b") * 4, F.lit(4)), F.col("b")))
    blocks = F.when(F.col("up.a") <= F.col("up.b"), rest).otherwise(upto(F.col("a"), F.col("b")))
    nodes = sized.select("k", "v", "level", F.explode(blocks).alias("block")).groupBy("k", "level", "block").agg(F.min("v").alias("v"))
    largest = sided.agg(F.max("top")).first()[0] or 0
    ends = F.array(F.col("lo"), F.when(F.col("hi") < most, F.col("hi") + 1).otherwise(F.lit(least)))
    starts = intervals.select("k", F.explode(ends).alias("at")).distinct()
    looks = starts.select("k", "at", F.explode(F.sequence(F.lit(0), F.lit(largest))).alias("level"))
    looks = looks.select("k", "at", "level", shifted("shiftright", F.col("at"), 2 * F.col("level")).alias("block"))
    # Blocks are many times what Spark estimates from the intervals, so never broadcast.
    return looks.join(nodes.hint("merge"), ["k", "level", "block"], "left").groupBy("k", "at").agg(F.min("v").alias("v"))


def on_steps(places: DataFrame, steps: DataFrame) -> DataFrame:
    """(row, v) of places (k, at, row): v of the last step (k, at, v) at or before it, where that isn't NULL.

    Both are dealt by ranges of (k, at), with a row's hash to part those at one place; what a part begins with is the last step of the parts before.
    """
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = places.select("k", "at", "row", nothing(steps, "v"), F.lit(1).alias("kind")).unionByName(steps.select("k", "at", nothing(places, "row"), "v", F.lit(0).alias("kind")))
    dealt = dealt_by_range(both, ["k"], [F.col("at"), F.col("kind"), F.xxhash64("row")], "part").withColumn("step", F.when(F.col("kind") == 0, F.struct("v")))
    ends = dealt.groupBy("k", "part").agg(F.max_by("step", F.when(F.col("kind") == 0, F.col("at"))).alias("step"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    ends = ends.select("k", "part", F.last("step", True).over(before).alias("begin"))
    local = Window.partitionBy("k", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("step", F.last("step", True).over(local)).filter("kind = 1").join(ends, ["k", "part"])
    return met.select("row", F.coalesce("step", "begin")["v"].alias("v")).filter("v IS NOT NULL")


def bin_width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(BIN).cast("bigint"), level * (FANOUT.bit_length() - 1))


def interval_level(length: Column) -> Column:
    """The lowest level at which `length` takes at most FANOUT widths: a count of comparisons, exact for any length."""
    return sum(((length > F.lit(min(BIN * FANOUT ** (i + 1), (1 << 63) - 1))).cast("int") for i in range(LEVELS - 1)), F.lit(0))


def floor_div(x: Column, width: Column) -> Column:
    """x / width rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, width), width)


def site_flag(df: DataFrame, sites: DataFrame, key: str, pos: str, flag: str) -> DataFrame:
    marked = sites.select(F.col(key), F.col("site").alias(pos)).distinct().withColumn(flag, F.lit(1))
    return df.join(marked, [key, pos], "left").na.fill({flag: 0})


def nearest_distance(df: DataFrame, sites: DataFrame, key: str, pos: str, name: str, none: int = 999, most: int = 100) -> DataFrame:
    """Distance to the nearest site of the same key, `none` without one, clipped to 0..most.

    Sites go to the bins of `most` positions that they can matter to, so an array holds at most 3 * most whole
    numbers and a row meets one array, however many sites its key has.
    """
    bins = F.explode(F.sequence(F.floor(F.col("site") / most) - 1, F.floor(F.col("site") / most) + 1))
    binned = sites.filter(F.col("site").isNotNull()).select(F.col(key).alias("_key"), "site", bins.alias("_bin"))
    arrays = binned.groupBy("_key", "_bin").agg(F.collect_set("site").alias("_sites"))
    joined = df.join(arrays, (F.col(key) == F.col("_key")) & (F.floor(F.col(pos) / most) == F.col("_bin")), "left")
    least, beyond = F.array_min(F.transform("_sites", lambda s: F.abs(s - F.col(pos)))), F.lit(none)
    if none < most:  # else a far site and none at all give the same
        known = sites.filter(F.col("site").isNotNull()).select(F.col(key).alias("_any")).distinct()
        joined = joined.join(known, F.col(key) == F.col("_any"), "left")
        beyond = F.when(F.col("_any").isNotNull() & F.col(pos).isNotNull(), F.lit(most)).otherwise(beyond)
    return joined.withColumn(name, clip(F.coalesce(least, beyond), 0, most)).select(*df.columns, name)


def mutation_score(df: DataFrame, logp: DataFrame, protein: str, pos: str, wild: str, mutant: str, name: str = "variant_score") -> DataFrame:
    """lp of the mutant residue less lp of the wild one, from the long table (protein, pos, aa, lp)."""
    table = logp.groupBy(F.col("protein").alias(protein), F.col("pos").alias(pos)).agg(F.map_from_entries(F.collect_list(F.struct("aa", "lp"))).alias("_lp"))
    score = F.try_element_at("_lp", F.col(mutant)) - F.try_element_at("_lp", F.col(wild))
    return df.join(table, [protein, pos], "left").withColumn(name, score).drop("_lp")


def attach_embeddings(df: DataFrame, embeddings: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows with their embedding, and how many have none."""
    return df.join(embeddings, key), df.join(embeddings.select(key), key, "left_anti").count()


def key_filter(keys: DataFrame, column: str, bits: int = 1 << 23, hashes: int = 4) -> DataFrame:
    """One row `words`: a Bloom filter of a column's values (as text) as `bits` bits, whatever their number.

    Each task makes its own words, which are combined by OR; at most bits / 64 rows meet. With n keys a value that isn't one passes by chance in
    (1 - exp(-hashes * n / bits)) ** hashes of all cases: some 0.5 % for a twelfth as many keys as bits.
    """
    places = F.explode(F.array(*_places(F.col(column).cast("string"), bits, hashes))).alias("p")
    set_bits = keys.filter(F.col(column).isNotNull()).select(places).select(F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int")).alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("bits"))
    words = set_bits.unionByName(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words"))


def _places(value: Column, bits: int, hashes: int) -> list[Column]:
    """Where a value sets bits: at steps that one hash gives, from where another does."""
    first, step = (F.pmod(h, F.lit(bits).cast("bigint")) for h in (F.xxhash64(value), F.xxhash64(value, F.lit(1))))
    return [(first + i * step) % bits for i in range(hashes)]


def packed_matches(df: DataFrame, column: str, keys: DataFrame, key: str, sep: str = ";", bits: int = 1 << 23, hashes: int = 4) -> DataFrame:
    """df with the elements of a packed text column that `keys` has, a row each under the column's name: what explode and a left semi join give.

    Each element is looked up in a Bloom filter of the keys as it is exploded, in the same task, and only those that pass are joined; the exact semi join
    follows. The filter is of a fixed size, so keys may be any number; keys and elements are compared as trimmed text, null ones match nothing.
    """
    if bits % 64:
        raise ValueError("bits come in words of 64")
    known = keys.select(F.trim(F.col(key).cast("string")).alias("k"))
    # Not a column: rows would carry the whole filter with them.
    words = key_filter(known, "k", bits, hashes).scalar()
    exploded = df.select(*[F.explode(F.split(c, sep)).alias(c) if c == column else F.col(c) for c in df.columns]).withColumn(column, F.trim(column))
    for p in _places(F.col(column), bits, hashes):
        exploded = exploded.filter(F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    (other,) = spare(df, "_key")
    return exploded.join(known.withColumnRenamed("k", other), F.col(column) == F.col(other), "left_semi")


def prefilter_packed(df: DataFrame, column: str, keys: list[str], sep: str = ";") -> DataFrame:
    """Rows whose packed field holds one of a short list of keys, before it is exploded."""
    return df.filter(F.arrays_overlap(F.transform(F.split(column, sep), lambda x: F.trim(x)), F.array(*[F.lit(k) for k in keys])))


def grouped_rows(df: DataFrame, key: str, columns: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """A key's rows as one sorted array of structs; with `most` as several (key, part, rows) of at most so many, whatever a key holds."""
    if most is not None:
        place, part = spare(df, "_place", "part")
        ranked = ranked_by_range(df, [key], [F.col(c).asc_nulls_first() for c in order], place)
        numbered = ranked.withColumn(part, F.call_function("div", F.col(place) - 1, F.lit(most).cast("bigint")))
        return numbered.groupBy(key, part).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("rows"))
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("rows"))

