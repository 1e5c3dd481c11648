"""What has to hold at any size: even ranges, quantiles by key, long intervals, greedy batches, versions, arriving files, key filters, records."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import dedup, enrich, metrics, packing, ranks, sampling
from lociflow.plans import reports
from lociflow.sources import proteins, tables
from lociflow.sources.snapshots import Conflict, Snapshots
from lociflow.streaming import slices


@pytest.fixture(autouse=True)
def importable(spark):
    import os

    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# ---------------------------------------------------------------- ranks and quantiles


def test_ranges_are_even_whatever_the_values(spark):
    rare = spark.range(300_000).select((F.rand(3) * 1e-4).alias("p"), F.col("id"))
    sizes = [r["count"] for r in ranks.dealt_by_range(rare, [], [F.col("p").desc()], "part", 16).groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 300_000 / 16


def test_running_sums_by_range(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, _bucket int, n int")
    got = ranks.running_by_range(df, ["k"], [F.col("x").asc_nulls_first(), F.col("_bucket")], {"upto": F.col("n"), "rank": F.lit(1)}, 7).collect()
    want, seen = {}, {}
    for k, x, i, n in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        total, place = seen.get(k, (0, 0))
        seen[k] = want[i] = (total + n, place + 1)
    assert {r["_bucket"]: (r.upto, r["rank"]) for r in got} == want


def test_null_keys_and_scores_stay(spark):
    df = spark.createDataFrame([("a", 5), (None, 5), ("b", 5)], "id string, n int")
    assert sorted(sampling.pack_batches(df, "id", "n").select(F.coalesce("id", F.lit("-"))).toPandas().iloc[:, 0]) == ["-", "a", "b"]
    pred = spark.createDataFrame([(1, 0.5), (0, None), (1, None), (0, 0.25)], "y int, p double")
    assert [tuple(r) for r in metrics.curve_points(pred).orderBy("tp", "fp").collect()] == [(0.5, 1, 0, 1, 0), (0.25, 0, 1, 1, 1), (None, 1, 1, 2, 2)]
    groups = sampling.group_folds(spark.createDataFrame([("g", 1), (None, 0), (None, 1)], "g string, y int"), "g", "y", 2)
    assert groups.count() == 2


def test_quantiles_by_key(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 20)
    rng = np.random.default_rng(2)
    kinds = {"uniform": rng.uniform(size=900), "heavy": rng.normal(size=700) ** 7 * 1e6, "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([3.5]), "none": np.array([]), "inf": np.array([-np.inf, 1, 2, np.inf])}
    rows = [(k, float(v), float(-v)) for k, values in kinds.items() for v in values] + [("none", None, float("nan")), (None, 1.0, None), (None, 3.0, None)]
    df = spark.createDataFrame(rows, "column string, a double, b double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = ranks.quantiles(df.withColumnRenamed("column", "k"), ["k"], ["a", "b"], shares)
    got = {(r["k"], r["column"]): (r["n"], r["values"]) for r in out.collect()}
    for k, values in kinds.items():
        for column, sign in (("a", 1), ("b", -1)):
            n, found = got[k, column]
            assert n == len(values)
            if k == "inf":
                assert found[0] == -np.inf and found[-1] == np.inf and found[3] == 1.5 * sign
            else:
                assert np.allclose(np.array(found, float), np.quantile(sign * values, shares) if n else np.full(6, np.nan), rtol=1e-12, equal_nan=True), k
    assert got[None, "a"] == (2, [1.0, 1.2, 1.5, 2.0, 2.8, 3.0]) and got[None, "b"] == (0, [None] * 6)


def test_quantile_jobs_do_not_grow_with_columns(spark):
    df = spark.range(30_000).select(*[(F.rand(i) * 10**i).alias(f"c{i}") for i in range(6)])
    jobs = []
    for n in (1, 6):
        spark.sparkContext.setJobGroup(f"quantiles-{n}", "")
        ranks.quantiles(df, [], [f"c{i}" for i in range(n)], [0.5]).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles-{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 2
    plan = reports.class_distribution(df.withColumn("y", F.lit(1)), "y", "c1")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_calibration_by_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), None if rng.random() < 0.2 else "m", int(rng.random() < 0.5), rng.random()) for _ in range(400)]
    every = metrics.calibration_bins(spark.createDataFrame(rows, "config string, model string, y int, p double"), 4, ["config", "model"])
    for c in "ab":
        for m in (None, "m"):
            own = np.array([p for a, b, _, p in rows if (a, b) == (c, m)])
            edges = np.quantile(own, [0.25, 0.5, 0.75])
            want = np.bincount((own[:, None] > edges).sum(1), minlength=4).tolist()
            got = every.filter((F.col("config") == c) & F.col("model").eqNullSafe(F.lit(m))).orderBy("bin").collect()
            assert [r.n for r in got] == want


# ---------------------------------------------------------------- intervals, batches, key filters


def test_long_intervals_against_brute_force(spark):
    rng = random.Random(1)
    spans = [(rng.choice("ab"), (lo := rng.randrange(-(10**6), 10**7)), lo + 10 ** rng.randrange(0, 8) - 1, i % 7, f"n{i}") for i in range(300)]
    spans += [("a", 5, 4, 0, "ends first"), (None, 1, 9, 0, "no key"), ("a", None, 9, 0, "no end"), ("b", -(10**12), 10**12, 9, "all")]
    points = [(i, rng.choice("abc"), rng.randrange(-(10**6), 2 * 10**7)) for i in range(1500)] + [(9998, "a", None), (9999, None, 5), (10000, "b", -(10**12))]
    table = spark.createDataFrame(spans, "k string, lo bigint, hi bigint, ord int, name string")
    df = spark.createDataFrame(points, "id int, k string, p bigint").withColumn("_row", F.lit("mine"))
    out = enrich.interval_annotate(df, table, "k", "p", "id", "inside", "found")
    assert out.columns == ["id", "k", "p", "_row", "found", "inside"]
    for r in out.collect():
        own = [(o, n) for k, lo, hi, o, n in spans if k is not None and k == r.k and lo is not None and r.p is not None and lo <= r.p <= hi]
        assert (r.found, r.inside, r["_row"]) == (min(own)[1] if own else None, int(bool(own)), "mine")
    # An interval takes few bins, whatever its length.
    width = enrich.bin_width(enrich.interval_level(F.col("n")))
    for n in (0, 1, 511, 512, 513, 10**7, 10**12, 10**18):
        bins, level = spark.range(1).select(F.lit(n).cast("bigint").alias("n")).select(enrich.floor_div(F.col("n"), width), enrich.interval_level(F.col("n"))).first()
        assert bins <= enrich.FANOUT and 0 <= level < enrich.LEVELS


def test_first_by_step_against_brute_force(spark):
    rng, low, high = random.Random(7), -(1 << 63), (1 << 63) - 1
    spans = [(rng.choice("ab"), (lo := rng.randrange(-300, 300)), lo + rng.randrange(0, 4 ** rng.randrange(1, 5)), (rng.randrange(9), f"n{i}")) for i in range(120)]
    spans += [("b", low, high, (20, "all")), ("a", high - 5, high, (1, "end")), ("a", low, low, (1, "begin")), ("c", -1, 0, (1, "zero"))]
    steps = enrich.first_by_step(spark.createDataFrame(spans, "k string, lo bigint, hi bigint, v struct<ord: int, name: string>")).collect()
    assert len(steps) == len({(r.k, r["at"]) for r in steps}) <= 2 * len(spans)
    for r in steps:
        own = [v for k, lo, hi, v in spans if k == r.k and lo <= r["at"] <= hi]
        assert (tuple(r.v) if r.v else None) == (min(own) if own else None)


def test_many_intervals_around_many_places(spark):
    """A place meets one step however many intervals hold it, and places on one spot go to several parts."""
    df = spark.range(20_000).selectExpr("id", "'g' AS k", "CASE WHEN id % 2 = 0 THEN 5000 ELSE id END AS p")
    spans = spark.range(5_000).selectExpr("'g' AS k", "-id AS lo", "20000 + id AS hi", "5000 - id AS ord", "concat('n', id) AS name")
    spans = spans.unionByName(spark.createDataFrame([("g", -(1 << 63), (1 << 63) - 1, 9999, "all")], spans.schema))
    known = spans.select("k", "lo", "hi", F.struct("ord", "name").alias("v"))
    met = enrich.on_steps(df.selectExpr("k", "p AS at", "id AS row"), enrich.first_by_step(known))
    assert met.count() == 20_000
    out = enrich.interval_annotate(df, spans, "k", "p", "id", "inside", "name")
    assert [tuple(r) for r in out.groupBy("inside", "name").count().collect()] == [(1, "n4999", 20_000)]


def greedy(costs, most_items, most_cost):
    out, batch, items, total = [], -1, 0, 0
    for c in costs:
        if batch < 0 or items >= most_items or total + c > most_cost:
            batch, items, total = batch + 1, 0, 0
        out.append(batch)
        items, total = items + 1, total + c
    return out


@pytest.mark.parametrize("n, items, cost, block", [(0, 3, 5, 8), (1, 3, 5, 8), (50, 4, 30, 8), (300, 32, 100, 32), (257, 4, 10**9, 16), (700, 7, 20, 64)])
def test_greedy_batches(spark, n, items, cost, block):
    rng = random.Random(n)
    costs = [rng.choice([0, 1, 5, 9, 50]) for _ in range(n)]
    rows = [(i, c if c else None, "x") for i, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "id int, c int, _place string").repartition(3)
    out = packing.greedy_batches(df, [F.col("id")], F.col("c"), items, cost, block=block)
    assert out.columns == ["id", "c", "_place", "batch"]
    assert [r.batch for r in out.orderBy("id").collect()] == greedy(costs, items, cost)


def test_packed_matches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", ";".join(f" {rng.randrange(5000)} " for _ in range(rng.randrange(1, 6)))]), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, packed string, _words string")
    keys = spark.createDataFrame([(k,) for k in range(0, 5000, 50)] + [(None,), (50,)], "key int")
    known = {str(k) for k in range(0, 5000, 50)}
    want = sorted((i, x.strip()) for i, p, _ in rows if p for x in p.split(";") if x.strip() in known)
    for bits in (64, 1 << 12, 1 << 20):  # a filter that lets everything through, and ones that don't
        out = enrich.packed_matches(df, "packed", keys, "key", bits=bits)
        assert out.columns == df.columns and sorted((r.id, r.packed) for r in out.collect()) == want
    filtered = enrich.key_filter(keys, "key", 1 << 12)
    assert len(filtered.first()["words"]) == (1 << 12) // 64
    # Nearly nothing but matches reaches the explode.
    words = filtered.first()["words"]
    at = lambda p: words[p >> 6] >> (p & 63) & 1
    places = spark.range(5000).select(F.array(*enrich._places(F.col("id").cast("string"), 1 << 12, 4))).collect()
    passed = sum(all(at(p) for p in r[0]) for r in places)
    assert 100 <= passed < 150
    assert enrich.packed_matches(df, "packed", keys.limit(0), "key").isEmpty()


def test_no_row_carries_the_key_filter(spark):
    """The filter stays a value of the plan: as a column every row would be copied with all its words."""
    df = spark.createDataFrame([(1, "a;b"), (2, "c")], "id int, packed string")
    out = enrich.packed_matches(df, "packed", df.selectExpr("'b' AS key"), "key")
    nodes, types = [out._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        types += [node.output().apply(i).dataType().sql() for i in range(node.output().size())]
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert "STRING" in types and "ARRAY<BIGINT>" not in types
    assert [tuple(r) for r in out.collect()] == [(1, "b")]


def test_keep_best_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, 3.0, "b")], "k int, _place double, _priority string")
    assert [tuple(r) for r in dedup.keep_best(df, ["k"], [F.col("_place").desc()]).collect()] == [(1, 3.0, "b")]
    both = dedup.union_by_priority([df, df.withColumn("k", F.lit(2))], ["k"])
    assert both.columns == df.columns and both.count() == 2


# ---------------------------------------------------------------- versions and arriving files


def test_versions(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.versions() == [] and table.manifest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = lambda *r: spark.createDataFrame(r, "config string, model string, p double")
    one = table.replace(rows(("a", "m", 0.1), ("b", "m", 0.2), (None, "m", 0.3)), ["config", "model"], note="first")
    pinned = table.read()
    two = table.replace(rows(("b", "m", 0.5), (None, "m", 0.6)), ["config", "model"])
    found = lambda df: sorted((r.config or "-", r.p) for r in df.collect())
    assert found(pinned) == found(table.read(one)) == [("-", 0.3), ("a", 0.1), ("b", 0.2)]
    assert found(table.read()) == found(table.read(two)) == [("-", 0.6), ("a", 0.1), ("b", 0.5)] and table.fact("note") == "first"

    @F.udf("double")
    def fails(x):
        raise ValueError("task dies")

    with pytest.raises(Exception):
        table.replace(rows(("a", "m", 9.0)).withColumn("p", fails("p")), ["config", "model"])
    (tmp_path / "t" / "manifests" / "v000000000003.json").write_text('{"version": 3, "parts": [')  # a writer that died
    assert table.versions() == [one, two] and found(table.read()) == [("-", 0.6), ("a", 0.1), ("b", 0.5)]
    base = table.manifest()
    four = table.replace(rows(("c", "n", 1.0)), ["config", "model"])
    assert four == 4
    with pytest.raises(Conflict):
        table._commit(base, base and table.read().schema, base["parts"], {})
    table.clean(1)
    assert table.versions() == [4] and found(table.read()) == [("-", 0.6), ("a", 0.1), ("b", 0.5), ("c", 1.0)]
    with pytest.raises(FileNotFoundError):
        table.read(one)
    with pytest.raises(ValueError):
        table.replace(rows(("a", "m", 0.0)), ["model"])


@pytest.mark.parametrize("files, runs", [(1, 8), (3, 2), (7, 3)])
def test_keep_best_over_arriving_files(spark, tmp_path, files, runs):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", "value")
    keys, order = ["user_id", "event_type"], [F.col("value").desc_nulls_last()]
    parts = [events.filter(F.pmod(F.xxhash64("event_id"), F.lit(files)) == i).coalesce(1) for i in range(files)]
    (tmp_path / "in").mkdir()
    run = lambda: slices.keep_best_arriving(slices.file_stream(spark, str(tmp_path / "in"), events.schema, 1), keys, order, str(tmp_path / "best"), str(tmp_path / "state"), runs)
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        if i == files // 2:
            run()  # the stream ends here, and goes on with what comes later
    run()
    table = Snapshots(spark, str(tmp_path / "best"))
    found = slices.best_so_far(spark, str(tmp_path / "best"), keys, order)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dedup.keep_best(events, keys, order).collect()))
    assert len(table.manifest()["parts"]) < max(2, runs) and table.fact("batch") == files - 1
    # A batch that runs again after a crash adds nothing.
    last = table.manifest()["version"]
    import shutil

    shutil.rmtree(tmp_path / "state")
    if files == 1:
        run()
        assert table.manifest()["version"] == last


# ---------------------------------------------------------------- sources


def test_keep_first_with_a_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")], "k int, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = slices.file_stream(spark, str(tmp_path / "in"), rows.schema)
    slices.append_all(slices.keep_first(stream, ["k"], "t"), lambda d: d.select("k"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.k for r in spark.read.schema("k int").parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_checked_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text('k\tv,1\n1\t"x\n2\n3\ty\tz\n\n4\t\n')
    (tmp_path / "in" / "b.tsv").write_text("k\tv,1\n5\tw\n")
    good, bad = tables.read_checked(spark, str(tmp_path / "in"))
    assert good.columns == ["k", "v,1"] and sorted((r[0], r[1] or "") for r in good.collect()) == [("1", '"x'), ("4", ""), ("5", "w")]
    counted = tables.quarantine(bad, str(tmp_path / "bad"))
    assert [tuple(r) for r in counted.collect()] == [("a.tsv", 2)]
    assert sorted(r.record for r in bad.collect()) == ["2", "3\ty\tz"]
    (tmp_path / "q.csv").write_text('a,b\n1,"x,y"\n2,"open\n3,z\n')
    good, bad = tables.read_checked(spark, str(tmp_path / "q.csv"), ",", quoted=True)
    assert ("1", "x,y") in {tuple(r) for r in good.collect()} and ("3", "z") in {tuple(r) for r in good.collect()}


def test_headers_sinks_and_caps(spark, tmp_path):
    from lociflow.operators import clean

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, b string")
    assert clean.resolve_column(df, ["nope", "b", "id"], "name").columns == ["id", "name"]
    with pytest.raises(ValueError):
        clean.resolve_column(df, ["nope"], "name")
    tables.write_table(df, str(tmp_path / "t"), kind="csv", sep="\t")
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t"), {"b": "x", "id": "y"}).collect()), key=str) == [("a", "1"), (None, "2")]
    tables.write_record(df.select(F.struct("id", "b").alias("r")).limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["r"]["id"] == 1
    assert tables.first_rows(df, 1).count() == 1 and tables.first_rows(df, None).count() == 2
    order = [r.id for r in sampling.deterministic_shuffle(spark.range(50).repartition(7), "id").collect()]
    assert order != sorted(order) and order == [r.id for r in sampling.deterministic_shuffle(spark.range(50).coalesce(1), "id").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_either_line_end(spark, tmp_path, end):
    one = "ID   R{0}_X\nAC   A{0};\nGN   Name=G{0};\nFT   DOMAIN          1..{0}\nSQ   S\n     MK\n     V\n//\n"
    text = "".join(one.format(i) for i in range(1, 120)).replace("\n", end)
    (tmp_path / "a.dat").write_bytes(text.encode())
    (tmp_path / "b.dat").write_bytes(one.format(500).replace("\n", end).rstrip().encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97b", "1000b", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = proteins.parse(proteins.read_records(spark, str(tmp_path))).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert sorted((r.entry, r.accession, r.gene, r.sequence, r.features[0].end) for r in rows) == sorted((f"R{i}_X", f"A{i}", f"G{i}", "MKV", i) for i in [*range(1, 120), 500])
