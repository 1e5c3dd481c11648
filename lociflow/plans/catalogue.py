"""Registered queries and their SQL twins, by name: the operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import scalars as S
from lociflow.functions.arrays import explode_packed
from lociflow.operators import clean, dedup, enrich, labels, metrics, packing, ranks, sampling, scale
from lociflow.plans import reports
from lociflow.sources import proteins, structures, tables
from lociflow.sources.shared import new_folder
from lociflow.sources.snapshots import Snapshots
from lociflow.streaming import slices

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- cleaning

_DIRTY = (
    "CASE WHEN p_partkey % 7 = 0 THEN '.' WHEN p_partkey % 11 = 0 THEN 'NA' WHEN p_partkey % 13 = 0 THEN '1.0d' WHEN p_partkey % 17 = 0 THEN '-1' "
    "WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN '100.5' ELSE cast(p_size AS {text}) END"
)


@query(f"""
WITH d AS (SELECT p_partkey, {_DIRTY.format(text="VARCHAR")} AS t FROM part),
n AS (SELECT p_partkey, try_cast(CASE WHEN t IN ('.', 'NA', '', '..', 'nan', '1.0d') THEN NULL ELSE t END AS DOUBLE) AS v FROM d)
SELECT p_partkey, CASE WHEN v <= 100 AND v <> -1 THEN v END AS size_clean FROM n""")
def null_token_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_DIRTY.format(text='STRING')} AS size_clean")
    return clean.numeric(df, ["size_clean"]).select("p_partkey", F.col("size_clean").cast("double").alias("size_clean"))


@query("""
SELECT l_returnflag, round(sum(coalesce(CASE WHEN l_discount > 0 THEN l_tax / l_discount END, l_quantity)), 4) AS total, count(*) AS n
FROM lineitem GROUP BY l_returnflag""")
def ratio_coalesce(spark, sf_dir):
    r = S.guarded_ratio(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(r), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS customer FROM orders)
SELECT * FROM d WHERE status IS NOT NULL AND priority IS NOT NULL""")
def drop_incomplete(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "nullif(o_orderstatus, 'P') AS status", "nullif(o_orderpriority, '5-LOW') AS priority", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS customer"
    )
    return clean.drop_incomplete(df, ["customer"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def constant_columns(spark, sf_dir):
    df = table(spark, sf_dir, "nation").withColumn("secondary", F.lit("U"))
    return clean.drop_constant_columns(df, "U")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns(spark, sf_dir):
    return clean.drop_columns(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderdate"], ["o_orderpriority", "not_there"])


@query("SELECT l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", "emb_0")
    return df.select(*clean.select_features(df, exclude=["l_orderkey", "l_partkey"]))


@query("SELECT l_discount, l_tax FROM lineitem")
def align_features(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return clean.align_features(lines, lines.withColumn("extra", F.lit(1)), ["l_discount", "l_tax"])


_SASA = "CASE WHEN p_partkey % 9 = 0 THEN -1 WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS sasa"


@query(f"SELECT * FROM (SELECT p_partkey, {_SASA} FROM part) WHERE sasa IS NULL OR sasa <> -1")
def drop_sentinel(spark, sf_dir):
    return clean.drop_sentinel(table(spark, sf_dir, "part").selectExpr("p_partkey", _SASA), "sasa")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::FLOAT::DOUBLE AS l_extendedprice, l_tax::FLOAT::DOUBLE AS l_tax FROM lineitem")
def downcast(spark, sf_dir):
    small = clean.floats(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"))
    return small.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_tax")])


_SCORE = {"revel": "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END", "sift": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END", "polyphen": "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity / 50.0 END"}
_SCORES_SQL = ", ".join(f"{e} AS {n}" for n, e in _SCORE.items())


@query(f"""SELECT l_orderkey, l_linenumber, round(0.6::DOUBLE * coalesce(revel, 0.5) + 0.2::DOUBLE * (1 - coalesce(sift, 0.5)) + 0.2::DOUBLE * coalesce(polyphen, 0.5), 6) AS consensus
FROM (SELECT l_orderkey, l_linenumber, {_SCORES_SQL} FROM lineitem)""")
def consensus_score(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _SCORE.items()])
    return df.select("l_orderkey", "l_linenumber", F.round(S.consensus_score(F.col("revel"), F.col("sift"), F.col("polyphen")), 6).alias("consensus"))


@query("""SELECT NOT EXISTS (SELECT 1 FROM customer JOIN orders ON c_custkey = o_custkey) AS customers_apart, NOT EXISTS (SELECT 1 FROM customer JOIN orders ON c_custkey = -o_custkey) AS negatives_apart""")
def disjoint_check(spark, sf_dir):
    keys, orders = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), table(spark, sf_dir, "orders")
    found = (clean.is_disjoint(keys, orders.selectExpr("o_custkey AS k"), "k"), clean.is_disjoint(keys, orders.selectExpr("-o_custkey AS k"), "k"))
    return spark.createDataFrame([found], "customers_apart boolean, negatives_apart boolean")


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 100000) AS large FROM orders")
def row_audit(spark, sf_dir):
    df, seen = clean.audit(table(spark, sf_dir, "orders"), "orders", finished=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 100000)
    df.write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.createDataFrame([(found["rows"], found["finished"], found["large"])], "rows bigint, finished bigint, large bigint")


_RESIDUES = sorted(S.MAX_SASA)


@query(f"""WITH r AS (SELECT p_partkey, [{', '.join(f"'{r}'" for r in _RESIDUES)}, 'sec', NULL][(p_partkey % 22 + 1)::INT] AS residue FROM part)
SELECT p_partkey, CASE upper(residue) {' '.join(f"WHEN '{r}' THEN {S.MAX_SASA[r]}" for r in _RESIDUES)} ELSE 200 END AS largest, substr(p_name, 1, 7) AS short_name FROM r JOIN part USING (p_partkey)""")
def literal_lookup(spark, sf_dir):
    names = F.array(*[F.lit(r.lower()) for r in _RESIDUES], F.lit("sec"), F.lit(None))
    df = table(spark, sf_dir, "part").withColumn("residue", F.element_at(names, (F.col("p_partkey") % 22 + 1).cast("int")))
    return df.select("p_partkey", S.max_sasa(F.col("residue")).alias("largest"), S.short_text(F.col("p_name"), 7).alias("short_name"))


# ---------------------------------------------------------------- labelling

_VARIANT = {
    "id": "o_orderkey",
    "chr": "n_name",
    "gene": "c_mktsegment",
    "pos": "o_custkey",
    "aapos": "cast(o_custkey % 50 AS int)",
    "ref": "substr(o_orderpriority, 1, 1)",
    "alt": "CASE o_orderkey % 7 WHEN 0 THEN 'X' WHEN 1 THEN substr(o_orderpriority, 1, 1) ELSE 'Q' END",
    "hgvsp": "CASE o_orderkey % 5 WHEN 0 THEN 'p.Arg1fs' WHEN 1 THEN 'p.Arg2Ter' WHEN 2 THEN NULL ELSE 'p.Arg3Gly' END",
    "clinsig": "CASE o_orderkey % 6 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_benign' WHEN 2 THEN 'Conflicting_pathogenic' WHEN 3 THEN NULL WHEN 4 THEN 'Benign/Pathogenic' ELSE 'Uncertain' END",
    "af": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 1e8 END",
    "recurrence": "o_orderkey % 60",
    "is_cancer_gene": "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END",
    "is_tsg": "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END",
    "is_civic": "CASE WHEN o_custkey % 37 = 0 THEN 1 ELSE 0 END",
    "consensus": "o_totalprice",
}
_HOTSPOTS = {"BUILDING": [1, 2, 3], "FURNITURE": [7, 21]}
_V = "v AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _VARIANT.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_L = (
    _V
    + """,
f AS (SELECT *, CASE WHEN (gene = 'BUILDING' AND aapos IN (1, 2, 3)) OR (gene = 'FURNITURE' AND aapos IN (7, 21)) THEN 1 ELSE 0 END AS is_hotspot,
  CASE WHEN coalesce(ref = alt, false) THEN 'synonymous' WHEN coalesce(lower(hgvsp) LIKE '%fs%', false) THEN 'frameshift'
       WHEN alt IN ('*', 'X') OR coalesce(regexp_matches(hgvsp, 'Ter|\\*'), false) THEN 'nonsense' ELSE 'missense' END AS consequence,
  coalesce(lower(clinsig) NOT LIKE '%conflict%' AND lower(clinsig) LIKE '%pathogenic%', false) AS clinvar_path,
  coalesce(lower(clinsig) NOT LIKE '%conflict%' AND lower(clinsig) LIKE '%benign%', false) AS clinvar_benign, coalesce(af >= 0.001, false) AS common FROM v),
s AS (SELECT *, CASE WHEN is_hotspot = 1 THEN 'known_hotspot' WHEN clinvar_path THEN 'clinvar_pathogenic' WHEN recurrence >= 10 AND is_cancer_gene = 1 THEN 'cosmic_driver'
  WHEN consequence IN ('nonsense', 'frameshift') AND is_tsg = 1 THEN 'lof_tsg_driver' WHEN is_civic = 1 THEN 'civic_clinical' END AS p,
  CASE WHEN common THEN 'gnomad_common' WHEN clinvar_benign THEN 'clinvar_benign' END AS b FROM f),
l AS (SELECT *, CASE WHEN p IS NOT NULL AND NOT common THEN 1 WHEN b IS NOT NULL AND p IS NULL THEN 0 ELSE -1 END AS label FROM s),
e AS (SELECT *, CASE label WHEN 1 THEN p WHEN 0 THEN b ELSE 'None' END AS evidence_source,
  CASE WHEN recurrence >= 50 THEN 'COSMIC' WHEN is_hotspot = 1 THEN 'Hotspot' WHEN is_civic = 1 THEN 'CIViC' ELSE 'None' END AS rescue_reason FROM l)"""
)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in _VARIANT.items()])


def labelled_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.hotspot_flag(variants(spark, sf_dir), _HOTSPOTS, "gene", "aapos")
    df = labels.clinical_flags(df, "clinsig").withColumn("consequence", labels.consequence(F.col("ref"), F.col("alt"), F.col("hgvsp")))
    return labels.rescue_reason(labels.label_by_evidence(df))


@query(f"WITH {_L} SELECT id, consequence FROM e")
def consequence_case(spark, sf_dir):
    return labelled_variants(spark, sf_dir).select("id", "consequence")


@query(f"WITH {_L} SELECT id, clinvar_path, clinvar_benign FROM e")
def clinical_flags(spark, sf_dir):
    return labels.clinical_flags(variants(spark, sf_dir), "clinsig").select("id", "clinvar_path", "clinvar_benign")


@query(f"WITH {_L} SELECT id, label, evidence_source, rescue_reason FROM e")
def evidence_label(spark, sf_dir):
    return labelled_variants(spark, sf_dir).select("id", "label", "evidence_source", "rescue_reason")


@query(f"""WITH {_L},
k AS (SELECT * FROM e WHERE label <> -1 QUALIFY row_number() OVER (PARTITION BY chr, gene, aapos ORDER BY consensus DESC, id) = 1)
SELECT evidence_source, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS pathogenic FROM k GROUP BY evidence_source""")
def evidence_report(spark, sf_dir):
    """Labelled evidence counts after keep-best deduplication."""
    kept = dedup.keep_best(labels.labelled(labelled_variants(spark, sf_dir)), ["chr", "gene", "aapos"], [F.col("consensus").desc(), F.col("id").asc()], total=True)
    return reports.label_evidence(kept)


@query("SELECT p_partkey, CASE WHEN (p_brand = 'Brand#2' AND p_size IN (11, 12)) OR (p_brand = 'Brand#17' AND p_size = 28) THEN 1 ELSE 0 END AS is_hotspot FROM part")
def hotspot_flag(spark, sf_dir):
    return labels.hotspot_flag(table(spark, sf_dir, "part"), {"Brand#2": [11, 12], "Brand#17": [28]}, "p_brand", "p_size").select("p_partkey", "is_hotspot")


@query("SELECT p_partkey, CASE WHEN p_retailprice <= (SELECT quantile_cont(p_retailprice, 0.5) FROM part) THEN 1 ELSE 0 END AS label FROM part")
def median_split(spark, sf_dir):
    return labels.median_split(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "label")


@query("""WITH g AS (SELECT l_partkey, l_suppkey, sum(cast(l_quantity AS BIGINT))::BIGINT AS sampled, max(l_linenumber) AS tested FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, sampled, tested, sampled / CASE WHEN tested = 0 THEN 1 ELSE tested END AS frequency FROM g WHERE sampled >= 50""")
def recurrence_agg(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("bigint"))
    return enrich.recurrence(df, ["l_partkey", "l_suppkey"], "quantity", "l_linenumber").filter("sampled >= 50")


# ---------------------------------------------------------------- joins


@query("""SELECT o_orderkey, coalesce(c_mktsegment, 'Not_in_CGC') AS segment, coalesce(c_nationkey, 0) AS tier
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON o_custkey = c_custkey""")
def dim_left_default(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").filter("c_nationkey < 12").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS segment", "c_nationkey AS tier")
    return enrich.join_dimension(table(spark, sf_dir, "orders"), dim, ["o_custkey"], {"segment": "Not_in_CGC", "tier": 0}).select("o_orderkey", "segment", "tier")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 0 END AS has_f,
CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 1 ELSE 0 END AS has_large FROM customer""")
def membership_flags(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sets = {"has_f": keys.filter("o_orderstatus = 'F'"), "has_large": keys.filter("o_totalprice > 400000")}
    return enrich.membership_flags(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", sets)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey")
    return enrich.semi(table(spark, sf_dir, "orders"), keys, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_groups(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return enrich.anti(table(spark, sf_dir, "customer"), keys, ["c_custkey"]).select("c_custkey", "c_name")


@query("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_partkey, l_suppkey, CASE WHEN (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM a) THEN 'clinvar' ELSE 'dms' END AS origin
FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def inner_multi_union_dedup(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    keys = ["l_partkey", "l_suppkey"]
    a = lines.join(orders.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select(*keys, F.lit("clinvar").alias("origin"))
    b = lines.filter("l_returnflag = 'R'").select(*keys, F.lit("dms").alias("origin"))
    return dedup.union_by_priority([a.distinct(), b.distinct()], keys)


@query("""WITH d AS (SELECT l_partkey, l_suppkey, sum(l_linenumber)::BIGINT AS recurrence FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l_orderkey, l_linenumber, coalesce(recurrence, 0) AS recurrence FROM lineitem LEFT JOIN d USING (l_partkey, l_suppkey)""")
def dim_left_composite(spark, sf_dir):
    lines, keys = table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]
    dim = lines.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_linenumber").alias("recurrence"))
    return enrich.join_dimension(lines, dim, keys, {"recurrence": 0}).select("l_orderkey", "l_linenumber", "recurrence")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_orderpriority IN ('1-URGENT')")
def packed_prefilter(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("packed", F.concat_ws(" ; ", "o_orderstatus", "o_orderpriority"))
    return enrich.prefilter_packed(df, "packed", ["F", "P", "1-URGENT"]).select("o_orderkey")


@query("""WITH i AS (SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey < 40)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem e WHERE l_returnflag <> 'A' AND NOT EXISTS (SELECT 1 FROM i WHERE i.l_partkey = e.l_partkey)
AND NOT EXISTS (SELECT 1 FROM i WHERE i.l_suppkey = e.l_suppkey AND i.l_linenumber = e.l_linenumber)""")
def deoverlap(spark, sf_dir):
    from lociflow.operators import models

    lines = table(spark, sf_dir, "lineitem")
    out = models.deoverlap(lines.filter("l_returnflag <> 'A'"), lines.filter("l_returnflag = 'A' AND l_suppkey < 40"), "l_partkey", ["l_suppkey", "l_linenumber"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""WITH r AS (SELECT s_suppkey AS res_no, 'Brand#' || s_nationkey AS accession, s_acctbal AS sasa, s_acctbal / 100 AS relative_sasa, s_acctbal + 1 AS plddt FROM supplier)
SELECT p_partkey, coalesce(sasa, -1) AS sasa, coalesce(relative_sasa, -1) AS relative_sasa, coalesce(plddt, -1) AS plddt FROM part LEFT JOIN r ON p_brand = accession AND p_size = res_no""")
def residue_lookup(spark, sf_dir):
    residues = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS res_no", "concat('Brand#', s_nationkey) AS accession", "s_acctbal AS sasa", "s_acctbal / 100 AS relative_sasa", "s_acctbal + 1 AS plddt")
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand AS accession", "cast(p_size AS bigint) AS res_no")
    return structures.join_residues(df, residues, ["accession", "res_no"]).select("p_partkey", "sasa", "relative_sasa", "plddt")


@query("""SELECT p_brand AS gene, arg_min(p_name, p_partkey) AS sequence FROM part WHERE p_size % 5 <> 0 GROUP BY p_brand""")
def first_sequence(spark, sf_dir):
    from lociflow.sources import proteins

    df = table(spark, sf_dir, "part").selectExpr("p_brand AS gene", "CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS sequence", "p_partkey AS input_seq")
    return proteins.first_sequence(df)


@query("""SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS rows FROM orders GROUP BY o_custkey""")
def grouped_rows(spark, sf_dir):
    lists = enrich.grouped_rows(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"], ["o_orderkey"])
    one = F.transform("rows", lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["o_orderstatus"]))
    return lists.select("o_custkey", F.size("rows").cast("bigint").alias("n"), F.array_join(one, ",").alias("rows"))


@query("""WITH r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS part FROM events)
SELECT user_id, part, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY t.ts, event_id) AS rows FROM r JOIN events t USING (user_id, event_id) GROUP BY user_id, part""")
def grouped_rows_parts(spark, sf_dir):
    """A user's events in lists of at most 20."""
    lists = enrich.grouped_rows(table(spark, sf_dir, "events"), "user_id", ["event_id"], ["ts", "event_id"], 20)
    return lists.select("user_id", "part", F.size("rows").cast("bigint").alias("n"), F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("rows"))


_INTERVALS = "(SELECT n_nationkey AS k, 'Brand#' || n_nationkey AS p_brand, (n_nationkey * 7) % 40 AS lo, (n_nationkey * 7) % 40 + 12 AS hi, 'D' || n_nationkey AS name FROM nation)"


def _intervals(spark, sf_dir) -> DataFrame:
    first = table(spark, sf_dir, "nation").selectExpr("concat('Brand#', n_nationkey) AS p_brand", "n_nationkey * 7 % 40 AS lo", "n_nationkey * 7 % 40 + 12 AS hi", "n_nationkey AS ord", "concat('D', n_nationkey) AS name")
    second = table(spark, sf_dir, "nation").selectExpr("concat('Brand#', n_nationkey) AS p_brand", "n_nationkey * 3 % 30 AS lo", "n_nationkey * 3 % 30 + 9 AS hi", "n_nationkey + 100 AS ord", "concat('E', n_nationkey) AS name")
    return first.unionByName(second)


@query("""WITH i AS (SELECT 'Brand#' || n_nationkey AS b, n_nationkey * 7 % 40 AS lo, n_nationkey * 7 % 40 + 12 AS hi, n_nationkey AS ord, 'D' || n_nationkey AS name FROM nation
UNION ALL SELECT 'Brand#' || n_nationkey, n_nationkey * 3 % 30, n_nationkey * 3 % 30 + 9, n_nationkey + 100, 'E' || n_nationkey FROM nation),
h AS (SELECT p_partkey, arg_min(name, ord) AS domain_name FROM part JOIN i ON p_brand = b AND p_size BETWEEN lo AND hi GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN domain_name IS NULL THEN 0 ELSE 1 END AS is_in_domain, domain_name FROM part LEFT JOIN h USING (p_partkey)""")
def interval_first(spark, sf_dir):
    out = enrich.interval_annotate(table(spark, sf_dir, "part"), _intervals(spark, sf_dir), "p_brand", "p_size", "p_partkey", "is_in_domain", "domain_name")
    return out.select("p_partkey", "is_in_domain", "domain_name")


@query("""WITH s AS (SELECT 'Brand#' || n_nationkey AS b, n_nationkey * 11 % 50 AS site FROM nation WHERE n_nationkey < 20 UNION SELECT 'Brand#' || n_nationkey, n_nationkey * 5 % 50 FROM nation WHERE n_nationkey < 20),
d AS (SELECT p_partkey, min(abs(p_size - site)) AS d, max(CASE WHEN p_size = site THEN 1 ELSE 0 END) AS hit FROM part JOIN s ON p_brand = b GROUP BY p_partkey)
SELECT p_partkey, coalesce(hit, 0) AS is_site, least(100, coalesce(d, 999)) AS distance FROM part LEFT JOIN d USING (p_partkey)""")
def nearest_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 20")
    sites = n.selectExpr("concat('Brand#', n_nationkey) AS p_brand", "n_nationkey * 11 % 50 AS site").unionByName(n.selectExpr("concat('Brand#', n_nationkey) AS p_brand", "n_nationkey * 5 % 50 AS site"))
    df = enrich.site_flag(table(spark, sf_dir, "part"), sites, "p_brand", "p_size", "is_site")
    return enrich.nearest_distance(df, sites, "p_brand", "p_size", "distance").select("p_partkey", "is_site", "distance")


_LOGP = "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'N' ELSE 'R' END"


@query("""WITH t AS (SELECT l_suppkey, l_linenumber, l_returnflag, round(avg(l_tax), 6) AS lp FROM lineitem GROUP BY ALL),
k AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)
SELECT k.l_suppkey, k.l_linenumber, round(m.lp - w.lp, 6) AS variant_score FROM k
LEFT JOIN t w ON w.l_suppkey = k.l_suppkey AND w.l_linenumber = k.l_linenumber AND w.l_returnflag = 'A'
LEFT JOIN t m ON m.l_suppkey = k.l_suppkey AND m.l_linenumber = k.l_linenumber AND m.l_returnflag = 'R'""")
def logratio_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    logp = lines.groupBy(F.col("l_suppkey").alias("protein"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("aa")).agg(F.round(F.avg("l_tax"), 6).alias("lp"))
    keys = lines.select("l_suppkey", "l_linenumber").distinct().withColumns({"wt": F.lit("A"), "mt": F.lit("R")})
    scored = enrich.mutation_score(keys, logp, "l_suppkey", "l_linenumber", "wt", "mt")
    return scored.select("l_suppkey", "l_linenumber", F.round("variant_score", 6).alias("variant_score"))


@query("""SELECT vec_id, label FROM embeddings JOIN documents ON vec_id = doc_id
WHERE (list_max(embedding) > 0 OR list_min(embedding) < 0) AND n_chars IS NOT NULL""")
def embedding_valid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS vec_id", "cast(n_chars AS double) AS score")
    joined, _ = enrich.attach_embeddings(docs, table(spark, sf_dir, "embeddings"), "vec_id")
    return clean.valid_embeddings(joined, "score", "embedding").select("vec_id", "label")


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z FROM embeddings)
SELECT a.vec_id, count(*) AS neighbours FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id
AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1.5 GROUP BY a.vec_id""")
def accessibility_grid(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 20).alias(c) for i, c in enumerate("xyz")])
    return structures.neighbours(points, "label", "vec_id", 1.5).groupBy("vec_id").agg(F.count(F.lit(1)).alias("neighbours"))


_SPAN = "(c_custkey * 7919) % 100000000"


@query(f"""WITH i AS (SELECT c_nationkey AS k, {_SPAN} AS lo, {_SPAN} + CASE c_custkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 99 WHEN 3 THEN 1000 WHEN 4 THEN 10000 WHEN 5 THEN 99999 WHEN 6 THEN 1000000 ELSE 10000000 END AS hi,
  c_custkey AS ord, c_name AS name FROM customer), p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 25 AS k, (l_orderkey * 104729 + l_linenumber * 1299709) % 100000000 AS pos FROM lineitem),
h AS (SELECT l_orderkey, l_linenumber, arg_min(name, ord) AS name FROM p JOIN i ON p.k = i.k AND pos BETWEEN lo AND hi GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS inside, name FROM p LEFT JOIN h USING (l_orderkey, l_linenumber)""")
def interval_long(spark, sf_dir):
    """Intervals of 1 to ten million positions."""
    widths = F.array(*[F.lit(x) for x in (0, 10, 99, 1000, 10000, 99999, 1000000, 10000000)])
    spans = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k", f"{_SPAN} AS lo", "c_custkey AS ord", "c_name AS name")
    spans = spans.withColumn("hi", F.col("lo") + F.get(widths, (F.col("ord") % 8).cast("int")))
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey % 25 AS k", "(l_orderkey * 104729 + l_linenumber * 1299709) % 100000000 AS pos")
    row = F.struct("l_orderkey", "l_linenumber")
    out = enrich.interval_annotate(lines.withColumn("row", row), spans, "k", "pos", "row", "inside", "name")
    return out.select("l_orderkey", "l_linenumber", "inside", "name")


@query("""WITH e AS (SELECT o_orderkey, trim(unnest(string_split(o_custkey || ' ; ' || (o_custkey * 7 % 5000) || ';' || o_orderstatus || ';' || (o_orderkey % 100000), ';'))) AS element FROM orders)
SELECT o_orderkey, element FROM e WHERE element IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0)""")
def packed_large_keys(spark, sf_dir):
    """Packed text against a key set of any size: Bloom filter before the explode, exact semi join after it."""
    packed = "concat(o_custkey, ' ; ', o_custkey * 7 % 5000, ';', o_orderstatus, ';', o_orderkey % 100000) AS element"
    df, keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey", packed), table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    return enrich.packed_matches(df, "element", keys, "c_custkey").select("o_orderkey", "element")


_ATOMS = "vec_id AS serial, 'S' || label AS accession, (vec_id // 5)::INT AS res_no, CASE WHEN vec_id // 5 % 3 = 0 THEN 'ALA' WHEN vec_id // 5 % 3 = 1 THEN 'GLY' ELSE 'SEC' END AS res_name, ['CA', 'N', 'O', 'SG', 'XX'][(vec_id % 5 + 1)::INT] AS atom, round(embedding[1]::DOUBLE * 60, 3) AS x, round(embedding[2]::DOUBLE * 60, 3) AS y, round(embedding[3]::DOUBLE * 60, 3) AS z, vec_id % 100 AS bfactor"
_BALL = "[" + ", ".join(f"{{'i': {i}, 'x': {x!r}::DOUBLE, 'y': {y!r}::DOUBLE, 'z': {z!r}::DOUBLE}}" for i, (x, y, z) in enumerate(structures.sphere(structures.POINTS))) + "]"


@query(f"""WITH a AS (SELECT {_ATOMS} FROM embeddings), r AS (SELECT *, CASE substr(atom, 1, 1) WHEN 'C' THEN 1.7::DOUBLE WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 WHEN 'S' THEN 1.8 WHEN 'H' THEN 1.2 WHEN 'P' THEN 1.8 ELSE 1.8 END + 1.4::DOUBLE AS r FROM a),
b AS (SELECT accession, serial, unnest({_BALL}) AS p FROM a), s AS (SELECT r.accession, r.serial, r.x + r.r * p.x AS x, r.y + r.r * p.y AS y, r.z + r.r * p.z AS z FROM r JOIN b USING (accession, serial)),
o AS (SELECT accession, serial, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM r n WHERE n.accession = s.accession AND n.serial <> s.serial AND (s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) + (s.z - n.z) * (s.z - n.z) < n.r * n.r) GROUP BY ALL),
g AS (SELECT accession, res_no, arg_min(res_name, serial) AS res_name, sum(coalesce(n, 0) * 4 * pi() / {structures.POINTS} * r * r) AS sasa, arg_min(bfactor, serial)::DOUBLE AS plddt FROM r LEFT JOIN o USING (accession, serial) GROUP BY accession, res_no)
SELECT accession, res_no, round(sasa, 4) AS sasa, CASE WHEN sasa > 0 THEN round(sasa / CASE res_name WHEN 'ALA' THEN 121 WHEN 'GLY' THEN 97 ELSE 200 END, 4) ELSE -1 END AS relative_sasa, plddt FROM g""")
def accessibility(spark, sf_dir):
    """Rolling-probe surface of structures whose atoms are the embeddings' first three numbers."""
    names = F.array(*map(F.lit, ("CA", "N", "O", "SG", "XX")))
    atoms = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("serial"), F.concat(F.lit("S"), "label").alias("accession"), F.floor(F.col("vec_id") / 5).cast("int").alias("res_no"), F.get(names, (F.col("vec_id") % 5).cast("int")).alias("atom"),
        F.element_at(F.array(*map(F.lit, ("ALA", "GLY", "SEC"))), (F.floor(F.col("vec_id") / 5) % 3 + 1).cast("int")).alias("res_name"),
        *[F.round(F.col("embedding")[i].cast("double") * 60, 3).alias(c) for i, c in enumerate("xyz")], (F.col("vec_id") % 100).cast("double").alias("bfactor"),
    )
    return structures.accessibility(atoms).select("accession", "res_no", "sasa", "relative_sasa", "plddt")


# ---------------------------------------------------------------- text and arrays


@query("""SELECT doc_id, (n_chars % 60)::BIGINT AS pos, n_chars % 60 BETWEEN 1 AND length(text) AND substr(text, (n_chars % 60)::INT, 1) = 'e' AS ok FROM documents""")
def ref_char_check(spark, sf_dir):
    pos = (F.col("n_chars") % 60).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", pos.cast("bigint").alias("pos"), S.reference_matches(F.col("text"), pos, F.lit("e")).alias("ok"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, (doc_id * 37 % length(text) + 1) AS pos FROM documents WHERE length(text) > 0),
s AS (SELECT *, greatest(0, pos - 51) AS a FROM d), e AS (SELECT *, least(n, a + 100) AS b FROM s), f AS (SELECT *, CASE WHEN b = n THEN greatest(0, b - 100) ELSE a END AS st FROM e)
SELECT doc_id, md5(CASE WHEN n > 250 THEN substr(text, (st + 1)::INT, (b - st)::INT) ELSE text END) AS crop_md5, (CASE WHEN n > 250 THEN pos - st ELSE pos END)::BIGINT AS local_pos FROM f""")
def centred_crop(spark, sf_dir):
    df = table(spark, sf_dir, "documents").filter(F.length("text") > 0).withColumn("pos", (F.col("doc_id") * 37 % F.length("text") + 1).cast("int"))
    out = df.select("doc_id", S.centred_crop(F.col("text"), F.col("pos"), 100, 250).alias("c"))
    return out.select("doc_id", F.md5(F.col("c.crop").cast("binary")).alias("crop_md5"), F.col("c.local_pos").cast("bigint").alias("local_pos"))


_PACKED = {"a": "concat(o_orderstatus, ';', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ';.' ELSE '' END)", "b": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(' ', o_orderstatus, ' ;', 'z') END"}
_UNPACK = "[CASE WHEN trim(x) IN ('.', 'nan', '') THEN NULL ELSE trim(x) END FOR x IN string_split(coalesce({0}, ''), ';')]"
_P = "p AS (SELECT o_orderkey, " + ", ".join(f"{_UNPACK.format('(' + e + ')')} AS {n}" for n, e in _PACKED.items()) + " FROM orders)"


def _packed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in _PACKED.items()])


@query(f"WITH {_P} SELECT o_orderkey, unnest(a) AS a, unnest(b) AS b FROM p")
def explode_paired(spark, sf_dir):
    return explode_packed(_packed(spark, sf_dir), ["a", "b"])


@query(f"WITH {_P}, q AS (SELECT o_orderkey, unnest(a) AS a, b FROM p) SELECT o_orderkey, a, unnest(b) AS b FROM q")
def explode_cross(spark, sf_dir):
    return explode_packed(_packed(spark, sf_dir), ["a", "b"], mode="cross")


# ---------------------------------------------------------------- dedup, sampling, folds


@query("SELECT l_partkey, l_suppkey, max(l_extendedprice) AS best_price FROM lineitem GROUP BY ALL")
def keep_best(spark, sf_dir):
    kept = dedup.keep_best(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], [F.col("l_extendedprice").desc()])
    return kept.select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("best_price"))


@query("""SELECT s_nationkey, arg_max(s_suppkey, struct_pack(a := s_acctbal > 5000, b := s_suppkey)) AS s_suppkey FROM supplier GROUP BY s_nationkey""")
def best_per_group(spark, sf_dir):
    return dedup.best_per_group(table(spark, sf_dir, "supplier"), "s_nationkey", [F.col("s_acctbal") > 5000, F.col("s_suppkey")], ["s_suppkey"])


@query("""WITH n AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM labels WHERE quality IS NOT NULL GROUP BY quality))
SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= (SELECT c FROM n)""")
def balance_exact(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.balance(df, "quality", "doc_id", order=F.col("doc_id"), bucket=F.floor(F.col("doc_id") / 1024))


_FOLDS = """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS positives, count(*) FILTER (o_orderstatus <> 'F') AS negatives FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY positives > 0 ORDER BY positives DESC, negatives DESC, o_custkey) - 1 AS i FROM g)
SELECT o_custkey, positives, negatives, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INT AS fold FROM r"""


@query(_FOLDS)
def group_folds(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return sampling.group_folds(df, "o_custkey", "y", 5)


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5)::INT AS fold FROM labels")
def stratified_folds(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.stratified_folds(df, "quality", "doc_id", order=F.col("doc_id"), bucket=F.floor(F.col("doc_id") / 1024))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 700")
def subsample(spark, sf_dir):
    """A sampling operator: the limit is the feature; the order is given, so that SQL can follow it."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.subsample(df, 700, "o_orderkey", order=F.col("o_orderkey"), bucket=F.floor(F.col("o_orderkey") / 1024))


_FOLD_OF = "(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)"


@query(f"""WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS positives, count(*) FILTER (o_orderstatus <> 'F') AS negatives FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY positives > 0 ORDER BY positives DESC, negatives DESC, o_custkey) - 1 AS i FROM g),
f AS (SELECT o_custkey, positives, negatives, {_FOLD_OF} AS fold FROM r),
q AS (SELECT o_custkey, row_number() OVER (PARTITION BY positives > 0 ORDER BY positives DESC, negatives DESC, o_custkey) - 1 AS i FROM f WHERE fold <> 2),
n AS (SELECT o_custkey, {_FOLD_OF} AS inner_fold FROM q)
SELECT o_orderkey, CASE WHEN fold = 2 THEN 'test' WHEN inner_fold = 0 THEN 'validation' ELSE 'train' END AS part FROM orders JOIN f USING (o_custkey) LEFT JOIN n USING (o_custkey)""")
def nested_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return sampling.nested_split(df, "o_custkey", "y", 2, inner_order=F.col("o_custkey")).select("o_orderkey", "part")


@query("""WITH d AS (SELECT doc_id, n_chars, (n_chars + 2) // 64 AS length_bucket FROM documents),
m AS (SELECT *, greatest(1, least(32, 16000 // ((length_bucket + 1) * 64))) AS most, row_number() OVER (PARTITION BY length_bucket ORDER BY doc_id) - 1 AS i FROM d)
SELECT length_bucket, i // most AS batch, count(*) AS items, sum(n_chars + 2)::BIGINT AS cost FROM m GROUP BY ALL""")
def pack_batches(spark, sf_dir):
    packed = sampling.pack_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")
    return packed.groupBy("length_bucket", "batch").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("n_chars") + 2).alias("cost"))


@query("""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS r, doc_id, n_chars + 2 AS cost FROM documents),
g AS (SELECT r, doc_id, cost AS tokens, 1 AS items, 0 AS batch FROM o WHERE r = 1
  UNION ALL SELECT o.r, o.doc_id, CASE WHEN items = 32 OR tokens + cost > 16000 THEN cost ELSE tokens + cost END, CASE WHEN items = 32 OR tokens + cost > 16000 THEN 1 ELSE items + 1 END,
  CASE WHEN items = 32 OR tokens + cost > 16000 THEN batch + 1 ELSE batch END FROM g JOIN o ON o.r = g.r + 1)
SELECT doc_id, batch::BIGINT AS batch FROM g""")
def pack_greedy(spark, sf_dir):
    """The batches of one pass over all documents by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return packing.greedy_batches(docs, [F.col("n_chars"), F.col("doc_id")], F.col("n_chars") + 2).select("doc_id", "batch")


@query("""WITH d AS (SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q FROM lineitem), m AS (SELECT quantile_cont(q, 0.5) AS m FROM d),
f AS (SELECT l_returnflag, coalesce(q, (SELECT m FROM m)) AS q FROM d)
SELECT l_returnflag, round(avg((q - (SELECT avg(q) FROM f)) / (SELECT stddev_pop(q) FROM f)), 6) AS mean_z, round(max((q - (SELECT avg(q) FROM f)) / (SELECT stddev_pop(q) FROM f)), 6) AS max_z FROM f GROUP BY l_returnflag""")
def impute_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"))
    filled = scale.impute(df, scale.fit_impute(df, ["q"]))
    z = scale.scale(filled, scale.fit_scale(filled, ["q"]))
    return z.groupBy("l_returnflag").agg(F.round(F.avg("q"), 6).alias("mean_z"), F.round(F.max("q"), 6).alias("max_z"))


# ---------------------------------------------------------------- reports

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{b}' AS a, '{a}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]))
def correlation_matrix(spark, sf_dir):
    return reports.correlation_matrix(table(spark, sf_dir, "lineitem"), _NUMBERS)


@query("""SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75
FROM (SELECT event_type, CASE WHEN value <> -1 THEN value END AS v FROM events) GROUP BY event_type""")
def class_distribution(spark, sf_dir):
    out = reports.class_distribution(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "q25", "q50", "q75")])


@query("""WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)
SELECT feature, round(avg(abs(value)), 4) AS importance FROM u GROUP BY feature ORDER BY importance DESC LIMIT 3""")
def attribution_topk(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select(*_NUMBERS).unpivot([], _NUMBERS, "feature", "value")
    return reports.attribution_topk(long, 3).select("feature", F.round("importance", 4).alias("importance"))


@query("""WITH m AS (SELECT l_returnflag AS c, avg(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT 'quantity' AS metric, round(a.quantity, 6) AS base, round(b.quantity, 6) AS other, round(b.quantity - a.quantity, 6) AS delta FROM m a, m b WHERE a.c = 'A' AND b.c = 'R'
UNION ALL SELECT 'tax', round(a.tax, 6), round(b.tax, 6), round(b.tax - a.tax, 6) FROM m a, m b WHERE a.c = 'A' AND b.c = 'R'""")
def metric_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    out = reports.metric_deltas(rows, "l_returnflag", "A", "R", ["quantity", "tax"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("base", "other", "delta")])


@query("""SELECT event_type, (CASE WHEN value < 10 THEN 0 WHEN value >= 90 THEN 9 ELSE floor((value - 10) / 10) + 1 END)::BIGINT AS bin, count(*) AS count FROM events GROUP BY ALL""")
def histogram(spark, sf_dir):
    return reports.histogram(table(spark, sf_dir, "events"), "event_type", "value", 10.0, 90.0, 8)


# ---------------------------------------------------------------- evaluation

_SCORES = {"y": "quality", "p": "(n_chars % 997 + 1) / 1000.0D", "p2": "(n_chars * 7 % 991 + 1) / 1000.0D"}
_PRED = "d AS (SELECT doc_id, max(quality)::INT AS y FROM labels GROUP BY doc_id), pred AS (SELECT doc_id, y, (n_chars % 997 + 1) / 1000.0::DOUBLE AS p, (n_chars * 7 % 991 + 1) / 1000.0::DOUBLE AS p2 FROM d JOIN documents USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    joined = known.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.selectExpr("doc_id", "y", f"{_SCORES['p']} AS p", f"{_SCORES['p2']} AS p2")


_GRID = "[" + ", ".join(f"{x!r}::DOUBLE" for x in metrics.grid()) + "]"
_CELLS = "count(*) FILTER (y = 1 AND p >= thr) AS tp, count(*) FILTER (y = 0 AND p >= thr) AS fp, count(*) FILTER (y = 1 AND p < thr) AS fn, count(*) FILTER (y = 0 AND p < thr) AS tn"
_MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt(((tp + fp) * (tp + fn))::DOUBLE * ((tn + fp) * (tn + fn))) END"
_THR = f"""{_PRED}, g AS (SELECT unnest({_GRID}) AS thr, unnest(range(393)) AS i), c AS (SELECT i, thr, {_CELLS} FROM g, pred GROUP BY i, thr),
k AS (SELECT *, {_MCC} AS mcc, tp / nullif(tp + fn, 0) AS recall FROM c)"""


_BOTH = f"{_PRED}, b AS (SELECT 'a' AS config, doc_id % 3 AS model, y, p FROM pred UNION ALL SELECT 'b', doc_id % 3, y, p2 FROM pred)"


def both_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations of three models each."""
    pred, model = predictions(spark, sf_dir), (F.col("doc_id") % 3).alias("model")
    return pred.select(F.lit("a").alias("config"), model, "y", "p").unionByName(pred.select(F.lit("b").alias("config"), model, "y", F.col("p2").alias("p")))


@query(f"""WITH {_BOTH}, e AS (SELECT config, model, {', '.join(f'quantile_cont(p, {i / 10}) AS e{i}' for i in range(1, 10))} FROM b GROUP BY ALL),
x AS (SELECT config, model, {' + '.join(f'(CASE WHEN e{i} < p THEN 1 ELSE 0 END)' for i in range(1, 10))} AS bin, p, y FROM b JOIN e USING (config, model))
SELECT config, model, bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM x GROUP BY ALL""")
def calibration_by_model(spark, sf_dir):
    out = metrics.calibration_bins(both_predictions(spark, sf_dir), keys=["config", "model"])
    return out.select("config", "model", "bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@query(" UNION ALL ".join(f"""SELECT l_returnflag, l_linestatus, '{c}' AS feature, count(v) AS n, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.95), 6) AS q95
FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = {i} THEN NULL ELSE {c} END AS v FROM lineitem) GROUP BY ALL""" for i, c in enumerate(_NUMBERS, 1)))
def grouped_quantiles(spark, sf_dir):
    """Quantiles of four columns by two keys, all in the same rounds."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", *[F.when(F.col("l_linenumber") != i, F.col(c)).alias(c) for i, c in enumerate(_NUMBERS, 1)])
    found = ranks.quantiles(df, ["l_returnflag", "l_linestatus"], _NUMBERS, [0.05, 0.5, 0.95])
    return found.select("l_returnflag", "l_linestatus", F.col("column").alias("feature"), "n", *[F.round(F.col("values")[i], 6).alias(f"q{q}") for i, q in enumerate(("05", "50", "95"))])


@query(f"WITH {_PRED} SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, sum(count(*) FILTER (y = 1)) OVER (ORDER BY p DESC)::BIGINT AS tp, sum(count(*) FILTER (y = 0)) OVER (ORDER BY p DESC)::BIGINT AS fp FROM pred GROUP BY p")
def roc_points(spark, sf_dir):
    return metrics.curve_points(predictions(spark, sf_dir))


@query(f"""WITH {_PRED}, t AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM pred GROUP BY p),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM t)
SELECT p, round(tp / (SELECT sum(pos) FROM t), 9) AS tpr, round(fp / (SELECT sum(neg) FROM t), 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM c""")
def curve_table(spark, sf_dir):
    return reports.curves(predictions(spark, sf_dir)).select("p", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "precision")])


@query(f"""WITH {_PRED}, t AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM pred GROUP BY p),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM t)
SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 9) AS auroc, round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 9) AS auprc FROM c""")
def ranking_scores(spark, sf_dir):
    return metrics.ranking_scores(predictions(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))


@query(f"WITH {_THR} SELECT i::INT AS i, thr, tp, fp, fn, tn FROM c")
def threshold_scan(spark, sf_dir):
    return metrics.threshold_counts(predictions(spark, sf_dir))


@query(f"""WITH {_THR}, b AS (SELECT *, tp / nullif(tp + fp, 0) AS precision FROM k)
SELECT thr, false AS feasible FROM b ORDER BY coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0) DESC, i LIMIT 1""")
def threshold_infeasible(spark, sf_dir):
    """No threshold reaches a recall of more than 1: the largest F-beta counts."""
    return metrics.select_threshold(predictions(spark, sf_dir), floor=1.1)


@query(f"WITH {_THR} SELECT thr, true AS feasible FROM k WHERE recall >= 0.9 ORDER BY mcc DESC, i LIMIT 1")
def threshold_choice(spark, sf_dir):
    return metrics.select_threshold(predictions(spark, sf_dir))


@query(f"""WITH {_PRED}, s AS (SELECT *, 0.3::DOUBLE AS thr FROM pred), a AS (SELECT {_CELLS}, avg((p - y) ** 2) AS brier FROM s), x AS (SELECT {_CELLS}, count(*) AS n FROM s WHERE abs(p - thr) >= 0.1),
u AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM pred GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM u),
v AS (SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 4) AS auroc, round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 4) AS auprc FROM c)
SELECT round(a.brier, 6) AS brier, a.tp, a.fp, a.fn, a.tn, round(a.tp / (a.tp + a.fp), 4) AS precision, round(a.tp / (a.tp + a.fn), 4) AS recall, round(2 * a.tp / (2 * a.tp + a.fp + a.fn), 4) AS f1,
round(x.n / (SELECT count(*) FROM s), 4) AS coverage, round(x.tp / (x.tp + x.fn), 4) AS s_recall, round(x.tp / (x.tp + x.fp), 4) AS s_precision,
(SELECT round({_MCC}, 4) FROM a) AS mcc, (SELECT round({_MCC}, 4) FROM x) AS s_mcc, v.auroc, v.auprc FROM a, x, v""")
def metric_suite(spark, sf_dir):
    thresholds = spark.range(1).select(F.lit(0.3).alias("thr"))
    out = metrics.evaluate(predictions(spark, sf_dir), thresholds)
    block = {"coverage": "coverage", "s_recall": "recall", "s_precision": "precision", "s_mcc": "mcc"}
    return out.select("mcc", "auroc", "auprc", "brier", "tp", "fp", "fn", "tn", "precision", "recall", "f1", *[F.col(f"selective.{c}").alias(n) for n, c in block.items()])


@query(f"""WITH {_PRED}, s AS (SELECT y, (p >= 0.5)::INT AS a, (p2 >= 0.5)::INT AS b FROM pred),
c AS (SELECT count(*) FILTER (a = y AND b <> y) AS n01, count(*) FILTER (a <> y AND b = y) AS n10 FROM s)
SELECT n01, n10, CASE WHEN n01 + n10 < 25 THEN least(n01, n10)::DOUBLE ELSE (abs(n01 - n10) - 1) ** 2 / (n01 + n10)::DOUBLE END AS statistic FROM c""")
def mcnemar_counts(spark, sf_dir):
    pairs = predictions(spark, sf_dir).selectExpr("y", "int(p >= 0.5) AS a", "int(p2 >= 0.5) AS b")
    return metrics.mcnemar_counts(pairs)


@query(f"""WITH {_PRED}, e AS (SELECT {', '.join(f'quantile_cont(p, {i / 10}) AS e{i}' for i in range(1, 10))} FROM pred),
b AS (SELECT {' + '.join(f'(CASE WHEN e{i} < p THEN 1 ELSE 0 END)' for i in range(1, 10))} AS bin, p, y FROM pred, e)
SELECT bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM b GROUP BY bin""")
def calibration_bins(spark, sf_dir):
    return metrics.calibration_bins(predictions(spark, sf_dir)).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


_TEMPERATURES = [1.0 + i * 0.25 for i in range(17)]


@query(f"""WITH {_PRED}, t AS (SELECT unnest({_TEMPERATURES!r}::DOUBLE[]) AS temperature), z AS (SELECT y, ln(p / (1 - p)) AS z FROM pred)
SELECT temperature, round(avg(greatest(z / temperature, 0) - z / temperature * y + ln(1 + exp(-abs(z / temperature)))), 8) AS loss FROM z, t GROUP BY temperature""")
def temperature_grid(spark, sf_dir):
    logits = predictions(spark, sf_dir).select("y", S.logit(F.col("p")).alias("z"))
    return metrics.log_losses(logits, _TEMPERATURES).select("temperature", F.round("loss", 8).alias("loss"))


@query(f"""WITH {_PRED} SELECT doc_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(p2 / (1 - p2))) / 2)), 9) AS p FROM pred""")
def ensemble_logits(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    members = pred.select("doc_id", S.logit(F.col("p")).alias("z")).unionByName(pred.select("doc_id", S.logit(F.col("p2")).alias("z")))
    return metrics.ensemble(members, "doc_id").select("doc_id", F.round("p", 9).alias("p"))


@query(f"""WITH {_PRED}, t AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM pred GROUP BY p),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) / (SELECT sum(pos) FROM t) AS tpr, sum(neg) OVER (ORDER BY p DESC) / (SELECT sum(neg) FROM t) AS fpr FROM t)
SELECT p, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM c WHERE (SELECT max(tpr) FROM c) >= 0.9 ORDER BY abs(tpr - 0.9), p DESC LIMIT 1""")
def operating_point(spark, sf_dir):
    return metrics.operating_point(predictions(spark, sf_dir)).select("p", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("SELECT quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.99) AS q99 FROM lineitem")
def exact_quantiles(spark, sf_dir):
    found = ranks.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99])
    return spark.createDataFrame([tuple(found)], "q10 double, q50 double, q99 double")


# ---------------------------------------------------------------- models and streams


def _features(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    counts = {"upper": "[A-Z]", "marks": r"[^\w\s]", "lines": "\n"}
    return docs.join(known, "doc_id").select("doc_id", "source", "y", F.col("n_chars").cast("double").alias("n_chars"), *[(F.regexp_count("text", F.lit(r)) / F.greatest(F.col("n_chars"), F.lit(1))).alias(c) for c, r in counts.items()])


@query()
def oof_predict(spark, sf_dir):
    """Out-of-fold boosted trees by source; the prepared features are written first, as every fold reads them."""
    from lociflow.operators import models

    path = new_folder(spark, "features")
    _features(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    return models.oof_predict(rows, "doc_id", "source", "y", ["n_chars", "upper", "marks", "lines"])


@query()
def tree_attributions(spark, sf_dir):
    """Attributions of every labelled document's features under one fitted model, in rows of (doc_id, feature, value)."""
    from lociflow.operators import attributions, models

    path, features = new_folder(spark, "features"), ["n_chars", "upper", "marks", "lines"]
    _features(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    return attributions.attributions(models.Scorer(features, "y", maxIter=20).fit(rows), rows, "doc_id")


@query()
def embedding_view(spark, sf_dir):
    from lociflow.operators import models

    return models.project(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _streamed(spark: SparkSession, sf_dir: str, name: str):
    """A stream over one Parquet table, and a new folder for its output."""
    # A stream's source is a folder; a table that is one file is picked out of its folder by name.
    at, schema = f"{sf_dir}/{name}.parquet", spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = slices.file_stream(spark, at, schema) if is_folder else slices.file_stream(spark, sf_dir, schema, name_filter=f"{name}.parquet")
    return stream, new_folder(spark, "stream")


_EVENT = "CASE WHEN event_type = 'purchase' THEN 1 WHEN value < 10 THEN 0 ELSE -1 END AS label"


@query(f"SELECT event_id, event_type, {_EVENT} FROM events")
def stream_label(spark, sf_dir):
    stream, out = _streamed(spark, sf_dir, "events")
    slices.append_all(stream, lambda df: df.selectExpr("event_id", "event_type", _EVENT), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    stream, out = _streamed(spark, sf_dir, "events")
    slices.running_counts(stream, ["event_type"], f"{out}/counts", f"{out}/state")
    return slices.latest(spark, f"{out}/counts")


@query("SELECT event_id, c_custkey, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_enrich(spark, sf_dir):
    stream, out = _streamed(spark, sf_dir, "events")
    dim = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    slices.append_all(stream, lambda df: df.join(dim, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_custkey", "c_mktsegment"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


@query("SELECT DISTINCT user_id FROM events")
def stream_keep_first(spark, sf_dir):
    """Which of a user's rows arrives first is the stream's affair; every user has one."""
    stream, out = _streamed(spark, sf_dir, "events")
    slices.append_all(slices.keep_first(stream, ["user_id"]), lambda df: df.select("user_id"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def stream_keep_best(spark, sf_dir):
    """Events arrive in several files; the best of each (user, type) is the batch operator's."""
    rows, out = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), new_folder(spark, "stream")
    rows.repartition(5, "event_id").write.parquet(f"{out}/in")
    keys, order = ["user_id", "event_type"], [F.col("value").desc_nulls_last(), F.col("event_id")]
    slices.keep_best_arriving(slices.file_stream(spark, f"{out}/in", rows.schema, 2), keys, order, f"{out}/best", f"{out}/state", runs=2)
    return slices.best_so_far(spark, f"{out}/best", keys, order)


@query(f"""WITH {_PRED} SELECT 1 AS version, 'a' AS config, doc_id, y, p FROM pred UNION ALL SELECT 1, 'b', doc_id, y, p FROM pred
UNION ALL SELECT 2, 'a', doc_id, y, p FROM pred UNION ALL SELECT 2, 'b', doc_id, y, p2 FROM pred""")
def prediction_versions(spark, sf_dir):
    """Two configurations are stored, one of them again; both versions are read."""
    path, pred = new_folder(spark, "versions"), predictions(spark, sf_dir)
    rows = lambda config, p: pred.select(F.lit(config).alias("config"), F.lit("m").alias("model"), "doc_id", "y", F.col(p).alias("p"))
    numbers = [tables.upsert_versioned(rows("a", "p").unionByName(rows("b", "p")), path), tables.upsert_versioned(rows("b", "p2"), path)]
    first, second = (Snapshots(spark, path).read(n).withColumn("version", F.lit(i)) for i, n in enumerate(numbers, 1))
    return first.unionByName(second).select("version", "config", "doc_id", "y", "p")


_RECORD = """concat('ID   O', o_orderkey, '\\nAC   C', o_custkey, '; X;\\nGN   Name=', replace(o_orderpriority, ' ', '_'), ' {E};\\n', features, 'SQ   SEQUENCE\\n     ', substr(repeat('ACDEF', 9), 1, cast(o_orderkey % 40 AS int)), '\\n     MKV')"""


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n_features, sum(l_linenumber)::BIGINT AS starts, sum(l_linenumber + cast(l_quantity AS BIGINT))::BIGINT AS ends FROM lineitem GROUP BY l_orderkey)
SELECT 'O' || o_orderkey AS entry, 'C' || o_custkey AS accession, replace(o_orderpriority, ' ', '_') AS gene, (o_orderkey % 40)::BIGINT + 3 AS residues, coalesce(n_features, 0) AS n_features, coalesce(starts, 0) AS starts, coalesce(ends, 0) AS ends
FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def record_files(spark, sf_dir):
    """Orders with their lines, written as flat files of records and read back."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey", "concat('FT   DOMAIN          ', l_linenumber, '..', cast(l_linenumber + l_quantity AS bigint), '\\n') AS ft")
    features = lines.groupBy("o_orderkey").agg(F.array_join(F.collect_list("ft"), "").alias("features"))
    rows = table(spark, sf_dir, "orders").join(features, "o_orderkey", "left").na.fill({"features": ""}).selectExpr(f"{_RECORD} AS value")
    path = new_folder(spark, "records")
    rows.write.option("lineSep", "\n//\n").text(path)
    found = proteins.parse(proteins.read_records(spark, path))
    total = lambda field: F.aggregate("features", F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    return found.select("entry", "accession", "gene", F.length("sequence").cast("bigint").alias("residues"), F.size("features").cast("bigint").alias("n_features"), total("start").alias("starts"), total("end").alias("ends"))


_STRAY = "CASE WHEN page_id % 7 = 0 THEN concat(url, '\\t', 'more') WHEN page_id % 5 = 0 THEN concat('\"', url) ELSE url END"


@query("""SELECT 'good' AS part, page_id::VARCHAR AS page_id, CASE WHEN page_id % 5 = 0 THEN '"' || url ELSE url END AS url FROM pages WHERE page_id % 7 <> 0
UNION ALL SELECT 'bad', 'all', count(*)::VARCHAR FROM pages WHERE page_id % 7 = 0""")
def checked_scan(spark, sf_dir):
    """Pages written as tab-separated text with stray quotes and tabs: what can be read comes back, the other lines are counted."""
    path = new_folder(spark, "checked")
    lines = table(spark, sf_dir, "pages").selectExpr(f"concat(page_id, '\\t', {_STRAY}) AS `page_id\turl`")
    tables.write_table(lines, f"{path}/pages", kind="csv", sep="\u0001", quote="\u0000", emptyValue="")
    good, rejected = tables.read_checked(spark, f"{path}/pages")
    count = tables.quarantine(rejected, f"{path}/rejected").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("string").alias("url"))
    return good.select(F.lit("good").alias("part"), "page_id", "url").unionByName(count.select(F.lit("bad").alias("part"), F.lit("all").alias("page_id"), "url"))


@query(f"WITH {_PRED} SELECT 'a' AS config, 'm' AS model, doc_id, y, p FROM pred UNION ALL SELECT 'b', 'm', doc_id, y, p2 FROM pred")
def prediction_upsert(spark, sf_dir):
    """Two configurations are stored, the second of them is written again, and the store is read back."""
    path, pred = new_folder(spark, "predictions"), predictions(spark, sf_dir)
    rows = lambda config, p: pred.select(F.lit(config).alias("config"), F.lit("m").alias("model"), "doc_id", "y", F.col(p).alias("p"))
    tables.upsert_predictions(rows("a", "p").unionByName(rows("b", "p")), path)
    tables.upsert_predictions(rows("b", "p2"), path)
    return spark.read.parquet(path).select("config", "model", "doc_id", "y", "p")
