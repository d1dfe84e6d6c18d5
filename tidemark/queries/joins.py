"""Queries of the joins between staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.operators import joins
from tidemark.queries.base import Registry, text_dates

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    "j5_exists_counted",
    """SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS with_return
 FROM orders GROUP BY 1""",
)
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    flagged = joins.flag_exists(X.table(spark, sf_dir, "orders"), lines, on=["o_orderkey"], where=F.col("l_returnflag") == "R")
    return flagged.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count_if("present").alias("with_return"))


@query(
    "j6_source_coverage",
    """SELECT c_custkey, a.d IS NOT NULL AS has_early, b.d IS NOT NULL AS has_late, a.d IS NOT NULL OR b.d IS NOT NULL AS covered, CAST(greatest(a.d, b.d) AS VARCHAR) AS latest FROM customer
 LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01' GROUP BY 1) a ON a.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) b ON b.o_custkey = c_custkey""",
)
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("last_date"))
    sources = {"early": o.where("last_date < '1994-01-01'"), "late": o.where("last_date >= '1997-01-01'")}
    return text_dates(joins.coverage_of(X.table(spark, sf_dir, "customer").select("c_custkey"), sources, on=["c_custkey"]))


@query(
    "j7_cross_check",
    """SELECT coalesce(k1, k2) AS o_orderkey, a, b, round(abs(a - b), 2) AS difference, CASE WHEN k2 IS NULL THEN 'ONLY_A' WHEN k1 IS NULL THEN 'ONLY_B' WHEN abs(a - b) <= 1000 THEN 'MATCHED' ELSE 'DIFFERENT' END AS status
 FROM (SELECT o_orderkey AS k1, o_totalprice AS a FROM orders WHERE o_orderkey % 10 <> 0)
 FULL JOIN (SELECT l_orderkey AS k2, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY 1) ON k1 = k2""",
)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return joins.cross_check(a, b, on=["o_orderkey"], value="v", tolerance=1000.0).withColumn("difference", F.round("difference", 2))


@query(
    "j7_key_difference",
    """(SELECT doc_id, 'MISSING' AS status FROM documents EXCEPT SELECT doc_id, 'MISSING' FROM labels)
 UNION ALL (SELECT doc_id, 'EXTRA' FROM labels EXCEPT SELECT doc_id, 'EXTRA' FROM documents)""",
)
def j7_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.key_difference(X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels"), on=["doc_id"])


@query("j8_with_mapping", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = X.table(spark, sf_dir, "nation").join(X.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mapping = nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return joins.with_mapping(X.table(spark, sf_dir, "customer"), mapping, on=["c_nationkey"]).select("c_custkey", "n_name", "r_name")


@query("j9_only_listed", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.only_listed(X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels").where("quality = 1"), on=["doc_id"]).select("doc_id", "lang", "source")


@query("j10_pending", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = X.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pending(X.table(spark, sf_dir, "orders"), done, on=["o_orderkey"]).select("o_orderkey", "o_orderstatus")


def _overrides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels")
    override = labels.select((F.col("doc_id") * 2).alias("doc_id"), F.when(F.col("quality") == 1, "manual").alias("source"), F.when(F.col("toxic") == 1, "xx").alias("lang"))
    twice = labels.where("doc_id % 9 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("twice").alias("source"), F.lit(None).cast("string").alias("lang"))
    return joins.with_override(docs.select("doc_id", "source", "lang"), override.unionByName(twice), on=["doc_id"], columns=["source", "lang"])


_OVERRIDE = """WITH o AS (SELECT doc_id * 2 AS doc_id, CASE WHEN quality = 1 THEN 'manual' END AS source, CASE WHEN toxic = 1 THEN 'xx' END AS lang FROM labels
 UNION ALL SELECT doc_id * 2, 'twice', NULL FROM labels WHERE doc_id % 9 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM o)"""


@query("j11_override", _OVERRIDE + " SELECT d.doc_id, coalesce(n.source, d.source) AS source, coalesce(n.lang, d.lang) AS lang FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND n.n = 1")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overrides(spark, sf_dir)[0]


@query(
    "j11_override_errors",
    _OVERRIDE + " SELECT DISTINCT doc_id, CASE WHEN n > 1 THEN 'DUPLICATE_OVERRIDE' ELSE 'UNKNOWN_OVERRIDE' END AS error FROM n WHERE n > 1 OR doc_id NOT IN (SELECT doc_id FROM documents)",
)
def j11_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overrides(spark, sf_dir)[1]


@query(
    "j12_derived_key_join",
    """SELECT o_orderkey, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 AND l_linestatus = CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))
    lines, known = X.table(spark, sf_dir, "lineitem"), X.table(spark, sf_dir, "supplier").select("s_suppkey")
    both = joins.derived_key_join(X.table(spark, sf_dir, "orders"), lines, {"o_orderkey": ("o_orderkey", "l_orderkey"), "__status": (status, "l_linestatus")})
    both = joins.derived_key_join(both, known, {"s_suppkey": ("l_suppkey", "s_suppkey")})
    return both.groupBy("o_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query(
    "j13_causal_link",
    """WITH k AS (SELECT DISTINCT event_type FROM events), ranked AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS r FROM k),
 e AS (SELECT event_id, user_id, value, CASE r WHEN 1 THEN 'SIGNAL' WHEN 2 THEN 'BUY' ELSE 'SELL' END AS kind FROM events JOIN ranked USING (event_type))
 SELECT x.event_id, x.user_id, x.kind, max(c.event_id) AS cause_id FROM e x LEFT JOIN e c ON c.user_id = x.user_id AND c.event_id < x.event_id AND c.kind = 'SIGNAL'
  AND (x.kind = 'BUY') = (c.value >= 50) WHERE x.kind <> 'SIGNAL' GROUP BY 1, 2, 3""",
)
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = X.table(spark, sf_dir, "events")
    ranked = e.select("event_type").distinct().withColumn("r", F.row_number().over(Window.orderBy("event_type")))  # a few types
    kind = F.when(F.col("r") == 1, "SIGNAL").when(F.col("r") == 2, "BUY").otherwise("SELL")
    rows = e.join(ranked, "event_type").select("event_id", "user_id", "value", kind.alias("kind"))
    linked = joins.causal_link(rows, keys=["user_id"], order=["event_id"], cause="SIGNAL", effects={"BUY": F.col("value") >= 50, "SELL": F.col("value") < 50}, cause_id="event_id")
    return linked.select("event_id", "user_id", "kind", "cause_id")


@query(
    "j14_fallback",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, concat_ws(',', CASE WHEN a.x IS NOT NULL OR a.y IS NOT NULL THEN 'first' END,
 CASE WHEN (a.x IS NULL AND b.x IS NOT NULL) OR (a.y IS NULL AND b.y IS NOT NULL) THEN 'second' END) AS sources
 FROM (SELECT p_partkey AS k, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS x, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS y FROM part WHERE p_partkey % 4 <> 0) a
 FULL JOIN (SELECT l_partkey AS k, round(max(l_extendedprice), 2) AS x, max(l_quantity) AS y FROM lineitem GROUP BY 1) b ON a.k = b.k""",
)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = X.table(spark, sf_dir, "part").where("p_partkey % 4 <> 0")
    a = part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("x"), F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("y"))
    b = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.max("l_extendedprice"), 2).alias("x"), F.max("l_quantity").alias("y"))
    out = joins.with_fallback(a, b, on=["k"], columns=["x", "y"], names=("first", "second"))
    return text_dates(out.withColumn("sources", F.array_join("sources", ",")))
