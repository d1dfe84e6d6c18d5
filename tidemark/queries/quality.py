"""Queries of coverage, profiles and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.operators import quality
from tidemark.queries.base import Registry, text_dates

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    "a1_dataset_coverage",
    X.with_views("facts") + """ SELECT symbol, count(*) AS row_count, CAST(min(eff) AS VARCHAR) AS minimum_date, CAST(max(eff) AS VARCHAR) AS maximum_date, count(known) AS point_in_time_rows,
 count(*) FILTER (WHERE value < 1000) AS synthetic_rows, min(eff) <= DATE '1995-02-01' AND max(eff) >= DATE '1998-06-01' AND count(*) FILTER (WHERE value < 1000) = 0 AND count(known) = count(*) AS ready
 FROM facts GROUP BY 1""",
)
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.facts(spark, sf_dir).withColumn("is_synthetic", F.col("value") < 1000)
    return text_dates(quality.dataset_coverage(rows, start="1995-02-01", end="1998-06-01", eff="eff", known="known", keys=["symbol"]))


@query(
    "a2_profile",
    X.with_views("shipped") + """ SELECT count(*) AS row_count, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, CAST(min(eff) AS VARCHAR) AS first, CAST(max(eff) AS VARCHAR) AS last,
 count(*) FILTER (WHERE l_tax IS NULL) AS null_l_tax, count(*) FILTER (WHERE l_shipdate IS NULL) AS null_l_shipdate, count(*) FILTER (WHERE known > eff) AS known_after_eff,
 count(*) FILTER (WHERE eff BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS window_rows,
 count(DISTINCT CASE WHEN eff BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN (l_orderkey, l_linenumber) END) AS window_keys FROM shipped""",
)
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(quality.profile(X.shipped(spark, sf_dir), keys=["l_orderkey", "l_linenumber"], date="eff", nullable=["l_tax", "l_shipdate"], ordered=[("known", "eff")], window=("1996-01-01", "1996-12-31")))


@query(
    "a3_duplicate_keys",
    """SELECT l_returnflag, CAST(sum(n - 1) AS BIGINT) AS surplus_rows, count(*) AS duplicated_keys FROM
 (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1""",
)
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(X.table(spark, sf_dir, "lineitem"), keys=["l_orderkey", "l_linenumber"], by=["l_returnflag"])


@query(
    "a4_field_coverage",
    X.with_views("cross_section") + """ SELECT asset_type, field, present, total, present / total AS coverage FROM (
 SELECT asset_type, 'roe' AS field, count(roe) AS present, count(*) AS total FROM cross_section GROUP BY 1 UNION ALL
 SELECT asset_type, 'pb', count(pb), count(*) FROM cross_section WHERE asset_type = 'STOCK' GROUP BY 1 UNION ALL
 SELECT asset_type, 'catalyst', count(catalyst), count(*) FROM cross_section WHERE asset_type = 'FUND' GROUP BY 1)""",
)
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_coverage(X.cross_section(spark, sf_dir), {"STOCK": ["roe", "pb"], "FUND": ["roe", "catalyst"]}, kind="asset_type")


@query(
    "a5_yearly_summary",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS row_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1""",
)
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.yearly_summary(X.table(spark, sf_dir, "orders"), date="o_orderdate", counts={"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000})


@query(
    "a6_value_counts",
    """SELECT 'status' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'last_digit', right(CAST(o_custkey AS VARCHAR), 1), count(*) FROM orders GROUP BY 2
 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"status": F.col("o_orderstatus"), "last_digit": F.right(F.col("o_custkey").cast("string"), F.lit(1)), "priority": F.col("o_orderpriority")}
    return quality.value_counts(X.table(spark, sf_dir, "orders"), named)


@query(
    "a7_fiscal_totals",
    X.with_views("cash_events") + " SELECT symbol, CAST(year(ex_date) AS BIGINT) AS fiscal_year, round(sum(cash), 4) AS total, CAST(max(known) AS VARCHAR) AS resolved_at, count(*) AS events FROM cash_events GROUP BY 1, 2",
)
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.cash_events(spark, sf_dir).withColumn("fiscal_year", F.year("ex_date").cast("long"))
    out = quality.fiscal_totals(events, keys=["symbol", "fiscal_year"], value="cash", known="known")
    return text_dates(out.withColumn("total", F.round("total", 4)))


@query(
    "a8_breadth",
    X.with_views("bars") + """ SELECT CAST(d AS VARCHAR) AS d, count(*) FILTER (WHERE c > 0) AS advancing, count(*) FILTER (WHERE c < 0) AS declining, count(*) FILTER (WHERE c = 0) AS unchanged,
 round(sum(CASE WHEN volume > 10 THEN amount END), 2) AS amount FROM (SELECT d, close - open AS c, volume, amount FROM bars) GROUP BY 1""",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = X.bars(spark, sf_dir).select("d", (F.col("close") - F.col("open")).alias("c"), F.when(F.col("volume") > 10, F.col("amount")).alias("amount"))
    return text_dates(quality.breadth(quotes, change="c", amount="amount", keys=["d"]).withColumn("amount", F.round("amount", 2)))


@query(
    "a9_universe_coverage",
    X.with_views("cross_section") + """, c AS (SELECT industry AS exchange, count(*) AS listed, count(last_price) AS quoted, count(*) FILTER (WHERE last_price IS NOT NULL AND pb IS NOT NULL) AS enriched FROM cross_section GROUP BY 1),
 r AS (SELECT *, round(enriched / listed, 6) AS rate FROM c) SELECT *, (SELECT bool_and(rate >= 0.85) FROM r) AS gate_passed FROM r""",
)
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.cross_section(spark, sf_dir).withColumnRenamed("industry", "exchange")
    return quality.universe_coverage(rows, exchange="exchange", quoted=F.col("last_price").isNotNull(), enriched=F.col("last_price").isNotNull() & F.col("pb").isNotNull(), gate=0.85)


@query(
    "a16_event_counts",
    X.with_views("shipped") + """ SELECT symbol, CAST(year(eff) AS BIGINT) AS year, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'R') AS "R"
 FROM shipped GROUP BY 1, 2""",
)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.event_counts(X.shipped(spark, sf_dir), symbol="symbol", at="eff", kind="l_returnflag", kinds=["A", "N", "R"])


@query(
    "a16_last_of_year",
    X.with_views("nav") + " SELECT account, CAST(year(d) AS BIGINT) AS year, max(struct_pack(d := d, s := seq, e := equity)).e AS last_value FROM nav GROUP BY 1, 2",
)
def a16_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.last_of_year(X.nav(spark, sf_dir), symbol="account", at="d", value="equity", tie="seq")


def probe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe log out of events: one probe an hour and user, its event types as endpoints with a status by value."""
    e = X.table(spark, sf_dir, "events").withColumn("at", F.date_trunc("hour", "ts"))
    status = F.when(F.col("value") > 95, "500").otherwise("200")
    calls = e.groupBy("at", "user_id", "event_type").agg(F.max(status).alias("status"), F.max("value").alias("v"))
    return calls.groupBy("at", "user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "status"))).alias("endpoints"),
        F.collect_list(F.when(F.col("v") < 2, F.col("event_type"))).alias("semantic_failures"),
    )


@query(
    "a17_probe_summary",
    """WITH c AS (SELECT date_trunc('hour', ts) AS h, user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3)
 SELECT count(DISTINCT (h, user_id)) AS probes, count(*) FILTER (WHERE v > 95) AS http_failures, count(*) FILTER (WHERE v < 2) AS semantic_failures, count(*) FILTER (WHERE v > 95 OR v < 2) = 0 AS passed FROM c""",
)
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.probe_summary(probe_log(spark, sf_dir))


@query(
    "a23_last_of_key",
    """SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS o_orderkey, max(struct_pack(d := o_orderdate, k := o_orderkey, s := o_orderstatus)).s AS o_orderstatus FROM orders GROUP BY 1""",
)
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return quality.last_of_key(orders, keys=["o_custkey"], order=["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "a24_delivery_gaps",
    """WITH a AS (SELECT o_orderkey AS w, CAST(o_orderkey % 5 + 2 AS BIGINT) AS announced FROM orders), d AS (SELECT l_orderkey AS w, count(DISTINCT l_linenumber) AS delivered FROM lineitem GROUP BY 1)
 SELECT w, announced, coalesce(delivered, 0) AS delivered FROM a LEFT JOIN d USING (w) WHERE coalesce(delivered, 0) <> announced""",
)
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    announced = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("w"), (F.col("o_orderkey") % 5 + 2).alias("announced"))
    return quality.delivery_gaps(X.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "w"), announced, window=["w"], key="l_linenumber", total="announced")
