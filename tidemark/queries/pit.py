"""Queries of the point-in-time core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.operators import pit
from tidemark.queries.base import Registry, text_dates

query = Registry()
QUERIES, SQL = query.queries, query.sql

_MONTHS = "months AS (SELECT symbol, min(d) AS d FROM bars GROUP BY symbol, date_trunc('month', d))"


def month_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.month_firsts(X.bars(spark, sf_dir), keys=["symbol"]).select("symbol", "d")


@query("a18_month_firsts", X.with_views("bars") + ", " + _MONTHS + " SELECT symbol, CAST(d AS VARCHAR) AS d FROM months")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(month_probe(spark, sf_dir))


_J1 = """ SELECT p.symbol, CAST(p.d AS VARCHAR) AS d, max(struct_pack(eff := f.eff, known := f.known, value := f.value)).value AS value
 FROM {probe} p LEFT JOIN facts f ON p.symbol = f.symbol AND f.eff <= p.d AND f.known <= {signal} GROUP BY p.symbol, p.d"""


@query("j1_bitemporal_asof", X.with_views("bars", "facts") + ", " + _MONTHS + _J1.format(probe="months", signal="p.d"))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(pit.bitemporal_asof(month_probe(spark, sf_dir), X.facts(spark, sf_dir), keys=["symbol"], values=["value"]))


@query("j1_bitemporal_asof_signal", X.with_views("bars", "facts") + ", " + _MONTHS + _J1.format(probe="months", signal="p.d - 30"))
def j1_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = month_probe(spark, sf_dir).withColumn("signal", F.date_sub("d", 30))
    return text_dates(pit.bitemporal_asof(probe, X.facts(spark, sf_dir), keys=["symbol"], signal="signal", values=["value"]).drop("signal"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee rules out of orders' priorities: one for each first order of a month, venue and side."""
    o = X.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("V"), F.col("o_custkey") % 3).alias("v"),
        F.element_at(F.array(F.lit("BUY"), F.lit("SELL"), F.lit("BOTH")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("side"),
        F.when(F.col("o_orderpriority").startswith("1"), "STAMP").otherwise("COMMISSION").alias("component"),
        F.to_date("o_orderdate").alias("start"),
        "o_orderkey",
    )
    o = o.withColumn("venue", F.when(F.col("v") == "V0", "ALL").otherwise(F.col("v")))
    best = o.groupBy("venue", "side", "component", F.trunc("start", "month").alias("m")).agg(F.min("start").alias("start"), F.min("o_orderkey").alias("k"))
    return best.select("venue", "side", "component", "start", F.date_add("start", 90).alias("end"), F.date_add("start", (F.col("k") % 5).cast("int")).alias("known"), ((F.col("k") % 1000) / 100000).alias("rate"))


_RULES = """rules AS (SELECT venue, side, component, start, start + 90 AS "end", start + CAST(k % 5 AS INT) AS known, (k % 1000) / 100000 AS rate FROM (
 SELECT CASE WHEN o_custkey % 3 = 0 THEN 'ALL' ELSE 'V' || (o_custkey % 3) END AS venue, CASE o_orderkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'BOTH' END AS side,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'STAMP' ELSE 'COMMISSION' END AS component, min(CAST(o_orderdate AS DATE)) AS start, min(o_orderkey) AS k
 FROM orders GROUP BY 1, 2, 3, date_trunc('month', o_orderdate)))"""


@query(
    "j2_interval_asof",
    "WITH " + _RULES + """, probe AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE + 14 AS d, 'V' || v AS venue FROM orders, (VALUES (1), (2)) t(v)),
 live AS (SELECT d, p.venue, side, component, max(struct_pack(s := start, k := known, v := rate)).v AS rate FROM probe p JOIN rules r ON r.venue IN ('ALL', p.venue)
   AND start <= d AND ("end" IS NULL OR d <= "end") AND known <= d GROUP BY 1, 2, 3, 4)
 SELECT CAST(d AS VARCHAR) AS d, venue, component, s.side AS side, coalesce(max(CASE WHEN live.side = s.side THEN rate END), max(CASE WHEN live.side = 'BOTH' THEN rate END)) AS rate
 FROM live, (VALUES ('BUY'), ('SELL')) s(side) GROUP BY d, venue, component, s.side HAVING count(*) FILTER (WHERE live.side IN (s.side, 'BOTH')) > 0""",
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = X.table(spark, sf_dir, "orders").select(F.date_add(F.trunc("o_orderdate", "month"), 14).alias("d")).distinct()
    probe = days.withColumn("venue", F.explode(F.array(F.lit("V1"), F.lit("V2"))))
    return text_dates(pit.interval_asof(probe.withColumn("signal", F.col("d")), _rules(spark, sf_dir), date="d", signal="signal"))


@query(
    "j2_missing_components",
    "WITH " + _RULES + """, probe AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE + 14 AS d, 'V' || v AS venue FROM orders, (VALUES (1), (2)) t(v))
 SELECT CAST(d AS VARCHAR) AS d, venue, s.side AS side, 'STAMP' AS component FROM probe p, (VALUES ('BUY'), ('SELL')) s(side)
 WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.component = 'STAMP' AND r.venue IN ('ALL', p.venue) AND r.side IN (s.side, 'BOTH') AND start <= d AND d <= "end" AND known <= d)""",
)
def j2_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = X.table(spark, sf_dir, "orders").select(F.date_add(F.trunc("o_orderdate", "month"), 14).alias("d")).distinct()
    probe = days.withColumn("venue", F.explode(F.array(F.lit("V1"), F.lit("V2")))).withColumn("signal", F.col("d"))
    found = pit.interval_asof(probe, _rules(spark, sf_dir), date="d", signal="signal")
    return text_dates(pit.missing_components(probe, found, [("BUY", "STAMP"), ("SELL", "STAMP")], date="d"))


_J3 = """ SELECT p.symbol, CAST(p.d AS VARCHAR) AS d, round(coalesce(sum(cash), 0), 4) AS total FROM months p
 LEFT JOIN cash_events e ON p.symbol = e.symbol AND ex_date <= p.d AND ex_date {op} p.d - 365 AND known <= p.d GROUP BY p.symbol, p.d"""


@query("j3_trailing_sum", X.with_views("bars", "cash_events") + ", " + _MONTHS + _J3.format(op=">"))
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.trailing_sum(month_probe(spark, sf_dir), X.cash_events(spark, sf_dir), keys=["symbol"])
    return text_dates(out.withColumn("total", F.round("total", 4)))


@query("j3_trailing_sum_closed", X.with_views("bars", "cash_events") + ", " + _MONTHS + _J3.format(op=">="))
def j3_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.trailing_sum(month_probe(spark, sf_dir), X.cash_events(spark, sf_dir), keys=["symbol"], lower_inclusive=True)
    return text_dates(out.withColumn("total", F.round("total", 4)))


@query(
    "j4_latest_known",
    X.with_views("facts") + """ SELECT symbol, y AS fiscal_year, CAST(max(struct_pack(known := known, eff := eff, value := value)).eff AS VARCHAR) AS eff,
 CAST(max(struct_pack(known := known, eff := eff, value := value)).known AS VARCHAR) AS known, max(struct_pack(known := known, eff := eff, value := value)).value AS value
 FROM (SELECT *, CAST(year(eff) AS BIGINT) AS y FROM facts WHERE known <= DATE '1997-06-30') GROUP BY 1, 2""",
)
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.facts(spark, sf_dir).withColumn("fiscal_year", F.year("eff").cast("long"))
    return text_dates(pit.latest_known(facts, keys=["symbol", "fiscal_year"], at=F.lit("1997-06-30").cast("date"), order=["eff"]))


@query(
    "j15_next_session",
    """WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders WHERE o_orderkey % 7 = 0), p AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
 SELECT CAST(d AS VARCHAR) AS d, CAST(min(session) AS VARCHAR) AS session FROM p LEFT JOIN s ON session >= d GROUP BY d""",
)
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = X.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.to_date("o_orderdate").alias("session"))
    probe = X.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return text_dates(pit.next_session(probe, sessions))


_CAL = "cal AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS d FROM orders)"
RATE_SIGNAL_SQL = """live AS (SELECT c.d, tenor, bank, max(struct_pack(s := start, r := -rate)).r * -1 AS rate FROM cal c JOIN rates r ON start <= c.d AND c.d <= "end" AND known <= c.d GROUP BY 1, 2, 3),
 by_tenor AS (SELECT d, tenor, median(rate) AS rate, count(*) AS banks FROM live GROUP BY 1, 2 HAVING count(*) >= 2),
 pref AS (SELECT *, tenor = CASE WHEN d <= DATE '2017-12-31' THEN 3 ELSE 5 END AS own FROM by_tenor),
 rate_signal AS (SELECT d, rate, tenor, CASE WHEN own THEN 'OBSERVED' ELSE 'TENOR_FALLBACK' END AS quality, banks FROM pref WHERE own OR tenor = 3
   QUALIFY row_number() OVER (PARTITION BY d ORDER BY own DESC) = 1)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("d")).distinct()


@query(
    "a19_rate_signal",
    X.with_views("rates") + f""", real AS (SELECT * FROM rates WHERE NOT (bank % 5 = 0 AND day(start) < 4)), {_CAL}, """ + RATE_SIGNAL_SQL.replace("JOIN rates r", "JOIN real r") + " SELECT CAST(d AS VARCHAR) AS d, round(rate, 8) AS rate, tenor, quality, banks FROM rate_signal",
)
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = X.rates(spark, sf_dir).withColumn("synthetic", (F.col("bank") % 5 == 0) & (F.day("start") < 4))
    out = pit.rate_signal(calendar(spark, sf_dir), observed, synthetic="synthetic")
    return text_dates(out.withColumn("rate", F.round("rate", 8)))


@query(
    "a20_one_per_bank",
    X.with_views("rates") + """ SELECT bank, tenor, CAST(start AS VARCHAR) AS start, rate, minimum, product, count(*) OVER (PARTITION BY bank, tenor, start) AS candidates FROM rates
 QUALIFY row_number() OVER (PARTITION BY bank, tenor, start ORDER BY minimum NULLS LAST, rate, product) = 1""",
)
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.rates(spark, sf_dir).select("bank", "tenor", "start", "rate", "minimum", "product")
    return text_dates(pit.one_per_bank(rows, keys=["bank", "tenor", "start"]))


@query(
    "a21_unique_rates",
    X.with_views("rates") + " SELECT bank, tenor, CAST(start AS VARCHAR) AS start, max(rate) AS rate FROM rates GROUP BY bank, tenor, start HAVING count(DISTINCT rate) = 1",
)
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(pit.unique_rates(X.rates(spark, sf_dir), keys=["bank", "tenor", "start"]))


@query(
    "a22_monthly_series",
    X.with_views("rates") + """, months AS (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS month FROM lineitem),
 best AS (SELECT date_trunc('month', start)::DATE AS month, bank, tenor, rate, product FROM rates
   QUALIFY row_number() OVER (PARTITION BY date_trunc('month', start) ORDER BY tenor DESC, bank, minimum IS NULL, minimum, rate, product) = 1)
 SELECT CAST(m.month AS VARCHAR) AS month, bank, tenor, rate, product, CASE WHEN b.month IS NULL THEN 'GAP' ELSE 'OBSERVED' END AS status FROM months m FULL JOIN best b ON m.month = b.month
 WHERE m.month IS NOT NULL UNION ALL SELECT CAST(month AS VARCHAR), bank, tenor, rate, product, 'OBSERVED' FROM best WHERE month NOT IN (SELECT month FROM months)""",
)
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.rates(spark, sf_dir).withColumn("month", F.trunc("start", "month"))
    months = X.table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"))
    order = [-F.col("tenor"), "bank", F.col("minimum").isNull(), "minimum", "rate", "product"]
    return text_dates(pit.monthly_series(rows, months, order=order, values=["bank", "tenor", "rate", "product"]))


@query(
    "w19_resolved_when_later",
    X.with_views("fiscal_years") + """ SELECT symbol, CAST(fiscal_year AS BIGINT) AS fiscal_year, total, CAST(known AS VARCHAR) AS known,
 CAST(min(known) OVER (PARTITION BY symbol ORDER BY fiscal_year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS VARCHAR) AS resolved_at FROM fiscal_years""",
)
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = X.fiscal_years(spark, sf_dir).withColumn("fiscal_year", F.col("fiscal_year").cast("long"))
    return text_dates(pit.resolved_when_later(years, keys=["symbol"]))


MEDIAN_SQL = """newest AS (SELECT p.symbol, p.d, total, row_number() OVER (PARTITION BY p.symbol, p.d ORDER BY fiscal_year DESC) AS r FROM months p
   JOIN known_years y ON p.symbol = y.symbol AND y.known <= p.d QUALIFY r <= 3),
 med AS (SELECT p.symbol, p.d, m.median FROM months p LEFT JOIN (SELECT symbol, d, CASE WHEN count(*) = 3 THEN median(total) END AS median FROM newest GROUP BY 1, 2) m USING (symbol, d))"""
KNOWN_YEARS_SQL = "known_years AS (SELECT symbol, fiscal_year, total, CAST(fiscal_year || '-12-31' AS DATE) + 120 AS known FROM fiscal_years)"


def known_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years that are known 120 days after their end."""
    return X.fiscal_years(spark, sf_dir).withColumn("known", F.date_add(F.make_date("fiscal_year", F.lit(12), F.lit(31)), 120))


@query("w20_median_of_newest", X.with_views("bars", "fiscal_years") + f", {_MONTHS}, {KNOWN_YEARS_SQL}, {MEDIAN_SQL} SELECT symbol, CAST(d AS VARCHAR) AS d, round(median, 6) AS median FROM med")
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.median_of_newest(month_probe(spark, sf_dir), known_years(spark, sf_dir), keys=["symbol"])
    return text_dates(out.withColumn("median", F.round("median", 6)))
