"""Queries of the composed signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.fixtures import rnd
from tidemark.plans import signals as sg
from tidemark.queries import pit as q
from tidemark.queries.base import Registry, text_dates

query = Registry()
QUERIES, SQL = query.queries, query.sql

_TTM = """ttm AS (SELECT p.symbol, p.d, round(coalesce(sum(cash), 0), 8) AS d_ttm FROM months p LEFT JOIN cash_events e ON p.symbol = e.symbol AND ex_date <= p.d AND ex_date > p.d - 365 AND known <= p.d {special} GROUP BY 1, 2)"""
_DIV = f"{q._MONTHS}, {q.KNOWN_YEARS_SQL}, {q.MEDIAN_SQL}, {_TTM}, div AS (SELECT m.symbol, m.d, CASE WHEN median IS NOT NULL THEN d_ttm END AS d_ttm, median AS d_med3, CASE WHEN median IS NOT NULL THEN least(d_ttm, median) END AS d_cons FROM med m JOIN ttm USING (symbol, d))"


def _dividends(spark: SparkSession, sf_dir: str, special: bool) -> DataFrame:
    return sg.conservative_dividend(q.month_probe(spark, sf_dir), X.cash_events(spark, sf_dir), q.known_years(spark, sf_dir), keys=["symbol"], include_special=special)


_DIV_OUT = " SELECT symbol, CAST(d AS VARCHAR) AS d, round(d_ttm, 6) AS d_ttm, round(d_med3, 6) AS d_med3, round(d_cons, 6) AS d_cons FROM div"


@query("g2_conservative_dividend", X.with_views("bars", "cash_events", "fiscal_years") + ", " + _DIV.format(special="") + _DIV_OUT)
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _dividends(spark, sf_dir, True)
    return text_dates(out.select("symbol", "d", *[F.round(c, 6).alias(c) for c in ("d_ttm", "d_med3", "d_cons")]))


@query("g2_without_special", X.with_views("bars", "cash_events", "fiscal_years") + ", " + _DIV.format(special="AND kind <> 'SPECIAL'") + _DIV_OUT)
def g2_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _dividends(spark, sf_dir, False)
    return text_dates(out.select("symbol", "d", *[F.round(c, 6).alias(c) for c in ("d_ttm", "d_med3", "d_cons")]))


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close is scaled to a share price that a tax-rate dividend can yield on."""
    bars = X.bars(spark, sf_dir).withColumn("close", F.col("close") / 1000)
    frame, _ = sg.security_day(bars, facts=X.facts(spark, sf_dir), events=X.cash_events(spark, sf_dir), years=q.known_years(spark, sf_dir), rates=X.rates(spark, sf_dir), quality=F.col("value") > 20000)
    return frame


_SIGNAL = (
    X.with_views("bars", "facts", "cash_events", "fiscal_years", "rates")
    + ", " + _DIV.format(special="") + ", cal AS (SELECT DISTINCT d FROM months), " + q.RATE_SIGNAL_SQL
    + """, roll AS (SELECT symbol, d, close / 1000 AS close, median(amount) OVER (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING) AS median_amount FROM bars),
 fact AS (SELECT p.symbol, p.d, max(struct_pack(eff := f.eff, known := f.known, value := f.value)).value AS value FROM months p LEFT JOIN facts f ON p.symbol = f.symbol AND f.eff <= p.d AND f.known <= p.d GROUP BY 1, 2),
 x AS (SELECT m.symbol, m.d, close, median_amount, value, d_ttm, d_med3, d_cons, rate, quality, value > 20000 AS ok, d_cons / close AS y, rate + CAST(0.03 AS DOUBLE) AS hurdle
   FROM months m JOIN roll USING (symbol, d) JOIN fact USING (symbol, d) JOIN div USING (symbol, d) LEFT JOIN rate_signal USING (d)),
 frame AS (SELECT *, ok IS NULL OR d_ttm IS NULL OR d_med3 IS NULL OR rate IS NULL AS gap FROM x)"""
)
_DECISION = "CASE WHEN gap THEN 'DATA_GAP' WHEN NOT ok THEN 'REJECT' WHEN y >= hurdle THEN 'ENTRY_ELIGIBLE' ELSE 'REJECT' END"
_HELD = "CASE WHEN gap THEN 'DATA_GAP' WHEN NOT ok THEN 'REJECT' WHEN y >= hurdle THEN 'HOLD' ELSE 'EXIT' END"


@query(
    "g1_security_day",
    _SIGNAL + f""" SELECT symbol, CAST(d AS VARCHAR) AS d, round(median_amount, 4) AS median_amount, value, round(d_ttm, 6) AS d_ttm, round(d_med3, 6) AS d_med3, round(rate, 8) AS rate,
 {_DECISION} AS decision, CASE WHEN NOT gap THEN round(y - hurdle, 6) END AS buffer, CASE WHEN NOT gap THEN round(d_cons / hurdle, 6) END AS maximum_price FROM frame""",
)
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _frame(spark, sf_dir)
    rounded = {"median_amount": 4, "d_ttm": 6, "d_med3": 6, "rate": 8, "buffer": 6, "maximum_price": 6}
    return text_dates(out.select("symbol", "d", "value", "decision", *[F.round(c, n).alias(c) for c, n in rounded.items()]))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sg.decide(F.lit(True), known_late=F.lit(False), quality_pass=F.col("value") > 20000, d_ttm=F.col("d_ttm"), d_med3=F.col("d_med3"), close=F.col("close"), rate=F.col("rate"), rate_quality=F.col("quality"))
    frame = _frame(spark, sf_dir).drop(*made)
    return frame.withColumns(made)


@query("g3_decision_held", _SIGNAL + f" SELECT symbol, CAST(d AS VARCHAR) AS d, {_HELD} AS decision, CASE WHEN NOT gap THEN round(y, 6) END AS yield FROM frame")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(_held(spark, sf_dir).select("symbol", "d", "decision", F.round("yield", 6).alias("yield")))


@query(
    "g4_prescreen",
    _SIGNAL + """ SELECT symbol, status, count(*) AS days, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last FROM (SELECT symbol, d,
 CASE WHEN close IS NULL OR close <= 0 THEN 'BLOCKED_PRICE' WHEN rate IS NULL THEN 'BLOCKED_CD_RATE' WHEN d_ttm <= 0 THEN 'DEFINITELY_INELIGIBLE_NO_TTM_DIVIDEND' WHEN d_ttm / close < rate + CAST(0.03 AS DOUBLE) THEN 'DEFINITELY_INELIGIBLE_UPPER_BOUND' ELSE 'POTENTIAL_ENTRY_REQUIRES_D_MED3_AND_QUALITY_GATE' END AS status FROM frame)
 GROUP BY 1, 2""",
)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, sf_dir).select("symbol", "d", sg.prescreen(F.col("close"), F.col("d_ttm"), F.col("rate")).alias("status"))
    return text_dates(rows.groupBy("symbol", "status").agg(F.count("*").alias("days"), F.min("d").alias("first"), F.max("d").alias("last")))


@query(
    "g5_first_exit",
    _SIGNAL + f""", s AS (SELECT symbol, d, {_HELD} AS decision FROM frame), h AS (SELECT symbol, min(d) + 400 AS entry FROM s GROUP BY 1),
 e AS (SELECT h.symbol, h.entry, min(CASE WHEN decision = 'EXIT' THEN d END) AS exit_date FROM h LEFT JOIN s ON s.symbol = h.symbol AND s.d > h.entry GROUP BY 1, 2)
 SELECT e.symbol, CAST(entry AS VARCHAR) AS entry, CAST(exit_date AS VARCHAR) AS exit_date, (SELECT count(*) FROM s WHERE s.symbol = e.symbol AND s.d > e.entry AND s.decision = 'DATA_GAP' AND (e.exit_date IS NULL OR s.d < e.exit_date)) AS gap_days FROM e""",
)
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _held(spark, sf_dir).select("symbol", "d", "decision")
    months = q.month_probe(spark, sf_dir).where("d IS NOT NULL")  # the days that signals have; the frame is not made again for them
    holdings = months.groupBy("symbol").agg(F.date_add(F.min("d"), 400).alias("entry"))
    return text_dates(sg.first_exit(holdings, signals, key="symbol", entry="entry"))


@query(
    "g6_quality_gate",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus = 'F' AND NOT o_custkey % 11 = 0 AND o_totalprice - 1000 > 0 AND o_custkey % 8 <= 5 AND o_orderkey % 400 >= 150 AND o_custkey % 20 >= 10.5
 ELSE o_orderstatus = 'F' AND NOT o_custkey % 11 = 0 AND o_totalprice - 1000 > 0 END AS passed FROM orders""",
)
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = sg.quality_gate(
        F.when(F.col("o_orderstatus") == "F", "STANDARD_UNQUALIFIED").otherwise("QUALIFIED"),
        F.col("o_custkey") % 11 == 0,
        F.col("o_totalprice") - 1000,
        bank=F.col("o_orderpriority").startswith("1"),
        npl=F.col("o_custkey") % 8,
        cover=F.col("o_orderkey") % 400,
        capital=F.col("o_custkey") % 20,
    )
    return X.table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("passed"))


@query(
    "g7_readiness",
    """WITH b AS (SELECT DISTINCT 'POLICY_' || o_orderpriority AS blocker, 'POLICY' AS source FROM orders WHERE o_orderstatus = 'P' UNION ALL
 SELECT 'DATASET_NOT_READY_' || l_suppkey, 'DATASET' FROM lineitem GROUP BY l_suppkey HAVING NOT (min(CAST(l_shipdate AS DATE)) <= DATE '1995-01-05' AND count(*) > 500))
 SELECT blocker, source, (SELECT count(*) = 0 FROM b) AS executable FROM b""",
)
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    blockers = X.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("POLICY_"), "o_orderpriority").alias("blocker"), F.lit(True).alias("open")).distinct()
    lines = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("dataset"))
    coverage = lines.agg(((F.min(F.to_date("l_shipdate")) <= F.lit("1995-01-05").cast("date")) & (F.count("*") > 500)).alias("ready"))
    return sg.readiness(blockers, coverage)


@query(
    "g8_statutory_rates",
    """WITH s AS (SELECT o_orderpriority AS component, CAST(o_orderdate AS DATE) AS start, max(o_custkey % 100 / 10000) AS rate FROM orders GROUP BY 1, 2),
 d AS (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS d FROM lineitem)
 SELECT CAST(d AS VARCHAR) AS d, component, max(struct_pack(s := start, r := rate)).r AS rate FROM d JOIN s ON start <= d GROUP BY d, component""",
)
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    schedule = o.groupBy(F.col("o_orderpriority").alias("component"), F.to_date("o_orderdate").alias("start")).agg(F.max(F.col("o_custkey") % 100 / 10000).alias("rate"))
    days = X.table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("d"))
    return text_dates(sg.statutory_rates(days, schedule))


@query(
    "g9_factor_rows",
    X.with_views("bars") + f""", r AS (SELECT *, close / lag(close) OVER w - 1 AS r, {rnd("(close / lag(close, 20) OVER w - 1) * 100", 4)} AS momentum20, {rnd("(close / lag(close, 60) OVER w - 1) * 100", 4)} AS momentum60,
  row_number() OVER w AS history_days FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
 SELECT symbol, CAST(d AS VARCHAR) AS d, momentum20, momentum60, history_days, CASE WHEN count(r) OVER w = 20 THEN {rnd("list_aggregate(list(r) OVER w, 'stddev_samp') * sqrt(252) * 100", 4)} END AS volatility,
  CASE WHEN count(amount) OVER w = 20 THEN sum(floor(amount) * 20) OVER w / 20 END AS avg_amount FROM r WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)""",
)
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir).select("symbol", "d", "close", (F.floor("amount") * 20).cast("double").alias("amount"))
    out = sg.factor_rows(bars)
    return text_dates(out.drop("close", "amount"))
