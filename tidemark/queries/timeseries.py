"""Queries of rolling windows and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.fixtures import rnd
from tidemark.operators import timeseries as ts
from tidemark.queries.base import Registry, text_dates

query = Registry()
QUERIES, SQL = query.queries, query.sql
_K = {"keys": ["symbol"], "order": ["d"]}
_W = "PARTITION BY symbol ORDER BY d"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bars(spark, sf_dir).select("symbol", "d", "close", "amount")


@query("w1_rolling_median", X.with_views("bars") + f" SELECT symbol, CAST(d AS VARCHAR) AS d, round(median(amount) OVER ({_W} ROWS 19 PRECEDING), 4) AS median FROM bars")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(ts.rolling_median(_bars(spark, sf_dir), value="amount", **_K).select("symbol", "d", F.round("median", 4).alias("median")))


@query(
    "w2_sma",
    X.with_views("bars") + " SELECT symbol, CAST(d AS VARCHAR) AS d, " + ", ".join(f"CASE WHEN count(*) OVER ({_W} ROWS {n - 1} PRECEDING) = {n} THEN round(avg(close) OVER ({_W} ROWS {n - 1} PRECEDING), 6) END AS ma{n}" for n in (5, 10, 20, 60)) + " FROM bars",
)
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(ts.sma(_bars(spark, sf_dir), **_K).drop("close", "amount"))


@query(
    "w3_w5_recursive_indicators",
    X.with_views("bars").replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT symbol, d, close, row_number() OVER ({_W}) AS i, close - lag(close) OVER ({_W}) AS m FROM bars),
 r AS (SELECT symbol, i, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS dea, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS l FROM s WHERE i = 1
  UNION ALL SELECT s.symbol, s.i, 2.0 / 13 * close + 11.0 / 13 * e12, 2.0 / 27 * close + 25.0 / 27 * e26,
   0.2 * ((2.0 / 13 * close + 11.0 / 13 * e12) - (2.0 / 27 * close + 25.0 / 27 * e26)) + 0.8 * dea,
   CASE WHEN s.i <= 15 THEN g + greatest(m, 0) / 14 ELSE (g * 13 + greatest(m, 0)) / 14 END, CASE WHEN s.i <= 15 THEN l + greatest(-m, 0) / 14 ELSE (l * 13 + greatest(-m, 0)) / 14 END
  FROM r JOIN s ON s.symbol = r.symbol AND s.i = r.i + 1)
 SELECT r.symbol, CAST(s.d AS VARCHAR) AS d, {rnd('e12', 3)} AS ema12, {rnd('e26', 3)} AS ema26, {rnd('e12 - e26', 3)} AS dif, {rnd('dea', 3)} AS dea, {rnd('2 * (e12 - e26 - dea)', 3)} AS macd,
  CASE WHEN r.i > 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE {rnd('100 - 100 / (1 + g / l)', 3)} END END AS rsi14
 FROM r JOIN s ON s.symbol = r.symbol AND s.i = r.i""",
)
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.recursive_indicators(_bars(spark, sf_dir).drop("amount"), decimals=None, **_K)
    return text_dates(out.select("symbol", "d", *[F.round(c, 3).alias(c) for c in ("ema12", "ema26", "dif", "dea", "macd", "rsi14")]))


@query(
    "w6_bollinger",
    X.with_views("bars") + f""" SELECT symbol, CAST(d AS VARCHAR) AS d, CASE WHEN n = 20 THEN round(m, 6) END AS boll_mid, CASE WHEN n = 20 THEN round(m + 2 * s, 6) END AS boll_upper, CASE WHEN n = 20 THEN round(m - 2 * s, 6) END AS boll_lower
 FROM (SELECT symbol, d, count(*) OVER w AS n, avg(close) OVER w AS m, list_aggregate(list(close) OVER w, 'stddev_pop') AS s FROM bars WINDOW w AS ({_W} ROWS 19 PRECEDING))""",
)
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.bollinger(_bars(spark, sf_dir), **_K)
    return text_dates(out.drop("close", "amount"))


_MOM = f"(close / lag(close, 20) OVER ({_W}) - 1) * 100"


@query("w7_momentum", X.with_views("bars") + f" SELECT symbol, CAST(d AS VARCHAR) AS d, {rnd(_MOM, 4)} AS momentum FROM bars")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(ts.momentum(_bars(spark, sf_dir), n=20, **_K).select("symbol", "d", "momentum"))


@query(
    "w8_relative_strength",
    X.with_views("bars") + f""", mom AS (SELECT symbol, d, {rnd(_MOM, 4)} AS m FROM bars), bench AS (SELECT d, max(m) AS b FROM mom WHERE symbol < 10 GROUP BY 1)
 SELECT symbol, CAST(mom.d AS VARCHAR) AS d, {rnd('m - b', 4)} AS relative FROM mom LEFT JOIN bench ON mom.d = bench.d""",
)
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mom = ts.momentum(_bars(spark, sf_dir), n=20, **_K)
    bench = mom.where("symbol < 10").groupBy("d").agg(F.max("momentum").alias("benchmark"))
    return text_dates(ts.relative_strength(mom, bench, date="d", value="momentum").select("symbol", "d", "relative"))


_VOL = "list_aggregate(list(r) OVER w, 'stddev_samp') * sqrt(252) * 100"


@query(
    "w9_volatility",
    X.with_views("bars") + f""", r AS (SELECT symbol, d, close / lag(close) OVER ({_W}) - 1 AS r FROM bars)
 SELECT symbol, CAST(d AS VARCHAR) AS d, CASE WHEN count(r) OVER w = 20 THEN {rnd(_VOL, 4)} END AS volatility FROM r WINDOW w AS ({_W} ROWS 19 PRECEDING)""",
)
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(ts.volatility(_bars(spark, sf_dir), **_K).select("symbol", "d", "volatility"))


@query(
    "w10_average_amount",
    X.with_views("bars") + f""" SELECT symbol, CAST(d AS VARCHAR) AS d, CASE WHEN count(a) OVER w = 20 THEN round(avg(a) OVER w, 2) END AS avg_amount
 FROM (SELECT symbol, d, CASE WHEN volume <> 7 THEN round(amount) END AS a FROM bars) WINDOW w AS ({_W} ROWS 19 PRECEDING)""",
)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.bars(spark, sf_dir).select("symbol", "d", F.when(F.col("volume") != 7, F.round("amount")).alias("amount"))
    return text_dates(ts.average_amount(rows, **_K).select("symbol", "d", "avg_amount"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price factors out of all orders, by the supplier their key falls to."""
    k = F.col("o_orderkey")
    return X.table(spark, sf_dir, "orders").select((k % 97 + 1).alias("symbol"), F.to_date("o_orderdate").alias("effective_date"), (F.col("o_orderdate") + F.expr("interval 1 day") * (k % 3).cast("int")).alias("announced_at"), (1 / (1 + (k % 7 - 3) / F.lit(7000.0))).alias("factor"))


_ACTIONS = """actions AS (SELECT o_orderkey % 97 + 1 AS symbol, CAST(o_orderdate AS DATE) AS effective_date, o_orderdate + to_days(CAST(o_orderkey % 3 AS INT)) AS announced_at, 1 / (1 + (o_orderkey % 7 - 3) / CAST(7000 AS DOUBLE)) AS factor
 FROM orders), usable AS (SELECT * FROM actions WHERE announced_at <= TIMESTAMP '1997-06-30' AND effective_date <= DATE '1997-06-30')"""


@query(
    "w11_adjust_forward",
    X.with_views("bars") + f""", {_ACTIONS} SELECT b.symbol, CAST(b.d AS VARCHAR) AS d, {rnd('round(any_value(close) * coalesce(product(factor), 1), 6)', 2)} AS close FROM bars b
 LEFT JOIN usable u ON u.symbol = b.symbol AND u.effective_date > b.d GROUP BY b.symbol, b.d""",
)
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.adjust_bars(_bars(spark, sf_dir), actions(spark, sf_dir), keys=["symbol"], as_of="1997-06-30", mode="forward", prices=["close"])
    return text_dates(out.select("symbol", "d", F.round("close", 2).alias("close")))


@query(
    "w11_adjust_backward",
    X.with_views("bars") + f""", {_ACTIONS} SELECT b.symbol, CAST(b.d AS VARCHAR) AS d, {rnd('round(any_value(close) / coalesce(product(factor), 1), 6)', 2)} AS close FROM bars b
 LEFT JOIN usable u ON u.symbol = b.symbol AND u.effective_date <= b.d GROUP BY b.symbol, b.d""",
)
def w11_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.adjust_bars(_bars(spark, sf_dir), actions(spark, sf_dir), keys=["symbol"], as_of="1997-06-30", mode="backward", prices=["close"])
    return text_dates(out.select("symbol", "d", F.round("close", 2).alias("close")))


@query(
    "w12_drawdown",
    X.with_views("nav") + """, p AS (SELECT account, seq, equity, max(equity) OVER w AS peak, d FROM nav WINDOW w AS (PARTITION BY account ORDER BY d, seq))
 SELECT account, seq, peak, round((peak - equity) / peak * 100, 4) AS drawdown, round(max((peak - equity) / peak * 100) OVER (PARTITION BY account ORDER BY d, seq), 4) AS max_drawdown FROM p""",
)
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.drawdown(X.nav(spark, sf_dir), keys=["account"], order=["d", "seq"], value="equity")
    return out.select("account", "seq", "peak", F.round("drawdown", 4).alias("drawdown"), F.round("max_drawdown", 4).alias("max_drawdown"))


@query("w16_earliest", "SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.earliest(X.table(spark, sf_dir, "documents"), keys=["source"], order=["n_chars", "doc_id"]).select("source", "doc_id", "lang")


@query(
    "w17_revision_lineage",
    """WITH m AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '5-%' AS r, lag(o_orderkey) OVER w AS before, lead(o_orderpriority) OVER w AS nxt FROM orders
  WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey))
 SELECT o_custkey, o_orderkey, CASE WHEN nxt LIKE '1-%' OR nxt LIKE '5-%' THEN 'SUPERSEDED' WHEN r AND before IS NOT NULL THEN 'REVISION' ELSE 'ORIGINAL' END AS revision_role, CASE WHEN r THEN before END AS supersedes FROM m""",
)
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = X.table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    out = ts.revision_lineage(filings, keys=["o_custkey", "y"], order=["o_orderdate", "o_orderkey"], title="o_orderpriority", doc_id="o_orderkey", terms=["^1-", "^5-"])
    return out.select("o_custkey", "o_orderkey", "revision_role", "supersedes")


@query(
    "w18_calendar_gaps",
    X.with_views("rates") + """, spans AS (SELECT bank, tenor, start, least("end", start + 3) AS e FROM rates),
 days AS (SELECT bank, tenor, CAST(d AS DATE) AS d FROM (SELECT DISTINCT bank, tenor FROM rates), unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) t(d)),
 g AS (SELECT bank, tenor, d FROM days WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.bank = days.bank AND s.tenor = days.tenor AND days.d BETWEEN s.start AND s.e)),
 i AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY bank, tenor ORDER BY d) AS INT) AS g FROM g)
 SELECT bank, tenor, CAST(min(d) AS VARCHAR) AS start, CAST(max(d) AS VARCHAR) AS "end", count(*) AS days FROM i GROUP BY bank, tenor, g""",
)
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = X.rates(spark, sf_dir).select("bank", "tenor", "start", F.least("end", F.date_add("start", 3)).alias("end"))
    return text_dates(ts.calendar_gaps(spans, keys=["bank", "tenor"], start="start", end="end", first="1995-01-01", last="1996-12-31"))


_COVERAGE = """, r AS (SELECT bank % 4 AS bank, tenor, floor(rate * 100) / 100 AS rate, start, least("end", start + 10) AS e FROM rates WHERE product IS NOT NULL),
 days AS (SELECT CAST(d AS DATE) AS d FROM unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) t(d)),
 u AS (SELECT d, tenor, bank FROM days JOIN r ON d BETWEEN start AND e GROUP BY 1, 2, 3 HAVING count(DISTINCT rate) = 1),
 n AS (SELECT d, tenor, count(*) AS banks FROM u GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT d, max(banks) FILTER (tenor = 3) AS banks FROM days LEFT JOIN n USING (d) GROUP BY 1)"""


@query(
    "w18_coverage_counts",
    X.with_views("rates") + _COVERAGE + """ SELECT counter, count(*) AS n FROM (SELECT CASE WHEN banks IS NULL THEN 'uncovered_calendar_days' ELSE 'covered_calendar_days' END AS counter FROM b
 UNION ALL SELECT 'covered_tenor_3y_days' FROM b WHERE banks IS NOT NULL UNION ALL SELECT 'covered_' || banks || '_bank_days' FROM b WHERE banks IS NOT NULL
 UNION ALL SELECT 'uncovered_range_count' FROM (SELECT banks, lag(banks) OVER (ORDER BY d) AS before, d FROM b) WHERE banks IS NULL AND (before IS NOT NULL OR d = (SELECT min(d) FROM b))) GROUP BY 1""",
)
def w18_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.rate_coverage(_coarse(spark, sf_dir), first="1995-01-01", last="1996-12-31")[0]


@query(
    "w18_coverage_gaps",
    X.with_views("rates") + _COVERAGE + """, g AS (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INT) AS g FROM b WHERE banks IS NULL)
 SELECT CAST(min(d) AS VARCHAR) AS start, CAST(max(d) AS VARCHAR) AS "end", count(*) AS days FROM g GROUP BY g""",
)
def w18_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(ts.rate_coverage(_coarse(spark, sf_dir), first="1995-01-01", last="1996-12-31")[1])


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of four banks in whole hundredths, valid ten days at most, so that a bank often has one rate."""
    return X.rates(spark, sf_dir).select((F.col("bank") % 4).alias("bank"), "tenor", (F.floor(F.col("rate") * 100) / 100).alias("rate"), "start", F.least("end", F.date_add("start", 10)).alias("end"))


@query("w21_first_of_month", "SELECT o_orderkey, o_custkey FROM orders QUALIFY CAST(o_orderdate AS DATE) = min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate))")
def w21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return ts.first_of_month(rows, keys=["o_custkey"], date="d").select("o_orderkey", "o_custkey")
