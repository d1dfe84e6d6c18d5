"""Queries of scalar normalisation, over texts made from the tables' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.fixtures import rnd
from tidemark.functions import normalize as nz
from tidemark.queries.base import Registry, text_dates

query = Registry()
QUERIES, SQL = query.queries, query.sql

_CODES = "codes AS (SELECT *, lpad(CAST((o_orderkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS code FROM orders)"
_EX = "CASE WHEN regexp_matches(code, '^(5|6|9[01])') THEN 'SSE' WHEN regexp_matches(code, '^(4|8|92)') THEN 'BSE' WHEN regexp_matches(code, '^(0|1|2|3)') THEN 'SZSE' END"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a six-digit code out of their keys."""
    return X.table(spark, sf_dir, "orders").withColumn("code", F.lpad(((F.col("o_orderkey") * 7919) % 1000000).cast("string"), 6, "0"))


@query("p1_exchange_of", f"WITH {_CODES} SELECT o_orderkey, {_EX} AS exchange, CASE WHEN o_orderkey % 70 IN (1, 2, 32) THEN 'SSE' WHEN o_orderkey % 70 IN (4, 8, 16) THEN 'SZSE' WHEN o_orderkey % 70 = 64 THEN 'BSE' END AS by_type FROM codes")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("o_orderkey", nz.exchange_of(F.col("code")).alias("exchange"), nz.exchange_of_market_type(F.col("o_orderkey") % 70).alias("by_type"))


@query(
    "p2_symbols",
    f"""WITH {_CODES}, x AS (SELECT o_orderkey, code, {_EX} AS e FROM codes), y AS (SELECT *, code || '.' || CASE e WHEN 'SSE' THEN 'SH' WHEN 'SZSE' THEN 'SZ' WHEN 'BSE' THEN 'BJ' END AS symbol FROM x)
 SELECT o_orderkey, symbol, code || '.SH' AS from_vendor, coalesce(regexp_matches(symbol, '^[0-9]{{6}}\\.(SH|SZ|BJ)$'), false) AS ok FROM y""",
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _codes(spark, sf_dir).withColumn("symbol", nz.to_symbol(F.col("code"), nz.exchange_of(F.col("code"))))
    return rows.select("o_orderkey", "symbol", nz.from_vendor_symbol(F.concat("code", F.lit(".SS"))).alias("from_vendor"), F.coalesce(nz.is_symbol(F.col("symbol")), F.lit(False)).alias("ok"))


@query(
    "p3_safe_casts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS number, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders""",
)
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = X.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = F.when(k % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return text_dates(o.select("o_orderkey", nz.safe_number(number).alias("number"), nz.safe_date(day).alias("d")))


@query(
    "p4_accounting_number",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN -round(abs(c_acctbal), 2) WHEN 1 THEN c_acctbal WHEN 2 THEN CAST(c_custkey % 100 AS DOUBLE) END AS value FROM customer""",
)
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("("), F.format_number(F.abs("c_acctbal"), 2), F.lit(")"))).when(k % 4 == 1, F.format_number("c_acctbal", 2)).when(k % 4 == 2, F.concat((k % 100).cast("string"), F.lit("%"))).otherwise("--")
    return X.table(spark, sf_dir, "customer").select("c_custkey", nz.accounting_number(text).alias("value"))


@query("p5_scaled", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_retailprice * 100 WHEN 1 THEN p_retailprice * 1000 WHEN 2 THEN p_retailprice / 10 WHEN 3 THEN p_retailprice * 10000 END AS value FROM part")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("LOT", "THOUSAND", "PER_TEN", "WAN", "?")]), (F.col("p_size") % 5 + 1).cast("int"))
    return X.table(spark, sf_dir, "part").select("p_partkey", nz.scaled(F.col("p_retailprice"), unit).alias("value"))


@query(
    "p6_chinese_text",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') WHEN year(o_orderdate + INTERVAL 30 DAY) >= 2000 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS "end",
 CAST(o_orderkey % 500 AS DOUBLE) / 100 / 100 AS rate, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 90 AS DOUBLE) * 10000 ELSE CAST(o_orderkey % 9000 AS DOUBLE) END AS amount, CASE o_orderkey % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 0.5 WHEN 2 THEN 5.0 END AS tenor
 FROM orders""".replace(", CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start", ", CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN year(o_orderdate + INTERVAL 30 DAY) >= 2000 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS start").replace("CAST(o_orderkey % 500 AS DOUBLE) / 100 / 100 AS rate", rnd("CAST(o_orderkey % 500 AS DOUBLE) / 100 / 100", 8) + " AS rate").replace("THEN 3.0 WHEN 1 THEN 0.5 WHEN 2 THEN 5.0 END", "THEN CAST(3 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(5 AS DOUBLE) END"),
)
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, later = F.col("o_orderkey"), F.col("o_orderdate") + F.expr("interval 30 days")
    text = F.concat(F.lit("自"), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("起至 "), F.date_format(later, "yyyy-MM-dd"), F.lit(" 止"))
    rate = F.concat(F.lit("年利率 "), (k % 500 / 100).cast("decimal(6,2)").cast("string"), F.lit(" %"))
    amount = F.when(k % 2 == 0, F.concat((k % 90).cast("string"), F.lit(" 万元起"))).otherwise(F.concat(F.format_number(k % 9000, 0), F.lit("元")))
    tenor = F.element_at(F.array(F.lit("三年"), F.lit(" 6 个月"), F.lit("5年A款"), F.lit("活期")), (k % 4 + 1).cast("int"))
    span = nz.date_range_in(text)
    out = X.table(spark, sf_dir, "orders").select("o_orderkey", span["start"].alias("start"), span["end"].alias("end"), nz.rate_in(rate).alias("rate"), nz.amount_in(amount).alias("amount"), nz.tenor_in(tenor).alias("tenor"))
    return text_dates(out)


@query(
    "p7_known_at",
    """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', g) + INTERVAL 1 DAY - INTERVAL 1 SECOND ELSE g END, '%Y-%m-%d %H:%M:%S') AS known_at, strftime(date_trunc('day', o_orderdate) + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M:%S') AS plan_at
 FROM (SELECT *, greatest(o_orderdate + to_hours(CAST(o_orderkey % 30 AS INT)), CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 50 AS INT)) END) AS g FROM orders)""",
)
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, hour = F.col("o_orderkey"), F.expr("interval 1 hour")
    notice = F.col("o_orderdate") + hour * (k % 30).cast("int")
    update = F.when(k % 3 == 0, F.col("o_orderdate") + hour * (k % 50).cast("int"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return X.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(nz.conservative_known_at(notice, update, k % 2 == 0), fmt).alias("known_at"), F.date_format(nz.plan_known_at(F.to_date("o_orderdate")), fmt).alias("plan_at"))


@query("p8_epoch_ms_date", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(X.table(spark, sf_dir, "events").select("event_id", nz.epoch_ms_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("d")))


@query("p9_provenance", "SELECT n_nationkey, 'nations' AS source_id, '2024-01-02 03:04:05' AS retrieved_at, 'public' AS licence, false AS formal_eligible FROM nation")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nz.with_provenance(X.table(spark, sf_dir, "nation").select("n_nationkey"), source_id="nations", retrieved_at="2024-01-02 03:04:05", licence="public")
    return out.withColumn("retrieved_at", F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss"))


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars(spark, sf_dir)
    spoil = F.dayofyear("d")
    return b.withColumns({"close": F.when(spoil % 31 == 0, None).when(spoil % 37 == 0, -F.col("close")).otherwise(F.col("close")), "high": F.when(spoil % 41 == 0, F.col("low") / 2).otherwise(F.col("high")), "volume": F.when(spoil % 43 == 0, -F.col("volume")).otherwise(F.col("volume"))})


_ROUGH = """, rough AS (SELECT symbol, d, open, low, CASE WHEN dayofyear(d) % 31 = 0 THEN NULL WHEN dayofyear(d) % 37 = 0 THEN -close ELSE close END AS close, CASE WHEN dayofyear(d) % 41 = 0 THEN low / 2 ELSE high END AS high, CASE WHEN dayofyear(d) % 43 = 0 THEN -volume ELSE volume END AS volume FROM bars)"""


@query(
    "p10_ohlc_checks",
    X.with_views("bars") + _ROUGH + """ SELECT symbol, count(*) FILTER (WHERE close IS NULL OR close <= 0) AS dropped, count(*) FILTER (WHERE close > 0 AND high < greatest(open, close)) AS high_too_low,
 count(*) FILTER (WHERE close > 0 AND low > least(open, close)) AS low_too_high, count(*) FILTER (WHERE close > 0 AND volume < 0) AS negative_volume FROM rough GROUP BY 1""",
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.ohlc_checks(_rough(spark, sf_dir), keys=["symbol"])[1]


@query("p10_ohlc_kept", X.with_views("bars") + _ROUGH + " SELECT symbol, CAST(d AS VARCHAR) AS d, close, volume FROM rough WHERE close > 0")
def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(nz.ohlc_checks(_rough(spark, sf_dir))[0].select("symbol", "d", "close", "volume"))


@query(
    "p11_statuses",
    """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'DELISTING' WHEN upper(p_name) LIKE '%ST%' OR p_partkey % 7 = 0 THEN 'ST' ELSE 'NORMAL' END AS risk,
 CASE WHEN p_partkey % 11 = 0 THEN 'UNKNOWN' WHEN p_partkey % 13 = 0 THEN 'SUSPENDED' ELSE 'NORMAL' END AS trading FROM part""",
)
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 50 == 0, "退").when(k % 7 == 0, "*st").otherwise(""))
    price, amount = F.when(k % 11 != 0, F.col("p_retailprice")), F.when(k % 13 != 0, F.col("p_retailprice"))
    return X.table(spark, sf_dir, "part").select("p_partkey", nz.risk_status(name).alias("risk"), nz.trading_status(price, amount).alias("trading"))


@query(
    "p12_lots_and_ticks",
    f"""WITH {_CODES}, v AS (SELECT o_orderkey, o_totalprice, CASE WHEN regexp_matches(code, '^(4|8|92)') THEN 'BSE' WHEN regexp_matches(code, '^68[89]') THEN 'SSE_STAR' WHEN code LIKE '3%' THEN 'SZSE_CHINEXT' WHEN regexp_matches(code, '^[569]') THEN 'SSE_MAIN' ELSE 'SZSE_MAIN' END AS venue FROM codes)
 SELECT o_orderkey, venue, CASE WHEN venue = 'SSE_STAR' THEN 200 ELSE 100 END AS minimum, CASE WHEN venue IN ('BSE', 'SSE_STAR') THEN 1 ELSE 100 END AS increment,
 (o_orderkey % 400) >= CASE WHEN venue = 'SSE_STAR' THEN 200 ELSE 100 END AND (o_orderkey % 400 - CASE WHEN venue = 'SSE_STAR' THEN 200 ELSE 100 END) % CASE WHEN venue IN ('BSE', 'SSE_STAR') THEN 1 ELSE 100 END = 0 AS valid,
 o_orderkey % 4 = 0 AS on_tick FROM v""",
)
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _codes(spark, sf_dir).withColumn("rule", nz.lot_rule(F.col("code")))
    price = F.round("o_totalprice") / 100 + F.when(k % 4 == 0, 0.0).otherwise(0.005)
    return rows.select("o_orderkey", "rule.venue", "rule.minimum", "rule.increment", nz.valid_quantity(k % 400, F.col("rule")).alias("valid"), nz.on_tick(price).alias("on_tick"))


@query(
    "p13_trade_cost",
    """SELECT o_orderkey, CAST(round(greatest(CAST(5 AS DECIMAL(18,8)), g * CAST(0.0003 AS DECIMAL(10,8))) + CASE WHEN side = 'SELL' THEN g * CAST(0.0005 AS DECIMAL(10,8)) ELSE 0 END + g * CAST(0.00001 AS DECIMAL(10,8)), 2) AS DOUBLE) AS cost
 FROM (SELECT o_orderkey, CAST(o_totalprice / 20 AS DECIMAL(18,2)) AS g, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS o_totalprice FROM orders))""",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", nz.trade_cost(side, F.floor("o_totalprice").cast("double") / 20).cast("double").alias("cost"))


@query(
    "p14_slipped",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * (1 + CAST(8 AS DOUBLE) / 10000) ELSE o_totalprice * (1 - CAST(8 AS DOUBLE) / 10000) END AS price,
 {rnd("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * (1 + CAST(8 AS DOUBLE) / 10000) ELSE o_totalprice * (1 - CAST(8 AS DOUBLE) / 10000) END + 1e-9::DOUBLE", 2)} AS cents FROM orders""",
)
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    side, p = F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL"), F.col("o_totalprice")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", nz.slipped(p, side, 8.0).alias("price"), nz.slipped(p, side, 8.0, cents=True).alias("cents"))


@query(
    "p15_freshness",
    """SELECT event_id, CASE WHEN s <= 300 THEN 'LIVE' WHEN s <= 86400 THEN 'DELAYED' ELSE 'STALE' END AS freshness FROM (SELECT event_id, epoch(date_trunc('second', max(ts) OVER (PARTITION BY user_id))) - epoch(date_trunc('second', ts)) AS s FROM events)""",
)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = X.table(spark, sf_dir, "events").withColumn("now", F.max("ts").over(Window.partitionBy("user_id")))
    return e.select("event_id", nz.freshness(F.col("ts"), F.col("now")).alias("freshness"))


@query(
    "p16_sector_heat",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN {rnd("least(CAST(100 AS DOUBLE), abs((o_orderkey % 37 - 18) / 7.0::DOUBLE) * 10 + log10(CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 8 = 0 THEN 0 ELSE o_totalprice * 5000 / 1e8::DOUBLE END + 1) * 12)", 1)} END AS heat FROM orders""",
)
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, amount = F.col("o_orderkey"), F.col("o_totalprice") * 5000
    change = F.when(k % 10 != 0, (k % 37 - 18) / F.lit(7.0))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", nz.sector_heat(change, F.when(k % 9 == 0, None).when(k % 8 == 0, -amount).otherwise(amount)).alias("heat"))


@query("p17_without_excluded", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = X.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return nz.without_excluded(X.table(spark, sf_dir, "lineitem"), bad, on=["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("p18_title_filters", "SELECT o_orderkey, o_orderkey % 4 = 0 AS full_report, CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS INT) END AS year FROM orders")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("年度报告", "年度报告摘要", "年度报告（英文版）", "季度报告")])
    title = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("年"), F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", nz.is_full_report(title).alias("full_report"), nz.title_year(title).alias("year"))


_SESSION = "dayofweek(t) NOT IN (0, 6) AND ((hour(t) * 3600 + minute(t) * 60) * 1000000 + microsecond(t) BETWEEN 34200000000 AND 41400000000 OR (hour(t) * 3600 + minute(t) * 60) * 1000000 + microsecond(t) BETWEEN 46800000000 AND 54000000000)"


@query("p19_in_session", f"SELECT event_id, {_SESSION} AS open FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('hour', ts) + to_minutes(CAST(event_id % 2 * 30 AS INT)) END AS t FROM events)")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.date_trunc("hour", "ts") + F.expr("interval 30 minutes")  # half hours: the ends of sessions among them
    e = X.table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("timestamp")).otherwise(edge))
    return e.select("event_id", nz.in_session(F.col("t")).alias("open"))


@query(
    "p19_trading_days",
    """SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1998-06-01' AND dayofweek(l_shipdate) NOT IN (0, 6) AND CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 0)""",
)
def p19_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = X.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    off = X.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.to_date("o_orderdate").alias("d"))
    return text_dates(nz.trading_days(days, off, first="1995-06-01", last="1998-06-01")[0])


@query("p20_redact", """SELECT event_id, '{"user":' || user_id || ',"inner":{"api_key":"[REDACTED]","Token":"[REDACTED]","tokens":"[REDACTED]"},"kind":"' || event_type || '","Phone_no":"[REDACTED]","rest":[{"email":"[REDACTED]"},' || event_id || ']}' AS json FROM events""")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.format_string('{"user":%d,"inner":{"api_key":"k%d","Token":%d,"tokens":{"a":["x","]}"],"b":{"c":null}}},"kind":"%s","Phone_no":[1,[2,"\\""]],"rest":[{"email":false},%d]}', "user_id", "event_id", "event_id", "event_type", "event_id")
    events = X.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return events.repartition(4 * spark.sparkContext.defaultParallelism, "event_id").select("event_id", nz.redact(raw).alias("json"))  # a few small files are not a few tasks


def _vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars(spark, sf_dir)
    code = F.lpad((F.col("symbol") * 9001 % 1000000).cast("string"), 6, "0")
    text = {c: F.col(c).cast("string").alias(f"v_{c}") for c in ("open", "high", "low", "close", "volume", "amount")}
    return b.select(code.alias("v_code"), F.date_format("d", "yyyyMMdd").alias("v_date"), *text.values(), F.when(F.col("volume") % 9 == 0, "0").otherwise("1").alias("v_status"))


_MAP = {"symbol": "v_code", "d": "v_date", "open": "v_open", "high": "v_high", "low": "v_low", "close": "v_close", "volume": "v_volume", "amount": "v_amount", "tradable": "v_status"}
_VCODE = "b2 AS (SELECT *, lpad(CAST(symbol * 9001 % 1000000 AS VARCHAR), 6, '0') AS code FROM bars), b3 AS (SELECT *, " + _EX + " AS e FROM b2)"


@query(
    "p21_standard_bars",
    X.with_views("bars") + f""", {_VCODE} SELECT code || '.' || CASE e WHEN 'SSE' THEN 'SH' WHEN 'SZSE' THEN 'SZ' WHEN 'BSE' THEN 'BJ' END AS symbol, e AS exchange, CAST(d AS VARCHAR) AS d, open, high, low, close, amount, volume, volume % 9 <> 0 AS tradable, 'none' AS adjustment FROM b3 WHERE e IS NOT NULL""",
)
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(nz.standard_bars(_vendor(spark, sf_dir), _MAP, adjustment="none", expected_end="2001-11-04")[0])


@query(
    "p21_bar_errors",
    X.with_views("bars") + f""", {_VCODE} SELECT code || '.' || CASE e WHEN 'SSE' THEN 'SH' WHEN 'SZSE' THEN 'SZ' WHEN 'BSE' THEN 'BJ' END AS symbol, 'UNEXPECTED_END' AS error, CAST(max(d) AS VARCHAR) AS detail FROM b3 WHERE e IS NOT NULL GROUP BY 1 HAVING max(d) <> DATE '2001-11-04'""",
)
def p21_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.standard_bars(_vendor(spark, sf_dir), _MAP, adjustment="none", expected_end="2001-11-04")[1]


@query(
    "p22_standard_dividends",
    X.with_views("cash_events") + """ SELECT DISTINCT CAST(symbol AS VARCHAR) AS symbol, CAST(known AS VARCHAR) AS announcement_date, CAST(ex_date AS VARCHAR) AS ex_date, CAST(CAST(cash AS DECIMAL(18,4)) AS DOUBLE) / 10 AS cash_per_share, strftime(known, '%Y-%m-%d') || ' 15:00:00' AS known_at
 FROM cash_events WHERE ex_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
)
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.cash_events(spark, sf_dir)
    raw = e.select(F.col("symbol").cast("string").alias("v_symbol"), F.col("known").cast("string").alias("v_notice"), F.date_format("ex_date", "yyyyMMdd").alias("v_ex"), F.col("cash").cast("decimal(18,4)").cast("string").alias("v_cash"))
    out = nz.standard_dividends(raw, {"symbol": "v_symbol", "notice": "v_notice", "ex": "v_ex", "cash": "v_cash"}, first="1996-01-01", last="1997-12-31")
    return text_dates(out.withColumn("known_at", F.date_format("known_at", "yyyy-MM-dd HH:mm:ss")))


@query(
    "p23_month_windows",
    X.with_views("rates") + """ SELECT product, CAST(greatest(start, CAST(m AS DATE)) AS VARCHAR) AS window_start, CAST(least("end", last_day(CAST(m AS DATE))) AS VARCHAR) AS window_end
 FROM (SELECT DISTINCT product, start, "end", unnest(generate_series(date_trunc('month', start)::DATE, date_trunc('month', "end")::DATE, INTERVAL 1 MONTH)) AS m FROM (SELECT DISTINCT product, start, "end" FROM rates))""",
)
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = X.rates(spark, sf_dir).select("product", "start", "end").distinct()
    return text_dates(nz.month_windows(spans, start="start", end="end").drop("start", "end"))
