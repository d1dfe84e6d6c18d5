"""Queries of ledger analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.fixtures import rnd
from tidemark.operators import ledger as lg
from tidemark.queries.base import Registry, text_dates

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-cent ledger events: a line buys or sells by its return flag; R lines pay out."""
    x = X.shipped(spark, sf_dir)
    kind = F.when(F.col("l_returnflag") == "N", "BUY").when(F.col("l_returnflag") == "A", "SELL").when(F.col("l_linestatus") == "O", "DIVIDEND").otherwise("TAX")
    return x.select((F.col("o_custkey") % 50).alias("run_id"), "symbol", kind.alias("kind"), F.col("l_quantity").cast("long").alias("quantity"), F.floor("l_extendedprice").alias("amount"), F.floor(F.col("l_extendedprice") / 100).alias("cost"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.floor(F.abs("s_acctbal")).alias("price"))


_PNL = """ev AS (SELECT o_custkey % 50 AS run_id, symbol, CASE WHEN l_returnflag = 'N' THEN 'BUY' WHEN l_returnflag = 'A' THEN 'SELL' WHEN l_linestatus = 'O' THEN 'DIVIDEND' ELSE 'TAX' END AS kind,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(floor(l_extendedprice) AS BIGINT) AS amount, CAST(floor(l_extendedprice / 100) AS BIGINT) AS cost FROM shipped),
 sums AS (SELECT run_id, symbol, CAST(coalesce(sum(amount) FILTER (kind = 'BUY'), 0) AS BIGINT) AS buy_gross, CAST(coalesce(sum(cost) FILTER (kind = 'BUY'), 0) AS BIGINT) AS buy_costs,
  CAST(coalesce(sum(amount) FILTER (kind = 'SELL'), 0) AS BIGINT) AS sell_gross, CAST(coalesce(sum(cost) FILTER (kind = 'SELL'), 0) AS BIGINT) AS sell_costs,
  CAST(coalesce(sum(amount) FILTER (kind = 'DIVIDEND'), 0) AS BIGINT) AS dividends, CAST(coalesce(sum(amount) FILTER (kind = 'TAX'), 0) AS BIGINT) AS tax,
  CAST(coalesce(sum(quantity) FILTER (kind = 'BUY'), 0) - coalesce(sum(quantity) FILTER (kind = 'SELL'), 0) AS BIGINT) AS quantity FROM ev GROUP BY 1, 2),
 pnl AS (SELECT s.*, CAST(floor(abs(s_acctbal)) AS BIGINT) AS price, CAST(floor(abs(s_acctbal)) AS BIGINT) * quantity AS market_value FROM sums s LEFT JOIN supplier ON s_suppkey = symbol)"""


@query(
    "a10_security_pnl",
    X.with_views("shipped") + f""", {_PNL}, l AS (SELECT *, sell_gross - sell_costs + dividends - tax + market_value AS lifecycle_value FROM pnl), t AS (SELECT *, lifecycle_value - buy_gross - buy_costs AS total_pnl FROM l)
 SELECT *, CASE WHEN quantity = 0 THEN total_pnl ELSE 0 END AS realized_pnl, CASE WHEN quantity <> 0 THEN total_pnl ELSE 0 END AS unrealized_pnl, CASE WHEN quantity <> 0 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM t""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.security_pnl(_events(spark, sf_dir), _marks(spark, sf_dir))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer")
    return c.groupBy((F.col("c_custkey") % 50).alias("run_id")).agg(F.sum(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).otherwise(0)).alias("contributions"), F.sum(F.when(F.col("c_acctbal") <= 0, F.floor(-F.col("c_acctbal"))).otherwise(0)).alias("withdrawals"))


_ACCOUNT = """flows AS (SELECT c_custkey % 50 AS run_id, CAST(sum(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END) AS BIGINT) AS contributions, CAST(sum(CASE WHEN c_acctbal <= 0 THEN floor(-c_acctbal) ELSE 0 END) AS BIGINT) AS withdrawals FROM customer GROUP BY 1),
 acc AS (SELECT f.run_id, contributions, withdrawals, CAST(coalesce(sum(buy_gross + buy_costs), 0) AS BIGINT) AS buys, CAST(coalesce(sum(sell_gross - sell_costs + dividends - tax), 0) AS BIGINT) AS gains, CAST(coalesce(sum(market_value), 0) AS BIGINT) AS market_value,
  count(*) FILTER (WHERE quantity > 0) AS open_positions FROM flows f LEFT JOIN pnl USING (run_id) GROUP BY 1, 2, 3)"""


@query(
    "a10_account_summary",
    X.with_views("shipped") + f", {_PNL}, {_ACCOUNT} SELECT run_id, contributions - withdrawals + gains - buys AS cash, market_value, contributions - withdrawals + gains - buys + market_value AS equity, gains - buys + market_value AS total_pnl, open_positions FROM acc",
)
def a10_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lg.account_summary(lg.security_pnl(_events(spark, sf_dir), _marks(spark, sf_dir)), _flows(spark, sf_dir))
    return out.select("run_id", "cash", "market_value", "equity", "total_pnl", "open_positions")


@query(
    "a11_reconcile_cash",
    X.with_views("shipped") + f""", {_PNL}, {_ACCOUNT} SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 5 WHEN run_id % 11 <> 0 THEN 0 END AS cash_difference, CASE WHEN run_id % 11 <> 0 OR run_id % 7 = 0 THEN 0 END AS pnl_difference,
 CASE WHEN run_id % 7 = 0 OR run_id % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM acc""".replace("CASE WHEN run_id % 7 = 0 THEN 5 WHEN run_id % 11 <> 0 THEN 0 END", "CAST(CASE WHEN run_id % 7 = 0 THEN 5 WHEN run_id % 11 <> 0 THEN 0 END AS BIGINT)").replace("CASE WHEN run_id % 11 <> 0 OR run_id % 7 = 0 THEN 0 END", "CAST(CASE WHEN run_id % 11 <> 0 OR run_id % 7 = 0 THEN 0 END AS BIGINT)"),
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = lg.account_summary(lg.security_pnl(_events(spark, sf_dir), _marks(spark, sf_dir)), _flows(spark, sf_dir))
    stored = summary.where("run_id % 11 <> 0 OR run_id % 7 = 0").select("run_id", F.when(F.col("run_id") % 7 == 0, F.col("cash") - 5).otherwise(F.col("cash")).alias("cash"), "total_pnl")
    return lg.reconcile_cash(summary, stored)


@query(
    "a12_reconcile_paper",
    """SELECT 'ACCOUNT_CASH_INVALID' AS error, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal < -1e-6
 UNION ALL SELECT 'POSITION_LOT_MISMATCH', CAST(coalesce(p.k, l.k) AS VARCHAR) FROM (SELECT p_partkey AS k, CAST(p_size * 50 AS BIGINT) AS q FROM part) p
  FULL JOIN (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) l ON p.k = l.k WHERE coalesce(p.q, 0) <> coalesce(l.q, 0)
 UNION ALL SELECT 'ORDER_FILL_MISMATCH', CAST(o_orderkey AS VARCHAR) FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(q, 0) <> 100
 UNION ALL SELECT 'ORDER_STATUS_MISMATCH', CAST(o_orderkey AS VARCHAR) FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE CASE WHEN coalesce(q, 0) = 120 THEN 'FILLED' WHEN q > 0 THEN 'PARTIAL' END <> CASE WHEN o_orderstatus = 'F' THEN 'FILLED' ELSE 'PARTIAL' END""",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, o = X.table(spark, sf_dir, "lineitem"), X.table(spark, sf_dir, "orders")
    accounts = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"))
    held = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") * 50).cast("long").alias("quantity"))
    lots = lines.select(F.col("l_partkey").alias("symbol"), F.col("l_quantity").cast("long").alias("remaining"))
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.lit(120).alias("quantity"), F.lit(100).alias("filled_quantity"), F.when(F.col("o_orderstatus") == "F", "FILLED").otherwise("PARTIAL").alias("status"))
    fills = lines.select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("long").alias("quantity"))
    return lg.reconcile_paper(accounts, held, lots, orders, fills)


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.shipped(spark, sf_dir).where("l_returnflag = 'N'")
    return x.select(F.col("o_custkey").alias("account"), "symbol", F.col("eff").alias("acquired"), F.col("l_quantity").cast("long").alias("remaining"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"))


@query(
    "a13_positions",
    X.with_views("shipped") + """ SELECT account, symbol, quantity, sellable, price, c / quantity AS average_cost, quantity * price AS market_value, quantity * price - c AS unrealized_pnl FROM (
 SELECT o_custkey AS account, symbol, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (eff < DATE '1997-03-01'), 0) AS BIGINT) AS sellable, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice / l_quantity) AS BIGINT)) AS BIGINT) AS c
 FROM shipped WHERE l_returnflag = 'N' AND l_quantity > 0 GROUP BY 1, 2) LEFT JOIN (SELECT s_suppkey, CAST(floor(abs(s_acctbal)) AS BIGINT) AS price FROM supplier) ON s_suppkey = symbol""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.positions(_lots(spark, sf_dir), _marks(spark, sf_dir), as_of="1997-03-01")


@query("a14_opened_on", X.with_views("shipped") + " SELECT o_custkey AS account, symbol, CAST(min(eff) AS VARCHAR) AS opened FROM shipped WHERE l_returnflag = 'N' GROUP BY 1, 2 HAVING min(eff) = DATE '1997-03-01'")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(lg.opened_on(_lots(spark, sf_dir), "1997-03-01"))


@query(
    "a15_risk_checks",
    """WITH h AS (SELECT c_nationkey AS account, c_custkey AS symbol, CAST(floor(abs(c_acctbal)) AS DOUBLE) AS mv FROM customer WHERE c_custkey % 3 <> 0),
 a AS (SELECT n_nationkey AS account, CAST(200000 + n_nationkey * 5000 AS DOUBLE) AS assets, CAST(n_nationkey * 7000 AS DOUBLE) AS market_value, CAST(n_nationkey * 1000 AS DOUBLE) AS cash, CAST((n_nationkey % 5 - 3) * 1500 AS DOUBLE) AS daily, CAST(n_nationkey % 15 AS DOUBLE) AS dd, n_nationkey % 4 AS opened FROM nation),
 o AS (SELECT c_custkey AS order_id, c_nationkey AS account, c_custkey AS symbol, c_custkey % 90 + 1 AS q, CAST(c_custkey % 400 + 10 AS DOUBLE) AS p, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 400 + 20 - c_custkey % 30 AS DOUBLE) END AS inv, CAST(5 AS DOUBLE) AS fees FROM customer),
 x AS (SELECT o.*, a.* EXCLUDE (account), h.mv AS own, q * p AS v, (SELECT coalesce(sum(m), 0) FROM (SELECT m FROM (SELECT mv AS m FROM h h2 WHERE h2.account = o.account AND h2.symbol <> o.symbol UNION ALL SELECT coalesce(h.mv, 0) + q * p) ORDER BY m DESC LIMIT 5)) AS top5
  FROM o JOIN a USING (account) LEFT JOIN h ON h.account = o.account AND h.symbol = o.symbol),
 c AS (SELECT order_id, unnest([{'k': 'invalidation_price', 'c': inv IS NOT NULL AND inv < p}, {'k': 'risk_budget', 'c': CASE WHEN inv < p THEN q <= floor(assets * (0.5 / 100) / (p - inv)) END},
  {'k': 'position_limit', 'c': coalesce(own, 0) + v <= assets * (CASE WHEN own IS NOT NULL THEN CAST(12 AS DOUBLE) ELSE CAST(8 AS DOUBLE) END / 100)}, {'k': 'gross_exposure_limit', 'c': market_value + v <= assets * (CASE WHEN dd >= 8 THEN CAST(30 AS DOUBLE) ELSE CAST(70 AS DOUBLE) END / 100)},
  {'k': 'top5_concentration_limit', 'c': top5 <= assets * 0.5}, {'k': 'cash_and_fees', 'c': v + fees <= cash}, {'k': 'daily_loss_stop', 'c': daily / (assets - daily) * 100 > -1.5}, {'k': 'drawdown_freeze', 'c': dd < 12},
  {'k': 'new_positions_per_day', 'c': own IS NOT NULL OR opened < 2}]) AS r FROM x)
 SELECT order_id, r.k AS "check", CASE WHEN r.c THEN 'PASS' ELSE 'FAIL' END AS status FROM c WHERE r.c IS NOT NULL""",
)
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = X.table(spark, sf_dir, "customer"), F.col("c_custkey")
    n = F.col("n_nationkey")
    holdings = c.where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("account"), k.alias("symbol"), F.floor(F.abs("c_acctbal")).cast("double").alias("market_value"))
    accounts = X.table(spark, sf_dir, "nation").select(
        n.alias("account"), (200000 + n * 5000).cast("double").alias("total_assets"), (n * 7000).cast("double").alias("market_value"), (n * 1000).cast("double").alias("cash"),
        ((n % 5 - 3) * 1500).cast("double").alias("daily_pnl"), (n % 15).cast("double").alias("max_drawdown"), (n % 4).alias("opened_today"),
    )
    orders = c.select(
        k.alias("order_id"), F.col("c_nationkey").alias("account"), k.alias("symbol"), (k % 90 + 1).alias("quantity"), (k % 400 + 10).cast("double").alias("price"),
        F.when(k % 5 != 0, (k % 400 + 20 - k % 30).cast("double")).alias("invalidation"), F.lit(5.0).alias("fees"),
    )
    return lg.risk_checks(orders, accounts, holdings)


_RET = f"""b AS (SELECT *, coalesce(lag(equity) OVER w, 0) + flow_in AS base FROM nav WINDOW w AS (PARTITION BY account ORDER BY d, seq)), r AS (SELECT *, CASE WHEN base > 0 THEN equity / base - 1 END AS period_return FROM b),
 u AS (SELECT *, product(1 + coalesce(period_return, 0)) OVER (PARTITION BY account ORDER BY d, seq) AS unit_index FROM r),
 dd AS (SELECT *, {rnd("(unit_index / greatest(1, max(unit_index) OVER (PARTITION BY account ORDER BY d, seq)) - 1)", 12)} AS drawdown FROM u)"""

#: The same with periods linked one after another: a product over a frame may group its factors in any way.
_LINKED = _RET.replace("product(1 + coalesce(period_return, 0)) OVER (PARTITION BY account ORDER BY d, seq)", "list_reduce(list(1 + coalesce(period_return, 0)) OVER (PARTITION BY account ORDER BY d, seq), lambda a, x: a * x)")


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.flow_adjusted_returns(X.nav(spark, sf_dir), keys=["account"], order=["d", "seq"])


@query("w13_flow_adjusted_returns", X.with_views("nav") + f", {_RET} SELECT account, seq, round(period_return, 6) + 0 AS period_return, round(unit_index, 6) AS unit_index, round(drawdown, 6) + 0 AS drawdown, round(min(drawdown) OVER (PARTITION BY account ORDER BY d, seq), 6) + 0 AS max_drawdown FROM dd")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).select("account", "seq", *[F.round(c, 6).alias(c) for c in ("period_return", "unit_index", "drawdown", "max_drawdown")])


@query("w13_linked_return", X.with_views("nav") + f", {_RET} SELECT account, round(product(1 + period_return) - 1, 6) + 0 AS twr, round(min(drawdown), 6) + 0 AS max_drawdown FROM dd GROUP BY 1")
def w13_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.linked_return(_returns(spark, sf_dir), keys=["account"]).select("account", F.round("twr", 6).alias("twr"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query(
    "w13_risk_metrics",
    X.with_views("nav") + f""", {_LINKED}, s AS (SELECT *, coalesce(last_value(CASE WHEN drawdown >= 0 THEN d END IGNORE NULLS) OVER w, first_value(d) OVER w) AS since FROM dd WINDOW w AS (PARTITION BY account ORDER BY d, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 m AS (SELECT account, count(period_return) AS periods, stddev_samp(period_return) * sqrt(252) AS volatility, sqrt(avg(least(period_return, 0) * least(period_return, 0)) FILTER (WHERE period_return IS NOT NULL) * 252) AS downside_deviation, count(*) FILTER (WHERE period_return > 0) / count(period_return) AS win_rate,
  CASE WHEN count(period_return) > 0 THEN max(struct_pack(d := d, s := seq, u := unit_index)).u - 1 END AS twr, min(drawdown) AS worst, date_diff('day', min(d), max(d)) AS span, max(CASE WHEN drawdown < 0 THEN date_diff('day', since, d) ELSE 0 END) AS longest_drawdown FROM s GROUP BY 1),
 a AS (SELECT *, CASE WHEN span > 0 AND twr > -1 THEN pow(1 + twr, 365.0 / span) - 1 END AS ar FROM m)
 SELECT account, periods, round(volatility, 6) AS volatility, round(downside_deviation, 6) AS downside_deviation, round(win_rate, 6) AS win_rate, round(ar, 6) + 0 AS annual_return, round(CASE WHEN worst < 0 THEN ar / -worst END, 6) + 0 AS calmar, longest_drawdown FROM a""",
)
def w13_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lg.risk_metrics(_returns(spark, sf_dir), keys=["account"], date="d", order=["d", "seq"])
    return out.select("account", "periods", *[F.round(c, 6).alias(c) for c in ("volatility", "downside_deviation", "win_rate", "annual_return", "calmar")], "longest_drawdown")


@query(
    "w13_turnover",
    X.with_views("nav", "fills") + """, t AS (SELECT account, CAST(year(d) AS BIGINT) AS year, sum(abs(quantity * price)) / 2 AS t FROM fills GROUP BY 1, 2), e AS (SELECT account, CAST(year(d) AS BIGINT) AS year, avg(equity) AS e FROM nav GROUP BY 1, 2)
 SELECT account, year, round(CASE WHEN e > 0 THEN t / e END, 6) AS turnover FROM t LEFT JOIN e USING (account, year)""",
)
def w13_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lg.turnover(X.fills(spark, sf_dir), X.nav(spark, sf_dir), keys=["account"], date="d")
    return out.withColumn("turnover", F.round("turnover", 6))


@query(
    "w14_daily_pnl",
    X.with_views("nav") + """, e AS (SELECT account, d, max(struct_pack(s := seq, e := equity)).e AS last, min(struct_pack(s := seq, e := equity)).e AS first FROM nav GROUP BY 1, 2)
 SELECT account, CAST(d AS VARCHAR) AS d, last, round(last - coalesce(lag(last) OVER (PARTITION BY account ORDER BY d), first), 2) AS daily_pnl FROM e""",
)
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lg.daily_pnl(X.nav(spark, sf_dir), keys=["account"], date="d", tie="seq")
    return text_dates(out.withColumn("daily_pnl", F.round("daily_pnl", 2)))


@query(
    "w15_annual_pnl",
    X.with_views("nav") + """, c AS (SELECT *, sum(flow_in) OVER (PARTITION BY account ORDER BY d, seq) AS flow FROM nav), l AS (SELECT account, CAST(year(d) AS BIGINT) AS year, max(struct_pack(d := d, s := seq, e := equity)).e AS e, max(struct_pack(d := d, s := seq, f := flow)).f AS f FROM c GROUP BY 1, 2)
 SELECT account, year, e AS end_assets, round(f - coalesce(lag(f) OVER w, 0), 2) + 0 AS net_flow, round(e - coalesce(lag(e) OVER w, 0) - (f - coalesce(lag(f) OVER w, 0)), 2) + 0 AS pnl FROM l WINDOW w AS (PARTITION BY account ORDER BY year)""",
)
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = X.nav(spark, sf_dir).withColumn("flow", F.sum("flow_in").over(Window.partitionBy("account").orderBy("d", "seq")))
    out = lg.annual_pnl(nav, keys=["account"], at=["d", "seq"], year=F.year("d").cast("long"), equity="equity", flow="flow")
    return out.withColumns({"net_flow": F.round("net_flow", 2), "pnl": F.round("pnl", 2)})


@query(
    "w22_next_open_fill",
    X.with_views("bars") + f""", o AS (SELECT o_orderkey AS order_id, o_custkey % 100 AS symbol, CAST(o_orderdate AS DATE) AS signal_date, CAST(o_orderkey % 3000 AS DOUBLE) AS limit_price FROM orders),
 f AS (SELECT o.*, min(CASE WHEN volume > 10 THEN b.d END) AS fill_date FROM o LEFT JOIN bars b ON b.symbol = o.symbol AND b.d > o.signal_date GROUP BY ALL),
 g AS (SELECT f.*, (SELECT open FROM bars b WHERE b.symbol = f.symbol AND b.d = f.fill_date) * (1 + CAST(10 AS DOUBLE) / 10000) AS p, CASE WHEN fill_date IS NOT NULL THEN (SELECT count(*) FROM bars b WHERE b.symbol = f.symbol AND b.d > f.signal_date AND b.d < f.fill_date) END AS queued_days FROM f)
 SELECT order_id, CAST(fill_date AS VARCHAR) AS fill_date, {rnd('p', 6)} AS fill_price, queued_days, CASE WHEN fill_date IS NULL THEN 'QUEUED' WHEN p <= limit_price THEN 'FILLED' ELSE 'REJECTED' END AS status FROM g""",
)
def w22(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 100).alias("symbol"), F.to_date("o_orderdate").alias("signal_date"), (F.col("o_orderkey") % 3000).cast("double").alias("limit_price"))
    out = lg.next_open_fill(orders, X.bars(spark, sf_dir), tradable=F.col("volume") > 10, slippage_bps=10)
    return text_dates(out.select("order_id", "fill_date", F.round("fill_price", 6).alias("fill_price"), "queued_days", "status"))


_FIFO = """run AS (SELECT *, coalesce(sum(quantity) FILTER (side = 'BUY') OVER w, 0) AS b, coalesce(sum(quantity) FILTER (side = 'SELL') OVER w, 0) AS s,
  coalesce((SELECT sum(quantity) FROM fills g WHERE g.account = f.account AND g.side = 'BUY' AND g.d < f.d), 0) AS earlier FROM fills f WINDOW w AS (PARTITION BY account ORDER BY d, seq)),
 bad AS (SELECT *, max(CASE WHEN side = 'SELL' AND s > earlier THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY d, seq) = 1 AS bad FROM run)"""


@query(
    "w23_fifo_match",
    X.with_views("fills") + f""", {_FIFO} SELECT k.account, k.seq AS sell, l.seq AS lot, CAST(least(k.s, l.b) - greatest(k.s - k.quantity, l.b - l.quantity) AS BIGINT) AS quantity FROM bad k JOIN bad l ON k.account = l.account AND k.side = 'SELL' AND l.side = 'BUY' AND NOT k.bad
 AND least(k.s, l.b) > greatest(k.s - k.quantity, l.b - l.quantity)""",
)
def w23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.fifo_match(X.fills(spark, sf_dir), keys=["account"])[0]


@query("w23_fifo_errors", X.with_views("fills") + f", {_FIFO} SELECT account, seq AS sell, CAST(d AS VARCHAR) AS d, quantity FROM bad WHERE side = 'SELL' AND bad")
def w23_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(lg.fifo_match(X.fills(spark, sf_dir), keys=["account"])[1])


@query(
    "w24_moving_average_cost",
    X.with_views("fills").replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY d, seq) AS i FROM fills),
 r AS (SELECT account, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT account FROM fills)
  UNION ALL SELECT s.account, s.i, CASE WHEN side = 'BUY' THEN q + quantity WHEN quantity <= q THEN q - quantity ELSE q END,
   CASE WHEN side = 'BUY' THEN (q * c + quantity * price) / (q + quantity) WHEN quantity = q THEN 0 ELSE c END FROM r JOIN s ON s.account = r.account AND s.i = r.i + 1)
 SELECT account, max(struct_pack(i := i, q := q)).q AS quantity, round(max(struct_pack(i := i, c := c)).c, 6) AS average_cost FROM r GROUP BY 1""",
)
def w24(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lg.moving_average_cost(X.fills(spark, sf_dir), keys=["account"], order=["d", "seq"])
    return out.withColumn("average_cost", F.round("average_cost", 6))


_W25 = """ac AS (SELECT DISTINCT s_suppkey AS symbol, DATE '1996-01-01' + CAST(k * 200 AS INT) AS effective_date, s_suppkey * 10 + k AS action_id, CASE WHEN k = 1 THEN 1.5 ELSE 2.0 END AS m, CASE WHEN k = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS c FROM supplier, (VALUES (0), (1)) t(k)),
 lt AS (SELECT row_number() OVER () AS id, o_custkey AS account, symbol, eff AS acquired, CAST(l_quantity AS BIGINT) AS remaining, floor(l_extendedprice / l_quantity) AS cost FROM shipped WHERE l_returnflag = 'N'),
 hit AS (SELECT lt.*, action_id, m, c, product(m) OVER (PARTITION BY id ORDER BY effective_date, action_id) AS p FROM lt JOIN ac USING (symbol) WHERE effective_date > acquired),
 pos AS (SELECT account, symbol, action_id, sum(remaining * p / m) AS quantity_before, sum(remaining * p) AS a, any_value(c) AS c FROM hit GROUP BY 1, 2, 3),
 bad AS (SELECT DISTINCT account, symbol FROM pos WHERE abs(a - round(a)) > 1e-8), tot AS (SELECT id, product(m) AS t FROM hit GROUP BY 1)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("k"))
    return s.select("symbol", F.date_add(F.lit("1996-01-01").cast("date"), F.col("k") * 200).alias("effective_date"), (F.col("symbol") * 10 + F.col("k")).alias("action_id"), F.when(F.col("k") == 1, 1.5).otherwise(2.0).alias("share_multiplier"), F.when(F.col("k") == 0, 0.5).alias("cash_per_share"))


def _acted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return lg.apply_actions(_lots(spark, sf_dir).withColumn("cost", F.col("cost").cast("double")), _actions(spark, sf_dir), cost="cost")


@query("w25_apply_actions", X.with_views("shipped") + f", {_W25} SELECT account, symbol, CAST(acquired AS VARCHAR) AS acquired, remaining, round(cost / coalesce(t, 1), 6) AS cost, CAST(round(remaining * coalesce(t, 1)) AS BIGINT) AS adjusted FROM lt LEFT JOIN tot USING (id) WHERE (account, symbol) NOT IN (SELECT (account, symbol) FROM bad)")
def w25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(_acted(spark, sf_dir)[0].withColumn("cost", F.round("cost", 6)))


@query("w25_fractions", X.with_views("shipped") + f", {_W25} SELECT account, symbol, CAST(acquired AS VARCHAR) AS acquired, remaining, cost FROM lt WHERE (account, symbol) IN (SELECT (account, symbol) FROM bad)")
def w25_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(_acted(spark, sf_dir)[1].drop("adjusted"))


@query("w25_cash", X.with_views("shipped") + f", {_W25} SELECT account, symbol, action_id, quantity_before, round(quantity_before * c, 2) AS cash FROM pos WHERE c <> 0 AND (account, symbol) NOT IN (SELECT (account, symbol) FROM bad)")
def w25_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acted(spark, sf_dir)[2]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("sequence"), "event_id", "event_type")



def _core():
    return F.concat_ws("|", "run_id", "sequence", "event_id", "event_type")


_CHAIN = """ WITH RECURSIVE s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, event_id, event_type FROM events),
 r AS (SELECT run_id, sequence, event_id, CAST(NULL AS VARCHAR) AS prev_event_hash, sha256(concat_ws('|', run_id, sequence, event_id, event_type)) AS event_hash FROM s WHERE sequence = 1
  UNION ALL SELECT s.run_id, s.sequence, s.event_id, r.event_hash, sha256(r.event_hash || concat_ws('|', s.run_id, s.sequence, s.event_id, s.event_type)) FROM r JOIN s ON s.run_id = r.run_id AND s.sequence = r.sequence + 1)"""


@query("w27_build_chain", _CHAIN + " SELECT run_id, sequence, event_id, prev_event_hash, event_hash FROM r")
def w27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.build_chain(_log(spark, sf_dir), core=_core()).select("run_id", "sequence", "event_id", "prev_event_hash", "event_hash")


@query(
    "w26_verify_chain",
    """SELECT user_id AS run_id, count(*) AS events, CASE WHEN user_id % 3 = 0 AND count(*) > 5 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS broken_links, CASE WHEN user_id % 3 = 0 AND count(*) >= 5 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS wrong_hashes,
 CAST(0 AS BIGINT) AS sequence_gaps, NOT (user_id % 3 = 0 AND count(*) >= 5) AS ok FROM events GROUP BY 1""",
)
def w26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with the fifth hash of every third run spoilt."""
    chain = lg.build_chain(_log(spark, sf_dir), core=_core())
    spoilt = chain.withColumn("event_hash", F.when((F.col("run_id") % 3 == 0) & (F.col("sequence") == 5), "spoilt").otherwise(F.col("event_hash")))
    return lg.verify_chain(spoilt, core=_core())


@query(
    "w28_xirr",
    """WITH RECURSIVE f AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -o_totalprice END AS a FROM orders),
 g AS (SELECT account, list(struct_pack(t := date_diff('day', DATE '1970-01-01', d) - m, a := a) ORDER BY d, a) AS fl, max(a) AS hi, min(a) AS lo FROM (SELECT *, min(date_diff('day', DATE '1970-01-01', d)) OVER (PARTITION BY account) AS m FROM f) GROUP BY 1),
 n AS (SELECT *, list_sum(list_transform(fl, lambda x: x.a / pow(0.0001, x.t / CAST(365 AS DOUBLE)))) AS v0 FROM g WHERE hi > 0 AND lo < 0),
 h AS (SELECT account, fl, v0, CAST(1 AS DOUBLE) AS h, 0 AS i FROM n UNION ALL SELECT account, fl, v0, CASE WHEN v0 * list_sum(list_transform(fl, lambda x: x.a / pow(1 + h, x.t / CAST(365 AS DOUBLE)))) > 0 AND h < 1000 THEN h * 2 ELSE h END, i + 1 FROM h WHERE i < 10),
 b AS (SELECT account, fl, v0 AS v, CAST(-0.9999 AS DOUBLE) AS lo, h AS hi, 0 AS i FROM h WHERE i = 10 AND v0 * list_sum(list_transform(fl, lambda x: x.a / pow(1 + h, x.t / CAST(365 AS DOUBLE)))) <= 0
  UNION ALL SELECT account, fl, CASE WHEN v * m <= 0 THEN v ELSE m END, CASE WHEN v * m <= 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN v * m <= 0 THEN (lo + hi) / 2 ELSE hi END, i + 1
  FROM (SELECT *, list_sum(list_transform(fl, lambda x: x.a / pow(1 + (lo + hi) / 2, x.t / CAST(365 AS DOUBLE)))) AS m FROM b WHERE i < 60))
 SELECT g.account, round((b.lo + b.hi) / 2, 6) AS xirr FROM g LEFT JOIN b ON b.account = g.account AND b.i = 60""",
)
def w28(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("a"))
    return lg.xirr(flows, keys=["account"], date="d", amount="a", steps=60).withColumn("xirr", F.round("xirr", 6))


@query(
    "g10_run_report",
    X.with_views("shipped") + f""", {_PNL}, {_ACCOUNT}, t AS (SELECT run_id, symbol, sell_gross - sell_costs + dividends - tax + market_value - buy_gross - buy_costs AS total_pnl FROM pnl),
 y AS (SELECT o_custkey % 50 AS run_id, string_agg(y || ':' || v, ',' ORDER BY y) AS annual FROM (SELECT o_custkey % 50 AS o_custkey, year(eff) AS y, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS v FROM shipped GROUP BY 1, 2) GROUP BY 1)
 SELECT acc.run_id, gains - buys + market_value AS total_pnl, annual, n_stocks, best_symbol, acc.run_id % 7 <> 0 AS audit_ok FROM acc LEFT JOIN y USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n_stocks, max(struct_pack(p := total_pnl, n := -symbol)).n * -1 AS best_symbol FROM t GROUP BY 1) USING (run_id)""",
)
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = lg.security_pnl(_events(spark, sf_dir), _marks(spark, sf_dir))
    account = lg.account_summary(stocks, _flows(spark, sf_dir)).select("run_id", "total_pnl")
    x = X.shipped(spark, sf_dir)
    annual = x.groupBy((F.col("o_custkey") % 50).alias("run_id"), F.year("eff").alias("year")).agg(F.sum(F.floor("l_extendedprice")).alias("pnl"))
    audit = account.select("run_id", (F.col("run_id") % 7 != 0).alias("audit_ok"))
    out = lg.run_report(account, annual, stocks, audit)
    return out.withColumn("annual", F.array_join(F.transform("annual", lambda y: F.concat_ws(":", y["year"], y["pnl"])), ","))
