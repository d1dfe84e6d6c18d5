"""Ledger analytics over event tables: positions, lots, costs, PnL, returns, reconciliation, hash chains.

Running sums and merged breakpoints keep lot matching linear; only moving-average cost and XIRR
fold over one array for each key, and a hash chain is built from a sorted stream, as they are
sequential by definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.screening import top_n

# Portfolio limits of the default policy, percent of net asset value unless named otherwise.
LIMITS = {
    "risk_per_trade": 0.50, "initial_position": 8.0, "single_stock": 12.0, "top5": 50.0, "gross": 70.0, "risk_off_gross": 30.0,
    "risk_off_drawdown": 8.0, "freeze_drawdown": 12.0, "daily_loss": 1.5, "new_positions": 2,
}


def _upto(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def security_pnl(events: DataFrame, marks: DataFrame, *, keys: Sequence[str] = ("run_id",), symbol: str = "symbol") -> DataFrame:
    """A10: for each run and security the cumulative buys, sells, costs, dividends, tax, quantity, market value and lifecycle PnL.

    events: kind (BUY, SELL, DIVIDEND, TAX), quantity, amount, cost; marks: symbol, price.
    """

    def total(kind: str, column: str = "amount") -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    sums = events.groupBy(*keys, symbol).agg(
        total("BUY").alias("buy_gross"), total("BUY", "cost").alias("buy_costs"), total("SELL").alias("sell_gross"), total("SELL", "cost").alias("sell_costs"),
        total("DIVIDEND").alias("dividends"), total("TAX").alias("tax"), (total("BUY", "quantity") - total("SELL", "quantity")).alias("quantity"),
    )
    marked = sums.join(marks, symbol, "left").withColumn("market_value", F.coalesce("price", F.lit(0)) * F.col("quantity"))
    lifecycle = F.col("sell_gross") - F.col("sell_costs") + F.col("dividends") - F.col("tax") + F.col("market_value")
    pnl = lifecycle - F.col("buy_gross") - F.col("buy_costs")
    return marked.withColumns({"lifecycle_value": lifecycle, "total_pnl": pnl, "realized_pnl": F.when(F.col("quantity") == 0, pnl).otherwise(F.lit(0)), "unrealized_pnl": F.when(F.col("quantity") != 0, pnl).otherwise(F.lit(0)), "state": F.when(F.col("quantity") != 0, "OPEN").otherwise("CLOSED")})


def account_summary(securities: DataFrame, flows: DataFrame, *, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """A10: for each run the cash implied by its events, market value, equity and total PnL; flows: keys, contributions, withdrawals."""
    sums = securities.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("buy_gross", "buy_costs", "sell_gross", "sell_costs", "dividends", "tax", "market_value")], F.count_if(F.col("quantity") > 0).alias("open_positions"))
    both = flows.join(sums, list(keys), "left").na.fill(0)
    cash = F.col("contributions") - F.col("withdrawals") + F.col("sell_gross") - F.col("sell_costs") + F.col("dividends") - F.col("tax") - F.col("buy_gross") - F.col("buy_costs")
    return both.withColumn("cash", cash).withColumn("equity", F.col("cash") + F.col("market_value")).withColumn("total_pnl", F.col("equity") + F.col("withdrawals") - F.col("contributions"))


def reconcile_cash(summary: DataFrame, stored: DataFrame, *, keys: Sequence[str] = ("run_id",), tolerance: float = 0.01) -> DataFrame:
    """Implied against stored cash and PnL: differences and PASS or FAIL; an account missing on a side fails."""
    s = stored.select(*keys, F.col("cash").alias("__c"), F.col("total_pnl").alias("__p"))
    both = summary.select(*keys, "cash", "total_pnl").join(s, list(keys), "full_outer")
    cash, pnl = F.col("cash") - F.col("__c"), F.col("total_pnl") - F.col("__p")
    ok = F.coalesce((F.abs(cash) <= tolerance) & (F.abs(pnl) <= tolerance), F.lit(False))
    return both.select(*keys, cash.alias("cash_difference"), pnl.alias("pnl_difference"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def reconcile_paper(accounts: DataFrame, positions: DataFrame, lots: DataFrame, orders: DataFrame, fills: DataFrame) -> DataFrame:
    """(error, id) of accounts with negative cash, positions that differ from their lots and orders that differ from their fills or status."""
    bad_cash = accounts.where("cash < -1e-6").select(F.lit("ACCOUNT_CASH_INVALID").alias("error"), F.col("account").cast("string").alias("id"))
    held = lots.groupBy("symbol").agg(F.sum("remaining").alias("__l"))
    both = positions.join(held, "symbol", "full_outer").where(F.coalesce("quantity", F.lit(0)) != F.coalesce("__l", F.lit(0)))
    bad_lots = both.select(F.lit("POSITION_LOT_MISMATCH").alias("error"), F.col("symbol").cast("string").alias("id"))
    done = fills.groupBy("order_id").agg(F.sum("quantity").alias("__f"))
    filled = orders.join(done, "order_id", "left").withColumn("__f", F.coalesce("__f", F.lit(0)))
    bad_fill = filled.where("filled_quantity <> __f").select(F.lit("ORDER_FILL_MISMATCH").alias("error"), F.col("order_id").cast("string").alias("id"))
    expected = F.when(F.col("__f") == F.col("quantity"), "FILLED").when(F.col("__f") > 0, "PARTIAL")
    bad_status = filled.where(expected != F.col("status")).select(F.lit("ORDER_STATUS_MISMATCH").alias("error"), F.col("order_id").cast("string").alias("id"))
    return bad_cash.unionByName(bad_lots).unionByName(bad_fill).unionByName(bad_status)


def positions(lots: DataFrame, marks: DataFrame, *, as_of: str, keys: Sequence[str] = ("account", "symbol"), symbol: str = "symbol") -> DataFrame:
    """Quantity, what may be sold on as_of (lots acquired before it), average cost, market value and unrealised PnL.

    lots: keys, acquired, remaining, cost (for each share); marks: symbol, price.
    """
    day = F.lit(as_of).cast("date")
    sums = lots.where("remaining > 0").groupBy(*keys).agg(F.sum("remaining").alias("quantity"), F.coalesce(F.sum(F.when(F.col("acquired") < day, F.col("remaining"))), F.lit(0)).alias("sellable"), F.sum(F.col("remaining") * F.col("cost")).alias("__c"))
    out = sums.join(marks, symbol, "left")
    return out.withColumns({"average_cost": F.col("__c") / F.col("quantity"), "market_value": F.col("quantity") * F.col("price"), "unrealized_pnl": F.col("quantity") * F.col("price") - F.col("__c")}).drop("__c")


def opened_on(lots: DataFrame, day: str, *, keys: Sequence[str] = ("account", "symbol"), acquired: str = "acquired") -> DataFrame:
    """Positions whose first lot is of that day."""
    return lots.groupBy(*keys).agg(F.min(acquired).alias("opened")).where(F.col("opened") == F.lit(day).cast("date"))


def risk_checks(orders: DataFrame, accounts: DataFrame, holdings: DataFrame, *, limits: Mapping = LIMITS) -> DataFrame:
    """order_id, check, status (PASS or FAIL) of each proposed buy.

    orders: order_id, account, symbol, quantity, price, invalidation, fees; accounts: account, total_assets,
    market_value, cash, daily_pnl, max_drawdown, opened_today; holdings: account, symbol, market_value.
    """
    # the five largest after the order are among the account's six largest before it, its own position left out: cut in each task before they meet
    six = top_n(holdings.where("market_value IS NOT NULL").select("account", "market_value"), 6, by=[F.desc("market_value")], within=["account"])
    per = six.groupBy("account").agg(F.sort_array(F.collect_list("market_value"), asc=False).alias("__all"))
    own = holdings.select("account", "symbol", F.col("market_value").alias("__own"))
    x = orders.join(accounts, "account").join(own, ["account", "symbol"], "left").join(per, "account", "left")
    value, held, assets = F.col("quantity") * F.col("price"), F.col("__own").isNotNull(), F.col("total_assets")
    everything = F.coalesce("__all", F.array().cast("array<double>"))
    at = F.array_position(everything, F.col("__own")).cast("int")
    others = F.when(held, F.concat(F.slice(everything, 1, F.greatest(at - 1, F.lit(0))), F.slice(everything, at + 1, F.size(everything)))).otherwise(everything)
    projected = F.slice(F.sort_array(F.concat(others, F.array(F.coalesce("__own", F.lit(0.0)) + value)), asc=False), 1, 5)
    top5 = F.aggregate(projected, F.lit(0.0), lambda a, b: a + b)

    def pct(name: str) -> Column:
        return assets * (limits[name] / 100)

    below = F.col("invalidation").isNotNull() & (F.col("invalidation") < F.col("price"))
    base = assets - F.col("daily_pnl")
    daily = F.when(base > 0, F.col("daily_pnl") / base * 100).otherwise(-100.0)
    checks = {
        "invalidation_price": below,
        "risk_budget": F.when(below, F.col("quantity") <= F.floor(pct("risk_per_trade") / (F.col("price") - F.col("invalidation")))),
        "position_limit": F.coalesce("__own", F.lit(0.0)) + value <= F.when(held, pct("single_stock")).otherwise(pct("initial_position")),
        "gross_exposure_limit": F.col("market_value") + value <= F.when(F.col("max_drawdown") >= limits["risk_off_drawdown"], pct("risk_off_gross")).otherwise(pct("gross")),
        "top5_concentration_limit": top5 <= pct("top5"),
        "cash_and_fees": value + F.col("fees") <= F.col("cash"),
        "daily_loss_stop": daily > -limits["daily_loss"],
        "drawdown_freeze": F.col("max_drawdown") < limits["freeze_drawdown"],
        "new_positions_per_day": held | (F.col("opened_today") < limits["new_positions"]),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.when(c, "PASS").when(~c, "FAIL").alias("status")) for n, c in checks.items()]))
    return x.select("order_id", rows.alias("r")).select("order_id", "r.*").where("status IS NOT NULL")


def flow_adjusted_returns(nav: DataFrame, *, keys: Sequence[str], order: Sequence[str], equity: str = "equity", flow_in: str = "flow_in", flow_out: str | None = None) -> DataFrame:
    """Sub-period return net of flows, unit index, drawdown (a negative fraction) and its minimum so far.

    A period whose starting capital and flows are not positive has a null return and leaves the index as it is. Drawdowns have 12 decimals: what binary
    fractions lose where nothing was gained or lost is none, and neither lasts nor divides a Calmar ratio.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    base = F.coalesce(F.lag(equity).over(w), F.lit(0.0)) + F.col(flow_in) - (F.col(flow_out) if flow_out else 0)
    out = nav.withColumn("period_return", F.when(base > 0, F.col(equity) / base - 1))
    run = _upto(keys, order)
    out = out.withColumn("unit_index", F.product(1 + F.coalesce("period_return", F.lit(0.0))).over(run))
    out = out.withColumn("drawdown", F.round(F.col("unit_index") / F.greatest(F.lit(1.0), F.max("unit_index").over(run)) - 1, 12))
    return out.withColumn("max_drawdown", F.min("drawdown").over(run))


def linked_return(nav: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Time-weighted return of each key: its period returns linked; null without one."""
    return nav.groupBy(*keys).agg((F.product(1 + F.col("period_return")) - 1).alias("twr"), F.min("drawdown").alias("max_drawdown"))


def risk_metrics(returns: DataFrame, *, keys: Sequence[str], date: str, order: Sequence[str], periods: float = 252.0) -> DataFrame:
    """Risk of each key's period returns (W13's frame): periods, volatility and downside deviation (of losses, about zero) a year, win rate, annual return, Calmar ratio, and the longest drawdown in days.

    The annual return links all periods, in their order (so it is the same to the last bit however rows are dealt out), over the calendar days between the first and the last; the Calmar ratio is that by the greatest drawdown, null without one.
    A drawdown lasts from the last day at the peak (or the first day, for an index that starts below 1) to each later row below it. Null returns count for nothing; a key
    with one day has no annual return.
    """
    upto = _upto(keys, order)
    since = F.coalesce(F.last(F.when(F.col("drawdown") >= 0, F.col(date)), True).over(upto), F.first(date).over(upto))
    rows = returns.withColumn("__days", F.when(F.col("drawdown") < 0, F.datediff(date, since)).otherwise(0))
    r = F.col("period_return")
    loss = F.when(r < 0, r).when(r.isNotNull(), F.lit(0.0))  # least() would count a null return as a period without a loss
    sums = rows.groupBy(*keys).agg(
        F.count("period_return").alias("periods"), (F.stddev_samp("period_return") * F.sqrt(F.lit(periods))).alias("volatility"), F.sqrt(F.avg(loss * loss) * periods).alias("downside_deviation"),
        (F.count_if(r > 0) / F.count("period_return")).alias("win_rate"), F.when(F.count("period_return") > 0, F.max_by("unit_index", F.struct(*order)) - 1).alias("__twr"), F.min("drawdown").alias("__worst"), F.datediff(F.max(date), F.min(date)).alias("__span"), F.max("__days").cast("long").alias("longest_drawdown"),
    )
    annual = F.when((F.col("__span") > 0) & (F.col("__twr") > -1), F.pow(1 + F.col("__twr"), F.lit(365.0) / F.col("__span")) - 1)
    return sums.withColumn("annual_return", annual).withColumn("calmar", F.when(F.col("__worst") < 0, F.col("annual_return") / -F.col("__worst"))).drop("__twr", "__worst", "__span")


def turnover(fills: DataFrame, nav: DataFrame, *, keys: Sequence[str], date: str, quantity: str = "quantity", price: str = "price", equity: str = "equity") -> DataFrame:
    """Turnover of each key and year: half of what was traded by the mean equity; null where the year has no positive equity."""
    year = F.year(date).cast("long").alias("year")
    traded = fills.groupBy(*keys, year).agg((F.sum(F.abs(F.col(quantity) * F.col(price))) / 2).alias("__t"))
    mean = nav.groupBy(*keys, year).agg(F.avg(equity).alias("__e"))
    return traded.join(mean, [*keys, "year"], "left").select(*keys, "year", F.when(F.col("__e") > 0, F.col("__t") / F.col("__e")).alias("turnover"))


def daily_pnl(nav: DataFrame, *, keys: Sequence[str], date: str, tie: str, equity: str = "equity") -> DataFrame:
    """The last value of each day less the last of an earlier day; on the first day less the day's first value."""
    days = nav.groupBy(*keys, date).agg(F.max_by(equity, tie).alias("last"), F.min_by(equity, tie).alias("first"))
    w = Window.partitionBy(*keys).orderBy(date)
    return days.withColumn("daily_pnl", F.col("last") - F.coalesce(F.lag("last").over(w), F.col("first"))).drop("first")


def annual_pnl(checkpoints: DataFrame, *, keys: Sequence[str], at: Sequence[str], year: Column, equity: str, flow: str, cumulative: Sequence[str] = ()) -> DataFrame:
    """From the last checkpoint of each year: change of equity net of flows, and of the cumulative columns."""
    last = checkpoints.groupBy(*keys, year.alias("year")).agg(*[F.max_by(c, F.struct(*at)).alias(c) for c in (equity, flow, *cumulative)])
    w = Window.partitionBy(*keys).orderBy("year")

    def delta(c: str) -> Column:
        return F.col(c) - F.lag(c, 1, 0.0).over(w)

    return last.select(*keys, "year", F.col(equity).alias("end_assets"), delta(flow).alias("net_flow"), (delta(equity) - delta(flow)).alias("pnl"), *[delta(c).alias(f"annual_{c}") for c in cumulative])


def next_open_fill(orders: DataFrame, bars: DataFrame, *, key: str = "symbol", signal_date: str = "signal_date", date: str = "d", price: str = "open", tradable: Column, slippage_bps: float, limit: str = "limit_price") -> DataFrame:
    """The first tradable open after each signal; FILLED if the slipped open is within the limit, REJECTED if not, QUEUED without one.

    queued_days counts the days in between that could not trade. A signal's fill depends on its key and date only: distinct ones and bars merge into
    one ordered stream of each key, so however many orders a key has, it has no more rows there than days; orders then look theirs up.
    """
    b = bars.select(F.col(key).alias("__k"), F.col(date).alias("__at"), F.when(tradable, F.struct(F.col(date).alias("d"), F.col(price).alias("p"))).alias("__open"), F.lit(1).alias("__bar"))
    asked = orders.where(F.col(key).isNotNull() & F.col(signal_date).isNotNull()).select(F.col(key).alias("__k"), F.col(signal_date).alias("__at")).distinct()
    b, o = b.join(asked.select("__k").distinct(), "__k", "left_semi"), asked.withColumn("__bar", F.lit(0))
    w = Window.partitionBy("__k").orderBy("__at", F.desc("__bar"))
    both = b.unionByName(o, allowMissingColumns=True).withColumn("__n", F.sum("__bar").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("__k").orderBy(F.desc("__at"), F.asc("__bar")).rowsBetween(Window.unboundedPreceding, -1)  # read backwards, the next open is the last one seen
    both = both.withColumn("__next", F.last(F.when(F.col("__open").isNotNull(), F.struct("__open", "__n")), ignorenulls=True).over(back))
    slipped = F.col("__next.__open.p") * (1 + slippage_bps / 10000)
    found = both.where("__bar = 0").select("__k", "__at", F.col("__next.__open.d").alias("fill_date"), slipped.alias("fill_price"), (F.col("__next.__n") - F.col("__n") - 1).alias("queued_days"))
    out = orders.join(found, (F.col(key) == F.col("__k")) & (F.col(signal_date) == F.col("__at")), "left").drop("__k", "__at")
    return out.withColumn("status", F.when(F.col("fill_date").isNull(), "QUEUED").when(F.col("fill_price") <= F.col(limit), "FILLED").otherwise("REJECTED"))


def fifo_match(fills: DataFrame, *, keys: Sequence[str], date: str = "d", seq: str = "seq", side: str = "side", quantity: str = "quantity") -> tuple[DataFrame, DataFrame]:
    """(keys, sell, lot, quantity) by first in, first out, where a sale takes only lots of earlier days; and the sales refused.

    A sale that exceeds what may be sold is an error, and so are the key's later sales, as they
    rest on it; so is a sale without a date. Cumulative buys and sales cut the same line of shares; merging their cuts in order gives the matches
    without a join of lots and sales. Fills are shuffled once, sorted by day for the running sums (what was bought before a day is known at its first
    fill) and once more by their cuts.
    """
    keys = list(keys)
    bought = F.when(F.col("__buy"), F.col(quantity))
    f = fills.select(*keys, date, seq, quantity, (F.col(side) == "BUY").alias("__buy"), F.datediff(date, F.lit("1970-01-01")).alias("__day"))
    run = Window.partitionBy(*keys).orderBy("__day", date, seq).rowsBetween(Window.unboundedPreceding, 0)
    same_day = Window.partitionBy(*keys, "__day").orderBy(date, seq).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumns({"__b": F.coalesce(F.sum(bought).over(run), F.lit(0)), "__s": F.coalesce(F.sum(F.when(~F.col("__buy"), F.col(quantity))).over(run), F.lit(0))})
    f = f.withColumn("__earlier", F.first(F.col("__b") - F.coalesce(bought, F.lit(0))).over(same_day))
    short = ~F.col("__buy") & (F.col("__day").isNull() | (F.col("__s") > F.col("__earlier")))
    f = f.withColumn("__bad", F.max(short.cast("int")).over(run) == 1)
    errors = f.where(~F.col("__buy") & F.col("__bad")).select(*keys, F.col(seq).alias("sell"), F.col(date), F.col(quantity).alias("quantity"))
    end = F.when(F.col("__buy"), F.col("__b")).otherwise(F.col("__s"))
    cuts = f.where((F.col("__buy") | ~F.col("__bad")) & (F.col(quantity) > 0)).select(
        *keys, (end - F.col(quantity)).alias("__at"), F.when(F.col("__buy"), F.col(seq)).alias("lot"), F.when(~F.col("__buy"), F.col(seq)).alias("sell"), F.when(~F.col("__buy"), F.col("__s")).alias("__sold")
    )
    line = Window.partitionBy(*keys).orderBy("__at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)  # of a lot and a sale cut at one place only the second gives a piece
    merged = cuts.withColumns({"lot": F.last("lot", ignorenulls=True).over(upto), "sell": F.last("sell", ignorenulls=True).over(upto), "__next": F.lead("__at").over(line), "__stop": F.max("__sold").over(Window.partitionBy(*keys))})
    until = F.least("__next", "__stop")  # skips nulls
    pieces = merged.where(F.col("sell").isNotNull() & (until > F.col("__at")))
    return pieces.select(*keys, "sell", "lot", (until - F.col("__at")).alias("quantity")), errors


def moving_average_cost(fills: DataFrame, *, keys: Sequence[str], order: Sequence[str], side: str = "side", quantity: str = "quantity", price: str = "price", fees: Column | None = None) -> DataFrame:
    """Quantity and average cost (fees included) of each key after its fills; a sale leaves the cost as it is.

    A sale of more than is held is refused; fills without a quantity or a cost change nothing. Each fill depends on all before it, so a key's fills stream
    through one task in order; what a task holds is the quantity and cost of the key it is at, whatever the number of fills.
    """
    keys = list(keys)
    cost = F.col(quantity) * F.col(price) + (F.lit(0.0) if fees is None else fees)
    rows = fills.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], (F.col(side) == "BUY").alias("__buy"), F.col(quantity).cast("double").alias("__q"), cost.cast("double").alias("__c"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))], "__buy", "__q", "__c")
    slim = rows.select(*keys, "__buy", "__q", "__c")
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField("quantity", T.DoubleType()), T.StructField("average_cost", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, mean = None, 0.0, 0.0
        for batch in batches:
            types, done = [f.type for f in batch.schema][: len(keys)], []
            for *key, buy, q, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != now:
                    done += [(*now, held, mean)] if now is not None else []
                    now, held, mean = key, 0.0, 0.0
                if q is None or c is None:
                    continue
                if buy and held + q != 0:
                    held, mean = held + q, (held * mean + c) / (held + q)
                elif not buy and q <= held:
                    held, mean = held - q, 0.0 if q == held else mean
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True) if done else [[]] * len(schema), [*types, pa.float64(), pa.float64()], strict=True)], names=schema.names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, held, mean), [*types, pa.float64(), pa.float64()], strict=True)], names=schema.names)

    return slim.mapInArrow(fold, schema)


def apply_actions(lots: DataFrame, actions: DataFrame, *, keys: Sequence[str] = ("symbol",), position: Sequence[str] = ("account", "symbol"), acquired: str = "acquired", quantity: str = "remaining", cost: str | None = None, truncate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lots after the share multipliers and dividends that follow their day; lots of positions with a fraction of a share; cash.

    An action counts once by action_id. A multiplier raises a lot's quantity (adjusted, rounded to whole shares) and divides its
    cost. A dividend is paid on the shares that earlier multipliers have made, in one amount for each position and action, rounded to
    cents: (position, action_id, quantity_before, cash). A position that an action leaves with a fraction of a share is an error with all its
    lots; with truncate fractions are cut off lot by lot instead. Repeated lots are lots of their own.
    """
    keys, position = list(keys), list(position)
    once = actions.dropDuplicates(["action_id"])
    a = once.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("effective_date").alias("__e"), "action_id", F.coalesce("share_multiplier", F.lit(1.0)).alias("__m"), F.coalesce("cash_per_share", F.lit(0.0)).alias("__c"))
    days = lots.select(*keys, acquired).distinct()
    later = days.join(a, [days[k] == a[f"__{k}"] for k in keys] + [F.col("__e") > F.col(acquired)]).drop(*[f"__{k}" for k in keys])
    run = Window.partitionBy(*keys, acquired).orderBy("__e", "action_id").rowsBetween(Window.unboundedPreceding, 0)
    grown = later.withColumn("__p", F.product("__m").over(run))
    held = lots.groupBy(*dict.fromkeys([*position, *keys, acquired])).agg(F.sum(quantity).alias("__q"))
    paid = held.join(grown, [*keys, acquired]).groupBy(*position, "action_id").agg(F.sum(F.col("__q") * F.col("__p") / F.col("__m")).alias("quantity_before"), F.sum(F.col("__q") * F.col("__p")).alias("__after"), F.first("__c").alias("__c"))
    split = F.abs(F.col("__after") - F.round("__after")) > 1e-8
    broken = paid.groupBy(*position).agg(F.max(split).alias("__bad")).where("__bad").drop("__bad")
    total = grown.groupBy(*keys, acquired).agg(F.product("__m").alias("__t"))
    out = lots.join(total, [*keys, acquired], "left").withColumn("__t", F.coalesce("__t", F.lit(1.0)))
    raw = F.col(quantity) * F.col("__t")
    whole = F.round(raw) if not truncate else F.when(F.abs(raw - F.round(raw)) <= 1e-8, F.round(raw)).otherwise(F.floor(raw))
    out = out.withColumn("adjusted", whole.cast("long"))
    out = (out.withColumn(cost, F.col(cost) / F.col("__t")) if cost else out).select(*lots.columns, "adjusted")
    cash = paid.where("__c <> 0").select(*position, "action_id", "quantity_before", F.round(F.col("quantity_before") * F.col("__c"), 2).alias("cash"))
    if truncate:
        return out, out.where("false"), cash
    errors = lots.join(broken, position, "left_semi").withColumn("adjusted", F.lit(None).cast("long"))
    return out.join(broken, position, "left_anti").select(*lots.columns, "adjusted"), errors.select(*lots.columns, "adjusted"), cash.join(broken, position, "left_anti")


def build_chain(events: DataFrame, *, run: str = "run_id", order: Sequence[str] = ("sequence",), core: Column) -> DataFrame:
    """Events with prev_event_hash and event_hash = sha256(previous + core).

    A chain is sequential by nature, so each run's rows stream through one task in order; a task keeps the last hash only, whatever the
    length of the run. Columns of events with those names are replaced.
    """
    kept = [c for c in events.columns if c not in ("prev_event_hash", "event_hash")]
    rows = events.select(*kept, F.coalesce(core, F.lit("")).alias("__core")).repartition(run).sortWithinPartitions(run, *order)
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("prev_event_hash", T.StringType()), T.StructField("event_hash", T.StringType())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            before, made = [], []
            for key, text in zip(batch.column(kept.index(run)).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                if (key,) != now:
                    now, last = (key,), None
                before.append(last)
                last = hashlib.sha256(((last or "") + text).encode()).hexdigest()
                made.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(before, pa.string()), pa.array(made, pa.string())], names=schema.names)

    return rows.mapInArrow(chain, schema)


def verify_chain(events: DataFrame, *, run: str = "run_id", sequence: str = "sequence", core: Column, prev: str = "prev_event_hash", stored: str = "event_hash") -> DataFrame:
    """For each run: events, broken links, wrong hashes, sequence gaps, ok. Parallel, as the previous hash is stored."""
    w = Window.partitionBy(run).orderBy(sequence)
    link = F.lag(stored).over(w)
    marked = events.select(run, (~link.eqNullSafe(F.col(prev))).alias("__l"), (F.sha2(F.concat(F.coalesce(prev, F.lit("")), core), 256) != F.col(stored)).alias("__h"), (F.col(sequence) != F.row_number().over(w)).alias("__g"))
    sums = marked.groupBy(run).agg(F.count("*").alias("events"), F.count_if("__l").alias("broken_links"), F.count_if("__h").alias("wrong_hashes"), F.count_if("__g").alias("sequence_gaps"))
    return sums.withColumn("ok", F.col("broken_links") + F.col("wrong_hashes") + F.col("sequence_gaps") == 0)


def xirr(flows: DataFrame, *, keys: Sequence[str], date: str, amount: str, steps: int = 200) -> DataFrame:
    """Annual internal rate of return of each key's flows by bisection; null without both signs or a bracket.

    Flows of one day are discounted alike, so they are summed up before they meet: bisection goes over a key's days, however many flows they have.
    """
    t = F.datediff(date, F.lit("1970-01-01")).cast("double")
    days = flows.groupBy(*keys, t.alias("__t")).agg(F.sum(F.col(amount).cast("double")).alias("__a"), F.max(amount).alias("__hi"), F.min(amount).alias("__lo"))
    one = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__t").alias("t"), F.col("__a").alias("a")))).alias("__f"), F.min("__t").alias("__0"), F.max("__hi").alias("__hi"), F.min("__lo").alias("__lo"))

    def npv(rate: Column) -> Column:
        return F.aggregate("__f", F.lit(0.0), lambda s, x: s + x["a"] / F.pow(1 + rate, (x["t"] - F.col("__0")) / 365.0))

    high = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(1.0), lambda h, _: F.when((npv(F.lit(-0.9999)) * npv(h) > 0) & (h < 1000), h * 2).otherwise(h))
    start = F.struct(F.lit(-0.9999).alias("lo"), F.col("__high").alias("hi"), npv(F.lit(-0.9999)).alias("v"))

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        value = npv(mid)
        left = a["v"] * value <= 0
        return F.struct(F.when(left, a["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(a["hi"]).alias("hi"), F.when(left, a["v"]).otherwise(value).alias("v"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: (a["lo"] + a["hi"]) / 2)
    ready = one.withColumn("__high", high).withColumn("__ok", (F.col("__hi") > 0) & (F.col("__lo") < 0) & (npv(F.lit(-0.9999)) * npv(F.col("__high")) <= 0))
    return ready.select(*keys, F.when(F.col("__ok"), found).alias("xirr"))


def run_report(account: DataFrame, annual: DataFrame, stocks: DataFrame, audit: DataFrame, *, run: str = "run_id") -> DataFrame:
    """One nested row for each run: account, annual rows, the number and best of its stocks, audit."""
    years = annual.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("year", "pnl"))).alias("annual"))
    best = stocks.groupBy(run).agg(F.count("*").alias("n_stocks"), F.max_by("symbol", F.struct("total_pnl", -F.col("symbol"))).alias("best_symbol"))
    return account.join(years, run, "left").join(best, run, "left").join(audit, run, "left")
