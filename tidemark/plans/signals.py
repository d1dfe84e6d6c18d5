"""Signals composed of point-in-time operators: dividends, rates, decisions, readiness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import pit, timeseries

#: What a yield must exceed the deposit rate by.
SPREAD = 0.03


def conservative_dividend(probe: DataFrame, events: DataFrame, years: DataFrame, *, keys: Sequence[str], date: str = "d", include_special: bool = True, kind: str = "kind", decimals: int = 8, asked: DataFrame | None = None) -> DataFrame:
    """Probe with d_ttm, d_med3 and d_cons, the lesser of both; all null unless three resolved years are known. asked: see pit.trailing_sum()."""
    usable = events if include_special else events.where(F.col(kind) != "SPECIAL")
    ttm = pit.trailing_sum(probe, usable, keys=keys, date=date, alias="d_ttm", asked=asked)
    both = pit.median_of_newest(ttm, years, keys=keys, date=date, alias="d_med3")
    ok = F.col("d_med3").isNotNull()
    return both.withColumns({"d_ttm": F.when(ok, F.round("d_ttm", decimals)), "d_cons": F.when(ok, F.least(F.round("d_ttm", decimals), "d_med3"))})


def decide(held: Column, *, known_late: Column, quality_pass: Column, d_ttm: Column, d_med3: Column, close: Column, rate: Column, rate_quality: Column, spread: float = SPREAD) -> dict[str, Column]:
    """Decision, reason, yield, hurdle, buffer and maximum_price, by tests in fixed order.

    Information from after the signal rejects; a missing input is a gap, never an exit;
    a yield at the hurdle enters and holds, only one strictly below exits.
    """
    gap = quality_pass.isNull() | d_ttm.isNull() | d_med3.isNull() | close.isNull() | rate.isNull()
    cons = F.least(d_ttm, d_med3)
    rate_of_return, hurdle = cons / F.when(close > 0, close), rate + spread
    meets = rate_of_return >= hurdle
    steps = [
        (known_late, "REJECT", "LOOK_AHEAD"),
        (gap, "DATA_GAP", "MISSING_INPUT"),
        (close <= 0, "REJECT", "PRICE_NOT_POSITIVE"),
        (rate_quality == "SYNTHETIC_CARRY", "REJECT", "SYNTHETIC_RATE"),
        (~quality_pass, "REJECT", "QUALITY_GATE"),
        (held & meets, "HOLD", "AT_OR_ABOVE_HURDLE"),
        (held, "EXIT", "BELOW_HURDLE"),
        (meets, "ENTRY_ELIGIBLE", "AT_OR_ABOVE_HURDLE"),
    ]
    known = ~F.coalesce(known_late, F.lit(False)) & ~gap & (close > 0) & ~F.coalesce(rate_quality == "SYNTHETIC_CARRY", F.lit(False))

    def chain(k: int, other: str) -> Column:
        return reduce(lambda out, s: F.when(s[0], s[k]).otherwise(out), reversed(steps), F.lit(other))

    return {
        "decision": chain(1, "REJECT"),
        "reason": chain(2, "BELOW_HURDLE"),
        "yield": F.when(known, rate_of_return),
        "hurdle": F.when(known, hurdle),
        "buffer": F.when(known, rate_of_return - hurdle),
        "maximum_price": F.when(known & (hurdle > 0), cons / hurdle),
    }


#: Fixed values: status codes of the pre-screen.
PRESCREEN = {
    "price": "BLOCKED_PRICE", "rate": "BLOCKED_CD_RATE", "dividend": "DEFINITELY_INELIGIBLE_NO_TTM_DIVIDEND", "bound": "DEFINITELY_INELIGIBLE_UPPER_BOUND",
    "open": "POTENTIAL_ENTRY_REQUIRES_D_MED3_AND_QUALITY_GATE",
}


def prescreen(close: Column, d_ttm: Column, rate: Column, spread: float = SPREAD) -> Column:
    """A safe upper bound: what can't reach the hurdle by its trailing dividend alone, and why the rest is blocked."""
    return (
        F.when(close.isNull() | (close <= 0), PRESCREEN["price"])
        .when(rate.isNull(), PRESCREEN["rate"])
        .when(d_ttm <= 0, PRESCREEN["dividend"])
        .when(d_ttm / F.when(close > 0, close) < rate + spread, PRESCREEN["bound"])
        .otherwise(PRESCREEN["open"])
    )


def first_exit(holdings: DataFrame, signals: DataFrame, *, key: str, entry: str, date: str = "d") -> DataFrame:
    """For each holding the first date after its entry with decision EXIT (null: still held) and the gap days until then.

    Holdings and signals of a key are one stream by date: looking back from the end, each row knows the next exit, and the gap days between are the
    difference of two running counts. On one day exits come before gaps and both before the holding, so only later signals count.
    """
    said = signals.where(F.col(date).isNotNull()).select(F.col(key).alias("__k"), F.col(date).alias("__at"), F.when(F.col("decision") == "EXIT", 0).otherwise(1).alias("__order"), (F.col("decision") == "DATA_GAP").alias("__gap"))
    held = holdings.select(F.col(key).alias("__k"), F.col(entry).alias("__at"), F.lit(2).alias("__order"), F.struct(*holdings.columns).alias("__h"))
    stream = Window.partitionBy("__k").orderBy("__at", "__order")
    gaps = F.count_if("__gap")
    both = said.unionByName(held, allowMissingColumns=True).withColumn("__gaps", gaps.over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ahead = F.min(F.when(F.col("__order") == 0, F.struct("__at", "__gaps"))).over(stream.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumns({"__next": ahead, "__all": gaps.over(Window.partitionBy("__k"))}).where("__order = 2")
    usable = F.col("__k").isNotNull() & F.col("__at").isNotNull()
    return both.select("__h.*", F.when(usable, F.col("__next.__at")).alias("exit_date"), F.when(usable, F.coalesce("__next.__gaps", "__all") - F.col("__gaps")).otherwise(0).alias("gap_days"))


def quality_gate(opinion: Column, going_concern: Column, profit: Column, *, bank: Column | None = None, npl: Column | None = None, cover: Column | None = None, capital: Column | None = None) -> Column:
    """Standard opinion, no going-concern flag, positive profit; banks also npl <= 5, cover >= 150, capital >= 10.5. Null where an input is."""
    base = (opinion == "STANDARD_UNQUALIFIED") & ~going_concern & (profit > 0)
    if bank is None:
        return base
    return F.when(bank, base & (npl <= 5) & (cover >= 150) & (capital >= 10.5)).otherwise(base)


def readiness(blockers: DataFrame, coverage: DataFrame, *, dataset: str = "dataset") -> DataFrame:
    """Open blockers of the policy and of datasets that aren't ready, and whether all may run: (blocker, source, executable)."""
    policy = blockers.where("open").select(F.col("blocker"), F.lit("POLICY").alias("source"))
    data = coverage.where(~F.col("ready")).select(F.concat(F.lit("DATASET_NOT_READY_"), F.col(dataset).cast("string")).alias("blocker"), F.lit("DATASET").alias("source"))
    every = policy.unionByName(data)
    return every.join(F.broadcast(every.agg((F.count("*") == 0).alias("executable"))))  # one row


def statutory_rates(days: DataFrame, schedule: DataFrame, *, date: str = "d", component: str = "component", start: str = "start", rate: str = "rate") -> DataFrame:
    """The rate of each component of a schedule in force on each date: the latest start (of equal starts the highest rate).

    Starts of a component follow each other, so each is in force until the day before the next; dates meet them as binary blocks of days.
    """
    one = schedule.groupBy(F.col(component).alias("__c"), F.col(start).alias("__from")).agg(F.max(rate).alias("__r"))
    until = F.lead(F.date_sub("__from", 1)).over(Window.partitionBy("__c").orderBy("__from"))
    spans = one.withColumn("__e", F.coalesce(until, F.lit("9999-12-31").cast("date")))
    found = pit.latest_valid(days, spans, keys=["__c"], date=date, start="__from", end="__e", known="__from", value="__r")
    return found.select(date, F.col("__c").alias(component), F.col("value").alias(rate))


def factor_rows(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), date: str = "d", benchmark: DataFrame | None = None) -> DataFrame:
    """Momentum over 20 and 60 rows, relative strength, volatility, mean amount and history length, in one window order."""
    k = {"keys": list(keys), "order": [date]}
    out = timeseries.momentum(bars, n=20, alias="momentum20", **k)
    out = timeseries.momentum(out, n=60, alias="momentum60", **k)
    out = timeseries.volatility(out, **k)
    out = timeseries.average_amount(out, **k)
    out = out.withColumn("history_days", F.count("*").over(Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))
    return out if benchmark is None else timeseries.relative_strength(out, benchmark, date=date, value="momentum20", alias="relative20")


def security_day(bars: DataFrame, *, facts: DataFrame, events: DataFrame, years: DataFrame, rates: DataFrame, quality: Column, keys: Sequence[str] = ("symbol",), date: str = "d") -> tuple[DataFrame, DataFrame]:
    """G1: the security-day frame of month-first days, with its decision; and rows whose facts are from after the day.

    Bars with their 20-row median amount are cut to each key's first day of a month, then joined
    to the bitemporal fact (and when it was known), dividends and the deposit-rate signal.

    Median and cut share one sort by key, month and day. Dividends and rates ask for the first days alone, which are counted out before they are shuffled, so
    that bars are sorted for the frame only.
    """
    keys, month = list(keys), "__month"
    rolled = timeseries.rolling_median(bars.withColumn(month, F.trunc(date, "month")), keys=keys, order=[month, date], value="amount", alias="median_amount")
    firsts = timeseries.first_of_month(rolled, keys=keys, date=date, month=month).drop(month)
    asked = pit.month_firsts(bars, keys=keys, date=date).where(F.col(date).isNotNull()).select(*keys, date)
    known = facts.withColumn("fact_known", F.col("known"))
    with_fact = pit.bitemporal_asof(firsts, known, keys=keys, date=date, values=["value", "fact_known"])
    paid = conservative_dividend(with_fact, events, years, keys=keys, date=date, asked=asked)
    rated = paid.join(pit.rate_signal(asked, rates, date=date), date, "left")
    made = decide(
        F.lit(False),
        known_late=F.coalesce(F.col("fact_known") > F.col(date), F.lit(False)),
        quality_pass=quality,
        d_ttm=F.col("d_ttm"),
        d_med3=F.col("d_med3"),
        close=F.col("close"),
        rate=F.col("rate"),
        rate_quality=F.col("quality"),
    )
    frame = rated.withColumns(made)
    return frame, frame.where(F.col("fact_known") > F.col(date))
