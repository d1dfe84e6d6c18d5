"""Rolling windows, indicators, adjustment and sequences, by key in time order.

Windows of the same key and order share one shuffle and sort. Only recursive indicators (EMA,
MACD, Wilder RSI) leave the JVM: a pass over each key's sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _last(keys: Sequence[str], order: Sequence[str], n: int):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def rolling_median(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, n: int = 20, alias: str = "median") -> DataFrame:
    """Median of the last n rows; fewer count too."""
    values = F.sort_array(F.collect_list(F.col(value).cast("double")).over(_last(keys, order, n)))  # n numbers at most; a percentile keeps a map of counts for each row
    middle = [F.get(values, half((F.size(values) - 1) / 2).cast("int")) for half in (F.floor, F.ceil)]
    return df.withColumn(alias, 0.5 * middle[0] + 0.5 * middle[1])


def sma(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str = "close", windows: Sequence[int] = (5, 10, 20, 60)) -> DataFrame:
    """ma<n>, null until the window is full, 6 decimals."""
    full = {n: _last(keys, order, n) for n in windows}
    return df.withColumns({f"ma{n}": F.when(F.count(value).over(w) == n, F.round(F.avg(value).over(w), 6)) for n, w in full.items()})


def bollinger(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str = "close", n: int = 20, width: float = 2.0) -> DataFrame:
    """boll_mid, boll_upper, boll_lower by the population deviation; null until the window is full."""
    w = _last(keys, order, n)
    full, mid, dev = F.count(value).over(w) == n, F.avg(value).over(w), F.stddev_pop(value).over(w)
    return df.withColumns({"boll_mid": F.when(full, F.round(mid, 6)), "boll_upper": F.when(full, F.round(mid + width * dev, 6)), "boll_lower": F.when(full, F.round(mid - width * dev, 6))})


def momentum(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], n: int, value: str = "close", alias: str = "momentum") -> DataFrame:
    """Change over n rows in percent, 4 decimals; null when too short or the base is not positive."""
    base = F.lag(value, n).over(_ordered(keys, order))
    return df.withColumn(alias, F.when(base > 0, F.round((F.col(value) / base - 1) * 100, 4)))


def relative_strength(df: DataFrame, benchmark: DataFrame, *, date: str, value: str, alias: str = "relative") -> DataFrame:
    """Value less the benchmark's on that date (date, benchmark), 4 decimals; null where either is."""
    return df.join(benchmark.select(date, F.col("benchmark")), date, "left").withColumn(alias, F.round(F.col(value) - F.col("benchmark"), 4)).drop("benchmark")


def volatility(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], n: int = 20, value: str = "close", alias: str = "volatility") -> DataFrame:
    """Sample deviation of the last n returns, annualised, percent, 4 decimals; null until there are n."""
    before = F.lag(value).over(_ordered(keys, order))
    w = _last(keys, order, n)
    returned = df.withColumn("__r", F.when(before > 0, F.col(value) / before - 1))
    return returned.withColumn(alias, F.when(F.count("__r").over(w) == n, F.round(F.stddev_samp("__r").over(w) * (252**0.5) * 100, 4))).drop("__r")


def average_amount(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], n: int = 20, value: str = "amount", alias: str = "avg_amount") -> DataFrame:
    """Mean of the last n values if none is null, 2 decimals."""
    w = _last(keys, order, n)
    return df.withColumn(alias, F.when(F.count(value).over(w) == n, F.round(F.avg(value).over(w), 2)))


class _Indicators:
    """What W3 to W5 remember of a key: three moving averages, the last value, and Wilder's averages, or the moves they start from while these are fewer than SPAN."""

    SPAN = 14

    def __init__(self) -> None:
        self.fast = self.slow = self.signal = self.last = self.gain = self.loss = None
        self.moves = np.zeros(0)

    @staticmethod
    def _smooth(x: np.ndarray, before: float | None, alpha: float) -> np.ndarray:
        """Exponential averages that go on from the one before, or start at the first value."""
        seeded = x if before is None else np.concatenate([[before], x])
        return pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(seeded) - len(x) :]

    def _rsi(self, x: np.ndarray) -> np.ndarray:
        """Null for the first SPAN values of a key; without losses 100, or 50 if there is no gain either."""
        n, out = self.SPAN, np.full(len(x), np.nan)
        new = np.diff(x) if self.last is None else np.diff(x, prepend=self.last)
        moves = np.concatenate([self.moves, new]) if self.gain is None else new
        if self.gain is None and len(moves) < n:
            self.moves = moves
            return out
        up, down = np.maximum(moves, 0), np.maximum(-moves, 0)
        if self.gain is None:
            up, down = (np.concatenate([[v[:n].mean()], v[n:]]) for v in (up, down))
        gain, loss = self._smooth(up, self.gain, 1 / n), self._smooth(down, self.loss, 1 / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[len(x) - len(gain) :] = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / loss))
        self.gain, self.loss, self.moves = gain[-1], loss[-1], moves[:0]
        return out

    def go_on(self, x: np.ndarray) -> list[np.ndarray]:
        """The indicators at the next values of the key."""
        fast, slow, rsi = self._smooth(x, self.fast, 2 / 13), self._smooth(x, self.slow, 2 / 27), self._rsi(x)
        signal = self._smooth(fast - slow, self.signal, 2 / 10)
        self.fast, self.slow, self.signal, self.last = fast[-1], slow[-1], signal[-1], x[-1]
        return [fast, slow, fast - slow, signal, 2 * (fast - slow - signal), rsi]


def recursive_indicators(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str = "close", decimals: int | None = 6) -> DataFrame:
    """Df with ema12, ema26, dif, dea, macd (histogram twice the gap) and rsi14, rounded to decimals.

    EMAs start from the first value, alpha 2 / (span + 1); MACD is EMA12 - EMA26, its signal the EMA9 of that. A key's rows stream through one
    task in order; from batch to batch it carries seven numbers of the key it is at, whatever the length of the history. Values must not be null.
    """
    keys, names = list(keys), ["ema12", "ema26", "dif", "dea", "macd", "rsi14"]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, carried = None, _Indicators()
        for pdf in frames:
            group = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()  # rows of a key lie together
            starts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(pdf)]
            made, x = [np.empty(len(pdf)) for _ in names], pdf[value].to_numpy(float)
            for a, b in zip(starts, starts[1:], strict=False):
                key = tuple(None if pd.isna(k) else k for k in pdf[keys].iloc[a]) if b > a else now
                if key != now:
                    now, carried = key, _Indicators()
                for column, v in zip(made, carried.go_on(x[a:b]) if b > a else [], strict=False):
                    column[a:b] = v
            yield pdf.assign(**{n: v if decimals is None else np.round(v, decimals) for n, v in zip(names, made, strict=True)})

    out = df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    return out.withColumn("rsi14", F.when(~F.isnan("rsi14"), F.col("rsi14")))


def adjust_bars(bars: DataFrame, actions: DataFrame, *, keys: Sequence[str], as_of: str, mode: str, date: str = "d", effective: str = "effective_date", announced: str = "announced_at", factor: str = "factor", prices: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Forward or backward adjusted prices, 6 decimals, by actions announced and effective by as_of.

    Forward multiplies by the factors effective after the bar; backward divides by those on
    or before it. Factors and bars merge into one ordered stream of each key, whose running product
    answers every bar.
    """
    if mode not in ("forward", "backward"):
        raise ValueError(f"mode: forward or backward, not {mode!r}")
    known = actions.where((F.col(announced) <= F.lit(as_of).cast("timestamp")) & (F.col(effective) <= F.lit(as_of).cast("date")))
    moves = known.groupBy(*keys, F.col(effective).alias("__at")).agg(F.product(factor).alias("__f"))
    both = bars.select(*keys, F.col(date).alias("__at"), F.struct(*bars.columns).alias("__bar")).unionByName(moves, allowMissingColumns=True)
    # a frame that grows from the stream's start is carried along; one that shrinks to its end would be computed anew for each row
    order = [F.desc("__at"), F.col("__f").isNotNull()] if mode == "forward" else [F.col("__at"), F.col("__f").isNull()]
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__x", F.product(F.coalesce("__f", F.lit(1.0))).over(run))
    out = both.where("__bar IS NOT NULL").select("__bar.*", "__x")
    return out.withColumns({p: F.round(F.col(p) * F.col("__x") if mode == "forward" else F.col(p) / F.col("__x"), 6) for p in prices}).drop("__x")


def drawdown(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Peak so far, drawdown and maximum drawdown so far, percent and positive."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    peaked = df.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak") * 100).otherwise(0.0))
    return peaked.withColumn("max_drawdown", F.max("drawdown").over(w))


def earliest(df: DataFrame, *, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of each key the row that comes first."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def revision_lineage(filings: DataFrame, *, keys: Sequence[str], order: Sequence[str], title: str, doc_id: str, terms: Sequence[str]) -> DataFrame:
    """revision_role and supersedes: a title with a revision term supersedes the filing before it.

    A filing that supersedes and is then superseded itself is SUPERSEDED, as the later mark wins.
    """
    w = _ordered(keys, order)
    revises = F.col(title).rlike("|".join(terms))
    marked = filings.withColumn("__is", revises & F.lag(doc_id).over(w).isNotNull()).withColumn("__before", F.lag(doc_id).over(w)).withColumn("__next", F.lead("__is").over(w))
    role = F.when(F.col("__next"), "SUPERSEDED").when(F.col("__is"), "REVISION").otherwise("ORIGINAL")
    return marked.withColumn("revision_role", role).withColumn("supersedes", F.when(F.col("__is"), F.col("__before"))).drop("__is", "__before", "__next")


def calendar_gaps(intervals: DataFrame, *, keys: Sequence[str], start: str, end: str, first: str, last: str) -> DataFrame:
    """The calendar days of each key from first to last that no interval covers, as ranges (start, end, days).

    A running maximum of the ends so far shows where the next start leaves days open: intervals of one start are one row, each key adds one
    row behind its last day, and nothing is taken apart into days. Intervals without a start or an end cover nothing.
    """
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    inside = intervals.select(*keys, F.greatest(F.when(F.col(start).isNotNull(), lo), start).alias("a"), F.when(F.col(end).isNotNull(), F.least(end, hi)).alias("b"))
    spans = inside.where("a <= b").groupBy(*keys, "a").agg(F.max("b").alias("b"))
    behind = intervals.select(*keys).distinct().select(*keys, F.date_add(hi, 1).alias("a"), F.lit(None).cast("date").alias("b"))
    so_far = F.max("b").over(_ordered(keys, ["a"]).rowsBetween(Window.unboundedPreceding, -1))
    open_days = spans.unionAll(behind).withColumn("start", F.coalesce(F.date_add(so_far, 1), lo)).where("a > start")
    return open_days.select(*keys, "start", F.date_sub("a", 1).alias("end"), F.datediff("a", "start").cast("long").alias("days"))


def _running(points: DataFrame, keys: Sequence[str], at: str, change: str) -> DataFrame:
    """keys, start, end (the day before the next change) and n, the running sum of change, from points of change."""
    w = _ordered(keys, [at])
    sums = points.groupBy(*keys, at).agg(F.sum(change).alias("__c")).where("__c <> 0")
    return sums.select(*keys, F.col(at).alias("start"), F.date_sub(F.lead(at).over(w), 1).alias("end"), F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def _ends(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, at, change: +1 where a span starts, -1 behind its end."""
    both = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("change")), F.struct(F.date_add(end, 1).alias("at"), F.lit(-1).alias("change")))
    return spans.select(*keys, F.explode(both).alias("p")).select(*keys, "p.*")


#: Fixed values: the tenor that counts first, by the day from which it does; names of the counters.
PREFERRED = (("0001-01-01", 3), ("2018-01-01", 5))
COVERED, UNCOVERED, RANGES = "covered_calendar_days", "uncovered_calendar_days", "uncovered_range_count"
COVERED_TENOR, COVERED_BANKS = "covered_tenor_%dy_days", "covered_%d_bank_days"


def rate_coverage(observations: DataFrame, *, first: str, last: str, bank: str = "bank", tenor: str = "tenor", rate: str = "rate", start: str = "start", end: str = "end", preferred: Sequence[tuple[str, int]] = PREFERRED, fallback: int = 3, least_banks: int = 2) -> tuple[DataFrame, DataFrame]:
    """Counts of calendar days from first to last by what covers them (counter, n) with the number of uncovered ranges, and these ranges (start, end, days).

    A bank counts for a tenor on a day when exactly one distinct rate of it is valid. The day takes the tenor preferred from
    that day on if least_banks banks count, else the fallback. Rows without a start or an end don't count.

    Spans become points of change: the spans of one rate are merged, a running sum over the starts and ends of a bank's rates tells where it has
    exactly one, and one over those of a tenor's banks how many it has. No interval is taken apart into days. What is left for one order over all are the days on which a
    number of banks changes, at most the days from first to last.
    """
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    kinds = sorted({t for _, t in preferred} | {fallback})
    inside = observations.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(tenor).isin(*kinds)).select(F.col(bank).alias("bank"), F.col(tenor).alias("tenor"), F.col(rate).alias("rate"), F.greatest(start, lo).alias("start"), F.least(end, hi).alias("end")).where("start <= end AND bank IS NOT NULL AND rate IS NOT NULL")
    own = ["tenor", "bank", "rate"]
    merged = _running(_ends(inside, own), own, "at", "change").where("n > 0")
    single = _running(_ends(merged, own[:2]), own[:2], "at", "change").where("n = 1")
    banks = _running(_ends(single, own[:1]), own[:1], "at", "change")
    # a row for each day of change, and for the first day and those on which the preference changes
    steps = observations.sparkSession.createDataFrame([(d,) for d in sorted({first, *(d for d, _ in preferred if first < d <= last)})], "d string").select(F.col("d").cast("date").alias("start"), F.lit(None).cast("int").alias("tenor"), F.lit(None).cast("long").alias("n"))
    changes = banks.where(F.col("start") <= hi).select("start", F.col("tenor").cast("int").alias("tenor"), "n").unionAll(steps)
    each = changes.groupBy("start").agg(*[F.max(F.when(F.col("tenor") == t, F.col("n"))).alias(f"n{t}") for t in kinds])
    w = Window.orderBy("start")
    states = each.select("start", F.coalesce(F.date_sub(F.lead("start").over(w), 1), hi).alias("end"), *[F.coalesce(F.last(f"n{t}", True).over(w), F.lit(0)).alias(f"n{t}") for t in kinds])
    wanted = reduce(lambda a, p: F.when(F.col("start") >= F.lit(p[0]).cast("date"), p[1]).otherwise(a), sorted(preferred), F.lit(None).cast("int"))
    has = lambda t: F.col(f"n{t}") >= least_banks
    pick = F.coalesce(*[F.when((wanted == t) & has(t), F.struct(F.lit(t).alias("tenor"), F.col(f"n{t}").alias("banks"))) for t in kinds], F.when(has(fallback), F.struct(F.lit(fallback).alias("tenor"), F.col(f"n{fallback}").alias("banks"))))
    spans = states.select("start", "end", (F.datediff("end", "start") + 1).cast("long").alias("days"), pick.alias("b"))
    open_span = F.col("b").isNull()
    begins = open_span & ~F.coalesce(F.lag(open_span).over(w), F.lit(False))
    gaps = spans.withColumn("__g", F.sum(begins.cast("int")).over(w)).where(open_span).groupBy("__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("days").alias("days")).drop("__g")
    names = F.when(open_span, F.array(F.lit(UNCOVERED))).otherwise(F.array(F.lit(COVERED), F.format_string(COVERED_TENOR, F.col("b.tenor")), F.format_string(COVERED_BANKS, F.col("b.banks"))))
    counts = spans.select(F.explode(names).alias("counter"), "days").groupBy("counter").agg(F.sum("days").alias("n"))
    return counts.unionAll(gaps.agg(F.lit(RANGES).alias("counter"), F.count("*").alias("n"))), gaps


def first_of_month(rows: DataFrame, *, keys: Sequence[str], date: str, month: str | None = None) -> DataFrame:
    """All rows of the first day of each month that has any; month names a column of the month, if there is one that rows are sorted by."""
    w = Window.partitionBy(*keys, F.col(month) if month else F.trunc(date, "month"))
    return rows.withColumn("__f", F.min(date).over(w)).where(F.col(date) == F.col("__f")).drop("__f")
