"""Point-in-time core: what was in force on a date and known at an instant, never later."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bitemporal_asof(probe: DataFrame, facts: DataFrame, *, keys: Sequence[str], date: str = "d", signal: str | None = None, eff: str = "eff", known: str = "known", values: Sequence[str]) -> DataFrame:
    """Probe with the values of the fact in force on its date and known at its signal.

    Of the facts of its keys with eff <= date and known <= signal, the one with the greatest (eff,
    known); nulls where there is none. A fact counts from greatest(eff, known) on, so where date and
    signal are one instant both tables merge into one ordered stream and a running maximum
    answers every probe: one shuffle by key, linear after the sort. With a signal apart from the date, the stream goes by known and
    signal and remembers the newest fact of each day; see _asof_signal(). Facts should be unique by keys, eff and known; facts with a null date are
    never visible.
    """
    keys = list(keys)
    payload = F.struct(F.col(eff).alias("__e"), F.col(known).alias("__k"), *[F.col(v).alias(v) for v in values])
    if signal is not None and signal != date:
        return _asof_signal(probe, facts.where(F.col(eff).isNotNull() & F.col(known).isNotNull()).select(*keys, F.col(eff).alias("__eff"), F.col(known).alias("__known"), payload.alias("__f")), keys, date, signal, values)
    seen = facts.where(F.col(eff).isNotNull() & F.col(known).isNotNull()).select(*keys, F.greatest(eff, known).alias("__at"), F.lit(0).alias("__side"), payload.alias("__f"))
    asks = probe.select(*keys, F.col(date).alias("__at"), F.lit(1).alias("__side"), F.struct(*probe.columns).alias("__p"))
    both = seen.unionByName(asks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = both.withColumn("__best", F.max("__f").over(order)).where("__side = 1")
    return best.select("__p.*", *[F.col(f"__best.{v}").alias(v) for v in values])


def _asof_signal(probe: DataFrame, facts: DataFrame, keys: list[str], date: str, signal: str, values: Sequence[str]) -> DataFrame:
    """J1 with a signal of its own: of each key the fact with the greatest (__eff, __known, values) that has __eff <= date and __known <= signal.

    Facts and probes of a key are one stream by known and signal, so each row is shuffled once and no fact is repeated. What a task holds is the newest
    fact so far of each __eff of the key it is at (as many rows as the key has days, however often each was restated), which a probe bisects.
    """
    instant = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-(1 << 63)))  # noqa: E731 - a null is before every fact
    found = F.when(F.col(date).isNotNull() & F.col(signal).isNotNull(), instant(date)).otherwise(F.lit(-(1 << 63)))
    asked = probe.select(*keys, instant(signal).alias("__at"), F.lit(1).alias("__side"), found.alias("__e"), F.struct(*probe.columns).alias("__p"))
    named = facts.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    made = [f"__v{i}" for i in range(len(values))]
    seen = named.select(*keys, instant("__known").alias("__at"), F.lit(0).alias("__side"), instant("__eff").alias("__e"), *[F.col(f"__f.{v}").alias(m) for m, v in zip(made, values, strict=True)])
    rows = seen.unionByName(asked, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "__at", "__side", *made).select(*keys, "__side", "__e", "__p", *made)
    schema, n = T.StructType([rows.schema["__p"], *[rows.schema[c] for c in made]]), len(keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, days, newest, none = None, [], {}, (None,) * len(made)
        for batch in batches:
            answers, asks = [], []
            key = zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)
            side, eff = (batch.column(n + i).to_numpy().tolist() for i in range(2))
            fact = zip(*(batch.column(n + 3 + i).to_pylist() for i in range(len(made))), strict=True)
            for i, (k, ask, e, f) in enumerate(zip(key, side, eff, fact, strict=True)):
                if k != now:
                    now, days, newest = k, [], {}
                if ask:
                    place = bisect_right(days, e)
                    asks.append(i)
                    answers.append(newest[days[place - 1]] if place else none)
                else:
                    if e not in newest:
                        insort(days, e)
                    newest[e] = f
            columns = zip(*answers, strict=True) if answers else [[]] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(n + 2).take(pa.array(asks, pa.int64())), *[pa.array(list(c), batch.column(n + 3 + i).type) for i, c in enumerate(columns)]], names=["__p", *made])

    return rows.mapInArrow(stream, schema).select("__p.*", *[F.col(m).alias(v) for m, v in zip(made, values, strict=True)])


def bitemporal_asof_by_range(probe: DataFrame, facts: DataFrame, *, keys: Sequence[str], date: str, signal: str, eff: str, known: str, values: Sequence[str]) -> DataFrame:
    """J1 as bitemporal_asof() answers with a signal of its own, also where that is the date."""
    signal_col = "__signal" if signal == date else signal
    p = probe.withColumn("__signal", F.col(signal)) if signal == date else probe
    out = bitemporal_asof(p, facts, keys=keys, date=date, signal=signal_col, eff=eff, known=known, values=values)
    return out.drop("__signal")


def interval_asof(probe: DataFrame, rules: DataFrame, *, date: str, signal: str, venue: str = "venue", side: str = "side", component: str = "component", start: str = "start", end: str = "end", known: str = "known", value: str = "rate", sides: Sequence[str] = ("BUY", "SELL")) -> DataFrame:
    """The rule in force for each probe row, side and component, (date, venue, side, component, value).

    A rule is valid from start to end (null: open) for its venue or for ALL. The latest by (start,
    known) of each side and component counts, and a side's own rule beats one for BOTH. A component without a
    rule for a side gives no row; missing_components() lists those.

    A probe asks for its venue and for ALL, so venues meet by equality. A rule's days are cut into binary blocks (two a level at most) and a date looks its
    LEVELS blocks up; in a block, rules and probes are one stream by when they were known, where a running maximum answers.
    No rule is paired with a date. Rules without start or known are never in force.
    """
    asked = probe.select(date, signal, venue).where(F.col(date).isNotNull() & F.col(signal).isNotNull() & F.col(venue).isNotNull()).distinct()
    asked = asked.withColumn("__in", F.explode(F.array_distinct(F.array(F.col(venue), F.lit("ALL")))))
    whole = rules.where(F.col(start).isNotNull() & F.col(known).isNotNull())
    r = whole.select(F.col(venue).alias("__in"), F.col(side).alias("__side"), F.col(component).alias("component"), F.col(start).alias("__s"), F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")).alias("__e"), F.col(known).alias("__k"), F.col(value).alias("__v"))
    kinds = r.select("__in", "__side", "component").distinct()
    at, order = F.array(*[_block(k, F.shiftright(_day(date), k)) for k in range(LEVELS)]), ["__in", "__side", "component", "__b"]
    asks = asked.join(kinds, "__in").select("__in", "__side", "component", F.explode(at).alias("__b"), F.col(signal).cast("timestamp").alias("__at"), F.lit(1).alias("__ask"), F.struct(date, venue).alias("__p"))
    seen = r.select("__in", "__side", "component", F.explode(_blocks(_day("__s"), _day("__e"))).alias("__b"), F.col("__k").cast("timestamp").alias("__at"), F.lit(0).alias("__ask"), F.struct("__s", "__k", "__v").alias("__f"))
    stream = Window.partitionBy(*order).orderBy("__at", "__ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = seen.unionByName(asks, allowMissingColumns=True).withColumn("__best", F.max("__f").over(stream)).where("__ask = 1 AND __best IS NOT NULL")
    latest = live.groupBy(F.col(f"__p.{date}").alias(date), F.col(f"__p.{venue}").alias(venue), "component", "__side").agg(F.max("__best").alias("b"))
    made = latest.groupBy(date, venue, "component").agg(*[F.coalesce(F.max(F.when(F.col("__side") == s, F.col("b.__v"))), F.max(F.when(F.col("__side") == "BOTH", F.col("b.__v")))).alias(s) for s in sides])
    return made.unpivot([date, venue, "component"], list(sides), "side", value).where(F.col(value).isNotNull())


def missing_components(probe: DataFrame, found: DataFrame, required: Sequence[tuple[str, str]], *, date: str, venue: str = "venue") -> DataFrame:
    """J2's error frame: probe rows lacking a required (side, component)."""
    wanted = probe.select(date, venue).distinct().withColumn("__r", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(c).alias("component")) for s, c in required])))
    return wanted.select(date, venue, "__r.*").join(found, [date, venue, "side", "component"], "left_anti")


def trailing_sum(probe: DataFrame, events: DataFrame, *, keys: Sequence[str], date: str = "d", signal: str | None = None, event_date: str = "ex_date", known: str = "known", value: str = "cash", days: int = 365, lower_inclusive: bool = False, alias: str = "total", asked: DataFrame | None = None) -> DataFrame:
    """Probe with the sum of its keys' events in the days before its date that are known at its signal; 0 without one.

    The window ends with the date itself; its far end is open unless lower_inclusive.
    Probe and events meet by key and year bucket, so a long history is not paired with every probe row. asked: the keys, dates and signals of probe, each once,
    where they are to be had by a shorter way than from probe.
    """
    keys, signal = list(keys), signal or date
    bucket = 1 + days
    p = asked if asked is not None else probe.select(*keys, date, signal).distinct() if signal != date else probe.select(*keys, date).distinct()
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    near = p.withColumn("__b", F.explode(F.array(F.floor(day / bucket), F.floor(day / bucket) - 1)))
    e = events.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(event_date).alias("__d"), F.col(known).alias("__k"), F.col(value).alias("__v")).withColumn("__eb", F.floor(F.datediff("__d", F.lit("1970-01-01")) / bucket))
    age = F.datediff(F.col(date), F.col("__d"))
    cond = [near[k] == e[f"__{k}"] for k in keys] + [F.col("__b") == F.col("__eb")]
    hit = near.join(e, cond).where((age >= 0) & (age <= days if lower_inclusive else age < days) & (F.col("__k") <= F.col(signal)))
    on = [*keys, *dict.fromkeys([date, signal])]
    sums = hit.groupBy(*on).agg(F.sum("__v").alias(alias))
    return probe.join(sums, on, "left").withColumn(alias, F.coalesce(alias, F.lit(0)))


def latest_known(facts: DataFrame, *, keys: Sequence[str], at: Column, known: str = "known", order: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key that is known at the instant, by (known, order)."""
    rest = [c for c in facts.columns if c not in keys]
    best = facts.where(F.col(known) <= at).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(known, *order)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def next_session(probe: DataFrame, sessions: DataFrame, *, date: str = "d", session: str = "session") -> DataFrame:
    """Probe with the first session on or after its date, null past the last.

    Sessions and distinct dates merge into one ordered stream for each year; dates after a year's
    last session take the first session of a later year, from a table of one row a year.
    """
    s = sessions.select(F.col(session).alias("__at")).distinct()
    firsts = s.groupBy(F.year("__at").alias("__fy")).agg(F.min("__at").alias("__first"))
    asks = probe.select(F.col(date).alias("__at")).where(F.col(date).isNotNull()).distinct()
    both = s.withColumn("__ask", F.lit(False)).unionByName(asks.withColumn("__ask", F.lit(True)))
    ahead = Window.partitionBy(F.year("__at")).orderBy("__at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("__next", F.min(F.when(~F.col("__ask"), F.col("__at"))).over(ahead)).where("__ask").withColumn("__y", F.year("__at"))
    later = found.where("__next IS NULL").select("__y").distinct().join(firsts, F.col("__fy") > F.col("__y")).groupBy("__y").agg(F.min("__first").alias("__later"))
    done = found.join(later, "__y", "left").select(F.col("__at").alias(date), F.coalesce("__next", "__later").alias(session))
    return probe.join(done, date, "left")


def month_firsts(sessions: DataFrame, *, date: str = "d", keys: Sequence[str] = ()) -> DataFrame:
    """The first date of each month (of each key)."""
    return sessions.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(F.min(date).alias(date))


#: Levels of the binary blocks of days that an interval is cut into: 2^22 days are more than all dates have.
LEVELS = 23


def _day(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("0001-01-01"))


def _block(level: int, number: Column) -> Column:
    """A block of 2^level days as one number."""
    return F.lit(level << 32) + number.cast("bigint")


def _blocks(first: Column, last: Column) -> Column:
    """The binary blocks that the days from first to last consist of; 2 a level at most, none twice."""
    out = []
    for k in range(LEVELS):
        a, b = F.shiftright(first + ((1 << k) - 1), k), F.shiftright(last + 1, k)
        out.append(F.when((a < b) & (a % 2 == 1), _block(k, a)))
        out.append(F.when((a < b) & (b % 2 == 1), _block(k, b - 1)))
    return F.array_compact(F.array(*out))


def latest_valid(probe: DataFrame, facts: DataFrame, *, keys: Sequence[str], date: str, start: str, end: str, known: str, value: str) -> DataFrame:
    """For each date and key the value of the latest start among facts with start <= date <= end and known <= date, of equal starts the least: (date, keys, value).

    Dates are numbered, and a fact is cut to the numbers of the dates that it is valid on, by a calendar from the first date to the last (so a broadcast of no
    more rows than there are days). Facts valid on no date go, and of all that a key has for the same dates one is kept, in each task before they meet. What is
    left is cut into binary blocks of numbers, and a date looks its LEVELS blocks up: nothing is paired with every date it is valid on.
    """
    keys = list(keys)

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by, "__s").agg(F.min("__v").alias("__v")).groupBy(*by).agg(F.max_by("__v", "__s").alias("__v"), F.max("__s").alias("__s"))

    asked = probe.select(date).where(F.col(date).isNotNull()).distinct()
    order = Window.orderBy("__day")  # days of a calendar: a few thousand rows
    numbered = asked.select(_day(date).alias("__day")).distinct().select("__day", (F.row_number().over(order) - 1).alias("__n"), F.lag("__day").over(order).alias("__before"))
    ends = numbered.agg(F.min("__day").alias("__first"), F.max("__day").alias("__last"), F.max("__n").alias("__most"))
    calendar = numbered.select("__n", F.explode(F.sequence(F.coalesce(F.col("__before") + 1, "__day"), "__day")).alias("__day"))  # each day with the first date from it on
    opens = calendar.select(F.col("__day").alias("__a"), F.col("__n").alias("__from"))
    closes = calendar.select((F.col("__day") - 1).alias("__z"), (F.col("__n") - 1).alias("__to"))
    whole = facts.where(F.col(start).isNotNull() & F.col(known).isNotNull() & F.col(end).isNotNull())
    days = whole.select(*keys, F.col(start).alias("__s"), F.greatest(_day(start), _day(known)).alias("__a"), _day(end).alias("__z"), F.col(value).alias("__v"))
    within = days.join(F.broadcast(ends)).where("__a <= __z AND __a <= __last AND __z >= __first").withColumns({"__a": F.greatest("__a", "__first"), "__z": F.least("__z", "__last")})
    cut = within.join(F.broadcast(opens), "__a").join(F.broadcast(closes), "__z", "left").withColumn("__to", F.coalesce("__to", "__most")).where("__from <= __to")
    once = best(cut.select(*keys, "__from", "__to", "__s", "__v"), [*keys, "__from", "__to"])
    blocks = best(once.select(*keys, "__s", "__v", F.explode(_blocks(F.col("__from"), F.col("__to"))).alias("__b")), [*keys, "__b"])
    at = numbered.select("__day", F.explode(F.array(*[_block(k, F.shiftright("__n", k)) for k in range(LEVELS)])).alias("__b"))
    found = best(at.join(blocks, "__b"), ["__day", *keys])
    return asked.withColumn("__day", _day(date)).join(found, "__day").select(date, *keys, F.col("__v").alias("value"))


def rate_signal(probe: DataFrame, observations: DataFrame, *, date: str = "d", bank: str = "bank", tenor: str = "tenor", rate: str = "rate", start: str = "start", end: str = "end", known: str = "known", synthetic: str | None = None, preferred: Column | None = None, least_banks: int = 2) -> DataFrame:
    """For each date the median over banks of their latest valid rate: preferred tenor (default: 3 to 2017, then 5), else 3.

    (date, rate, tenor, quality, banks); quality is OBSERVED or TENOR_FALLBACK. A tenor needs
    least_banks banks; dates without one give no row. Among a bank's valid observations the latest start
    counts, then the lowest rate. Rows whose column synthetic is true don't count. A date meets one row for each bank, tenor and block of days.
    """
    wanted = F.when(F.col(date) <= F.lit("2017-12-31").cast("date"), 3).otherwise(5) if preferred is None else preferred
    real = observations if synthetic is None else observations.where(~F.coalesce(F.col(synthetic), F.lit(False)))
    named = real.select(F.col(bank).alias("bank"), F.col(tenor).alias("tenor"), F.col(rate).alias("__rate"), F.col(start).alias("__from"), F.col(end).alias("__e"), F.col(known).alias("__k"))
    by_bank = latest_valid(probe, named, keys=["bank", "tenor"], date=date, start="__from", end="__e", known="__k", value="__rate")
    by_tenor = by_bank.groupBy(date, "tenor").agg(F.percentile("value", F.lit(0.5)).alias("rate"), F.count("*").alias("banks")).where(F.col("banks") >= least_banks)
    ranked = by_tenor.where((F.col("tenor") == wanted) | (F.col("tenor") == 3)).groupBy(date).agg(F.max(F.struct((F.col("tenor") == wanted).alias("own"), "tenor", "rate", "banks")).alias("b"))
    return ranked.select(date, "b.rate", "b.tenor", F.when(F.col("b.own"), "OBSERVED").otherwise("TENOR_FALLBACK").alias("quality"), "b.banks")


def one_per_bank(observations: DataFrame, *, keys: Sequence[str], minimum: str = "minimum", rate: str = "rate", tie: Sequence[str] = ("product",)) -> DataFrame:
    """Of each key the row with the lowest minimum (null last), then rate, then tie; with candidates counted."""
    rest = [c for c in observations.columns if c not in keys]
    best = observations.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(minimum).isNull(), minimum, rate, *tie)).alias("__b"), F.count("*").alias("candidates"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest], "candidates")


def unique_rates(observations: DataFrame, *, keys: Sequence[str], rate: str = "rate") -> DataFrame:
    """Keys with exactly one distinct rate, and that rate."""
    return observations.groupBy(*keys).agg(F.count_distinct(rate).alias("__n"), F.max(rate).alias(rate)).where("__n = 1").drop("__n")


def monthly_series(observations: DataFrame, months: DataFrame, *, month: str = "month", order: Sequence[Column | str], values: Sequence[str]) -> DataFrame:
    """The first observation of each month by order; months without one are GAP rows."""
    best = observations.groupBy(month).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("__b"))
    picked = best.select(month, *[F.col(f"__b.{v}").alias(v) for v in values], F.lit("OBSERVED").alias("status"))
    gaps = months.select(month).distinct().join(picked, month, "left_anti").withColumn("status", F.lit("GAP"))
    return picked.unionByName(gaps, allowMissingColumns=True)


def resolved_when_later(years: DataFrame, *, keys: Sequence[str], year: str = "fiscal_year", known: str = "known") -> DataFrame:
    """Years with resolved_at, the instant when any later year of the key first becomes known."""
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(1, Window.unboundedFollowing)
    return years.withColumn("resolved_at", F.min(known).over(w))


def median_of_newest(probe: DataFrame, years: DataFrame, *, keys: Sequence[str], date: str = "d", year: str = "fiscal_year", known: str = "known", value: str = "total", n: int = 3, alias: str = "median") -> DataFrame:
    """Probe with the median of its keys' n newest years known at its date; null unless there are n.

    Years and probes merge into one stream by when a year was known, whose state is the n newest so far: the newest is a running maximum, the
    next one that of what it leaves over, and so on, all in one order. Years should be unique by keys and year.
    """
    keys = list(keys)
    facts = years.where(F.col(known).isNotNull()).select(*keys, F.col(known).alias("__at"), F.lit(0).alias("__ask"), F.struct(F.col(year).alias("y"), F.col(value).cast("double").alias("v")).alias("__x"))
    asks = probe.select(*keys, F.col(date).alias("__at"), F.lit(1).alias("__ask"), F.struct(*probe.columns).alias("__p"))
    stream = Window.partitionBy(*keys).orderBy("__at", "__ask")
    upto, before = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow), stream.rowsBetween(Window.unboundedPreceding, -1)
    both = facts.unionByName(asks, allowMissingColumns=True)
    for k in range(n):  # the k-th newest is the running maximum of what those before it leave over
        held = F.max("__x").over(before)
        both = both.withColumn("__left", F.when(F.col("__x").isNotNull() & held.isNotNull(), F.least("__x", held))).withColumn(f"__t{k}", F.max("__x").over(upto)).withColumn("__x", F.col("__left"))
    values = F.array_sort(F.array_compact(F.array(*[F.col(f"__t{k}.v") for k in range(n)])))
    middle = (F.get(values, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(values, F.ceil((F.size(values) - 1) / 2).cast("int"))) / 2
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("__at").isNotNull())
    return both.where("__ask = 1").select("__p.*", F.when(usable & F.col(f"__t{n - 1}").isNotNull(), middle).alias(alias))
