"""Coverage, profiles and quality audits; every one is a pre-aggregated group-by."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_coverage(df: DataFrame, *, start: str, end: str, eff: str = "effective_date", known: str = "known_at", synthetic: str | None = "is_synthetic", keys: Sequence[str] = ()) -> DataFrame:
    """A1: rows, dates, rows known by the day they count from, synthetic rows, and whether the window start to end is covered by real rows."""
    fake = F.col(synthetic) if synthetic else F.lit(False)
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        F.min(eff).alias("minimum_date"),
        F.max(eff).alias("maximum_date"),
        F.count_if(F.col(known).isNotNull()).alias("point_in_time_rows"),
        F.count_if(fake).alias("synthetic_rows"),
    )
    ready = (F.col("row_count") > 0) & (F.col("minimum_date") <= F.lit(start).cast("date")) & (F.col("maximum_date") >= F.lit(end).cast("date")) & (F.col("synthetic_rows") == 0) & (F.col("point_in_time_rows") == F.col("row_count"))
    return counted.withColumn("ready", ready)


def profile(df: DataFrame, *, keys: Sequence[str], date: str, nullable: Sequence[str], ordered: Sequence[tuple[str, str]] = (), window: tuple[str, str] | None = None) -> DataFrame:
    """A2: one row: rows, distinct keys, date bounds, nulls by column, rows where the first date of a pair is after the second, and rows and keys in a window."""
    out = [F.count("*").alias("row_count"), F.count_distinct(*keys).alias("keys"), F.min(date).alias("first"), F.max(date).alias("last")]
    out += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nullable]
    out += [F.count_if(F.col(a) > F.col(b)).alias(f"{a}_after_{b}") for a, b in ordered]
    if window:
        inside = F.col(date).between(*[F.lit(x).cast("date") for x in window])
        out += [F.count_if(inside).alias("window_rows"), F.count_distinct(F.when(inside, F.struct(*keys))).alias("window_keys")]
    return df.agg(*out)


def duplicate_keys(df: DataFrame, *, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A3: surplus rows and duplicated keys (for each value of by)."""
    counted = df.groupBy(*keys, *by).agg(F.count("*").alias("__n")).where("__n > 1")
    return counted.groupBy(*by).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("surplus_rows"), F.count("*").alias("duplicated_keys"))


def field_coverage(df: DataFrame, fields: dict[str, Sequence[str]], *, kind: str) -> DataFrame:
    """A4: for each kind and each field that it should have: kind, field, present, total, coverage."""
    every = list(dict.fromkeys(f for fs in fields.values() for f in fs))
    counts = df.groupBy(kind).agg(F.count("*").alias("total"), *[F.count(f).alias(f) for f in every])
    long = counts.unpivot([kind, "total"], every, "field", "present")
    wanted = reduce(lambda a, b: a | b, [(F.col(kind) == k) & F.col("field").isin(*fs) for k, fs in fields.items()])
    return long.where(wanted).withColumn("coverage", F.col("present") / F.col("total"))


def yearly_summary(df: DataFrame, *, date: str, counts: dict[str, Column]) -> DataFrame:
    """A5: year, row_count and rows that meet each condition."""
    return df.groupBy(F.year(date).cast("long").alias("year")).agg(F.count("*").alias("row_count"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(field, value, n) of each named expression; one pass over df."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in columns.items()])).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def fiscal_totals(events: DataFrame, *, keys: Sequence[str], value: str, known: str) -> DataFrame:
    """Total, the instant when all of it is known, and events."""
    return events.groupBy(*keys).agg(F.sum(value).alias("total"), F.max(known).alias("resolved_at"), F.count("*").alias("events"))


def breadth(quotes: DataFrame, *, change: str, amount: str, keys: Sequence[str] = ()) -> DataFrame:
    """Advancing, declining and unchanged quotes and their amount (null if all are null)."""
    c = F.col(change)
    return quotes.groupBy(*keys).agg(F.count_if(c > 0).alias("advancing"), F.count_if(c < 0).alias("declining"), F.count_if(c == 0).alias("unchanged"), F.sum(amount).alias("amount"))


def universe_coverage(rows: DataFrame, *, exchange: str, quoted: Column, enriched: Column, gate: float = 0.95) -> DataFrame:
    """Listed, quoted, enriched and rate by exchange, and whether every exchange passes the gate."""
    counted = rows.groupBy(exchange).agg(F.count("*").alias("listed"), F.count_if(quoted).alias("quoted"), F.count_if(enriched).alias("enriched"))
    rated = counted.withColumn("rate", F.when(F.col("listed") > 0, F.round(F.col("enriched") / F.col("listed"), 6)).otherwise(0.0))
    passed = rated.agg(F.bool_and(F.col("rate") >= gate).alias("gate_passed"))
    return rated.join(F.broadcast(passed))  # one row


def event_counts(events: DataFrame, *, symbol: str, at: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Events by symbol and year, a column for each kind."""
    return events.groupBy(symbol, F.year(at).cast("long").alias("year")).pivot(kind, list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def last_of_year(events: DataFrame, *, symbol: str, at: str, value: str, tie: str) -> DataFrame:
    """The last value of each symbol and year."""
    return events.groupBy(symbol, F.year(at).cast("long").alias("year")).agg(F.max_by(value, F.struct(at, tie)).alias("last_value"))


def probe_summary(log: DataFrame, *, endpoints: str = "endpoints", failures: str = "semantic_failures") -> DataFrame:
    """Probes, calls that did not answer 200, semantic failures, passed; one row."""
    bad = F.size(F.filter(F.map_values(endpoints), lambda x: x != "200"))
    sums = log.agg(F.count("*").alias("probes"), F.coalesce(F.sum(bad), F.lit(0)).alias("http_failures"), F.coalesce(F.sum(F.size(failures)), F.lit(0)).alias("semantic_failures"))
    return sums.withColumn("passed", (F.col("probes") > 0) & (F.col("http_failures") + F.col("semantic_failures") == 0))


def last_of_key(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each business key the row that comes last."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def delivery_gaps(delivered: DataFrame, announced: DataFrame, *, window: Sequence[str], key: str, total: str) -> DataFrame:
    """Windows whose distinct delivered keys differ from the announced total (0 when nothing came)."""
    got = delivered.groupBy(*window).agg(F.count_distinct(key).alias("delivered"))
    both = announced.join(got, list(window), "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))
    return both.where(F.col("delivered") != F.col(total))
