"""Joins between staged tables: coverage flags, cross-checks, pending work, overrides and fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_exists(left: DataFrame, right: DataFrame, *, on: Sequence[str], where: Column | None = None, alias: str = "present") -> DataFrame:
    """Left with a flag whether a right row with its keys exists (and meets where)."""
    keys = (right if where is None else right.where(where)).select(*on).distinct().withColumn(alias, F.lit(True))
    return left.join(keys, list(on), "left").withColumn(alias, F.coalesce(alias, F.lit(False)))


def coverage_of(identities: DataFrame, sources: dict[str, DataFrame], *, on: Sequence[str], date: str = "last_date") -> DataFrame:
    """Identities with has_<source> for each source, covered (any of them) and the latest date of all."""
    out = identities
    for name, df in sources.items():
        latest = df.groupBy(*on).agg(F.max(date).alias(f"__{name}"))
        out = out.join(latest, list(on), "left").withColumn(f"has_{name}", F.col(f"__{name}").isNotNull())
    dates = [F.col(f"__{n}") for n in sources]
    latest = F.greatest(*dates) if len(dates) > 1 else dates[0]
    covered = [F.col(f"has_{n}") for n in sources]
    any_of = covered[0]
    for c in covered[1:]:
        any_of = any_of | c
    return out.withColumns({"covered": any_of, "latest": latest}).drop(*[f"__{n}" for n in sources])


def cross_check(a: DataFrame, b: DataFrame, *, on: Sequence[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """Full outer match of two sources: keys, a, b, difference, status (MATCHED, DIFFERENT, ONLY_A, ONLY_B)."""
    left = a.select(*on, F.col(value).alias("a"), F.lit(True).alias("__a"))
    right = b.select(*on, F.col(value).alias("b"), F.lit(True).alias("__b"))
    diff = F.abs(F.col("a") - F.col("b"))
    status = F.when(F.col("__b").isNull(), "ONLY_A").when(F.col("__a").isNull(), "ONLY_B").when(diff <= tolerance, "MATCHED").otherwise("DIFFERENT")
    return left.join(right, list(on), "full_outer").select(*on, "a", "b", diff.alias("difference"), status.alias("status"))


def key_difference(expected: DataFrame, found: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Keys that are expected but not found (MISSING) or found but not expected (EXTRA)."""
    e, f = expected.select(*on).distinct(), found.select(*on).distinct()
    missing = e.join(f, list(on), "left_anti").withColumn("status", F.lit("MISSING"))
    return missing.unionByName(f.join(e, list(on), "left_anti").withColumn("status", F.lit("EXTRA")))


def with_mapping(df: DataFrame, mapping: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Df with the columns of a mapping table; the optimizer broadcasts the table while its size allows."""
    return df.join(mapping, list(on), "inner")


def only_listed(df: DataFrame, listed: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Rows of df whose keys are listed, each once."""
    return df.join(listed, list(on), "left_semi")


def pending(plan: DataFrame, done: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Rows of the plan not yet done (also: failures without a later success)."""
    return plan.join(done, list(on), "left_anti")


def with_override(base: DataFrame, override: DataFrame, *, on: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Base with override's values where it has any, column by column; and override rows that are unknown or duplicate.

    Of duplicate override keys none is applied.
    """
    counted = override.withColumn("__n", F.count("*").over(Window.partitionBy(*on)))
    known = base.select(*on).distinct().withColumn("__known", F.lit(True))
    checked = counted.join(known, list(on), "left")
    errors = checked.where((F.col("__n") > 1) | F.col("__known").isNull())
    errors = errors.select(*on, F.when(F.col("__n") > 1, "DUPLICATE_OVERRIDE").otherwise("UNKNOWN_OVERRIDE").alias("error")).distinct()
    use = counted.where("__n = 1").select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    merged = base.join(use, list(on), "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])
    return merged, errors


def causal_link(events: DataFrame, *, keys: Sequence[str], order: Sequence[str], kind: str = "kind", cause: str, effects: dict[str, Column], cause_id: str) -> DataFrame:
    """Effect events with the id of the newest earlier cause of the matching kind, null without one.

    effects maps an event kind to the condition that a cause event must meet to explain it.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    linked = F.lit(None).cast(events.schema[cause_id].dataType)
    for name, meets in effects.items():
        linked = F.when(F.col(kind) == name, F.last(F.when((F.col(kind) == cause) & meets, F.col(cause_id)), ignorenulls=True).over(w)).otherwise(linked)
    return events.withColumn("cause_id", linked).where(F.col(kind).isin(*effects))


def with_fallback(first: DataFrame, second: DataFrame, *, on: Sequence[str], columns: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """First with gaps filled from second, field by field; sources lists which of them gave a value."""
    other = second.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = first.join(other, list(on), "full_outer")
    own = [F.col(c).isNotNull() for c in columns]
    filled = [F.col(c).isNull() & F.col(f"__{c}").isNotNull() for c in columns]

    def any_of(xs: list[Column]) -> Column:
        out = xs[0]
        for x in xs[1:]:
            out = out | x
        return out

    lineage = F.array_compact(F.array(F.when(any_of(own), F.lit(names[0])), F.when(any_of(filled), F.lit(names[1]))))
    return joined.withColumn("sources", lineage).withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def derived_key_join(left: DataFrame, right: DataFrame, on: Mapping[str, tuple[Column | str, Column | str]], how: str = "inner") -> DataFrame:
    """An equi join on keys that are computed on either side: name: (left, right), columns or expressions such as a CASE.

    A key's name stays as a column; other columns that both sides have are the left one's.
    """
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    a = left.withColumns({k: as_column(x) for k, (x, _) in on.items()})
    b = right.withColumns({k: as_column(y) for k, (_, y) in on.items()})
    return a.join(b.select(*on, *[c for c in b.columns if c not in on and c not in a.columns]), list(on), how)
