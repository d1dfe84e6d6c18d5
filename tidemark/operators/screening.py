"""Cross-sectional screening: many dates score at once, ranks come from counts by value range, and top rows are cut in each task before they meet by date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hard filter thresholds and factor weights of the default policy.
POLICY = {
    "asset_type": "ORDINARY_A_SHARE",
    "data_quality": ("A", "B"),
    "trading_status": ("NORMAL",),
    "risk_status": ("NORMAL",),
    "minimum_history_days": 120,
    "minimum_amount": 50_000_000.0,
    "first_target": 300,
    "second_target": 30,
    "missing_penalty": 8.0,
}
WEIGHTS = {"quality": 0.20, "value": 0.15, "trend": 0.25, "liquidity": 0.15, "catalyst": 0.10, "risk": 0.15}


def hard_failures(rows: DataFrame, policy: Mapping = POLICY, *, price: str = "last_price", amount: str = "amount", as_of_ok: Column | None = None) -> DataFrame:
    """K1: rows with reasons, an array of every hard filter that the row fails, in fixed order."""

    def fails(cond: Column, reason: Column | str) -> Column:
        return F.when(cond, reason if isinstance(reason, Column) else F.lit(reason))

    codes = [
        fails(F.col("asset_type") != policy["asset_type"], "UNSUPPORTED_ASSET_TYPE"),
        fails(~F.col("data_quality").isin(*policy["data_quality"]), "DATA_QUALITY_BELOW_B"),
        fails(~F.col("trading_status").isin(*policy["trading_status"]), F.concat(F.lit("TRADING_STATUS_"), "trading_status")),
        fails(~F.col("risk_status").isin(*policy["risk_status"]), F.concat(F.lit("RISK_STATUS_"), "risk_status")),
        fails(F.col("history_days") < policy["minimum_history_days"], "INSUFFICIENT_HISTORY"),
        fails(F.col(price).isNull(), "MISSING_PRICE"),
        fails(F.col(amount).isNull() | (F.col(amount) < policy["minimum_amount"]), "INSUFFICIENT_LIQUIDITY"),
    ]
    if as_of_ok is not None:
        codes.append(fails(~F.coalesce(as_of_ok, F.lit(False)), "INVALID_AS_OF"))
    return rows.withColumn("reasons", F.array_compact(F.array(*codes)))


def top_n(rows: DataFrame, n: int, *, by: Sequence[Column], within: Sequence[str] = ("as_of",), alias: str = "rank") -> DataFrame:
    """K2: the first n rows of each date by the given order, ranked from 1. Each task keeps its own first n rows of a date before they meet."""
    return rows.withColumn(alias, F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col(alias) <= n)


#: Value ranges of an octave (of the values between a number and its double): counts are summed up by range before values are ranked within.
RANGES = 256


def _range_of(value: str) -> Column:
    """A number that grows with value, the same for values of one range; zero, both infinities and NaN are ranges of their own."""
    size = f"floor((log2(least(abs({value}), 1.7976931348623157E308D)) + 1100) * {RANGES})"
    return F.expr(f"CASE WHEN isnan({value}) THEN 10000000 WHEN {value} = 0 THEN 0 ELSE CAST(signum({value}) AS BIGINT) * ({size} + IF(abs({value}) > 1.7976931348623157E308D, 1, 0)) END")


def mid_ranks(rows: DataFrame, fields: Mapping[str, bool], *, within: Sequence[str] = ("as_of",), prefix: str = "rank_") -> DataFrame:
    """K3: rows with prefix + field for each of fields (name: inverted), the mid-rank percentile (0 to 100) among the field's non-null values; null where it is null.

    Ranks come from counts: distinct values of all fields are counted at once (in part before any shuffle, so ties of any number are one row), counts are summed by value
    range, a running sum over ranges tells what lies below each, and values are ranked within their range only. No date's
    cross-section is ever in one task. Values are compared as double. Repeated rows all count and all come back.
    """
    within, names = list(within), list(fields)
    row, where = F.struct(*rows.columns), ", ".join([*within, "k"])
    entries = [F.struct(F.lit(-1).alias("k"), F.lit(None).cast("double").alias("v"), row.alias("row"))] + [F.struct(F.lit(i).alias("k"), F.col(f).cast("double").alias("v"), F.when(F.lit(False), row).alias("row")) for i, f in enumerate(names)]
    long = rows.select(*within, F.sha2(F.to_json(row), 256).alias("id"), F.explode(F.array(*entries)).alias("p")).select(*within, "id", "p.k", "p.v", "p.row")
    counts = long.where("v IS NOT NULL").groupBy(*within, "k", "v").agg(F.count("*").alias("n")).withColumn("s", _range_of("v"))
    ranges = counts.groupBy(*within, "k", "s").agg(F.sum("n").alias("n"))
    ranges = ranges.selectExpr(*within, "k", "s", f"coalesce(sum(n) OVER (PARTITION BY {where} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below", f"sum(n) OVER (PARTITION BY {where}) AS total")
    inner = counts.withColumn("inner", F.expr(f"coalesce(sum(n) OVER (PARTITION BY {where}, s ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    same = lambda a, b, *more: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in [*within, "k", *more]))
    score = "(below + inner + 0.5D * n) / total * 100"
    turned = ", ".join(str(i) for i, f in enumerate(names) if fields[f]) or "-1"
    scored = inner.alias("a").join(ranges.alias("b"), same("a", "b", "s")).selectExpr(*[f"a.{c}" for c in within], "a.k", "a.v", f"CASE WHEN a.k IN ({turned}) THEN 100 - {score} ELSE {score} END AS score")
    found = long.alias("a").join(scored.alias("b"), same("a", "b", "v"), "left").select("a.id", "a.k", "a.row", "b.score")
    back = found.groupBy("id").agg(F.first("row", True).alias("row"), F.count_if(F.col("k") == -1).alias("copies"), *[F.expr(f"max(IF(k = {i}, score, NULL)) AS r{i}") for i in range(len(names))])
    return back.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*", *[F.col(f"r{i}").alias(prefix + f) for i, f in enumerate(names)])


def factor(parts: Sequence[Column], penalty: float = POLICY["missing_penalty"]) -> tuple[Column, Column]:
    """K4: mean of the parts there are, less penalty times the share missing, within 0 to 100, 4 decimals; and whether any is missing."""
    n, present = len(parts), F.array_compact(F.array(*[p.cast("double") for p in parts]))
    have, total = F.size(present), F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total / have - penalty * (n - have) / n)), 4)
    return F.when(have == 0, 0.0).otherwise(score), have < n


def score_factors(rows: DataFrame, *, weights: Mapping[str, float] = WEIGHTS, penalty: float = POLICY["missing_penalty"], top: int = POLICY["second_target"], within: Sequence[str] = ("as_of",), symbol: str = "symbol") -> DataFrame:
    """K5: six factors, their weighted score, reason codes and rank of the top rows of each date.

    Values of no use to a factor (a PE or PB that is not positive) give no part, but stay in
    the population that others are ranked in.
    """

    names = {"roe": False, "cash_ratio": False, "pe": True, "pb": True, "momentum20": False, "momentum60": False, "relative20": False, "amount": False, "turnover": False, "volatility": True}
    ranked = mid_ranks(rows, names, within=within, prefix="__")

    def part(f: str) -> Column:
        return F.col(f"__{f}")

    parts = {
        "quality": [part("roe"), part("cash_ratio")],
        "value": [F.when(F.col("pe") > 0, part("pe")), F.when(F.col("pb") > 0, part("pb"))],
        "trend": [part("momentum20"), part("momentum60"), part("relative20")],
        "liquidity": [part("amount"), part("turnover")],
        "catalyst": [F.col("catalyst")],
        "risk": [100 - F.col("risk"), part("volatility")],
    }
    made = {k: factor(p, penalty) for k, p in parts.items()}
    scored = ranked.withColumns({f"{k}_factor": v for k, (v, _) in made.items()} | {"__missing": reduce(lambda a, b: a | b, [m for _, m in made.values()])})
    total = reduce(lambda a, b: a + b, [F.col(f"{k}_factor") * w for k, w in weights.items()])
    out = scored.withColumn("score", F.round(total, 4)).withColumn("reason_codes", F.array_compact(F.array(F.lit("FACTOR_SCORE_V1"), F.when(F.col("__missing"), "MISSING_FACTOR_PENALTY_APPLIED"))))
    return top_n(out, top, by=[F.desc("score"), F.asc(symbol)], within=within).drop("__missing", *[f"__{f}" for f in names])


def screen(rows: DataFrame, policy: Mapping = POLICY, **options) -> DataFrame:
    """K1 to K5: hard filter, the most traded of each date, then the best scores."""
    passed = hard_failures(rows, policy).where(F.size("reasons") == 0).drop("reasons")
    first = top_n(passed, policy["first_target"], by=[F.desc("amount"), F.asc("symbol")], alias="first_rank")
    return score_factors(first, top=policy["second_target"], penalty=policy["missing_penalty"], **options)


def entry_ranking(candidates: DataFrame, *, month: str, buffer: str, amount: str, symbol: str, vacancies: str) -> DataFrame:
    """K6: eligible rows of each month by yield buffer, traded amount and symbol, cut at that month's vacancies."""
    w = Window.partitionBy(month).orderBy(F.desc(buffer), F.desc(amount), F.asc(symbol))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col(vacancies))


def top_and_bottom(rows: DataFrame, *, within: Sequence[str], value: str, tie: str, n: int = 10) -> DataFrame:
    """K7: the n highest and n lowest rows of each kind, each row once."""
    high = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(value), F.asc(tie)))
    low = F.row_number().over(Window.partitionBy(*within).orderBy(F.asc(value), F.asc(tie)))
    return rows.withColumns({"high_rank": high, "low_rank": low}).where((F.col("high_rank") <= n) | (F.col("low_rank") <= n))


def latest_valid_run(runs: DataFrame, invalidated: DataFrame, *, run_id: str = "run_id", at: str = "created_at", within: Sequence[str] = ()) -> DataFrame:
    """K8: the latest run (of each group) that has not been invalidated."""
    rest = runs.join(invalidated, run_id, "left_anti")
    best = rest.groupBy(*within).agg(F.max_by(F.struct(*runs.columns), F.struct(at, run_id)).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def latest_cards(cards: DataFrame, *, symbol: str, as_of: str, valid: Column, tie: str) -> DataFrame:
    """K9: each symbol's latest valid card."""
    best = cards.where(valid).groupBy(symbol).agg(F.max_by(F.struct(*cards.columns), F.struct(as_of, tie)).alias("b"))
    return best.select("b.*")
