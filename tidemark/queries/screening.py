"""Queries of cross-sectional screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.fixtures import rnd
from tidemark.operators import screening as sc
from tidemark.queries.base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

POLICY = {**sc.POLICY, "asset_type": "STOCK", "trading_status": ("TRADING",), "minimum_history_days": 2, "minimum_amount": 50_000.0}

_REASONS = """concat_ws(',', CASE WHEN asset_type <> 'STOCK' THEN 'UNSUPPORTED_ASSET_TYPE' END, CASE WHEN data_quality NOT IN ('A', 'B') THEN 'DATA_QUALITY_BELOW_B' END,
 CASE WHEN trading_status <> 'TRADING' THEN 'TRADING_STATUS_' || trading_status END, CASE WHEN risk_status <> 'NORMAL' THEN 'RISK_STATUS_' || risk_status END,
 CASE WHEN history_days < 2 THEN 'INSUFFICIENT_HISTORY' END, CASE WHEN last_price IS NULL THEN 'MISSING_PRICE' END, CASE WHEN amount IS NULL OR amount < 50000 THEN 'INSUFFICIENT_LIQUIDITY' END)"""
_FIRST = f"""passed AS (SELECT * FROM cross_section WHERE {_REASONS} = ''),
 first AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY amount DESC, symbol) AS first_rank FROM passed QUALIFY first_rank <= 300)"""


def _mid(f: str, inv: bool = False) -> str:
    base = f"((rank() OVER (PARTITION BY as_of ORDER BY {f} NULLS LAST) - 1 + 0.5 * count({f}) OVER (PARTITION BY as_of, {f})) / count({f}) OVER (PARTITION BY as_of) * 100)"
    return f"CASE WHEN {f} IS NOT NULL THEN CAST({'100 - ' if inv else ''}{base} AS DOUBLE) END"


_FIELDS = {"roe": False, "cash_ratio": False, "pe": True, "pb": True, "momentum20": False, "momentum60": False, "relative20": False, "amount": False, "turnover": False, "volatility": True}
_RANKED = "ranked AS (SELECT *, " + ", ".join(f"{_mid(f, i)} AS r_{f}" for f, i in _FIELDS.items()) + " FROM first)"


def _factor(parts: list[str]) -> str:
    n = len(parts)
    have = " + ".join(f"(CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END)" for p in parts)
    total = " + ".join(f"coalesce({p}, CAST(0 AS DOUBLE))" for p in parts)
    inner = f"greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), ({total}) / ({have}) - CAST(8 AS DOUBLE) * ({n} - ({have})) / {n}))"
    return f"CASE WHEN ({have}) = 0 THEN CAST(0 AS DOUBLE) ELSE {rnd(inner, 4)} END"


_PARTS = {
    "quality": ["r_roe", "r_cash_ratio"],
    "value": ["(CASE WHEN pe > 0 THEN r_pe END)", "(CASE WHEN pb > 0 THEN r_pb END)"],
    "trend": ["r_momentum20", "r_momentum60", "r_relative20"],
    "liquidity": ["r_amount", "r_turnover"],
    "catalyst": ["catalyst"],
    "risk": ["(100 - risk)", "r_volatility"],
}
_SCORED = "scored AS (SELECT *, " + ", ".join(f"{_factor(p)} AS {k}_factor" for k, p in _PARTS.items()) + " FROM ranked)"
_TOTAL = " + ".join(f"{k}_factor * CAST({w} AS DOUBLE)" for k, w in sc.WEIGHTS.items())


@query("k1_hard_failures", X.with_views("cross_section") + f" SELECT symbol, as_of, {_REASONS} AS reasons FROM cross_section")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.hard_failures(X.cross_section(spark, sf_dir), POLICY).select("symbol", "as_of", F.array_join("reasons", ",").alias("reasons"))


@query("k2_top_n", X.with_views("cross_section") + f", {_FIRST} SELECT symbol, as_of, amount, first_rank AS rank FROM first")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = sc.hard_failures(X.cross_section(spark, sf_dir), POLICY).where(F.size("reasons") == 0)
    return sc.top_n(passed, 300, by=[F.desc("amount"), F.asc("symbol")]).select("symbol", "as_of", "amount", F.col("rank").cast("long").alias("rank"))


@query("k3_mid_rank", X.with_views("cross_section") + f" SELECT symbol, as_of, round({_mid('roe')}, 6) AS roe_rank, round({_mid('pb', True)}, 6) AS pb_rank FROM cross_section")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = sc.mid_ranks(X.cross_section(spark, sf_dir).select("symbol", "as_of", "roe", "pb"), {"roe": False, "pb": True})
    return ranked.select("symbol", "as_of", F.round("rank_roe", 6).alias("roe_rank"), F.round("rank_pb", 6).alias("pb_rank"))


@query("k4_factor", X.with_views("cross_section") + f" SELECT symbol, as_of, {_factor(['catalyst', 'risk', 'roe'])} AS f, catalyst IS NULL OR risk IS NULL OR roe IS NULL AS missing FROM cross_section")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, missing = sc.factor([F.col("catalyst"), F.col("risk"), F.col("roe")])
    return X.cross_section(spark, sf_dir).select("symbol", "as_of", f.alias("f"), missing.alias("missing"))


@query(
    "k5_factor_score",
    X.with_views("cross_section") + f""", {_FIRST}, {_RANKED}, {_SCORED}, total AS (SELECT *, {rnd(_TOTAL, 4)} AS score FROM scored)
 SELECT symbol, as_of, score, quality_factor, value_factor, trend_factor, liquidity_factor, catalyst_factor, risk_factor, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS rank
 FROM total QUALIFY rank <= 30""",
)
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.screen(X.cross_section(spark, sf_dir), POLICY)
    return out.select("symbol", "as_of", "score", *[f"{k}_factor" for k in sc.WEIGHTS], F.col("rank").cast("long").alias("rank"))


@query(
    "k6_entry_ranking",
    X.with_views("cross_section") + """ SELECT symbol, as_of, row_number() OVER (PARTITION BY as_of ORDER BY momentum60 DESC, amount DESC, symbol) AS rank FROM cross_section WHERE momentum60 > 0.03
 QUALIFY rank <= as_of % 7 + 5""",
)
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.cross_section(spark, sf_dir).where("momentum60 > 0.03").withColumn("vacancies", F.col("as_of") % 7 + 5)
    out = sc.entry_ranking(rows, month="as_of", buffer="momentum60", amount="amount", symbol="symbol", vacancies="vacancies")
    return out.select("symbol", "as_of", F.col("rank").cast("long").alias("rank"))


@query(
    "k7_top_and_bottom",
    """SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS high_rank, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS low_rank
 FROM customer QUALIFY high_rank <= 10 OR low_rank <= 10""",
)
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.top_and_bottom(X.table(spark, sf_dir, "customer"), within=["c_mktsegment"], value="c_acctbal", tie="c_custkey")
    return out.select("c_mktsegment", "c_custkey", F.col("high_rank").cast("long").alias("high_rank"), F.col("low_rank").cast("long").alias("low_rank"))


@query(
    "k8_latest_valid_run",
    """SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) GROUP BY 1""",
)
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = X.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    bad = X.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("run_id"))
    return sc.latest_valid_run(runs, bad, within=["o_custkey"]).select("o_custkey", "run_id")


@query(
    "k9_latest_cards",
    """SELECT source, max(struct_pack(n := n_chars, k := doc_id)).k AS doc_id FROM documents WHERE lang IN ('en', 'de') GROUP BY 1""",
)
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang")
    return sc.latest_cards(docs, symbol="source", as_of="n_chars", valid=F.col("lang").isin("en", "de"), tie="doc_id").select("source", "doc_id")
