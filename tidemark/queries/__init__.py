"""The registered queries of the market operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries import documents, joins, ledger, normalize, pit, quality, screening, signals, sources, streams, timeseries

MODULES = (sources, normalize, pit, joins, quality, timeseries, screening, signals, ledger, documents, streams)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The security-day frame with its decision."""
    return signals.QUERIES["g1_security_day"](spark, sf_dir)
