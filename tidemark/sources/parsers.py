"""Vendor text lines to typed rows; the same columns work in batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: positions of the fields in a quote line, what their units scale to, the fields that are missing unless positive, and the least fields of a line.
QUOTE_FIELDS = {
    "name": 1, "code": 2, "price": 3, "previous_close": 4, "open": 5, "quoted_at": 30, "change": 31, "change_pct": 32, "high": 33, "low": 34, "volume": 36, "amount": 37,
    "turnover_pct": 38, "pe_ttm": 39, "float_market_cap": 44, "total_market_cap": 45, "pb": 46, "limit_up": 47, "limit_down": 48,
}
QUOTE_SCALE = {"volume": 100.0, "amount": 10_000.0, "total_market_cap": 100_000_000.0, "float_market_cap": 100_000_000.0}
QUOTE_OPTIONAL = ("amount", "turnover_pct", "pe_ttm", "float_market_cap", "total_market_cap", "pb", "limit_up", "limit_down")
STOCK_PARTS, INDEX_PARTS = 50, 6
#: Fixed values: fields of an index line; other fields of a stock line are no fields of these.
INDEX_FIELDS = ("name", "code", "price", "change", "change_pct", "amount", "quoted_at")


def parse_quotes(lines: DataFrame, *, value: str = "value", index: bool = False) -> DataFrame:
    """v_code="a~b~..." lines as quotes, volumes in shares, amounts and market values in yuan.

    A stock line has 50 fields and a name. Numbers that are missing or none count as 0, those of QUOTE_OPTIONAL are null
    unless positive (4 decimals). With index the lines are of indices: 6 fields suffice and INDEX_FIELDS are read.
    Lines that are no quotes give no row.
    """
    body = F.regexp_extract(value, r'^\s*v_[a-z]{2}[0-9]+="([^"]*)"', 1)
    parts = lines.withColumn("__p", F.split(body, "~")).where(F.size("__p") >= (INDEX_PARTS if index else STOCK_PARTS))
    names = INDEX_FIELDS if index else tuple(QUOTE_FIELDS)

    def field(name: str) -> Column:
        return F.trim(F.get("__p", F.lit(QUOTE_FIELDS[name])))

    def number(name: str) -> Column:
        scale, read = QUOTE_SCALE.get(name, 1.0), F.coalesce(field(name).try_cast("double"), F.lit(0.0))
        return F.when(read > 0, F.round(read * scale, 4)) if name in QUOTE_OPTIONAL else read * scale

    rest = [c for c in lines.columns if c != value]
    if not index:
        parts = parts.where(field("name") != "")
    return parts.select(*rest, field("code").alias("code"), field("name").alias("name"), F.try_to_timestamp(field("quoted_at"), F.lit("yyyyMMddHHmmss")).alias("quoted_at"), *[number(n).alias(n) for n in names if n not in ("name", "code", "quoted_at")])


def parse_sectors(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """A JSONP map of comma lists as sectors: key, code, name, members, change_pct, amount; short lists are left out."""
    body = F.from_json(F.regexp_extract(value, r"(?s)=\s*(\{.*\})", 1), "map<string,string>")
    rest = [c for c in lines.columns if c != value]
    rows = lines.select(*rest, F.explode(body).alias("key", "__v")).withColumn("__p", F.split("__v", ",")).where(F.size("__p") >= 8)

    def number(i: int) -> Column:
        return F.col("__p")[i].try_cast("double")

    return rows.select(*rest, "key", F.col("__p")[0].alias("code"), F.col("__p")[1].alias("name"), F.col("__p")[2].try_cast("bigint").alias("members"), number(5).alias("change_pct"), number(7).alias("amount"))
