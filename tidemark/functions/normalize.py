"""Scalar normalisation: every function takes and returns columns, so Catalyst sees all of it but the walk through a text of redact()."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exchange_of(code: Column) -> Column:
    """Exchange from a code's prefix, null for other codes."""
    return F.when(code.rlike("^(5|6|9[01])"), "SSE").when(code.rlike("^(4|8|92)"), "BSE").when(code.rlike("^(0|1|2|3)"), "SZSE")


#: Fixed values: exchange of a market-type code.
MARKET_TYPES = {1: "SSE", 2: "SSE", 4: "SZSE", 8: "SZSE", 16: "SZSE", 32: "SSE", 64: "BSE"}


def exchange_of_market_type(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in MARKET_TYPES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def to_symbol(code: Column, exchange: Column) -> Column:
    """Code and exchange as CODE.SH, .SZ or .BJ; null for another exchange."""
    suffix = F.when(exchange == "SSE", "SH").when(exchange == "SZSE", "SZ").when(exchange == "BSE", "BJ")
    return F.concat(code, F.lit("."), suffix)


def from_vendor_symbol(symbol: Column) -> Column:
    """600000.SS as 600000.SH."""
    return F.regexp_replace(symbol, r"\.SS$", ".SH")


def is_symbol(symbol: Column) -> Column:
    return symbol.rlike(r"^[0-9]{6}\.(SH|SZ|BJ)$")


def safe_number(text: Column, kind: str = "double") -> Column:
    """A number, null where the text is none."""
    return F.trim(text).try_cast(kind)


def safe_date(text: Column) -> Column:
    """A date from yyyy-MM-dd or yyyyMMdd, null where the text is neither."""
    compact = F.regexp_replace(F.trim(text), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(compact.rlike(r"^\d{4}-\d{2}-\d{2}$"), compact.try_cast("date"))


def accounting_number(text: Column) -> Column:
    """Commas and percent signs are dropped, a number in brackets is negative: (1,234.5) is -1234.5, 12% is 12, (12 is 12; null where the rest is no number."""
    bare = F.regexp_replace(F.trim(text), "[,%]", "")
    value = F.regexp_replace(bare, r"^[()]+|[()]+$", "").try_cast("double")
    return F.when(bare.rlike(r"^\(.*\)$"), -value).otherwise(value)


#: P5: fixed values: what one of a unit is in shares or yuan (or per share).
UNIT_SCALE = {"LOT": 100.0, "THOUSAND": 1000.0, "PER_TEN": 0.1, "WAN": 1e4, "YI": 1e8}


def scaled(value: Column, unit: Column) -> Column:
    """P5: value in base units; null for an unknown unit."""
    out = F.lit(None).cast("double")
    for k, v in UNIT_SCALE.items():
        out = F.when(unit == k, value * v if v >= 1 else value / (1 / v)).otherwise(out)
    return out


#: Fixed values: patterns of a date, a rate, an amount in ten thousands, any amount.
_DATE = r"(20\d{2})\s*[年/\-.]\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})"
_RATE = r"(\d+(?:\.\d+)?)\s*%"
_WAN = r"(\d+(?:\.\d+)?)\s*万"
_AMOUNT = r"(\d+(?:\.\d+)?)"


def _date_at(text: Column, n: int) -> Column:
    parts = [F.regexp_extract_all(text, F.lit(_DATE), F.lit(k)) for k in (1, 2, 3)]
    y, m, d = [F.get(p, F.lit(n)) for p in parts]
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def date_in(text: Column) -> Column:
    """The first date in Chinese or numeric form; null without one."""
    return F.when(text.rlike(_DATE), _date_at(text, 0))


def date_range_in(text: Column) -> Column:
    """(start, end) of the first two dates; one date is both."""
    first = date_in(text)
    second = F.when(F.size(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))) > 1, _date_at(text, 1))
    return F.struct(first.alias("start"), F.coalesce(second, first).alias("end"))


def rate_in(text: Column) -> Column:
    """The first percentage as a fraction, 8 decimals."""
    return F.round(F.regexp_extract(text, _RATE, 1).try_cast("double") / 100, 8)


def amount_in(text: Column) -> Column:
    """The first amount in yuan; a number before 万 counts ten thousand."""
    wan = F.regexp_extract(text, _WAN, 1).try_cast("double") * 10000
    return F.coalesce(wan, F.regexp_extract(F.regexp_replace(text, ",", ""), _AMOUNT, 1).try_cast("double"))


#: Fixed values: tenors by name, in years, and the pattern of a product name that starts with one.
TENOR_YEARS = {
    "五年": 5.0, "5年": 5.0, "三年": 3.0, "3年": 3.0, "二年": 2.0, "两年": 2.0, "2年": 2.0, "一年": 1.0, "1年": 1.0, "18个月": 1.5, "九个月": 0.75, "9个月": 0.75,
    "六个月": 0.5, "6个月": 0.5, "三个月": 0.25, "3个月": 0.25, "一个月": 1 / 12, "1个月": 1 / 12,
}
_TENOR = r"^([5321])年(?:期|[A-Z款（(].*)?$"


def tenor_in(text: Column) -> Column:
    """A tenor in years from its name, or from N年 at the start of a product name; else null."""
    bare = F.regexp_replace(text, r"\s+", "")
    named = F.create_map(*[F.lit(x) for kv in TENOR_YEARS.items() for x in kv])
    return F.coalesce(F.try_element_at(named, bare), F.regexp_extract(bare, _TENOR, 1).try_cast("double"))


def conservative_known_at(notice: Column, update: Column, date_only: Column) -> Column:
    """The later of notice and update; an instant known by its date only counts from the day's last second."""
    latest = F.greatest(notice, update)
    return F.when(date_only, F.date_trunc("day", latest) + F.expr("interval 1 day") - F.expr("interval 1 second")).otherwise(latest)


def plan_known_at(day: Column) -> Column:
    """A plan announced on a day counts from 15:00."""
    return day.cast("timestamp") + F.expr("interval 15 hours")


def epoch_ms_date(ms: Column) -> Column:
    """The session-zone date of epoch milliseconds."""
    return F.to_date(F.timestamp_millis(ms))


def with_provenance(df: DataFrame, *, source_id: str, retrieved_at: str, licence: str) -> DataFrame:
    """Provenance columns on every row; staged rows are not eligible until checked."""
    return df.withColumns({"source_id": F.lit(source_id), "retrieved_at": F.lit(retrieved_at).cast("timestamp"), "licence": F.lit(licence), "formal_eligible": F.lit(False)})


def ohlc_checks(bars: DataFrame, *, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """P10: bars with a positive close, and counts of rows dropped, high below open or close, low above them, negative volume (kept)."""
    ok = F.col("close").isNotNull() & (F.col("close") > 0)
    report = bars.groupBy(*keys).agg(
        F.count_if(~ok).alias("dropped"),
        F.count_if(ok & (F.col("high") < F.greatest("open", "close"))).alias("high_too_low"),
        F.count_if(ok & (F.col("low") > F.least("open", "close"))).alias("low_too_high"),
        F.count_if(ok & (F.col("volume") < 0)).alias("negative_volume"),
    )
    return bars.where(ok), report


def risk_status(name: Column) -> Column:
    """DELISTING for 退, ST for names with ST, else NORMAL."""
    return F.when(name.contains("退"), "DELISTING").when(F.upper(name).contains("ST"), "ST").otherwise("NORMAL")


def trading_status(price: Column, amount: Column) -> Column:
    """UNKNOWN without a price, SUSPENDED without an amount, else NORMAL."""
    return F.when(price.isNull(), "UNKNOWN").when(amount.isNull(), "SUSPENDED").otherwise("NORMAL")


def lot_rule(code: Column) -> Column:
    """(minimum, increment, venue) of an order in a code."""
    venue = F.when(code.rlike("^(4|8|92)"), "BSE").when(code.rlike("^68[89]"), "SSE_STAR").when(code.rlike("^3"), "SZSE_CHINEXT").when(code.rlike("^[569]"), "SSE_MAIN").otherwise("SZSE_MAIN")
    return F.struct(F.when(venue == "SSE_STAR", 200).otherwise(100).alias("minimum"), F.when(venue.isin("BSE", "SSE_STAR"), 1).otherwise(100).alias("increment"), venue.alias("venue"))


def valid_quantity(quantity: Column, rule: Column) -> Column:
    """At least the minimum and a whole number of increments above it."""
    return (quantity >= rule["minimum"]) & ((quantity - rule["minimum"]) % rule["increment"] == 0)


def on_tick(price: Column) -> Column:
    """A multiple of 0.01."""
    return F.abs(price * 100 - F.round(price * 100)) < 1e-6


def trade_cost(side: Column, gross: Column, *, commission: float = 0.0003, minimum: float = 5.0, stamp: float = 0.0005, transfer: float = 0.00001, regulatory: float = 0.0) -> Column:
    """Commission (at least minimum), stamp duty on sales, transfer and regulatory fees, half up to cents."""
    g = gross.cast("decimal(22,2)")

    def part(rate: float) -> Column:
        return g * F.lit(rate).cast("decimal(10,8)")

    fees = F.greatest(F.lit(minimum).cast("decimal(22,2)"), part(commission)) + F.when(side == "SELL", part(stamp)).otherwise(F.lit(0)) + part(transfer) + part(regulatory)
    return F.round(fees, 2).cast("decimal(22,2)")


def slipped(price: Column, side: Column, bps: float, cents: bool = False) -> Column:
    """A buy pays bps more, a sale gets bps less; with cents to two decimals."""
    out = price * F.when(side == "BUY", 1 + bps / 10000).otherwise(1 - bps / 10000)
    return F.round(out + 1e-9, 2) if cents else out


def freshness(quoted: Column, now: Column) -> Column:
    """LIVE to 300 seconds, DELAYED to a day, else STALE."""
    age = F.unix_timestamp(now) - F.unix_timestamp(quoted)
    return F.when(age <= 300, "LIVE").when(age <= 86400, "DELAYED").otherwise("STALE")


def sector_heat(change: Column, amount: Column) -> Column:
    """A score to 100 of move and turnover, one decimal; a missing or negative amount counts as none, without a change there is no score."""
    turnover = F.log10(F.greatest(F.coalesce(amount, F.lit(0.0)) / 1e8, F.lit(0.0)) + 1) * 12
    return F.when(change.isNotNull(), F.round(F.least(F.lit(100.0), F.abs(change) * 10 + turnover), 1))


def without_excluded(df: DataFrame, excluded: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Rows whose keys no policy excludes."""
    return df.join(excluded, list(on), "left_anti")


def is_full_report(title: Column, *, wanted: str = "年度报告", unwanted: Sequence[str] = ("摘要", "英文", "取消", "已取消")) -> Column:
    """A full annual report by its title."""
    return title.contains(wanted) & ~title.rlike("|".join(unwanted))


def title_year(title: Column) -> Column:
    """The year in a title, null without one."""
    return F.regexp_extract(title, r"(20[0-9]{2})", 1).try_cast("int")


def in_session(ts: Column) -> Column:
    """From 09:30 to 11:30 or from 13:00 to 15:00 of a weekday, each end included."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts)
    weekday = ~F.dayofweek(ts).isin(1, 7)
    return weekday & (second.between(34200, 41400) | second.between(46800, 54000))


def trading_days(days: DataFrame, holidays: DataFrame, *, date: str = "d", first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """Days that trade (weekdays that are no holiday), and days outside the calendar's cover."""
    covered = F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    weekday = ~F.dayofweek(date).isin(1, 7)
    return days.where(covered & weekday).join(holidays, date, "left_anti"), days.where(~covered)


#: P20: fixed values: parts of key names whose values are withheld.
SENSITIVE = ("api_key", "apikey", "authorization", "token", "secret", "cookie", "email", "phone")
_STRING, _BLANK = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"[\t\n\r ]*+"


def redact(json_text: Column, sensitive: Sequence[str] = SENSITIVE) -> Column:
    """P20: JSON text with the values of sensitive keys replaced at any depth, whatever they are: strings, numbers, literals, objects, arrays.

    Strings are taken as a whole, so nothing inside one is read as a key or a bracket; a key counts as it reads once its escapes are
    decoded. A text is gone through once, from string to bracket, with the open brackets at hand; an object or array that is withheld ends at its own bracket. A text whose
    brackets or quotes don't match, or that has control characters, is withheld whole.
    """
    withheld, closing = '"[REDACTED]"', {"{": "}", "[": "]"}
    names, control = re.compile("|".join(sensitive)), re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    token, colon = re.compile(rf'(?s){_STRING}|[\[\]{{}}"]'), re.compile(f"{_BLANK}:{_BLANK}")
    scalar = re.compile(rf'(?s){_STRING}|[^\t\n\r ,\[\]{{}}"]++')

    def names_sensitive(part: str) -> bool:
        if "\\" in part:
            try:
                part = json.loads(part)
            except ValueError:
                return False
        return names.search(part.lower()) is not None

    def walked(text: str, known: dict[str, bool]) -> str:
        if control.search(text):
            return withheld
        out, done, at, opened, held = [], 0, 0, [], 0  # held: brackets open when the withheld object or array has ended, plus one
        while m := token.search(text, at):
            part, at = m[0], m.end()
            if part == '"':
                return withheld
            if part in "{[":
                opened.append(closing[part])
            elif part in "}]":
                if not opened or opened.pop() != part:
                    return withheld
                if held == len(opened) + 1:
                    done, held = at, 0
            elif not held:
                named = known.get(part)
                if named is None:
                    if len(known) >= 10_000:
                        known.clear()
                    named = known[part] = names_sensitive(part)
                if named and (c := colon.match(text, at)):
                    value = c.end()
                    if text[value : value + 1] in closing:
                        out += [text[done:value], withheld]
                        held = len(opened) + 1
                    elif s := scalar.match(text, value):
                        out += [text[done:value], withheld]
                        at = done = s.end()
        return withheld if opened else "".join([*out, text[done:]])

    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}  # strings seen, and whether they name something sensitive
        return pd.Series([None if t is None else walked(t, known) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(json_text)


def standard_bars(vendor: DataFrame, mapping: Mapping[str, str], *, adjustment: str, expected_end: str) -> tuple[DataFrame, DataFrame]:
    """Vendor bars (all text) of known exchanges in the standard schema, and errors: duplicate (symbol, date) or a last date that isn't the expected end.

    mapping names the vendor's column for each of symbol, d, open, high, low, close, volume, amount and tradable.
    """
    m = {k: F.col(v) for k, v in mapping.items()}
    numbers = {k: safe_number(m[k]).alias(k) for k in ("open", "high", "low", "close", "amount")}
    code = m["symbol"]
    rows = vendor.select(to_symbol(code, exchange_of(code)).alias("symbol"), exchange_of(code).alias("exchange"), safe_date(m["d"]).alias("d"), *numbers.values(), safe_number(m["volume"], "bigint").alias("volume"), (m["tradable"] == "1").alias("tradable"), F.lit(adjustment).alias("adjustment")).where("symbol IS NOT NULL")
    twice = rows.groupBy("symbol", "d").agg(F.count("*").alias("n")).where("n > 1").select("symbol", F.lit("DUPLICATE_BAR").alias("error"), F.col("d").cast("string").alias("detail"))
    ends = rows.groupBy("symbol").agg(F.max("d").alias("d")).where(~F.col("d").eqNullSafe(F.lit(expected_end).cast("date"))).select("symbol", F.lit("UNEXPECTED_END").alias("error"), F.col("d").cast("string").alias("detail"))
    return rows, twice.unionByName(ends)


def standard_dividends(vendor: DataFrame, mapping: Mapping[str, str], *, first: str, last: str) -> DataFrame:
    """Vendor dividends (all text, cash per ten shares) in the standard schema, whole duplicates once, with ex dates from first to last and a candidate known_at."""
    m = {k: F.col(v) for k, v in mapping.items()}
    rows = vendor.select(m["symbol"].alias("symbol"), safe_date(m["notice"]).alias("announcement_date"), safe_date(m["ex"]).alias("ex_date"), scaled(safe_number(m["cash"]), F.lit("PER_TEN")).alias("cash_per_share"))
    inside = F.col("ex_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return rows.where(inside).dropDuplicates().withColumn("known_at", plan_known_at(F.col("announcement_date")))


def month_windows(spans: DataFrame, *, start: str, end: str) -> DataFrame:
    """Each span cut at months: window_start, window_end."""
    cut = spans.withColumn("__m", F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))))
    return cut.select(*spans.columns, F.greatest(F.col(start), "__m").alias("window_start"), F.least(F.col(end), F.last_day("__m")).alias("window_end"))


def day_windows(spans: DataFrame, *, start: str, end: str, days: int = 1) -> DataFrame:
    """Each span cut into windows of so many days."""
    cut = spans.withColumn("window_start", F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"interval {days} days"))))
    return cut.withColumn("window_end", F.least(F.col(end), F.date_add("window_start", days - 1)))
