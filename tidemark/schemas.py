"""Fixed schemas of the bitemporal tables; readers pass them, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS, _B, _I, _L = T.StringType(), T.DateType(), T.TimestampType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _table(keys: dict, columns: dict) -> T.StructType:
    common = {"source_id": (_S, False), "source_uri": (_S, True), "is_synthetic": (_B, False)}
    fields = {**{k: (v, False) for k, v in keys.items()}, "effective_date": (_D, False), "known_at": (_TS, False), **columns, **common}
    return T.StructType([T.StructField(n, t, nullable) for n, (t, nullable) in fields.items()])


_SECURITY = {"symbol": _S, "exchange": _S}
TABLES = {
    "prices": _table(_SECURITY, {**{c: (_dec(18, 4), True) for c in ("open", "high", "low", "close")}, "volume": (_L, True), "amount": (_dec(22, 2), True)}),
    "security_master": _table(_SECURITY, {"name": (_S, False), "asset_type": (_S, False), "ownership_type": (_S, False), "listing_date": (_D, True), "delisting_date": (_D, True)}),
    "security_status": _table(_SECURITY, {"risk_status": (_S, False), "trading_status": (_S, False)}),
    "dividends": _table(_SECURITY, {"fiscal_year": (_I, False), "announcement_date": (_D, False), "ex_date": (_D, True), "pay_date": (_D, True), "cash_per_share": (_dec(18, 6), False), "dividend_kind": (_S, False)}),
    "dividend_fiscal_years": _table(_SECURITY, {"fiscal_year": (_I, False), "total_cash_per_share": (_dec(18, 6), False), "fully_resolved": (_B, False)}),
    "financial_facts": _table(_SECURITY, {"report_period": (_D, False), "profile": (_S, False), "metric": (_S, False), "value": (_dec(24, 8), True), "unit": (_S, False)}),
    "corporate_actions": _table(_SECURITY, {"action_type": (_S, False), "share_multiplier": (_dec(18, 8), True), "cash_per_share": (_dec(18, 6), True), "terms_json": (_S, False)}),
    "cd_rates": _table({"bank": _S, "tenor_years": _I}, {"effective_end_date": (_D, True), "annual_rate": (_dec(12, 8), False), "minimum_purchase_cny": (_dec(22, 2), True), "issue_window": (_S, True), "early_withdrawal_terms": (_S, True)}),
    "fee_rules": _table({"venue": _S, "side": _S}, {"effective_end_date": (_D, True), "component": (_S, False), "rate": (_dec(16, 10), True), "minimum_cny": (_dec(18, 4), True), "rule_json": (_S, False)}),
}
