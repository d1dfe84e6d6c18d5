"""Costs, returns and risk of long histories against plain Python."""

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents as dc
from tidemark.operators import ledger as lg

START = date(2020, 1, 1)


def test_moving_average_cost_by_hand(spark):
    rng = random.Random(1)
    fills = [(rng.choice(["a", "b", None]), rng.randrange(400), i, rng.choice(["BUY", "BUY", "SELL"]), rng.choice([float(rng.randrange(0, 9)), None]), rng.choice([1.0 + rng.random(), None, 2.0])) for i in range(500)] + [("none", 1, 1, "SELL", 5.0, 1.0)]
    fees = 0.25
    want = {}
    for k, _, _, side, q, p in sorted(fills, key=lambda r: (r[1], r[2])):
        held, mean = want.get(k, (0.0, 0.0))
        if q is not None and p is not None:
            if side == "BUY" and held + q:
                held, mean = held + q, (held * mean + q * p + fees) / (held + q)
            elif side == "SELL" and q <= held:
                held, mean = held - q, 0.0 if q == held else mean
        want[k] = held, mean
    df = spark.createDataFrame(fills, "k string, d long, seq long, side string, quantity double, price double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # keys go across batches
    try:
        got = {r["k"]: (r["quantity"], r["average_cost"]) for r in lg.moving_average_cost(df, keys=["k"], order=["d", "seq"], fees=F.lit(fees)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert lg.moving_average_cost(df.where("false"), keys=["k"], order=["d", "seq"]).count() == 0


def test_rate_of_return_of_many_flows_a_day(spark):
    """A year at ten percent, paid in and out in very many parts."""
    flows = [("a", START, -1.0)] * 3000 + [("a", START + timedelta(365), 1.1)] * 3000 + [("b", START, -5.0), ("c", START, -5.0), ("c", START, 5.0)]
    got = {r["k"]: r["xirr"] for r in lg.xirr(spark.createDataFrame(flows, "k string, d date, a double").repartition(9), keys=["k"], date="d", amount="a", steps=60).collect()}
    assert got["a"] == pytest.approx(0.1) and got["b"] is None


def test_risk_metrics_by_hand(spark):
    rng = random.Random(2)
    nav, e = [], 100.0
    for i in range(300):
        e *= 1 + rng.gauss(0.0005, 0.02)
        nav.append(("a", START + timedelta(i + i // 5 * 2), i, e, 100.0 if i == 0 else 0.0))
    nav += [("one", START, 0, 50.0, 50.0), ("down", START, 0, 90.0, 100.0), ("down", START + timedelta(9), 1, 99.0, 0.0), ("up", START, 0, 10.0, 10.0), ("up", START + timedelta(365), 1, 11.0, 0.0)]
    df = spark.createDataFrame(nav, "k string, d date, seq long, equity double, flow_in double").repartition(5)
    got = {r["k"]: r.asDict() for r in lg.risk_metrics(lg.flow_adjusted_returns(df, keys=["k"], order=["d", "seq"]), keys=["k"], date="d", order=["d", "seq"]).collect()}
    returns = [0.0 + nav[0][3] / 100 - 1] + [b[3] / a[3] - 1 for a, b in zip(nav[:299], nav[1:300], strict=True)]
    index, peak, at, worst, longest = 1.0, 1.0, None, 0.0, 0
    for r, row in zip(returns, nav, strict=False):
        index *= 1 + r
        peak = max(peak, index)
        worst = min(worst, index / peak - 1)
        at = row[1] if index >= peak or at is None else at
        longest = max(longest, (row[1] - at).days)
    a, years = got["a"], (nav[299][1] - START).days / 365
    assert a["periods"] == 300 and a["volatility"] == pytest.approx(statistics.stdev(returns) * 252**0.5) and a["win_rate"] == pytest.approx(sum(r > 0 for r in returns) / 300)
    assert a["downside_deviation"] == pytest.approx((statistics.fmean(min(r, 0) ** 2 for r in returns) * 252) ** 0.5)
    assert a["annual_return"] == pytest.approx(index ** (1 / years) - 1) and a["calmar"] == pytest.approx(a["annual_return"] / -worst) and a["longest_drawdown"] == longest
    assert got["one"]["annual_return"] is None and got["one"]["calmar"] is None and got["one"]["longest_drawdown"] == 0
    assert got["down"]["longest_drawdown"] == 9 and got["up"]["calmar"] is None and got["up"]["annual_return"] == pytest.approx(0.1)
    fills = spark.createDataFrame([("a", START, 2.0, 30.0), ("a", START, -1.0, 40.0), ("zero", START, 1.0, 1.0)], "k string, d date, quantity double, price double")
    year = statistics.fmean(r[3] for r in nav[:300] if r[1].year == 2020)
    assert {r["k"]: r["turnover"] for r in lg.turnover(fills, df, keys=["k"], date="d").collect()} == {"a": pytest.approx(50 / year), "zero": None}


def test_research_gate_by_hand(spark):
    rng, t = random.Random(3), lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    cards = [(i, rng.choice(["x", "y", None]), rng.choice([t(rng.randrange(60)), None]), t(rng.randrange(90)), rng.choice(["ACTIVE", "DRAFT"])) for i in range(60)]
    scores = [(i, bool(i % 3)) for i in range(0, 60) if i % 7]
    orders = [(i, rng.choice(["x", "y", "z", None]), rng.choice([t(rng.randrange(80)), None]), rng.randrange(60)) for i in range(200)]
    passed = dict(scores)
    want = []
    for i, s, at, v in orders:
        seen = max(((a, c, e, st) for c, sym, a, e, st in cards if s and at and sym == s and a and a <= at), default=None)
        flags = (False,) * 5 if seen is None else (True, seen[1] == v, seen[2] > at, seen[3] == "ACTIVE", bool(passed.get(seen[1])))
        want.append((i, *flags, all(flags)))
    made = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    out = dc.research_gate(made(orders, "id long, symbol string, at timestamp, v long"), made(cards, "card_id long, symbol string, as_of timestamp, expires_at timestamp, status string"), made(scores, "card_id long, passed boolean"), order_id="id", symbol="symbol", at="at", version="v")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_indicators_go_on_from_batch_to_batch(spark):
    """Histories shorter and longer than a batch, by the recursions row by row; keys with null, and one value."""
    from tidemark.operators import timeseries as ts

    rng = random.Random(4)
    lengths = {"a": 100, "b": 14, "c": 15, "d": 1, None: 40, "flat": 20, "e": 2}
    rows = [(k, i, 10.0 if k == "flat" else 10 + rng.random()) for k, n in lengths.items() for i in range(n)]
    want = {}
    for k in lengths:
        x = [v for key, _, v in rows if key == k]
        fast = slow = x[0]
        dea = gain = loss = 0.0
        for i, v in enumerate(x):
            if i:
                fast, slow = fast + 2 / 13 * (v - fast), slow + 2 / 27 * (v - slow)
                dea += 0.2 * (fast - slow - dea)
                up, down = max(v - x[i - 1], 0), max(x[i - 1] - v, 0)
                gain, loss = (gain + up / 14, loss + down / 14) if i <= 14 else ((gain * 13 + up) / 14, (loss * 13 + down) / 14)
            rsi = None if i < 14 else (100.0 if gain > 0 else 50.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
            want[k, i] = (fast, slow, fast - slow, dea, 2 * (fast - slow - dea), rsi)
    df = spark.createDataFrame(rows, "k string, seq long, close double").repartition(6)
    for size in (3, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r["k"], r["seq"]): tuple(r)[3:] for r in ts.recursive_indicators(df, keys=["k"], order=["seq"], decimals=None).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys()
        for at, w in want.items():
            assert got[at][:5] == pytest.approx(w[:5], abs=1e-9) and (got[at][5] is None) == (w[5] is None) and (w[5] is None or got[at][5] == pytest.approx(w[5]))
    assert ts.recursive_indicators(df.where("false"), keys=["k"], order=["seq"]).count() == 0
