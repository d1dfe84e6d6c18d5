"""Ranks, intervals and streams of the market operators against brute force over random rows, and what their plans must not hold."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.operators import screening as sc
from tidemark.operators import timeseries as ts
from tidemark.plans import signals as sg

START = date(2019, 1, 1)


def day(n):
    return START + timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def got(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_mid_ranks_by_brute_force(spark):
    rng, inf = random.Random(1), math.inf
    odd = [None, math.nan, inf, -inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, 1.0, math.nextafter(1.0, 2), -1e-9]
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([*odd, rng.gauss(0, 1), rng.randrange(5) * 1.0, 1 + rng.random() / 1e6]), rng.choice([None, rng.randrange(9)])) for i in range(900)]
    rows += [rows[0], rows[0], ("z", 1, None, 3)]
    df = spark.createDataFrame(rows, "as_of string, symbol long, a double, b long").repartition(5)
    out = sc.mid_ranks(df, {"a": False, "b": True})
    key = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)

    def rank(v, group, inverted):
        if v is None:
            return None
        known = [key(x) for x in group if x is not None]
        score = (sum(x < key(v) for x in known) + 0.5 * sum(x == key(v) for x in known)) / len(known) * 100
        return 100 - score if inverted else score

    want = [(d, s, rank(a, [r[2] for r in rows if r[0] == d], False), rank(b, [r[3] for r in rows if r[0] == d], True)) for d, s, a, b in rows]
    assert got(out, "as_of", "symbol", "rank_a", "rank_b") == sorted(want, key=repr)
    windows = [x for x in plan(out).splitlines() if "Window [" in x or "Window(" in x]
    assert windows and all(" k#" in x for x in windows)
    assert sc.mid_ranks(df.where("false"), {"a": False}).count() == 0


def brute_rules(probes, rules):
    out = []
    for d, s, v in {p for p in probes if None not in p}:
        best = {}
        for venue, side, comp, a, b, k, rate in rules:
            if venue in ("ALL", v) and a and k and a <= d and (b is None or d <= b) and k <= s:
                best[comp, side] = max(best.get((comp, side), (date.min,)), (a, k, rate))
        for comp in {c for c, _ in best}:
            for side in ("BUY", "SELL"):
                if found := best.get((comp, side)) or best.get((comp, "BOTH")):
                    out.append((d, v, comp, side, found[2]))
    return sorted(out, key=repr)


RULES = "venue string, side string, component string, start date, end date, known date, rate double"


def test_rules_in_force_by_brute_force(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["ALL", "V1", "V2", "V9", None]), rng.choice(["BUY", "SELL", "BOTH"]), rng.choice("xyz"), day(a := rng.randrange(300)), rng.choice([None, day(a + rng.randrange(60)), day(a)]), rng.choice([day(rng.randrange(300)), None]), i / 8) for i in range(400)]
    probes = [(day(rng.randrange(320)), None if i == 5 else day(rng.randrange(320)), rng.choice(["V1", "V2", "V3", "ALL", None])) for i in range(150)]
    probes = list({(d, v): (d, s, v) for d, s, v in probes}.values())
    out = pit.interval_asof(spark.createDataFrame(probes, "d date, s date, venue string"), spark.createDataFrame(rules, RULES), date="d", signal="s")
    assert got(out, "d", "venue", "component", "side", "rate") == brute_rules(probes, rules)


def test_a_hundred_thousand_rules(spark):
    """No nested loop, and rows in proportion to rules and probes."""
    n = 100_000
    rules = spark.range(n).selectExpr("IF(id % 3 = 0, 'ALL', 'V1') AS venue", "'BOTH' AS side", "'FEE' AS component", "date_add(DATE'2000-01-01', CAST(id % 5000 AS INT)) AS start", "IF(id % 7 = 0, NULL, date_add(DATE'2000-01-01', CAST(id % 5000 + 400 AS INT))) AS end", "date_add(DATE'2000-01-01', CAST(id % 5000 AS INT)) AS known", "CAST(id AS DOUBLE) AS rate")
    probe = spark.range(1000).selectExpr("date_add(DATE'2000-01-01', CAST(id * 6 AS INT)) AS d", "'V1' AS venue").withColumn("s", F.col("d"))
    out = pit.interval_asof(probe, rules, date="d", signal="s")
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    found = {(r["d"], r["side"]): r["rate"] for r in out.collect()}
    for i in (0, 17, 400, 833, 999):
        d = 6 * i
        ids = [k for k in range(n) if (a := k % 5000) <= d and (k % 7 == 0 or d <= a + 400)]
        latest = max(k % 5000 for k in ids)
        assert found[date(2000, 1, 1) + timedelta(days=d), "BUY"] == max(k for k in ids if k % 5000 == latest)


def test_gaps_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, day(s := rng.randrange(-20, 130))]), rng.choice([None, day(s + rng.randrange(-2, 9))])) for _ in range(60)] + [("never", day(200), day(300)), ("whole", day(-9), day(400)), ("nulls", None, None)]
    df = spark.createDataFrame(rows, "k string, s date, e date")
    out = ts.calendar_gaps(df, keys=["k"], start="s", end="e", first=str(day(0)), last=str(day(120)))
    want = []
    for key in {r[0] for r in rows}:
        free = [d for d in map(day, range(121)) if not any(k == key and s and e and s <= d <= e for k, s, e in rows)]
        begins = [d for d in free if d - timedelta(1) not in free]
        want += [(key, d, (end := next(x for x in free if x >= d and x + timedelta(1) not in free)), (end - d).days + 1) for d in begins]
    assert got(out, "k", "start", "end", "days") == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_rate_coverage_by_brute_force(spark, seed):
    rng, before = random.Random(seed), date(2017, 11, 20)
    near = lambda n: before + timedelta(days=n)
    rows = [(rng.choice("ABCD"), rng.choice([1, 3, 5]), rng.choice([0.02, 0.03]), rng.choice([near(a := rng.randrange(-5, 95)), None, near(a)]), near(a + rng.randrange(0, 12))) for _ in range(70)]
    obs = spark.createDataFrame(rows, "bank string, tenor long, rate double, start date, end date")
    counts, gaps = ts.rate_coverage(obs, first=str(near(0)), last=str(near(80)))
    want, free = {"uncovered_range_count": 0}, []
    for d in map(near, range(81)):
        for t in (3 if d < date(2018, 1, 1) else 5, 3):
            valid = {}
            for b, tenor, r, s, e in rows:
                if tenor == t and s and s <= d <= e:
                    valid.setdefault(b, set()).add(r)
            banks = sum(len(x) == 1 for x in valid.values())
            if banks >= 2:
                names = ["covered_calendar_days", f"covered_tenor_{t}y_days", f"covered_{banks}_bank_days"]
                break
        else:
            names = ["uncovered_calendar_days"]
            free.append(d)
        for x in names:
            want[x] = want.get(x, 0) + 1
    begins = [d for d in free if d - timedelta(1) not in free]
    want["uncovered_range_count"] = len(begins)
    assert {r["counter"]: r["n"] for r in counts.collect()} == want
    assert got(gaps, "start", "days") == sorted([(d, next(n for n in range(1, 90) if d + timedelta(n) not in free)) for d in begins], key=repr)
    assert ts.rate_coverage(obs.where("false"), first=str(near(0)), last=str(near(80)))[1].collect()[0]["days"] == 81


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_median_of_newest_by_brute_force(spark, n):
    rng = random.Random(n)
    years = list({(k, y): (k, y, rng.choice([day(rng.randrange(200)), None, day(50)]), rng.randrange(100) / 4) for k in "abc" for y in range(2000, 2012)}.values())
    probes = [(rng.choice(["a", "b", "c", "none", None]), rng.choice([day(rng.randrange(220)), day(50), None])) for _ in range(120)]
    out = pit.median_of_newest(spark.createDataFrame(probes, "k string, d date").repartition(3), spark.createDataFrame(years, "k string, fiscal_year int, known date, total double").repartition(4), keys=["k"], n=n)

    def median(k, d):
        seen = sorted((y, v) for x, y, a, v in years if x == k and a and d and a <= d)[-n:]
        values = sorted(v for _, v in seen)
        return (values[(n - 1) // 2] + values[n // 2]) / 2 if len(values) == n else None

    assert got(out, "k", "d", "median") == sorted([(k, d, median(k, d)) for k, d in probes], key=repr)
    assert "Join" not in plan(out)


def test_first_exit_by_brute_force(spark):
    rng = random.Random(6)
    signals = [(rng.choice(["a", "b", None]), rng.choice([day(rng.randrange(120)), None]), rng.choice(["HOLD", "HOLD", "DATA_GAP", "EXIT"])) for _ in range(150)]
    holdings = [(rng.choice(["a", "b", "c", None]), rng.choice([day(rng.randrange(-5, 130)), None]), i // 2) for i in range(80)] + [("a", day(3), 7)] * 2
    out = sg.first_exit(spark.createDataFrame(holdings, "symbol string, entry date, lot long").repartition(3), spark.createDataFrame(signals, "symbol string, d date, decision string").repartition(3), key="symbol", entry="entry")
    want = []
    for k, e, lot in holdings:
        later = [(d, x) for s, d, x in signals if k and e and s == k and d and d > e]
        left = min((d for d, x in later if x == "EXIT"), default=None)
        want.append((k, e, lot, left, sum(x == "DATA_GAP" and (left is None or d < left) for d, x in later)))
    assert got(out, "symbol", "entry", "lot", "exit_date", "gap_days") == sorted(want, key=repr)
    assert "Join" not in plan(out)
