"""Known answers and properties of the market operators."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalize as nz
from tidemark.operators import documents as dc
from tidemark.operators import ledger as lg
from tidemark.operators import pit
from tidemark.operators import screening as sc
from tidemark.operators import timeseries as ts
from tidemark.plans import signals as sg
from tidemark.sources import files, parsers


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


def test_dividend_known_answer_and_no_look_ahead(spark):
    probe = spark.createDataFrame([("a", date(2020, 6, 10))], "symbol string, d date")
    events = spark.createDataFrame([("a", date(2020, 6, 10), date(2020, 1, 1), "ORDINARY", 0.2), ("a", date(2020, 6, 10), date(2020, 1, 1), "SPECIAL", 0.1), ("a", date(2021, 1, 10), date(2020, 1, 1), "ORDINARY", 0.5)], "symbol string, ex_date date, known date, kind string, cash double")
    years = spark.createDataFrame([("a", 2017, 0.3, date(2018, 5, 1)), ("a", 2018, 0.0, date(2019, 5, 1)), ("a", 2019, 0.2, date(2020, 5, 1))], "symbol string, fiscal_year int, total double, known date")
    r = one(sg.conservative_dividend(probe, events, years, keys=["symbol"]))
    assert (r["d_ttm"], r["d_med3"], r["d_cons"]) == (0.3, 0.2, 0.2)
    assert one(sg.conservative_dividend(probe, events, years, keys=["symbol"], include_special=False))["d_ttm"] == 0.2
    late = years.withColumn("known", F.lit("2020-06-11").cast("date"))
    assert one(sg.conservative_dividend(probe, events, late, keys=["symbol"]))["d_cons"] is None


def test_asof_forms_agree_and_future_rows_change_nothing(spark):
    rng = np.random.default_rng(3)
    base = date(2020, 1, 1).toordinal()
    facts = pd.DataFrame({"k": rng.integers(0, 4, 300), "eff": rng.integers(0, 60, 300), "known": rng.integers(0, 90, 300), "v": range(300)}).drop_duplicates(["k", "eff", "known"])
    for c in ("eff", "known"):
        facts[c] = [date.fromordinal(base + int(x)) for x in facts[c]]
    probe = spark.createDataFrame([(k, date.fromordinal(base + d)) for k in range(5) for d in range(0, 100, 7)], "k long, d date")
    f = spark.createDataFrame(facts)
    args = {"keys": ["k"], "values": ["v"]}
    a = pit.bitemporal_asof(probe, f, **args).toPandas().sort_values(["k", "d"])
    b = pit.bitemporal_asof(probe.withColumn("s", F.col("d")), f, signal="s", **args).drop("s").toPandas().sort_values(["k", "d"])
    assert a.reset_index(drop=True).equals(b.reset_index(drop=True))
    early = f.where("known <= '2020-02-10'")
    seen = pit.bitemporal_asof(probe.where("d <= '2020-02-10'"), f, **args).toPandas().sort_values(["k", "d"]).reset_index(drop=True)
    assert seen.equals(pit.bitemporal_asof(probe.where("d <= '2020-02-10'"), early, **args).toPandas().sort_values(["k", "d"]).reset_index(drop=True))


def test_rate_signal_falls_back_and_needs_two_banks(spark):
    rows = [(1, 3, 0.031), (2, 3, 0.033), (1, 5, 0.04)]
    obs = spark.createDataFrame([(b, t, r, date(2019, 1, 1), date(2021, 1, 1), date(2019, 1, 1)) for b, t, r in rows], "bank long, tenor long, rate double, start date, end date, known date")
    probe = spark.createDataFrame([(date(2020, 6, 10),)], "d date")
    r = one(pit.rate_signal(probe, obs))
    assert (round(r["rate"], 6), r["tenor"], r["quality"]) == (0.032, 3, "TENOR_FALLBACK")
    assert pit.rate_signal(probe, obs.where("bank = 1")).isEmpty()


@pytest.mark.parametrize("held,y,want", [(False, 0.06, "ENTRY_ELIGIBLE"), (True, 0.06, "HOLD"), (True, 0.0599, "EXIT"), (False, 0.0599, "REJECT")])
def test_decision_at_the_hurdle(spark, held, y, want):
    made = sg.decide(F.lit(held), known_late=F.lit(False), quality_pass=F.lit(True), d_ttm=F.lit(y), d_med3=F.lit(1.0), close=F.lit(1.0), rate=F.lit(0.03), rate_quality=F.lit("OBSERVED"))
    assert one(spark.range(1).select(made["decision"].alias("x")))["x"] == want


def test_indicators_on_a_ramp(spark):
    bars = spark.createDataFrame([("a", i, 10.0 + i) for i in range(65)], "symbol string, d long, close double")
    out = ts.recursive_indicators(ts.sma(bars, keys=["symbol"], order=["d"]), keys=["symbol"], order=["d"]).toPandas().sort_values("d")
    assert np.isnan(out.ma5.iloc[3]) and out.ma5.iloc[4] == 12 and out.rsi14.iloc[-1] == 100 and np.isnan(out.rsi14.iloc[13])


def test_adjustment_ignores_what_was_not_announced(spark):
    bars = spark.createDataFrame([("a", date(2020, 1, 1), 10.0), ("a", date(2020, 1, 2), 9.0)], "symbol string, d date, close double")
    act = spark.createDataFrame([("a", date(2020, 1, 2), datetime(2020, 1, 1), 0.9)], "symbol string, effective_date date, announced_at timestamp, factor double")
    args = {"keys": ["symbol"], "as_of": "2020-01-03", "prices": ["close"]}
    assert sorted(r["close"] for r in ts.adjust_bars(bars, act, mode="forward", **args).collect()) == [9.0, 9.0]
    assert sorted(r["close"] for r in ts.adjust_bars(bars, act, mode="backward", **args).collect()) == [10.0, 10.0]
    late = act.withColumn("announced_at", F.lit("2020-02-01").cast("timestamp"))
    assert sorted(r["close"] for r in ts.adjust_bars(bars, late, mode="forward", **args).collect()) == [9.0, 10.0]


def test_returns_and_xirr(spark):
    flows = spark.createDataFrame([("a", date(2020, 1, 1), -100.0), ("a", date(2021, 1, 1), 110.0), ("b", date(2020, 1, 1), -1.0)], "k string, d date, a double")
    got = {r["k"]: r["xirr"] for r in lg.xirr(flows, keys=["k"], date="d", amount="a").collect()}
    assert abs(got["a"] - 0.1) < 0.001 and got["b"] is None


def test_fifo_takes_only_earlier_lots(spark):
    f = spark.createDataFrame([("a", 1, date(2020, 1, 1), "BUY", 100), ("a", 2, date(2020, 1, 2), "BUY", 100), ("a", 3, date(2020, 1, 2), "SELL", 50), ("a", 4, date(2020, 1, 3), "SELL", 120), ("b", 5, date(2020, 1, 1), "BUY", 10), ("b", 6, date(2020, 1, 1), "SELL", 10)], "k string, seq long, d date, side string, quantity long")
    matches, errors = lg.fifo_match(f, keys=["k"])
    assert sorted(tuple(r) for r in matches.collect()) == [("a", 3, 1, 50), ("a", 4, 1, 50), ("a", 4, 2, 70)]
    assert [(r["k"], r["sell"]) for r in errors.collect()] == [("b", 6)]


def test_fifo_by_brute_force_in_one_shuffle(spark):
    import random

    draw, rows = random.Random(3), []
    for k in range(40):
        for seq in range(draw.randint(0, 30)):
            rows.append((k, seq, date(2020, 1, 1 + draw.randint(0, 8)), draw.choice(["BUY", "BUY", "SELL"]), draw.randint(0, 9)))
    rows += [(99, 1, date(2020, 1, 1), "BUY", 5), (99, 2, None, "SELL", 1), (99, 3, date(2020, 1, 3), "SELL", 1)]
    want, refused = [], []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] or date.min, r[1]))
        lots, sold, bad = [[r[1], r[2], r[4]] for r in own if r[3] == "BUY"], 0, False
        for _, seq, d, side, n in own:
            if side == "BUY":
                continue
            sold += n
            bad = bad or d is None or sold > sum(r[4] for r in own if r[3] == "BUY" and r[2] < d)
            if bad:
                refused.append((k, seq))
                continue
            for lot in lots:
                took = min(n, lot[2])
                lot[2], n = lot[2] - took, n - took
                if took:
                    want.append((k, seq, lot[0], took))
    f = spark.createDataFrame(draw.sample(rows, len(rows)), "k long, seq long, d date, side string, quantity long")
    matches, errors = lg.fifo_match(f, keys=["k"])
    assert sorted(tuple(r) for r in matches.collect()) == sorted(want)
    assert sorted((r["k"], r["sell"]) for r in errors.collect()) == sorted(refused)
    plan = lg.fifo_match(f, keys=["k"])[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2, plan


def test_bars_are_sorted_once_for_a_security_day(spark):
    from tidemark.queries import QUERIES

    for name, windows in (("g1_security_day", 2), ("g3_decision_held", 1), ("g4_prescreen", 1), ("g5_first_exit", 1)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [min(d#") == 1, (name, plan)
        assert plan.count("Window [min(d#") + plan.count("Window [collect_list(") == windows and "percentile(amount" not in plan, (name, plan)


def test_rolling_median_with_nulls_and_few_rows(spark):
    rows = [("a", 1, None), ("a", 2, 3.0), ("a", 3, 1.0), ("a", 4, 8.0), ("a", 5, 0.1), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    for n, want in ((3, [None, 3.0, 2.0, 3.0, 1.0, None]), (100, [None, 3.0, 2.0, 3.0, 2.0, None])):
        out = ts.rolling_median(df, keys=["k"], order=["i"], value="v", n=n)
        assert [r["median"] for r in out.orderBy("k", "i").collect()] == want


def test_only_latest_cards_are_scored(spark):
    from tidemark.queries import QUERIES

    out = QUERIES["h12_qualified"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("collect_list(") :]
    assert "Join LeftSemi" in below, plan


def test_screen_is_the_same_in_any_order(spark):
    from tidemark import fixtures as X

    rows = X.cross_section(spark, "/root/testdata/sf0.001")
    policy = {**sc.POLICY, "asset_type": "STOCK", "trading_status": ("TRADING",), "minimum_history_days": 1, "minimum_amount": 1.0}
    a = sc.screen(rows, policy).orderBy("as_of", "rank").toPandas()
    b = sc.screen(rows.orderBy(F.desc("symbol")), policy).orderBy("as_of", "rank").toPandas()
    assert len(a) and a.equals(b)


def test_lots_fees_and_quotes(spark):
    codes = spark.createDataFrame([("688001",), ("300001",), ("600000",), ("830001",), ("000001",)], "c string")
    got = {r["c"]: tuple(r["r"]) for r in codes.select("c", nz.lot_rule(F.col("c")).alias("r")).collect()}
    assert got == {"688001": (200, 1, "SSE_STAR"), "300001": (100, 100, "SZSE_CHINEXT"), "600000": (100, 100, "SSE_MAIN"), "830001": (100, 1, "BSE"), "000001": (100, 100, "SZSE_MAIN")}
    r = one(spark.range(1).select(*[nz.trade_cost(F.lit(s), F.lit(100000.0), stamp=x).alias(f"{s}{i}") for s in ("BUY", "SELL") for i, x in enumerate((0.001, 0.0005))]))
    assert r["BUY0"] == r["BUY1"] and float(r["SELL0"] - r["SELL1"]) == 50.0
    assert parsers.parse_quotes(spark.createDataFrame([("nonsense",)], "value string")).isEmpty()


def test_documents_with_a_broken_file_and_symbol_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "docs/b.json").write_text('{"id": ')
    (tmp_path / "docs/c.json").write_text('{"n": 2}')
    good, bad = files.scan_documents(spark, str(tmp_path / "docs"), "id string, n long", ["id"])
    assert [r["id"] for r in good.collect()] == ["a"]
    assert sorted(r["reason"] for r in bad.collect()) == ["INVALID_JSON", "MISSING_id"]
    for name in ("x/600000.SH.csv", "y/600000.SH.csv", "000001.SZ.csv", "830001.BJ.csv"):
        path = tmp_path / "bars" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("d,close\n2020-01-01,1.5\n2020-01-02,x\n")
    rows, twice = files.scan_symbol_files(spark, str(tmp_path / "bars"), {"d": "date", "close": "double"})
    assert rows.count() == 6 and rows.where("symbol = '000001.SZ' AND close IS NULL").count() == 1
    assert [r["symbol"] for r in twice.collect()] == ["600000.SH"]


def test_import_appends_only_clean_data(spark, tmp_path):
    df = spark.createDataFrame([(date(2020, 1, 1), datetime(2020, 1, 1), "s", False)], "effective_date date, known_at timestamp, source_id string, is_synthetic boolean")
    seen = spark.createDataFrame([], "manifest_id string")
    manifest = {"manifest_id": "m", "columns": df.columns, "row_count": 1, "minimum": "2020-01-01", "maximum": "2020-01-01"}
    folder = str(tmp_path / "t")
    assert files.import_dataset(df, manifest, seen, folder).isEmpty() and spark.read.parquet(folder).count() == 1
    assert not files.import_dataset(df, {**manifest, "row_count": 2}, seen, folder).isEmpty() and spark.read.parquet(folder).count() == 1


def test_opinion_negation_and_fallback(spark):
    pages = spark.createDataFrame([(1, 1, "x 无保留意见"), (1, 2, "审计意见 我们认为 在所有重大方面 公允反映"), (2, 1, "出具 保留 意见")], "doc_id long, page_no long, text string")
    out = dc.classify_pages(pages, [("QUALIFIED", ["保留意见"])], negations={"QUALIFIED": "无"}, fallback=("STANDARD", ["审计意见", "我们认为", "公允反映"], "我们认为"))
    assert {r["doc_id"]: (r["classification"], r["page"]) for r in out.collect()} == {1: ("STANDARD", 2), 2: ("QUALIFIED", 1)}


def test_table_hash_ignores_order(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    a, b = (one(dc.table_hash(x))["input_hash"] for x in (df, df.orderBy(F.desc("id"))))
    assert a == b != one(dc.table_hash(df.where("id > 0")))["input_hash"]


def test_scalars_with_known_answers(spark):
    texts = {"12%": 12.0, "(12": 12.0, "(1,234.5)": -1234.5, "1,000": 1000.0, "--": None, "": None, "(3%)": -3.0}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nz.accounting_number(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == texts
    heat = spark.createDataFrame([(2.0, None, 20.0), (2.0, -5e8, 20.0), (-1.0, 9e8, 22.0), (50.0, 0.0, 100.0), (None, 1e8, None)], "c double, a double, h double")
    assert all(r["h"] == r["x"] for r in heat.select("h", nz.sector_heat(F.col("c"), F.col("a")).alias("x")).collect())
    clock = {"09:29:59": False, "09:30:00": True, "11:30:00": True, "11:30:01": False, "12:59:59": False, "13:00:00": True, "15:00:00": True, "15:00:00.5": False}
    times = spark.createDataFrame([(t, datetime.fromisoformat(f"2024-01-03 {t}")) for t in clock], "t string, ts timestamp")
    assert {r["t"]: r["o"] for r in times.select("t", nz.in_session(F.col("ts")).alias("o")).collect()} == clock
    status = one(spark.range(1).select(nz.trading_status(F.lit(0.0), F.lit(0.0)).alias("a"), nz.trading_status(F.lit(None).cast("double"), F.lit(1.0)).alias("b"), nz.trading_status(F.lit(1.0), F.lit(None).cast("double")).alias("c")))
    assert tuple(status) == ("NORMAL", "UNKNOWN", "SUSPENDED")
    tenors = {"五年": 5.0, "18个月": 1.5, "1个月": 1 / 12, "3年期": 3.0, "2年A款": 2.0, "十年": None}
    assert {r["t"]: r["y"] for r in spark.createDataFrame([(t,) for t in tenors], "t string").select("t", nz.tenor_in(F.col("t")).alias("y")).collect()} == tenors


def test_redaction_at_any_depth(spark):
    import json

    deep = {"token": 1}
    for _ in range(40):
        deep = {"secret": [deep]} if _ % 2 else [deep]
    cases = [{"token": {"value": "x1"}, "cookie": ["a", "b"], "n": 1}, {"a": [{"EMAIL": "q\"}x", "b": {"myPhone": -1.5e3}}, "token"]}, {"apikey": True, "k": {"secret": {"deep": [[{"z": "]"}]]}}}, {"plain": "token: x"}, deep]

    def withheld(v):
        if isinstance(v, dict):
            return {k: "[REDACTED]" if any(s in k.lower() for s in nz.SENSITIVE) else withheld(x) for k, x in v.items()}
        return [withheld(x) for x in v] if isinstance(v, list) else v

    out = [json.loads(r["o"]) for r in spark.createDataFrame([(json.dumps(c),) for c in cases], "t string").select(nz.redact(F.col("t")).alias("o")).collect()]
    assert out == [withheld(c) for c in cases]
    long = json.dumps({"token": ["x" * 50_000, *range(20_000)], "k": "y" * 50_000})
    assert json.loads(one(spark.createDataFrame([(long,)], "t string").select(nz.redact(F.col("t")).alias("o")))["o"]) == {"token": "[REDACTED]", "k": "y" * 50_000}


def test_redaction_reads_strings_whole(spark):
    import json

    held = "[REDACTED]"
    literal = {
        r'{"a":"say \"token\": 5"}': r'{"a":"say \"token\": 5"}', r'{"to\u006ben" : [1, "}", {"b":"]"}] , "x":1}': rf'{{"to\u006ben" : "{held}" , "x":1}}',
        r'{"a\\":{"secret":"\\"},"b":"\\\"{"}': rf'{{"a\\":{{"secret":"{held}"}},"b":"\\\"{{"}}', r'["token","secret:",{"k":"token"}]': r'["token","secret:",{"k":"token"}]',
        r'{"x":"\"email\":[","phone":{},"y":[{"cookie":[]},{"z":{"MyToken":null}}]}': rf'{{"x":"\"email\":[","phone":"{held}","y":[{{"cookie":"{held}"}},{{"z":{{"MyToken":"{held}"}}}}]}}',
        r'{"token":"a': f'"{held}"', r'{"token":{"a":1}': f'"{held}"', "{\"a\":\"\x01\"}": f'"{held}"', "": "", "12": "12", r'"token"': r'"token"', r'{"token":"{[$1\\","k":"{[$1"}': rf'{{"token":"{held}","k":"{{[$1"}}',
    }
    got = {r["t"]: r["o"] for r in spark.createDataFrame([(t,) for t in literal], "t string").select("t", nz.redact(F.col("t")).alias("o")).collect()}
    assert got == literal
    deep, want = {"token": 1, "k": 2}, {"token": held, "k": 2}
    for i in range(100):
        deep, want = ([deep, "x"], [want, "x"]) if i % 2 else ({"a": deep, "secret": [deep] * (i == 3)}, {"a": want, "secret": held})
    assert json.loads(one(spark.createDataFrame([(json.dumps(deep),)], "t string").select(nz.redact(F.col("t")).alias("o")))["o"]) == want
    assert one(spark.createDataFrame([(None,)], "t string").select(nz.redact(F.col("t")).alias("o")))["o"] is None


def test_redaction_withholds_open_quotes_and_brackets_anywhere(spark):
    held = '"[REDACTED]"'
    cases = {
        '{"token":["a]}': held, '{"token":[}]}': held, '{"a":1}}': held, '{"k":1,"token":[1,{"a":[]}] ,"b":[2]}': f'{{"k":1,"token":{held} ,"b":[2]}}',
        '{"token":"secret":{"a":1}}': f'{{"token":{held}:{{"a":1}}}}', '{"token":,"k":"v"}': '{"token":,"k":"v"}', r'{"to\x":1,"Secret\n":x}': rf'{{"to\x":1,"Secret\n":{held}}}',
    }
    got = {r["t"]: r["o"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", nz.redact(F.col("t")).alias("o")).collect()}
    assert got == cases


def test_redaction_is_dealt_over_tasks(spark):
    from tidemark.queries import QUERIES

    assert QUERIES["p20_redact"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_quote_lines_with_known_answers(spark):
    parts = [""] * 50
    for i, v in {1: "name", 2: "600000", 3: "10.5", 31: "x", 36: "12", 37: "3", 38: "-1", 44: "2", 45: "1", 46: "0.9", 47: "11.55"}.items():
        parts[i] = v
    line = 'v_sh600000="' + "~".join(parts) + '";'
    r = one(parsers.parse_quotes(spark.createDataFrame([(line,), ('v_sh600001="' + "~".join(parts[:49]) + '";',)], "value string")))
    assert (r["price"], r["open"], r["change"], r["volume"], r["amount"], r["turnover_pct"], r["pe_ttm"], r["float_market_cap"], r["total_market_cap"], r["pb"], r["limit_up"], r["limit_down"]) == (10.5, 0.0, 0.0, 1200.0, 30000.0, None, None, 2e8, 1e8, 0.9, 11.55, None)
    assert parsers.parse_quotes(spark.createDataFrame([('v_s_sh000001="1~i~000001~3000.5~1~0";',)], "value string"), index=True).count() == 0
    assert one(parsers.parse_quotes(spark.createDataFrame([('v_sh000001="1~i~000001~3000.5~1~0";',)], "value string"), index=True))["price"] == 3000.5


def test_upsert_stream_goes_on_after_a_restart(spark, tmp_path):
    from tidemark.streaming import jobs

    def feed(rows):
        df = spark.createDataFrame(rows, "k long, n long, v string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
        out = jobs.upsert_latest(stream, str(tmp_path / "t"), keys=["k"], newest=["n"], checkpoint=str(tmp_path / "c"), buckets=4)
        return {r["k"]: r["v"] for r in out.collect()}

    assert feed([(1, 1, "a"), (2, 1, "b")]) == {1: "a", 2: "b"}
    assert feed([(3, 1, "c")]) == {1: "a", 2: "b", 3: "c"}
    assert feed([(1, 0, "old"), (2, 5, "new")]) == {1: "a", 2: "new", 3: "c"}


def test_rate_needs_two_real_banks(spark):
    day = date(2020, 1, 2)
    rows = [("ICBC", 5, 0.04, day, date(2020, 1, 1), date(2020, 3, 31), True), ("ABC", 3, 0.031, day, date(2020, 1, 1), date(2020, 3, 31), False), ("BOC", 3, 0.033, day, date(2020, 1, 1), date(2020, 3, 31), None)]
    obs = spark.createDataFrame(rows, "bank string, tenor long, rate double, known date, start date, end date, synthetic boolean")
    probe = spark.createDataFrame([(day,), (date(2020, 1, 1),), (date(2020, 3, 31),), (date(2020, 4, 1),)], "d date")
    got = {r["d"]: (round(r["rate"], 9), r["tenor"], r["quality"], r["banks"]) for r in pit.rate_signal(probe, obs, synthetic="synthetic").collect()}
    assert got == {d: (0.032, 3, "TENOR_FALLBACK", 2) for d in (day, date(2020, 3, 31))}
    assert pit.rate_signal(probe, obs.where("bank <> 'BOC'"), synthetic="synthetic").isEmpty()


def test_asof_with_a_signal_by_brute_force(spark):
    import random

    rng, start = random.Random(4), date(2019, 1, 1)
    day = lambda: start + timedelta(days=rng.randrange(400))
    facts = list({(k, e, n): (k, e, n, v) for v in range(300) for k, e, n in [(rng.randrange(4), day(), day())]}.values())
    probes = [(rng.randrange(5), day(), day()) for _ in range(200)] + [(1, None, day()), (1, day(), None)]
    want = sorted(((k, d, s, max(((e, n, v) for x, e, n, v in facts if d and s and x == k and e <= d and n <= s), default=(None,) * 3)[2]) for k, d, s in probes), key=repr)
    p, f = spark.createDataFrame(probes, "k long, d date, s date"), spark.createDataFrame(facts, "k long, eff date, known date, v long")
    assert sorted((tuple(r) for r in pit.bitemporal_asof(p.repartition(3), f.repartition(5), keys=["k"], signal="s", values=["v"]).collect()), key=repr) == want


def test_actions_on_positions(spark):
    lots = spark.createDataFrame([("a", "x", date(2020, 1, 1), 101, 10.0), ("a", "x", date(2020, 1, 1), 101, 10.0), ("a", "x", date(2020, 6, 1), 3, 12.0), ("b", "x", date(2020, 1, 1), 101, 10.0), ("c", "y", date(2020, 1, 1), 7, 1.0)], "account string, symbol string, acquired date, remaining long, cost double")
    actions = spark.createDataFrame([(1, "x", date(2020, 2, 1), 1.5, None), (1, "x", date(2020, 2, 1), 1.5, None), (2, "x", date(2020, 7, 1), None, 0.125)], "action_id long, symbol string, effective_date date, share_multiplier double, cash_per_share double")
    out, errors, cash = lg.apply_actions(lots, actions, cost="cost")
    assert sorted((r["account"], r["remaining"], r["adjusted"], round(r["cost"], 6)) for r in out.collect()) == [("a", 3, 3, 12.0), ("a", 101, 152, round(10 / 1.5, 6)), ("a", 101, 152, round(10 / 1.5, 6)), ("c", 7, 7, 1.0)]
    assert [(r["account"], r["adjusted"]) for r in errors.collect()] == [("b", None)]  # 151.5 shares
    assert [tuple(r) for r in cash.collect()] == [("a", "x", 2, 306.0, 38.25)]
    cut = lg.apply_actions(lots, actions, cost="cost", truncate=True)[0]
    assert sorted(r["adjusted"] for r in cut.collect()) == [3, 7, 151, 151, 151]


def test_coverage_takes_unique_rates_of_two_banks(spark):
    day = lambda n: date(2017, 12, 28) + timedelta(days=n)
    rows = [("A", 3, 0.03, day(0), day(9)), ("B", 3, 0.031, day(0), day(5)), ("B", 3, 0.032, day(2), day(2)), ("A", 5, 0.04, day(5), day(7)), ("C", 5, 0.04, day(5), day(7)), ("C", 5, 0.04, day(6), day(8)), ("D", 3, 0.03, None, day(9))]
    obs = spark.createDataFrame(rows, "bank string, tenor long, rate double, start date, end date")
    counts, gaps = ts.rate_coverage(obs, first="2017-12-28", last="2018-01-06")
    assert {r["counter"]: r["n"] for r in counts.collect()} == {"covered_calendar_days": 7, "uncovered_calendar_days": 3, "covered_2_bank_days": 7, "covered_tenor_3y_days": 4, "covered_tenor_5y_days": 3, "uncovered_range_count": 2}
    assert sorted((r["start"], r["end"], r["days"]) for r in gaps.collect()) == [(day(2), day(2), 1), (day(8), day(9), 2)]


def test_asof_with_a_signal_repeats_no_fact(spark):
    """A fact is one row of the stream, whatever the length of history; the latest of a day's restatements that is known counts, and nulls are never visible."""
    day = date(2020, 1, 1)
    facts = [("a", day + timedelta(i), day + timedelta(i + k), i * 10 + k) for i in range(20) for k in range(3)] + [("a", None, day, -1), ("a", day, None, -2), (None, day, day, -3)]
    asks = [("a", day + timedelta(9), day + timedelta(10)), ("a", day + timedelta(9), day + timedelta(3)), ("a", day, day - timedelta(1)), ("a", None, day), ("a", day, None), ("b", day, day), (None, day, day)]
    f, p = spark.createDataFrame(facts, "k string, eff date, known date, v long"), spark.createDataFrame(asks, "k string, d date, s date")
    out = pit.bitemporal_asof(p, f, keys=["k"], signal="s", values=["v"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:3]: r["v"] for r in out.collect()} == dict(zip(asks, [91, 30, None, None, None, None, None], strict=True))


def test_risk_checks_keep_six_positions_of_an_account(spark):
    """Top five after the order, by brute force: equal values, a held position within and beyond the six largest, and no holdings at all."""
    values = [100.0, 100.0, 90.0, 80.0, 70.0, 60.0, 50.0, 50.0, 10.0]
    held = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("a", 50, None)], "account string, symbol int, market_value double")
    accounts = spark.createDataFrame([(x, 1000.0, 0.0, 1e9, 0.0, 0.0, 0) for x in "ab"], "account string, total_assets double, market_value double, cash double, daily_pnl double, max_drawdown double, opened_today int")
    asks = [(n, x, i, q) for n, (x, i, q) in enumerate((x, i, q) for x in "ab" for i in (0, 1, 4, 5, 6, 8, 50, 99) for q in (0, 1, 25, 45, 75, 105, 125))]
    orders = spark.createDataFrame([(n, x, i, q, 1.0, None, 0.0) for n, x, i, q in asks], "order_id int, account string, symbol int, quantity int, price double, invalidation double, fees double")
    out = lg.risk_checks(orders, accounts, held, limits={**lg.LIMITS, "top5": 45.0})
    tops = out.where("check = 'top5_concentration_limit'")

    def status(x, i, q):
        before = dict(enumerate(values)) if x == "a" else {}
        before[i] = before.get(i, 0.0) + q
        return "PASS" if sum(sorted(before.values(), reverse=True)[:5]) <= 450 else "FAIL"

    assert {r["order_id"]: r["status"] for r in tops.collect()} == {n: status(x, i, q) for n, x, i, q in asks}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_means_of_a_cross_section_are_the_same_in_any_order(spark, tmp_path):
    """Means of half a unit of the last digit: they round up in whatever order values are added, here and in the SQL."""
    import duckdb

    from tidemark import fixtures

    taxes = [[0.08, 0.03, 0.01, 0.0, 0.01, 0.02, 0.02, 0.02], [0.05, 0.0, 0.06, 0.01, 0.06, 0.02, 0.02, 0.05], [0.08, 0.08, 0.02, 0.06, 0.04, 0.04, 0.07, 0.04]]
    rows = [(i, p, t) for p, kind in enumerate(taxes) for i, order in enumerate((kind, sorted(kind), sorted(kind, reverse=True))) for t in order]
    lines = pd.DataFrame([{"l_orderkey": 1, "l_partkey": 10 * p + i, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 100 * t, "l_extendedprice": 1.0, "l_discount": t, "l_tax": t, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": datetime(1996, 1, 1)} for i, p, t in rows])
    parts = pd.DataFrame([{"p_partkey": k, "p_brand": "b", "p_size": 1, "p_retailprice": 900.0} for k in lines["l_partkey"].unique()])
    for name, df in (("lineitem", lines), ("part", parts)):
        df.to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    want = {10 * p + i: round(float(m), 4) for p, m in enumerate(("0.0238", "0.0338", "0.0538")) for i in range(3)}
    got = fixtures.cross_section(spark, str(tmp_path))
    assert {r["symbol"]: r["momentum60"] for r in got.collect()} == want
    c = duckdb.connect()
    for name in ("lineitem", "part"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert dict(c.sql(fixtures.with_views("cross_section") + " SELECT symbol, momentum60 FROM cross_section").fetchall()) == want


def test_risk_metrics_without_losses(spark):
    """A null return is no period without a loss, and what binary fractions lose is no drawdown."""
    days = [date(2020, 1, 1) + timedelta(i) for i in range(4)]
    lost = spark.createDataFrame([(1, d, e, f) for d, e, f in zip(days, [100.0, 0.0, 0.0, 50.0], [100.0, 0.0, 0.0, 100.0], strict=True)], "k int, d date, equity double, flow_in double")
    r = one(lg.risk_metrics(lg.flow_adjusted_returns(lost, keys=["k"], order=["d"]), keys=["k"], date="d", order=["d"]))
    assert r["periods"] == 3 and r["downside_deviation"] == pytest.approx(math.sqrt((1 + 0.25) / 3 * 252))
    steps = [(days[0], 0.3, 0.3), (days[1], 0.3 + 0.1 + 0.2, 0.0), (days[2], 0.9, 0.3)]
    assert 0.9 / (0.3 + 0.1 + 0.2 + 0.3) < 1  # nothing was lost
    flat = spark.createDataFrame([(1, d, e, f) for d, e, f in steps], "k int, d date, equity double, flow_in double")
    r = one(lg.risk_metrics(lg.flow_adjusted_returns(flat, keys=["k"], order=["d"]), keys=["k"], date="d", order=["d"]))
    assert (r["calmar"], r["longest_drawdown"]) == (None, 0)


def test_matrices_meet_while_they_are_wide(spark):
    """Cells are taken apart after matrices have met, so none is shuffled; symbols and dates may lack in one of them."""
    close = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 4.0), (4, float("inf"), 6.0)], "d int, a double, b double")
    opened = spark.createDataFrame([(1, 10.0, 30.0, 50), (3, 20.0, 40.0, 60)], "d int, b double, a double, c int").withColumn("c", F.col("c").cast("double"))
    out = files.matrices_to_rows({"close": close, "open": opened})
    assert {tuple(r) for r in out.select("d", "symbol", "close", "open").collect()} == {(1, "a", 1.0, 30.0), (2, "b", 4.0, None), (4, "b", 6.0, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "Expand" not in plan


def test_orders_of_one_day_ask_once(spark):
    """Orders of a key and day are one row of the stream of bars, and all come back; bars of keys without orders stay out of it."""
    day = date(2020, 1, 1)
    bars = spark.createDataFrame([(k, day + timedelta(i), 10.0 + i, i != 1) for k in ("a", "z") for i in range(4)], "symbol string, d date, open double, t boolean")
    orders = spark.createDataFrame([(n, "a", day, 12.0 + n % 2) for n in range(50)] + [(50, "a", day + timedelta(3), 99.0), (51, "b", day, 1.0), (52, None, day, 1.0), (53, "a", None, 1.0)], "id int, symbol string, signal_date date, limit_price double")
    out = lg.next_open_fill(orders, bars, tradable=F.col("t"), slippage_bps=0)
    got = {r["id"]: (r["fill_date"], r["queued_days"], r["status"]) for r in out.collect()}
    assert got == {n: (day + timedelta(2), 1, "FILLED") for n in range(50)} | {n: (None, None, "QUEUED") for n in (50, 51, 52, 53)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Window") < plan.index("Aggregate")


def test_latest_valid_by_brute_force(spark):
    """Facts before, after, between and across the dates; those of the same dates are one row before they are cut into blocks."""
    rng, day = np.random.default_rng(5), date(2020, 1, 1)
    rows = [(int(k), day + timedelta(int(a)), day + timedelta(int(a + n)), day + timedelta(int(a + late)), int(v)) for k, a, n, late, v in zip(rng.integers(0, 3, 400), rng.integers(-60, 200, 400), rng.integers(-3, 50, 400), rng.integers(0, 20, 400), rng.integers(0, 9, 400), strict=True)]
    asks = sorted({day + timedelta(int(i)) for i in rng.integers(0, 120, 25)})
    facts, probe = spark.createDataFrame(rows, "k int, s date, e date, known date, v int"), spark.createDataFrame([(d,) for d in asks], "d date")
    out = pit.latest_valid(probe, facts, keys=["k"], date="d", start="s", end="e", known="known", value="v")
    want = {}
    for d in asks:
        for k, a, z, known, v in rows:
            if a <= d <= z and known <= d:
                want[d, k] = min(want.get((d, k), (date.max - a, v)), (date.max - a, v))
    assert {(r["d"], r["k"]): r["value"] for r in out.collect()} == {x: v for x, (_, v) in want.items()}
    assert "__from" in out._jdf.queryExecution().optimizedPlan().toString()
