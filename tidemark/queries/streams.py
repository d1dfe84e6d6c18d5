"""Queries of the streaming jobs: the events table streamed to its end; each has the batch form as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.queries.base import Registry, scratch
from tidemark.queries.sources import quote_lines
from tidemark.streaming import jobs

query = Registry()
QUERIES, SQL = query.queries, query.sql
_FMT = "yyyy-MM-dd HH:mm:ss"
_TF = "'%Y-%m-%d %H:%M:%S'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = X.table(spark, sf_dir, "events").schema
    # a pattern may name one file, a path only a folder
    stream = jobs.file_stream(spark, f"{sf_dir}/events.parque[t]", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _in_batches(spark: SparkSession, df: DataFrame, order: str, n: int = 4, files: int = 4) -> DataFrame:
    """df as a stream of n batches in the given order, each of so many files; files are taken by age, so batches are written one after another."""
    path = scratch(spark)
    cuts = df.approxQuantile(order, [k / n for k in range(1, n)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.where(F.col(order) > low)
        (part if high is None else part.where(F.col(order) <= high)).repartition(files).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, df.schema, files_per_batch=files)


@query(
    "t1_quote_stream",
    f"""SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'LIVE' WHEN o_orderkey % 3 = 1 THEN 'DELAYED' ELSE 'STALE' END AS freshness FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0""",
)
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    lag = F.element_at(F.array(F.lit(60), F.lit(4000), F.lit(100000)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    lines = quote_lines(o).join(o.select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 second") * lag).alias("received_at")), "o_orderkey")
    path = scratch(spark)
    lines.write.parquet(path)
    out = jobs.run(jobs.quote_stream(jobs.file_stream(spark, path, lines.schema)), scratch(spark))
    return out.select("o_orderkey", "price", "freshness")


@query(
    "t2_tick_bars",
    f"""SELECT user_id, strftime(time_bucket(INTERVAL 60 MINUTE, ts), {_TF}) AS bar_start, min(struct_pack(t := ts, i := event_id, v := value)).v AS open, max(value) AS high, min(value) AS low, max(struct_pack(t := ts, i := event_id, v := value)).v AS close, count(*) AS ticks FROM events GROUP BY 1, 2""",
)
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = jobs.tick_bars(_events(spark, sf_dir), key="user_id", ts="ts", price="value", size="value", tie="event_id", minutes=60)
    out = jobs.run(bars, scratch(spark), mode="complete")
    return out.select("user_id", F.date_format("bar_start", _FMT).alias("bar_start"), "open", "high", "low", "close", "ticks")


def _late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in three batches: every fiftieth comes in the last. What the first batch closes comes out with the second, so rows for it are late in the last."""
    e, path = X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), scratch(spark)
    for part in ("event_id % 2 = 0 AND event_id % 50 <> 0", "event_id % 2 <> 0", "event_id % 50 = 0"):
        e.where(part).coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, e.schema, files_per_batch=1)


_IN_TIME = """m AS (SELECT max(ts) FILTER (WHERE event_id % 2 = 0 AND event_id % 50 <> 0) - INTERVAL {delay} MINUTE AS closed, max(ts) - INTERVAL {delay} MINUTE AS last FROM {events}),
 kept AS (SELECT e.* FROM {events} e, m WHERE event_id % 50 <> 0 OR {end} > closed)"""
_BUCKET = "time_bucket(INTERVAL 60 MINUTE, ts)"


@query(
    "t2_tick_bars_append",
    "WITH " + _IN_TIME.format(delay=10, events="events", end=f"{_BUCKET} + INTERVAL 60 MINUTE") + f""" SELECT user_id, strftime({_BUCKET}, {_TF}) AS bar_start, min(struct_pack(t := ts, i := event_id, v := value)).v AS open, max(value) AS high, min(value) AS low, max(struct_pack(t := ts, i := event_id, v := value)).v AS close, count(*) AS ticks
 FROM kept, m WHERE {_BUCKET} + INTERVAL 60 MINUTE <= last GROUP BY 1, 2""",
)
def t2_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = jobs.tick_bars(_late_events(spark, sf_dir), key="user_id", ts="ts", price="value", size="value", tie="event_id", minutes=60)
    out, _ = jobs.run_counted(bars, scratch(spark))
    return out.select("user_id", F.date_format("bar_start", _FMT).alias("bar_start"), "open", "high", "low", "close", "ticks")


@query("t3_dedup_payloads", "SELECT DISTINCT user_id, event_type || ':' || CAST(floor(value / 10) AS BIGINT) AS body FROM events")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws(":", "event_type", F.floor(F.col("value") / 10))
    stream = jobs.dedup_payloads(_events(spark, sf_dir), body, keys=["user_id"], ts="ts", watermark="365 days")
    return jobs.run(stream.select("user_id", body.alias("body")), scratch(spark))


@query("t4_upsert_latest", "SELECT user_id, max(event_id) AS event_id, max(struct_pack(i := event_id, v := value)).v AS value FROM events GROUP BY 1")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return jobs.upsert_latest(_in_batches(spark, e, "event_id"), scratch(spark), keys=["user_id"], newest=["event_id"], checkpoint=scratch(spark))


@query("t5_route_late", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS route FROM events")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select("event_id", "ts", (F.col("ts") + F.expr("interval 1 second") * F.when(F.col("event_id") % 7 == 0, 5).otherwise(0)).alias("known_at"))
    good, bad = scratch(spark), scratch(spark)
    jobs.route_late(_in_batches(spark, e, "event_id"), F.col("known_at") > F.col("ts"), good, bad, checkpoint=scratch(spark))
    ok = spark.read.parquet(good).select("event_id", F.lit("ACCEPTED").alias("route"))
    return ok.unionByName(spark.read.parquet(bad).select("event_id", F.lit("REJECTED").alias("route")))


@query(
    "t6_stateful_indicators",
    """WITH RECURSIVE s AS (SELECT user_id, event_id, CAST(floor(value) AS DOUBLE) AS x, row_number() OVER w AS i, CAST(floor(value) - lag(floor(value)) OVER w AS DOUBLE) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT user_id, i, x AS e12, x AS e26, CAST(0 AS DOUBLE) AS dea, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS l FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, e12 + CAST(2 AS DOUBLE) / 13 * (x - e12), e26 + CAST(2 AS DOUBLE) / 27 * (x - e26), dea + CAST(0.2 AS DOUBLE) * ((e12 + CAST(2 AS DOUBLE) / 13 * (x - e12)) - (e26 + CAST(2 AS DOUBLE) / 27 * (x - e26)) - dea),
   CASE WHEN s.i <= 15 THEN g + greatest(m, 0) / 14 ELSE (g * 13 + greatest(m, 0)) / 14 END, CASE WHEN s.i <= 15 THEN l + greatest(-m, 0) / 14 ELSE (l * 13 + greatest(-m, 0)) / 14 END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
 SELECT r.user_id, s.event_id AS seq, round(e12, 6) AS ema12, round(e26, 6) AS ema26, round(dea, 6) + 0 AS dea, CASE WHEN r.i > 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE round(100 - 100 / (1 + g / l), 6) END END AS rsi14
 FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i""",
)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("double").alias("value"))
    stream = jobs.stateful_indicators(_in_batches(spark, e, "event_id"), key="user_id", order="event_id", value="value")
    out = jobs.run(stream, scratch(spark))
    return out.select("user_id", "seq", *[F.round(c, 6).alias(c) for c in ("ema12", "ema26", "dea", "rsi14")])


@query(
    "t7_windowed_breadth",
    f"""SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), {_TF}) AS window_start, count(*) FILTER (WHERE floor(value) > 50) AS advancing, count(*) FILTER (WHERE floor(value) < 50) AS declining, count(*) FILTER (WHERE floor(value) = 50) AS unchanged, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS amount FROM events GROUP BY 1""",
)
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", (F.floor("value") - 50).alias("change"), F.floor("value").alias("amount"))
    out = jobs.run(jobs.windowed_breadth(e, ts="ts", change="change", amount="amount"), scratch(spark), mode="complete")
    return out.withColumn("window_start", F.date_format("window_start", _FMT))


@query(
    "t7_windowed_breadth_append",
    "WITH " + _IN_TIME.format(delay=60, events="events", end=f"{_BUCKET} + INTERVAL 60 MINUTE") + f""" SELECT strftime({_BUCKET}, {_TF}) AS window_start, count(*) FILTER (WHERE floor(value) > 50) AS advancing, count(*) FILTER (WHERE floor(value) < 50) AS declining, count(*) FILTER (WHERE floor(value) = 50) AS unchanged, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS amount
 FROM kept, m WHERE {_BUCKET} + INTERVAL 60 MINUTE <= last GROUP BY 1""",
)
def t7_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _late_events(spark, sf_dir).select("ts", (F.floor("value") - 50).alias("change"), F.floor("value").alias("amount"))
    out, _ = jobs.run_counted(jobs.windowed_breadth(e, ts="ts", change="change", amount="amount"), scratch(spark))
    return out.withColumn("window_start", F.date_format("window_start", _FMT))


def _sessions(rows: str) -> str:
    """Sessions of rows: user_id, their first and last failure, and how many."""
    return f"""(SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 600 MINUTE AS brk FROM {rows})) GROUP BY user_id, s)"""


# sessions that the watermark closes before the last batch are out by then: late rows neither join nor bridge them, but start sessions of their own
@query(
    "t8_failure_sessions_append",
    "WITH bad AS (SELECT * FROM events WHERE value > 60), " + _IN_TIME.format(delay=30, events="bad", end="ts + INTERVAL 600 MINUTE") + f""", early AS (SELECT * FROM {_sessions("(SELECT * FROM kept WHERE event_id % 50 <> 0)")}),
 done AS (SELECT early.* FROM early, m WHERE z + INTERVAL 600 MINUTE <= closed), rest AS (SELECT * FROM kept k WHERE event_id % 50 = 0 OR NOT EXISTS (SELECT 1 FROM done d WHERE d.user_id = k.user_id AND k.ts BETWEEN d.a AND d.z)),
 made AS (SELECT * FROM done UNION ALL SELECT r.* FROM {_sessions("rest")} r, m WHERE r.z + INTERVAL 600 MINUTE <= last)
 SELECT user_id, strftime(a, {_TF}) AS session_start, strftime(z + INTERVAL 600 MINUTE, {_TF}) AS session_end, n AS failures FROM made""",
)
def t8_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = jobs.run_counted(jobs.failure_sessions(_late_events(spark, sf_dir), F.col("value") > 60, endpoint="user_id", ts="ts", gap="600 minutes"), scratch(spark))
    return out.select("user_id", F.date_format("session_start", _FMT).alias("session_start"), F.date_format("session_end", _FMT).alias("session_end"), "failures")


@query(
    "t8_failure_sessions",
    f"""WITH f AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 600 MINUTE AS brk FROM events WHERE value > 60), g AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
 SELECT user_id, strftime(min(ts), {_TF}) AS session_start, strftime(max(ts) + INTERVAL 600 MINUTE, {_TF}) AS session_end, count(*) AS failures FROM g GROUP BY user_id, s""",
)
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.run(jobs.failure_sessions(_events(spark, sf_dir), F.col("value") > 60, endpoint="user_id", ts="ts", gap="600 minutes"), scratch(spark), mode="complete")
    return out.select("user_id", F.date_format("session_start", _FMT).alias("session_start"), F.date_format("session_end", _FMT).alias("session_end"), "failures")


@query(
    "t9_drawdown_alerts",
    """WITH p AS (SELECT user_id, event_id, CAST(floor(value) + 10 AS DOUBLE) AS v, max(CAST(floor(value) + 10 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id) AS peak FROM events)
 SELECT user_id, event_id AS seq, peak, round((peak - v) / peak * 100, 6) AS drawdown, (peak - v) / peak * 100 >= 12 AS alert FROM p""",
)
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") + 10).cast("double").alias("v"))
    out = jobs.run(jobs.drawdown_alerts(_in_batches(spark, e, "event_id"), key="user_id", order="event_id", value="v"), scratch(spark))
    return out.withColumn("drawdown", F.round("drawdown", 6))
