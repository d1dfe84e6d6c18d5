"""Queries of scans and sinks: what a table gives after it went through a file and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.queries.base import Registry, scratch, text_dates
from tidemark.sources import files, parsers

query = Registry()
QUERIES, SQL = query.queries, query.sql


#: Tasks move their own files into a new folder: where files are many, the driver would move one after another. A task that runs again writes the same names.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars(spark, sf_dir)
    dec = {c: F.col(c).cast("decimal(18,4)").alias(c) for c in ("open", "high", "low", "close")}
    return b.select(F.col("symbol").cast("string").alias("symbol"), F.lit("SSE").alias("exchange"), F.col("d").alias("effective_date"), F.col("d").cast("timestamp").alias("known_at"), *dec.values(), "volume", F.col("amount").cast("decimal(22,2)").alias("amount"), F.lit("x").alias("source_id"), F.lit(None).cast("string").alias("source_uri"), (F.col("volume") < 5).alias("is_synthetic"))


@query("s1_scan_bitemporal", X.with_views("bars") + " SELECT CAST(symbol AS VARCHAR) AS symbol, CAST(d AS VARCHAR) AS effective_date, close, volume FROM bars WHERE volume >= 5")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _prices(spark, sf_dir).write.parquet(path)
    return text_dates(files.scan_bitemporal(spark, path, "prices").select("symbol", "effective_date", F.col("close").cast("double").alias("close"), "volume"))


@query("s2_scan_parquet", "SELECT o_orderkey, o_custkey FROM orders")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return files.scan_parquet(spark, path)


@query("s3_scan_csv", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    c = X.table(spark, sf_dir, "customer")
    c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 9 == 0, "none").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal")).write.option("header", True).csv(path)
    return files.scan_csv(spark, path, {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"})


@query("s4_scan_jsonl", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 2 = 1 THEN p_type END AS p_type FROM part")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    p = X.table(spark, sf_dir, "part")
    p.where("p_partkey % 2 = 0").select("p_partkey", "p_brand").write.json(path)
    p.where("p_partkey % 2 = 1").select("p_type", "p_partkey").write.mode("append").json(path)
    return files.scan_jsonl(spark, path, "p_partkey bigint, p_brand string, p_type string")


@query("s5_documents", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each supplier, a file each; some are cut short, some lack a name."""
    return _documents(spark, sf_dir)[0].select("id", "name")


@query("s5_quarantined", "SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'INVALID_JSON' ELSE 'MISSING_name' END AS reason, count(*) AS n FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 GROUP BY 1")
def s5_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path, k = scratch(spark), F.col("s_suppkey")
    whole = F.to_json(F.struct(k.alias("id"), F.when(k % 5 != 0, F.col("s_name")).alias("name")))
    text = F.when(k % 7 == 0, F.concat(F.lit('{"id": '), k)).otherwise(whole)
    X.table(spark, sf_dir, "supplier").repartition(4 * spark.sparkContext.defaultParallelism).select(text.alias("value")).write.options(**BY_TASKS).option("maxRecordsPerFile", 1).text(path)
    return files.scan_documents(spark, path, "id long, name string", ["id", "name"])


_FILES = X.with_views("bars") + """, f AS (SELECT lpad(CAST(symbol AS VARCHAR), 6, '0') || CASE symbol % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END AS symbol, symbol % 3 AS v, d, close, volume FROM bars)"""


@query("s6_symbol_files", _FILES + " SELECT symbol, CASE v WHEN 0 THEN 'SSE' ELSE 'SZSE' END AS exchange, CAST(d AS VARCHAR) AS d, CASE WHEN volume % 9 <> 0 THEN close END AS close FROM f WHERE v < 2")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as one CSV file for each symbol, read back as one table."""
    path = scratch(spark)
    b = X.bars(spark, sf_dir)
    name = F.concat(F.lpad(F.col("symbol").cast("string"), 6, "0"), F.when(F.col("symbol") % 3 == 0, ".SH").when(F.col("symbol") % 3 == 1, ".SZ").otherwise(".BJ"))
    text = b.select(name.alias("file"), F.col("d").cast("string").alias("d"), F.when(F.col("volume") % 9 == 0, "x").otherwise(F.col("close").cast("string")).alias("close"))
    text.repartition("file").write.options(**BY_TASKS).partitionBy("file").option("header", True).csv(path)
    pattern = r"file=([0-9]{6})\.(SH|SZ|BJ)/"
    return text_dates(files.scan_symbol_files(spark, path, {"d": "date", "close": "double"}, pattern)[0])


#: Columns of a matrix file: a symbol's place in its block of symbols.
BLOCK = 50


def _matrices(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Matrices of all symbols, a row for each date and block of BLOCK symbols."""
    b = X.bars(spark, sf_dir).withColumns({"place": F.concat(F.lit("c"), F.col("symbol") % BLOCK), "block": F.floor(F.col("symbol") / BLOCK)})
    return {f: b.groupBy("d", "block").pivot("place", [f"c{i}" for i in range(BLOCK)]).agg(F.max(v)) for f, v in {"close": F.when(F.col("volume") % 5 != 0, F.col("close")), "open": F.col("open")}.items()}


@query("s7_matrices_to_rows", X.with_views("bars") + " SELECT CAST(d AS VARCHAR) AS d, CAST(symbol AS VARCHAR) AS symbol, close, open FROM bars WHERE volume % 5 <> 0")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.matrices_to_rows(_matrices(spark, sf_dir), others=["block"])
    return text_dates(rows.withColumn("symbol", (F.col("block") * BLOCK + F.substring("symbol", 2, 9).cast("int")).cast("string")).drop("block"))


def quote_lines(df: DataFrame) -> DataFrame:
    """Quote lines out of orders."""
    blank = F.lit("")
    parts = [blank] * 50
    k = F.col("o_orderkey")
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    filled = {
        0: F.lit("1"), 1: F.when(k % 13 != 0, F.concat(F.lit("N"), F.col("o_custkey"))).otherwise(""), 2: F.lpad(k.cast("string"), 6, "0"), 3: money(F.col("o_totalprice")), 4: money(F.col("o_totalprice") + 1),
        6: F.lit("777"), 30: F.date_format("o_orderdate", "yyyyMMddHHmmss"), 32: F.when(k % 7 == 0, "--").otherwise((k % 20 - 10).cast("string")), 36: (k % 1000).cast("string"), 37: (k % 5000).cast("string"),
        38: (k % 9 / 4).cast("decimal(6,2)").cast("string"), 39: (k % 50 - 10).cast("string"), 44: (k % 300).cast("string"), 45: (k % 400).cast("string"), 46: F.when(k % 5 == 0, "-").otherwise((k % 8).cast("string")), 47: money(F.col("o_totalprice") + 2), 48: F.lit("0.00"),
    }
    for i, c in filled.items():
        parts[i] = c
    short = F.when(k % 17 == 0, F.concat_ws("~", *parts[:40])).otherwise(F.concat_ws("~", *parts))
    good = F.concat(F.lit("v_sh"), F.lpad(k.cast("string"), 6, "0"), F.lit('="'), short, F.lit('";'))
    return df.select(k, F.when(k % 11 == 0, "pv_none_match=1;").otherwise(good).alias("value"))


@query(
    "s8_parse_quotes",
    """SELECT o_orderkey, 'N' || o_custkey AS name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS quoted_at, o_totalprice AS price, CAST(0 AS DOUBLE) AS high, CAST(o_orderkey % 1000 AS DOUBLE) * 100 AS volume, CASE WHEN o_orderkey % 5000 > 0 THEN CAST(o_orderkey % 5000 AS DOUBLE) * 10000 END AS amount,
 CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 20 - 10 AS DOUBLE) ELSE 0 END AS change_pct, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 9 AS DOUBLE) / 4 END AS turnover_pct, CASE WHEN o_orderkey % 50 > 10 THEN CAST(o_orderkey % 50 - 10 AS DOUBLE) END AS pe_ttm,
 CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 8 > 0 THEN CAST(o_orderkey % 8 AS DOUBLE) END AS pb, CASE WHEN o_orderkey % 400 > 0 THEN CAST(o_orderkey % 400 AS DOUBLE) * 1e8 END AS total_market_cap, CASE WHEN o_orderkey % 300 > 0 THEN CAST(o_orderkey % 300 AS DOUBLE) * 1e8 END AS float_market_cap,
 CAST(CAST(o_totalprice + 2 AS DECIMAL(18,2)) AS DOUBLE) AS limit_up, CAST(NULL AS DOUBLE) AS limit_down FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0""",
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsers.parse_quotes(quote_lines(X.table(spark, sf_dir, "orders")))
    return out.select("o_orderkey", "name", F.date_format("quoted_at", "yyyy-MM-dd HH:mm:ss").alias("quoted_at"), "price", "high", "volume", "amount", "change_pct", "turnover_pct", "pe_ttm", "pb", "total_market_cap", "float_market_cap", "limit_up", "limit_down")


@query(
    "s8_parse_indices",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN 'N' || o_custkey ELSE '' END AS name, o_totalprice AS price, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 20 - 10 AS DOUBLE) ELSE 0 END AS change_pct,
 CASE WHEN o_orderkey % 5000 > 0 THEN CAST(o_orderkey % 5000 AS DOUBLE) * 10000 END AS amount FROM orders WHERE o_orderkey % 11 <> 0""",
)
def s8_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse_quotes(quote_lines(X.table(spark, sf_dir, "orders")), index=True).select("o_orderkey", "name", "price", "change_pct", "amount")


@query("s9_parse_sectors", "SELECT p_brand AS brand, 'c' || p_partkey AS key, p_name AS name, CAST(p_size AS BIGINT) AS members, CAST(p_size - 25 AS DOUBLE) / 10 AS change_pct, p_retailprice AS amount FROM part WHERE p_partkey % 6 <> 0")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = X.table(spark, sf_dir, "part"), F.col("p_partkey")
    full = F.concat_ws(",", F.concat(F.lit("c"), k), "p_name", "p_size", F.lit("1"), F.lit("2"), ((F.col("p_size") - 25) / 10).cast("decimal(6,1)").cast("string"), F.lit("3"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    entry = F.struct(F.concat(F.lit("c"), k).alias("key"), F.when(k % 6 == 0, "short,row").otherwise(full).alias("value"))
    lines = p.groupBy("p_brand").agg(F.concat(F.lit("var S_Finance = "), F.to_json(F.map_from_entries(F.collect_list(entry)))).alias("value"))
    return parsers.parse_sectors(lines.withColumnRenamed("p_brand", "brand")).select("brand", "key", "name", "members", "change_pct", "amount")


@query(
    "s10_check_import",
    X.with_views("bars") + """ SELECT problem, found, expected FROM (SELECT 'row_count' AS problem, CAST(count(*) AS VARCHAR) AS found, '10' AS expected FROM bars UNION ALL SELECT 'maximum', CAST(max(d) AS VARCHAR), '2000-01-01' FROM bars
 UNION ALL SELECT 'synthetic_rows', CAST(count(*) FILTER (WHERE volume < 5) AS VARCHAR), '0' FROM bars UNION ALL SELECT 'columns', 'extra', '' UNION ALL SELECT 'manifest_id', 'm1', 'new') WHERE found <> expected""",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prices(spark, sf_dir)
    first = X.bars(spark, sf_dir).agg(F.min("d").cast("string")).collect()[0][0]
    manifest = {"manifest_id": "m1", "columns": [*df.columns, "extra"], "row_count": 10, "minimum": first, "maximum": "2000-01-01"}
    return files.check_import(df, manifest, spark.createDataFrame([("m1",)], "manifest_id string"))


@query("s10_import", X.with_views("bars") + " SELECT CAST(symbol AS VARCHAR) AS symbol, CAST(d AS VARCHAR) AS effective_date, CAST(close AS DOUBLE) AS close FROM bars WHERE volume >= 5")
def s10_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append half: clean rows are appended, the same rows under a manifest with another row count are not."""
    path = scratch(spark)
    df = _prices(spark, sf_dir).where("NOT is_synthetic")
    n, first, last = X.bars(spark, sf_dir).where("volume >= 5").agg(F.count("*"), F.min("d").cast("string"), F.max("d").cast("string")).collect()[0]
    manifest = {"manifest_id": "m2", "columns": df.columns, "row_count": n, "minimum": first, "maximum": last}
    seen = spark.createDataFrame([("m1",)], "manifest_id string")
    files.import_dataset(df, manifest, seen, path)
    files.import_dataset(df, {**manifest, "manifest_id": "m3", "row_count": n + 1}, seen, path)
    return text_dates(spark.read.schema(df.schema).parquet(path).select("symbol", "effective_date", F.col("close").cast("double").alias("close")))


@query("s11_upsert", "SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS o_orderkey FROM orders GROUP BY 1")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return files.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), keys=["o_custkey"], newest=["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("s12_newest_rows", X.with_views("bars") + " SELECT symbol, CAST(d AS VARCHAR) AS d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS position FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 30)")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.newest_rows(X.bars(spark, sf_dir).select("symbol", "d", "close"), 30, keys=["symbol"], order=["d"])
    return text_dates(out.withColumn("position", F.col("position").cast("long")))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws(":", "event_type", F.floor(F.col("value") / 10)).alias("body"))


@query("s13_new_snapshots", "WITH e AS (SELECT user_id, event_id, event_type || ':' || CAST(floor(value / 10) AS BIGINT) AS body FROM events) SELECT user_id, body, min(event_id) AS event_id, sha256(body) AS payload_hash FROM e WHERE (user_id, body) NOT IN (SELECT (user_id, body) FROM e WHERE event_id % 10 = 0) GROUP BY 1, 2")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _snapshots(spark, sf_dir)
    stored = e.where("event_id % 10 = 0").withColumn("payload_hash", F.sha2("body", 256))
    return files.new_snapshots(e, stored, keys=["user_id"], payload=F.col("body"), at="event_id").select("user_id", "body", "event_id", "payload_hash")


@query("s13_latest_snapshot", "SELECT user_id, max(struct_pack(k := event_id, t := event_type)).t AS event_type FROM events GROUP BY 1")
def s13_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return files.latest_snapshot(e, keys=["user_id"], at="ts", tie="event_id").select("user_id", "event_type")


@query("s14_write_once", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    return text_dates(files.write_once(o, scratch(spark), keys=["o_custkey"], date="d").drop("content_hash"))
