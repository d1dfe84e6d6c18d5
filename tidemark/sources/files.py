"""Typed scans and checked sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import TABLES


def scan_bitemporal(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A bitemporal table by its fixed schema, without synthetic rows; the filter reaches the scan."""
    return spark.read.schema(TABLES[table]).parquet(path).where(~F.col("is_synthetic"))


def scan_parquet(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """All Parquet files under the paths; folder names give no columns."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).parquet(*([paths] if isinstance(paths, str) else paths))


def scan_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """S3: CSV with a header read as text, then cast to columns' types; what can't be cast is null."""
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()])


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by name; keys that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def scan_documents(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A folder of JSON documents: the good ones, and (file, reason) of those that don't parse or lack a required field."""
    # a document is a file
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("__raw"))
    parsed = texts.withColumn("__p", F.from_json("__raw", f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt", "mode": "PERMISSIVE"}))
    lacks = F.array_compact(F.array(*[F.when(F.col(f"__p.{c}").isNull(), F.lit(c)) for c in required]))
    reason = F.when(F.col("__p").isNull() | F.col("__p.__corrupt").isNotNull(), "INVALID_JSON").when(F.size(lacks) > 0, F.concat(F.lit("MISSING_"), F.array_join(lacks, ",")))
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason IS NULL").select("file", "__p.*").drop("__corrupt"), marked.where("reason IS NOT NULL").select("file", "reason")


def scan_symbol_files(spark: SparkSession, path: str, columns: Mapping[str, str], pattern: str = r"([0-9]{6})\.(SH|SZ|BJ)\.csv$") -> tuple[DataFrame, DataFrame]:
    """Many CSV files, one for each symbol, as one table with symbol and exchange from the file name, BJ left out; and symbols with more than one file."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    name = F.col("_metadata.file_path")
    venue = F.regexp_extract(name, pattern, 2)
    rows = raw.select(F.concat_ws(".", F.regexp_extract(name, pattern, 1), venue).alias("symbol"), F.when(venue == "SH", "SSE").otherwise("SZSE").alias("exchange"), name.alias("__file"), *[F.col(c).try_cast(t).alias(c) for c, t in columns.items()])
    kept = rows.where(F.col("symbol").rlike(r"\.(SH|SZ)$"))
    twice = kept.groupBy("symbol").agg(F.count_distinct("__file").alias("files")).where("files > 1")
    return kept.drop("__file"), twice


def matrices_to_rows(fields: Mapping[str, DataFrame], *, date: str = "d", required: str = "close", symbol: str = "symbol", others: Sequence[str] = ()) -> DataFrame:
    """Date by symbol matrices, one for each field, as rows; cells where the required field is finite are kept.

    others are further columns that a matrix row is known by, such as the block of symbols its columns stand for; date and others are unique in a matrix.
    """
    keys, names = [date, *others], list(fields)
    cells = {f: [c for c in m.columns if c not in keys] for f, m in fields.items()}
    # a row of one matrix meets a row of another while both are wide, so what is shuffled is a row for each date, not one for each cell
    wide = [m.select(*keys, F.struct(*[F.col(c) for c in cells[f]]).alias(f"__{f}")) for f, m in fields.items()]
    both = reduce(lambda a, b: a.join(b, keys, "full_outer"), wide)
    symbols = list(dict.fromkeys(c for f in names for c in cells[f]))
    kinds = {f: fields[f].schema[cells[f][0]].dataType for f in names}
    cell = [F.struct(F.lit(c).alias(symbol), *[(F.col(f"__{f}").getField(c) if c in cells[f] else F.lit(None).cast(kinds[f])).alias(f) for f in names]) for c in symbols]
    r = F.col(f"__c.{required}")
    kept = both.select(*keys, F.explode(F.array(*cell)).alias("__c")).where(r.isNotNull() & ~F.isnan(r.cast("double")) & (F.abs(r) != float("inf")))
    return kept.select(*keys, "__c.*")


def check_import(df: DataFrame, manifest: Mapping, seen: DataFrame, *, eff: str = "effective_date", known: str = "known_at") -> DataFrame:
    """The problems of a dataset against its manifest (problem, found, expected); no row means that it may be appended.

    manifest: manifest_id, columns, row_count, minimum, maximum; seen: manifest_id of earlier imports. One pass over the rows.
    """
    spark = df.sparkSession
    got = df.agg(F.count("*").cast("string").alias("row_count"), F.min(eff).cast("string").alias("minimum"), F.max(eff).cast("string").alias("maximum"), F.count_if(F.col(known).isNull()).cast("string").alias("null_known_at"), F.count_if(F.col("source_id").isNull()).cast("string").alias("null_source_id"), F.count_if("is_synthetic").cast("string").alias("synthetic_rows"))
    wanted = {"row_count": str(manifest["row_count"]), "minimum": str(manifest["minimum"]), "maximum": str(manifest["maximum"]), "null_known_at": "0", "null_source_id": "0", "synthetic_rows": "0"}
    pairs = got.select(F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(k).alias("found"), F.lit(v).alias("expected")) for k, v in wanted.items()])).alias("x")).select("x.*")
    out = pairs.where(~F.col("found").eqNullSafe(F.col("expected")))
    odd = sorted(set(df.columns) ^ set(manifest["columns"]))
    rows = [("columns", ",".join(odd), "")] if odd else []
    again = seen.where(F.col("manifest_id") == manifest["manifest_id"]).select(F.lit("manifest_id").alias("problem"), F.col("manifest_id").alias("found"), F.lit("new").alias("expected")).distinct()
    return out.unionByName(again).unionByName(spark.createDataFrame(rows, "problem string, found string, expected string"))


def import_dataset(df: DataFrame, manifest: Mapping, seen: DataFrame, folder: str) -> DataFrame:
    """Appends df to folder if check_import() finds nothing; returns the problems."""
    problems = check_import(df, manifest, seen)
    if problems.isEmpty():
        df.write.mode("append").parquet(folder)
    return problems


def upsert(old: DataFrame, new: DataFrame, *, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Both tables with one row for each key, the newest."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest]).select(*both.columns)


def newest_rows(df: DataFrame, n: int, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest n rows of each key, numbered in ascending order."""
    down = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where(F.col("__r") <= n)
    return down.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).drop("__r")


def new_snapshots(snapshots: DataFrame, stored: DataFrame, *, keys: Sequence[str], payload: Column, at: str) -> DataFrame:
    """Snapshots whose payload hash is not stored yet for their key, each content once (the first)."""
    hashed = snapshots.withColumn("payload_hash", F.sha2(payload, 256))
    fresh = hashed.join(stored.select(*keys, "payload_hash"), [*keys, "payload_hash"], "left_anti")
    return fresh.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "payload_hash").orderBy(at))).where("__r = 1").drop("__r")


def latest_snapshot(stored: DataFrame, *, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The latest snapshot of each key."""
    rest = [c for c in stored.columns if c not in keys]
    best = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def receipt(df: DataFrame, *, keys: Sequence[str], date: str) -> DataFrame:
    """Rows, distinct keys, date bounds and an order-free content hash: one row."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(*keys).alias("n_keys"), F.min(date).alias("first"), F.max(date).alias("last"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("content_hash"))


def write_once(df: DataFrame, path: str, *, kind: str = "parquet", keys: Sequence[str], date: str) -> DataFrame:
    """Writes a new dataset (fails if path exists), zstd Parquet or JSON lines, and returns the receipt of what lies there."""
    writer = df.write.mode("errorifexists")
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    else:
        writer.json(path)
    spark = df.sparkSession
    return receipt((spark.read.schema(df.schema).parquet if kind == "parquet" else spark.read.schema(df.schema).json)(path), keys=keys, date=date)
