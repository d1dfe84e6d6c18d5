"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and everything runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir: a folder that all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


#: With this setting Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read back, so that no lost executor recomputes what came before; the write's shuffle files go with its end."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, n: int) -> list[str]:
    """n column names that df has not, whatever the case of its own."""
    taken, names, k = {c.lower() for c in df.columns}, [], 0
    while len(names) < n:
        if (name := f"__own{k}") not in taken:
            names.append(name)
        k += 1
    return names


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts go to Python workers so many rows at a time; long ones then fit in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter; lower() is the fast way where a text has ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str = SPACE_RUN) -> Column:
    """The words of a text between runs of separators; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n (null ids: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Identifies a row by id and content: ids may be null or repeated. Rows with the same key are copies and get the same result."""
    return [doc_id.alias("__id"), F.xxhash64(text).alias("__th")]


def on_key(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & (left["__th"] == right["__th"])


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of counts (with a column n) of the greatest n, about limit and never more: all from some n on, found from a histogram.

    No task sorts or returns more than its share of them, however many rows there are. Where the limit falls among
    counts that are about equal, a hash of the row decides, so that many ties are not dropped together.
    """
    step = F.floor(F.log2("n") * 16)
    least, total, share = None, 0, 0.0
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["b"]):  # some hundred rows
        least = r["b"]
        if total + r["c"] > limit:
            room = limit - total
            share = max(0.0, room - 4 * room**0.5) / r["c"]
            break
        total, share = total + r["c"], 1.0
    if least is None:
        return counts
    drawn = F.pmod(F.xxhash64(*sorted(c for c in counts.columns if c != "n")), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    return counts.where((step > least) | ((step == least) & drawn))
