"""How queries are registered."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def text_dates(df: DataFrame) -> DataFrame:
    """Dates as text, as SQL engines print them alike."""
    return df.select(*[F.col(n).cast("string").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes])



def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; a temporary one only where everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir: a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{uuid.uuid4().hex}"
