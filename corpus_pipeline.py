"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor kept, as columns of documents, and is written before the
next one reads it; the last returns the packed pieces. A stage is only a call of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import cut, read, unused

#: A line goes from all but its first document once so many documents hold it.
LINE_DOCS = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, unchanged.

    Null and empty texts have fewer words than the rules ask for and go. Rows of the same id and text stay or go together; null ids,
    languages and sources are values like others. An empty table stays empty.
    """
    return quality.drop_low_quality(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that LINE_DOCS or more of them hold, but for the first of each; n_chars, where there is one, follows the text.

    A null text becomes an empty one; a document may be left without a line. Rows of the same id and text count as one document
    and are treated alike.
    """
    own = [c for c in docs.columns if c.lower() in line_dedup.OWN]
    aside = dict(zip(own, unused(docs, len(own)), strict=True))  # columns that only share a name with what the operator adds
    done = line_dedup.dedup_lines(docs.withColumnsRenamed(aside), min_docs=LINE_DOCS, keep="first")
    made = {"text": F.col("kept_text")} | ({"n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.withColumns(made).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts, unchanged: that of the least id (null ids last).

    Empty texts are one class. Rows of the same id and text are one document and stay together.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth lies in benchmark windows, unchanged. Empty texts and, without benchmark items, all documents stay."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of tokens; an empty text is its end token alone, an empty table gives no piece."""
    return packing.pack(packing.encode(docs)).drop("__part", "__row")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: Robust estimates, order MinHash and tokens are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of the table documents; each stage is written to the shared folder before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
