"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its longest
character n-grams that the model knows (4 to 1, with word boundaries). The model holds every word that
a bounded sample of labelled rows has twice, and the n-grams of all its words, which Spark counts; its size
follows from the sample alone. Every text is then scored whole. Words are runs of Unicode letters
(category L), lower-cased, in training as in prediction.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

LETTERS = regex.compile(r"\p{L}+")
#: About so many labelled rows of each language a model is learnt from, and the least count of a word that it holds.
SAMPLE_ROWS, LEAST_COUNT = 5_000, 2
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_logp: np.ndarray  # a row for each word, a column for each language
    grams: list[dict[str, np.ndarray]]  # for each of ORDERS

    def backoff(self, word: str) -> np.ndarray:
        """Of an unseen word: the mean log probability of its known n-grams of the greatest order that has any."""
        padded = f"_{word}_"
        for n, known in zip(ORDERS, self.grams, strict=True):
            rows = [r for i in range(len(padded) - n + 1) if (r := known.get(padded[i : i + n])) is not None]
            if rows:
                return sum(rows) / len(rows)
        return np.zeros(len(self.langs))


def _log_table(counts: pd.DataFrame, at: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """The row of each name in counts (lang, name, n), and log10 of its smoothed share in each language."""
    names = {x: i for i, x in enumerate(sorted(set(counts["name"])))}
    c = np.zeros((len(names), len(at)))
    np.add.at(c, (counts["name"].map(names).to_numpy(int), counts["lang"].map(at).to_numpy(int)), counts["n"].to_numpy(float))
    return names, np.log10((c + SMOOTHING) / (c.sum(0) + SMOOTHING * (len(names) + 1))).astype(np.float32)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the languages in labelled; rows without text or language are left out. None if no letter is left.

    The sample is by a hash of id and text: every language gives about sample_rows rows (a repeated row is picked as often
    as it occurs; null ids are rows like others), so a language of few rows is learnt from all of them.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    sizes = rows.groupBy("__lang").agg((sample_rows / F.count("*")).alias("__share"))
    picked = rows.join(F.broadcast(sizes), "__lang").where(F.pmod(F.xxhash64("__id", "__text", F.lit("sample")), F.lit(1_000_000)) < 1_000_000 * F.col("__share"))  # a row for each language
    words = picked.select("__lang", F.explode(F.split(F.lower("__text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    counts = C.cut(words.groupBy("__lang", "w").agg(F.count("*").alias("n")))
    padded = F.concat(F.lit("_"), F.col("w"), F.lit("_"))
    each = counts.select("__lang", "n", padded.alias("p"), F.explode(F.array(*[F.lit(n) for n in ORDERS])).alias("k")).where(F.length("p") >= F.col("k"))
    each = each.select("__lang", "n", "k", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - F.col("k") + 1), lambda i: F.col("p").substr(i, F.col("k")))).alias("g"))
    grams = each.groupBy("__lang", "k", "g").agg(F.sum("n").alias("n")).toDF("lang", "k", "name", "n").toPandas()  # both tables are bounded by the sample
    words = counts.where(F.col("n") >= LEAST_COUNT).toDF("lang", "name", "n").toPandas()
    if grams.empty:
        return None
    langs = sorted(set(grams["lang"]))
    at = {x: i for i, x in enumerate(langs)}
    tables = []
    for k in ORDERS:
        names, logp = _log_table(grams[grams["k"] == k], at)
        tables.append(dict(zip(names, logp, strict=True)))
    return Model(langs, *_log_table(words, at), tables)


def predict_text(model: Model, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
    """Language and score (its posterior; long texts count as 20 words). UNKNOWN and 0 without a letter; ties: the first language."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return UNKNOWN, 0.0
    counts = Counter(words)
    found = list(map(model.words.get, counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    known = np.array([i is not None for i in found])
    total = n[known] @ model.word_logp[[i for i in found if i is not None]] if known.any() else np.zeros(len(model.langs))
    for w, i, c in zip(counts, found, n, strict=True):
        if i is None:
            row = cache.get(w)
            if row is None:
                row = cache[w] = model.backoff(w)
            total = total + c * row
    mean = total / len(words) * min(len(words), 20) * math.log(10)
    p = np.exp(mean - mean.max())
    best = int(p.argmax())
    return model.langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, lang_pred, score. Null and letterless texts are UNKNOWN, as all are without a model.

    Only the text is looked at; repeated rows and null ids give a row each.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(cache) > 100_000:
                cache.clear()
            got = [predict_text(shared.value, t, cache) if shared.value else (UNKNOWN, 0.0) for t in batch["__text"]]
            out = pd.DataFrame(got, columns=["lang_pred", "score"])
            out.insert(0, id_col, batch[id_col].values)
            yield out

    C.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInPandas(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    held_out = C.bucket_of(F.col("doc_id"), 3) == 1
    found = identify(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
