"""What a run leaves behind or deals out, beside its results."""

import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import lm, near_dedup


def test_one_group_is_dealt_out_once(spark):
    """Both sides of the join of pairs are one group: as many tasks as partitions, not as pairs of a side's pieces."""
    tight = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in tight}
    texts = C.cut(spark.range(600).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("node"), F.concat(F.lit("a b c d e f "), F.col("id").cast("string")).alias("text")))
    groups = C.cut(texts.select(F.lit(1).cast("long").alias("shingle"), "node", F.col("node").alias("root"), F.lit(600).cast("long").alias("n")))
    signed = near_dedup._signed(texts.select("node"), texts)
    try:
        for k, v in tight.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("dealt", "")
        near_dedup._verify(near_dedup._close(groups, signed, 0.8), texts, 0.8)
        tracker = spark.sparkContext.statusTracker()
        tasks = [tracker.getStageInfo(k).numTasks for j in tracker.getJobIdsForGroup("dealt") for k in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(k)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) <= 24, sorted(tasks)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_cut_leaves_no_shuffle_files(spark):
    blocks = lambda: sum(b.toString().startswith("shuffle_") for b in _list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()))
    before = blocks()
    out = C.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they are removed beside the query
        if (left := blocks()) <= before:
            break
        time.sleep(0.1)
    assert left <= before and spark.conf.get(C.SHUFFLES_GO) == "false" and out.count() == 7


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _exchanges(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").count("Exchange ")


def test_words_are_shuffled_once(spark, monkeypatch):
    """Counts of words, beside classes too, by one exchange, whatever the tasks hand on in between."""
    monkeypatch.setattr(lm, "COUNTED", 3)
    texts = ["a b A c\td", None, "", "b \u00e9\x0bb z", "Q r s t a"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["word"]: r["n"] for r in lm.count_words(docs, "text").collect()}
    assert got == Counter(w for t in texts for w in [*(t or "").encode().lower().decode().split(), "\n"])
    vocab = lm.vocabulary(lm.count_words(docs, "text"), 3)
    encoded = lm.encode(docs, vocab, id_col="doc_id", text_col="text", held_out=F.lit(False))
    near = lm.rare_counts(encoded, np.concatenate([[lm.FINAL], np.zeros(len(vocab.counts) - 1, int), [lm.REST], np.arange(lm.CLASSES)]))
    assert _exchanges(near) == 1
    frequent = {w.decode() for w in vocab.words}
    assert {bytes(r["word"]).decode(): sum(p["n"] for p in r["near"] if p["place"] < lm.N) for r in near.collect()} == {w: n for w, n in got.items() if w not in frequent}


def test_rare_words_go_out_once_for_each_block(spark, monkeypatch):
    """A block lists a rare word once, however often it stands there, and scores do not depend on where blocks end, on held-out rows among them, or on what goes back together."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{x}" for x in rng.zipf(1.3, 60) % 5000) for _ in range(700)] + ["alone " * 500, "", None, " \t\n", "\u00c9t\u00e9 \x0bW1  W1 a\x1cb "] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (50,))
    out = C.bucket_of(F.col("doc_id"), 10) == 0
    vocab = lm.vocabulary(lm.count_words(docs.where(~out), "text"), 50)

    def scores():
        found, words, block = lm.score_documents(docs, passes=1).collect(), 0, lm.encode(docs, vocab, id_col="doc_id", text_col="text", held_out=out).collect()
        for r in block:
            assert len(set(map(bytes, r["rare"]))) == len(r["rare"]) and sum(r["sizes"]) * 4 == len(r["ids"]) and len(r["__ids"]) == len(r["sizes"])
            words += len(r["which"])
        assert words == sum(w not in vocab.words for t in texts for w in (t or "").encode().lower().split())
        return len(block), {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in found}

    few, want = scores()
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1)
    monkeypatch.setattr(lm, "RETURNED", 1)
    more, got = scores()
    assert few < more and got == want and {i: x[1] for i, x in got.items()} == {i: len((t or "").encode().split()) + 1 for i, t in enumerate(texts)}
