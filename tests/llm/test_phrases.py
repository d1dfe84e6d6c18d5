"""Phrase collocations against counting by hand; both ways of sending ids, tiles, long texts, odd tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, least, longest, top):
    counts, out = defaultdict(Counter), []
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n, many = sum(c for p, c in f.items() if len(p) == 1), {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        dropped = {p[i:j] for p, c in many.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * c >= 80 * many[p[i:j]]}
        scored = []
        for p, a in many.items():
            if p not in dropped:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_whole_table_by_brute_force_and_both_ways(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = brute([(r["text"], r["lang"]) for r in docs.collect()], 5, 4, 300)
    assert len(want) > 200 and found(phrases.collocations(docs, least=5, top=300)) == want
    assert found(phrases.collocations(docs, least=5, top=300, sent=0)) == want


def test_small_blocks_and_slices_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(120)
    want = found(phrases.collocations(docs, least=4, top=100))
    for name, value in (("BLOCK", 500), ("OPEN", 900), ("PART", 64), ("HELD", 50), ("SLICE", 40), ("DENSE", 2)):
        monkeypatch.setattr(phrases, name, value)  # workers are forked or unpickle by module, so what counts is what the driver plans and what runs in it
    assert found(phrases.collocations(docs, least=4, top=100)) == want
    small = [row for text in ("a b. C d\nA b;; c", "a b " * 3000 + "x" * 900) for row in phrases._parts(text.encode())]
    assert [w for part in small for w in part if w != b"."] == b"a b c d a b c".split() + [b"a", b"b"] * 3000 + [b"x" * 900]


def test_repeats_overlaps_nulls_and_odd_bytes(spark):
    rows = [("a a a a a", "en"), ("A A. a\ta", None), (None, "en"), ("", None), (" \t.;\n", "de"), ("café x café x É é", "fr"), ("a b c d e " * 40, "en"), ("b c|d", ""), ("x" * 300_000, "en"), ("to be or. not to be? to be or", None)]
    rows = rows * 3
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("block", "ids", "w", "c", "n", "phrase", "a")})
    for sent in (phrases.SENT, 0):
        assert found(phrases.collocations(df, least=3, sent=sent)) == brute(rows, 3, 4, 2000)
    assert phrases.collocations(df.where("false")).count() == 0 and phrases.collocations(df, least=10**6).count() == 0
    assert found(phrases.collocations(df, least=3, longest=2)) == brute(rows, 3, 2, 2000)


@pytest.mark.parametrize("size", [0, 10, 300_000])
def test_tiles_count_as_a_dictionary_does(size):
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, (2, size)), 2**31 - 1).astype(np.int64)
    keys = (ids[0] << 32) | ids[1]
    names, counts = phrases.tile_counts(keys)
    assert list(names) == sorted(set(keys.tolist())) and dict(zip(names.tolist(), counts.tolist(), strict=True)) == dict(Counter(keys.tolist()))
    if size:
        assert (np.bincount(phrases._slice_of(names, 8), minlength=8) > 0).sum() > 1


def test_ids_follow_frequency(spark):
    df = spark.createDataFrame([(lang, f"w{i}", 1000 - i // 3) for lang in "ab" for i in range(500)], "lang string, word string, n long")
    for lang in "ab":
        got = [(r["word"], r["id"]) for r in phrases.ranked(df, "word").where(F.col("lang") == lang).orderBy("id").collect()]
        assert got == [(w, i + 1) for i, w in enumerate(sorted((f"w{i}" for i in range(500)), key=lambda w: (int(w[1:]) // 3, w)))]
