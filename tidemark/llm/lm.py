"""Language-model scoring with Brown classes.

Words are assigned to classes by exchange. The most frequent words move among the classes on the driver, each to where the likelihood of the class bigrams
rises most, from counts that a pass over the whole training corpus gathers; half of them move between two passes, the next pass counts
anew, and moves that have not raised the likelihood are taken back. Meanwhile all other words of the training corpus are one class, REST. Then
each of these words, however many there are, leaves it by the same rule: Spark sums up its counts beside each class and tasks take the class of the greatest gain.
What is never learnt stays in REST, whose share is that of words seen once. A token's probability is that of its class after the class before, times
that of the word in its class. Counts of frequent words (a table of bounded size) are broadcast. All other words meet once: texts are held in blocks, a block's rare words
are listed once with what stands beside them, go to their word by a shuffle, and their classes and counts come back to the block by another.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Frequent words that are broadcast, those of them that move on the driver, classes, and passes of these moves over the corpus.
HEAD, CLUSTERED, CLASSES, PASSES = 100_000, 20_000, 32, 2
#: The classes behind these: of words that aren't assigned, and of the end.
REST, FINAL = CLASSES, CLASSES + 1
N = CLASSES + 2
#: Counts of a word beside classes: after each, before each, and after itself.
WIDTH, BLOCK, HELD = 2 * N + 1, 256, 1 << 21
#: Words that a task counts before it hands them on.
COUNTED = 500_000
#: Bytes of text that a block has before it ends, and occurrences of rare words that go back to their blocks together.
BLOCK_BYTES, RETURNED = 4 << 20, 1 << 20
ADD, PULL = 0.1, 5.0
END = b"\n"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).alias("__text")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts with A-Z lower-cased, what bytes.lower().split() finds, and where each text's begin in these."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, starts = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    there = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty one
    return words.filter(pa.array(there)), np.concatenate([[0], np.cumsum(there)])[starts]


def _blocks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """Rows in order, together until their texts have so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass
class Vocabulary:
    words: dict[bytes, int]  # id of each frequent word, by falling count; END is 0
    counts: np.ndarray  # of each id
    total: int
    distinct: int
    once: int  # words that occur once

    @property
    def clustered(self) -> int:
        return min(CLUSTERED, len(self.counts))


def count_words(train: DataFrame, text_col: str) -> DataFrame:
    """(word, n) for every token of the training texts, END as a line end. Tasks count before words meet, up to COUNTED at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for block in _blocks(batches, 0, BLOCK_BYTES):
            found = _words(block.column(0).chunk(0))[0].value_counts()
            held += [pa.table([found.field(0), found.field(1)], ["word", "n"]), pa.table([pa.array([END], pa.binary()), pa.array([len(block)], pa.int64())], ["word", "n"])]
            rows += len(found) + 1
            if rows > 2 * COUNTED:
                held = [_summed(held)]
                rows = len(held[0])
                if rows > COUNTED:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _summed(held).to_batches()

    C.small_batches(train.sparkSession, 256)
    found = train.select(_text(text_col)).mapInArrow(run, "word binary, n long").select(F.col("word").cast("string").alias("word"), "n")
    return C.cut(found.repartition("word").groupBy("word").agg(F.sum("n").alias("n")))


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    top = C.most_frequent(counts.where("word <> '\n'"), head - 1).toPandas().sort_values(["n", "word"], ascending=[False, True])  # head rows at most
    end = counts.where("word = '\n'").select("n").collect()
    names = [END, *(w.encode() for w in top["word"])]
    n = np.array([end[0]["n"] if end else 0, *top["n"]], np.int64)
    once = counts.where("n = 1 AND word <> '\n'").count()
    return Vocabulary({w: i for i, w in enumerate(names)}, n, sums["n"], sums["v"], once)


def encode(docs: DataFrame, vocab: Vocabulary, *, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """Written once, a row for each block of documents that are all held out or all not: __block, __ids and sizes (their tokens) of the documents, held_out,
    ids (int32 of each token, document after document; len(head) for other words), rare (those words, each once) and which (of these, at each such token)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((list(vocab.words), len(vocab.counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = shared.value
        head, block = pa.array(words, pa.binary()), TaskContext.get().partitionId() << 40
        for table in _blocks(batches, 2, BLOCK_BYTES):
            for out in (False, True):
                some = table.filter(pc.equal(table.column(1), out)).combine_chunks()
                if not len(some):
                    continue
                found, starts = _words(some.column(2).chunk(0))
                at = pc.index_in(found, head)
                other = found.filter(at.is_null()).dictionary_encode()
                ids = np.insert(at.fill_null(size).to_numpy().astype("<i4"), starts[1:], 0)
                columns = {"__block": pa.array([block], pa.int64()), "__ids": _one(some.column(0).chunk(0)), "sizes": _one(pa.array(np.diff(starts) + 1, pa.int32())), "held_out": pa.array([out]), "ids": pa.array([ids.tobytes()], pa.binary()), "rare": _one(other.dictionary), "which": _one(other.indices.cast(pa.int32()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                block += 1

    C.small_batches(docs.sparkSession, 256)
    texts = docs.select(F.col(id_col).alias("__id"), held_out.alias("held_out"), _text(text_col))
    return C.cut(texts.mapInArrow(run, f"__block long, __ids array<{kind}>, sizes array<int>, held_out boolean, ids binary, rare array<binary>, which array<int>"))


def _one(values: pa.Array) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4")


def class_counts(encoded: DataFrame, classes: np.ndarray, first: int = 0, last: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The class bigrams of the training rows, and (key, data): for blocks of the words from first to last their counts beside classes, WIDTH numbers a word.

    Tasks count into arrays of fixed size; these are summed by Spark in blocks of words, written once.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, big, near, held, size = shared.value, np.zeros((N, N), np.int64), np.zeros((last - first) * WIDTH, np.int32), [], 0

        def settle() -> None:
            nonlocal size
            if held:
                near[:] += np.bincount(np.concatenate(held), minlength=len(near)).astype(np.int32)
                held.clear()
                size = 0

        for batch in batches:
            ids = _flat(batch.column(0))
            c = of[ids]
            before = np.concatenate([[of[0]], c[:-1]])
            big += np.bincount(before * N + c, minlength=N * N).reshape(N, N)
            if last > first:
                mine = (ids >= first) & (ids < last)
                at = (ids.astype(np.int64) - first) * WIDTH
                held += [(at + before)[mine], (at[:-1] + N + c[1:])[mine[:-1]], (at[1:] + WIDTH - 1)[mine[1:] & (ids[1:] == ids[:-1])]]
                size += 2 * int(mine.sum())
                if size >= HELD:
                    settle()
        settle()
        keys, data, table = [-1], [big.astype("<i8").tobytes()], near.reshape(-1, WIDTH)
        for k in range(0, last - first, BLOCK):
            if table[k : k + BLOCK].any():
                keys.append(first + k)
                data.append(table[k : k + BLOCK].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["key", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in pdf["data"])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "data": [total.tobytes()]})

    C.small_batches(spark, 1)
    parts = encoded.where("NOT held_out").select("ids").mapInArrow(run, "key int, data binary")
    pieces = parts.groupBy("key", F.pmod(F.xxhash64("data"), F.lit(8)).alias("salt")).applyInPandas(add, "key int, data binary")  # sums of sums: tasks' arrays never meet at once
    sums = C.cut(pieces.groupBy("key").applyInPandas(add, "key int, data binary"))
    big = [np.frombuffer(r["data"], "<i8").reshape(N, N) for r in sums.where("key < 0").collect()]
    return big[0] if big else np.zeros((N, N), np.int64), sums.where("key >= 0")


def _collected(blocks: DataFrame, size: int) -> np.ndarray:
    near = np.zeros((size, WIDTH), np.int64)
    for r in blocks.collect():  # CLUSTERED * WIDTH numbers at most
        got = np.frombuffer(r["data"], "<i8").reshape(-1, WIDTH)
        near[r["key"] : r["key"] + BLOCK] = got
    return near


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(big: np.ndarray) -> float:
    """What classes contribute to the log likelihood of a corpus with these class bigrams."""
    big = big.astype(float)
    return float(_f(big).sum() - _f(big.sum(0)).sum() - _f(big.sum(1)).sum())


def gains(big: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, home: np.ndarray | int) -> np.ndarray:
    """By how much likelihood() rises, but for a constant, when each word joins each of the first CLASSES classes: a row for each word.

    big counts the words in their classes home; left and right are their bigrams after and before words of each class without those with themselves, own are these.
    """
    w, k = np.arange(len(left)), np.arange(CLASSES)
    home = np.broadcast_to(home, len(left))
    ins, outs = np.repeat(big[None, :, :CLASSES].astype(float), len(left), 0), np.repeat(big[None, :CLASSES].astype(float), len(left), 0)
    moved = home < CLASSES  # take each word away from where it is
    ins[w, home] -= right[:, :CLASSES]
    outs[w, :, home] -= left[:, :CLASSES]
    ins[w[moved], :, home[moved]] -= left[moved]
    outs[w[moved], home[moved]] -= right[moved]
    ins[w[moved], home[moved], home[moved]] -= own[moved]
    outs[w[moved], home[moved], home[moved]] -= own[moved]
    into, out_of = np.zeros_like(ins), np.zeros_like(outs)
    i, j = np.nonzero(left)  # bigrams with other classes stay as they are
    into[i, j] = _f(ins[i, j] + left[i, j, None]) - _f(ins[i, j])
    i, j = np.nonzero(right)
    out_of[i, :, j] = _f(outs[i, :, j] + right[i, j, None]) - _f(outs[i, :, j])
    same = ins[:, k, k]
    both = _f(same + left[:, :CLASSES] + right[:, :CLASSES] + own[:, None]) - _f(same)
    gain = into.sum(1) - into[:, k, k] + out_of.sum(2) - out_of[:, k, k] + both
    # what stands beside the word counts in its own class's totals whichever class the word joins
    for sums, size in ((ins.sum(1) + right[:, :CLASSES], left.sum(1) + own), (outs.sum(2) + left[:, :CLASSES], right.sum(1) + own)):
        gain -= _f(sums + size[:, None]) - _f(sums)
    return gain


def _best(big: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The class of the greatest gain for words of REST, from their counts beside classes."""
    own, left, right = near[:, -1].astype(float), near[:, :N].astype(float), near[:, N:-1].astype(float)
    left[:, REST] -= own
    right[:, REST] -= own
    return gains(big, left, right, own, REST).argmax(1)


def rare_counts(encoded: DataFrame, classes: np.ndarray) -> DataFrame:
    """(word, near, block, at) for each word of the training rows that isn't among the frequent ones: near are its counts beside classes, as pairs (place, n), block and at
    say where it is listed, held-out rows included."""
    shared, size = encoded.sparkSession.sparkContext.broadcast(classes), len(classes) - 1 - CLASSES

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block and word: beside has two numbers in one for each occurrence in a training row, the classes before and after, and whether the word itself comes next."""
        of = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                words, which = batch.column(3)[k].values, batch.column(4)[k].values.to_numpy()
                beside, starts = np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int32)
                if not batch.column(1)[k].as_py():
                    ids = np.frombuffer(batch.column(2)[k].as_buffer(), "<i4")
                    at = np.flatnonzero(ids == size)
                    before = np.where(at > 0, of[ids[at - 1]], of[0])
                    again = np.append((at[1:] == at[:-1] + 1) & (which[1:] == which[:-1]), False)
                    beside = ((before * N + of[ids[at + 1]]) * 2 + again[: len(at)]).astype(np.int32)[np.argsort(which, kind="stable")]  # a text ends with END
                    starts[1:] = np.cumsum(np.bincount(which, minlength=len(words)))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), batch.column(0)[k].as_py()), pa.int64()), pa.array(np.arange(len(words)), pa.int32()), pa.ListArray.from_arrays(pa.array(starts), pa.array(beside))], names=["word", "block", "at", "beside"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column(0)[-1] != held[0].column(0)[0]:  # more than one word: all but the last are whole
                table = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(table.column(0).chunk(0))
                yield _near(table.slice(0, starts[-1]), starts)
                held = table.slice(starts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield _near(table, np.append(_starts(table.column(0).chunk(0)), len(table)))

    C.small_batches(encoded.sparkSession, 1)
    rows = encoded.select("__block", "held_out", "ids", "rare", "which").mapInArrow(listed, "word binary, block long, at int, beside array<int>")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, near array<struct<place: int, n: bigint>>, block array<bigint>, at array<int>")


def _starts(words: pa.Array) -> np.ndarray:
    """Where another word begins."""
    return np.concatenate([[0], np.flatnonzero(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)) + 1])


def _near(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """What rare_counts() gives of rows of words that begin at starts, whose last is the end."""
    (lists, block, at), first = (table.column(c).combine_chunks() for c in ("beside", "block", "at")), starts[:-1]
    lists, block, at = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, block, at))
    cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py())[starts]
    pair, word = lists.flatten().to_numpy(), np.repeat(np.arange(len(first)) * WIDTH, np.diff(cuts))
    again = pair % 2 == 1
    places, n = np.unique(np.concatenate([word + pair // 2 // N, word + N + pair // 2 % N, word[again] + WIDTH - 1]), return_counts=True)
    near = pa.StructArray.from_arrays([pa.array(places % WIDTH, pa.int32()), pa.array(n, pa.int64())], names=["place", "n"])
    columns = [table.column("word").combine_chunks().take(pa.array(first)), pa.ListArray.from_arrays(pa.array(np.searchsorted(places, np.arange(len(starts)) * WIDTH), pa.int32()), near)]
    columns[0] = columns[0].chunk(0) if isinstance(columns[0], pa.ChunkedArray) else columns[0]
    columns += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in (block, at)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "near", "block", "at"]).filter(pa.array(np.diff(cuts) > 0))


def assigned(near: DataFrame, big: np.ndarray) -> DataFrame:
    """(word, class, n, block, at) of what rare_counts() gives."""
    shared = near.sparkSession.sparkContext.broadcast(big)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}  # class by counts beside classes: most rare words have the same few
        for batch in batches:
            lists = batch.column(1)
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place, n = (np.ascontiguousarray(lists.flatten().field(j).to_numpy()) for j in (0, 1))
            many = np.diff(np.concatenate([[0], np.cumsum(np.where(place < N, n, 0))])[cuts])
            cuts = cuts.tolist()
            p, m, wp, wn = place.tobytes(), n.tobytes(), place.itemsize, n.itemsize
            keys = [p[x * wp : y * wp] + m[x * wn : y * wn] for x, y in zip(cuts, cuts[1:], strict=False)]
            if len(known) > 500_000:
                known.clear()
            new = {k: i for i, k in enumerate(keys) if k not in known}
            at = list(new.values())
            for some in (at[i : i + 256] for i in range(0, len(at), 256)):
                table = np.zeros((len(some), WIDTH))
                for row, i in enumerate(some):
                    table[row, place[cuts[i] : cuts[i + 1]]] = n[cuts[i] : cuts[i + 1]]
                for i, best in zip(some, _best(shared.value, table).tolist(), strict=True):
                    known[keys[i]] = best
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known[k] for k in keys], pa.int32()), pa.array(many, pa.int64()), batch.column(2), batch.column(3)], names=["word", "class", "n", "block", "at"])

    C.small_batches(near.sparkSession, 4096)
    return C.cut(near.mapInArrow(run, "word binary, class int, n long, block array<bigint>, at array<int>"))


def exchange(classes: np.ndarray, big: np.ndarray, near: np.ndarray, turn: int = 0, turns: int = 1) -> np.ndarray:
    """One round: each word whose turn it is leaves its class for the one where the likelihood of the class bigrams is greatest.

    Counts beside classes are those of the pass; class bigrams follow every move, and what a move takes away it adds again.
    """
    classes, big = classes.copy(), big.astype(float)
    for w in range(1, len(near)):
        a, own = classes[w], float(near[w, -1])
        if w % turns != turn or not near[w, :N].any():
            continue
        left, right = near[w, :N].astype(float), near[w, N:-1].astype(float)
        left[a] -= own
        right[a] -= own
        b = int(gains(big, left[None], right[None], np.array([own]), a)[0].argmax())
        for x, sign in ((a, -1), (b, 1)):
            big[:, x] += sign * left
            big[x] += sign * right
            big[x, x] += sign * own
        classes[w] = b
    return classes


@dataclass
class Model:
    vocab: Vocabulary
    classes: np.ndarray  # of each id; then of words that aren't learnt, and of ids that stand for a class
    transition: np.ndarray  # log10 of a class after a class
    divisor: np.ndarray  # log10 of what a class divides a word's count + ADD by
    rises: list[float]  # likelihood() of the classes at first, after each pass, and with all words


def seeds(encoded: DataFrame, vocab: Vocabulary, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, DataFrame, list[float]]:
    """Classes of the frequent words that move on the driver, all others in REST; their class bigrams, the counts of the other frequent words, and the likelihoods on the way."""
    k, size = vocab.clustered, len(vocab.counts)
    classes = np.concatenate([[FINAL], np.arange(k - 1) % CLASSES, np.full(size - k + 1, REST), np.arange(CLASSES)])
    best, rises = None, []
    for turn in range(passes + 1):
        first, last = (0, k) if turn < passes else (k, size)
        big, blocks = class_counts(encoded, classes, first, last)
        rises.append(likelihood(big))
        if best is not None and rises[-1] <= best[0]:
            big, blocks = class_counts(encoded, best[1], first, last)
            best = (best[0], best[1], big, blocks)
        else:
            best = (rises[-1], classes, big, blocks)
        if turn < passes:
            classes = best[1].copy()
            classes[:k] = exchange(best[1][:k], best[2], _collected(best[3], k), turn % 2, 2)
    return best[1], best[2], best[3], rises


def train(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, passes: int = PASSES) -> tuple[Model, DataFrame]:
    """Classes and their probabilities from the rows of encoded that are not held out; and encoded with the classes (as ids behind the frequent words') and counts of rare words.

    counts, of all words, are not read: a rare word's count comes with its counts beside classes.
    """
    size = len(vocab.counts)
    classes, big, blocks, rises = seeds(encoded, vocab, passes)

    def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"key": df["key"], "classes": [_best(big, np.frombuffer(x, "<i8").reshape(-1, WIDTH)).astype(int).tolist() for x in df["data"]]})

    final = classes.copy()
    for r in blocks.mapInPandas(settled, "key int, classes array<int>").collect():  # HEAD numbers at most
        final[r["key"] : r["key"] + len(r["classes"])] = r["classes"]
    rare = assigned(rare_counts(encoded, classes), big)
    learnt = _with_rare(encoded, rare, size)
    big, _ = class_counts(learnt, final)
    rises.append(likelihood(big))
    tokens = big.sum(0).astype(float)
    share = (tokens + ADD) / (tokens.sum() + ADD * N)
    once = (vocab.once + ADD) / (vocab.total + 2 * ADD)  # what words seen once say of those never seen
    step = (big + PULL * share) / (big.sum(1, keepdims=True) + PULL)
    step[:, REST] = 0
    step = step / step.sum(1, keepdims=True) * (1 - once)
    step[:, REST] = once
    words = np.bincount(final[1:size], minlength=N).astype(float)
    for r in rare.groupBy("class").agg(F.count("*").alias("n")).collect():  # a row for each class
        words[r["class"]] += r["n"]
    words[FINAL] = words[REST] = 1
    tokens[REST] = 0
    return Model(vocab, final, np.log10(step), np.log10(np.maximum(tokens + ADD * words, ADD)), rises), learnt


def _with_rare(encoded: DataFrame, rare: DataFrame, size: int) -> DataFrame:
    """Written once: __ids, sizes, held_out, ids, n (counts of the block's rare tokens in order): a rare word's id is size + 1 + its class; what was never learnt keeps size and has n 0."""
    names = ["__block", "at", "class", "n"]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task knows of a block, in one row."""
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            block, at, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(block, kind="stable")
            block, times = np.unique(block, return_counts=True)
            cuts = pa.array(np.concatenate([[0], np.cumsum(times)]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(block), *(pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (at, c, n))], names=names)

        for batch in batches:
            times = np.diff(batch.column(2).offsets.to_numpy())
            held.append((batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), times), np.repeat(batch.column(1).to_numpy(), times)))
            size += len(held[-1][0])
            if size >= RETURNED:
                yield rows()
                held.clear()
                size = 0
        if held:
            yield rows()

    def settle(blocks: pa.Table, found: pa.Table) -> pa.Table:
        ids, n = [], []
        at, c, many = (found.column(k).combine_chunks().flatten().to_numpy() for k in names[1:])
        for raw, words, which in zip(blocks.column("ids"), blocks.column("listed").to_pylist(), blocks.column("which"), strict=True):  # one
            of, count = np.full(words, size, np.int32), np.zeros(words, np.int64)
            of[at], count[at] = size + 1 + c, many
            x, which = np.frombuffer(raw.as_buffer(), "<i4").copy(), which.values.to_numpy()
            x[x == size] = of[which]
            ids.append(x.tobytes())
            n.append(count[which])
        return pa.table([*(blocks.column(k) for k in ("__ids", "sizes", "held_out")), pa.array(ids, pa.binary()), pa.array(n, pa.list_(pa.int64()))], ["__ids", "sizes", "held_out", "ids", "n"])

    C.small_batches(encoded.sparkSession, 4096)
    found = rare.select("class", "n", "block", "at").mapInArrow(back, "__block long, at array<int>, class array<int>, n array<bigint>")
    blocks = encoded.select("__block", "__ids", "sizes", "held_out", "ids", F.size("rare").alias("listed"), "which")
    kind = encoded.schema["__ids"].dataType.simpleString()
    return C.cut(blocks.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(settle, f"__ids {kind}, sizes array<int>, held_out boolean, ids binary, n array<bigint>"))


def score(learnt: DataFrame, model: Model) -> DataFrame:
    """One row for each document of learnt: __id, held_out, n_tokens, n_known, base_score, score."""
    spark, kind, size = learnt.sparkSession, learnt.schema["__ids"].dataType.elementType.simpleString(), len(model.vocab.counts)
    counts = np.concatenate([model.vocab.counts, np.zeros(1 + CLASSES, np.int64)])
    divisor = float(np.log10(model.vocab.total + ADD * (model.vocab.distinct + 1)))
    shared = spark.sparkContext.broadcast((model.classes, model.transition, model.divisor, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, transition, below, counts = shared.value
        for batch in batches:
            ids, sizes = _flat(batch.column(3)), batch.column(1).flatten().to_numpy().astype(np.int64)
            out = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), np.diff(batch.column(1).offsets.to_numpy()))
            starts = np.cumsum(sizes) - sizes
            c, n = classes[ids], counts[ids]
            n[ids >= size] = batch.column(4).flatten().to_numpy()
            before = np.concatenate([[classes[0]], c[:-1]])  # each row ends with END
            word = np.log10(n + ADD)
            sums = [np.add.reduceat(x, starts) if len(sizes) else x for x in ((n > 0).astype(np.int64), word - divisor, word + transition[before, c] - below[c])]
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(out, pa.bool_()), pa.array(sizes), *map(pa.array, sums)], names=["__id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    C.small_batches(spark, 1)
    return learnt.select("__ids", "sizes", "held_out", "ids", "n").mapInArrow(run, f"__id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, passes: int = PASSES) -> DataFrame:
    """One row for each row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows where held_out (default: crc32 of the id as text is a multiple of 10) is true are not
    learnt from. Tokens are words at white space with A-Z lower-cased, then one end; a null or
    empty text is the end alone. base_score is of smoothed word frequencies, score of the class model,
    both log10 probabilities of the text; perplexity is 10^(-score / n_tokens). Repeated rows and null ids
    count and are scored as they come; without training rows all words are unseen. A word that is never learnt is one of
    a class of its own, as likely anywhere as words that occur once are in all.
    """
    out = C.bucket_of(F.col(id_col), 10) == 0 if held_out is None else held_out
    counts = count_words(docs.where(~out), text_col)
    vocab = vocabulary(counts)
    encoded = encode(docs, vocab, id_col=id_col, text_col=text_col, held_out=out)
    model, learnt = train(encoded, counts, vocab, passes)
    found = score(learnt, model)
    return found.select(F.col("__id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.read(spark, sf_dir, "documents"))
