"""Near-duplicate classes by order MinHash, verified by banded alignment.

A sketch takes the few least-hashed 5-word shingles of a text (each labelled with its
occurrence) in the order in which they stand, so it follows edit similarity rather than mere overlap.
Texts that agree in a sketch share a bucket. First each member of a bucket is held against one member
drawn at random, which connects most of what is similar. Similarity isn't transitive, so buckets that still hold
several components are gone through once more, by prefixes: of two texts of similarity 0.8 each has one of the other's
rarest fifth of shingles among its own rarest fifth, so members that share but frequent passages don't meet. Who shares a rare
shingle meets a drawn one again, and where that leaves several components all who share it: pairs
go on only if signatures of one bit for each of 2,048 MinHash functions differ in few enough places for their similarity.
A match is always verified by alignment: the longest chain of common shingles in order, within the band that the
similarity allows. Components are found three times, however many texts there are: of the first links, then of what the
others connect among these.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import graph

WORDS, SIMILARITY = 5, 0.8
#: Sketches of each text and shingles in each; texts of under SHORT shingles have SHORT_SKETCHES more of SHORT_SIZE.
SKETCHES, SIZE = 36, 8
SHORT, SHORT_SKETCHES, SHORT_SIZE = 24, 24, 4
#: Bits of a signature, and standard deviations by which a pair at the least similarity may differ more than expected (lost: one in thirty thousand).
BITS, SLACK = 2048, 4.0
#: Rows of a group that meet in one task; larger groups are dealt over several.
BUCKET_ROWS = 1024
#: Slots in which shingles are counted to tell rare from frequent ones; any order of them gives the same links.
SLOTS = 1 << 18
#: First groups that a row carries, by which pairs that share several are made once; others are made more often and put together after.
FIRST = 64
#: Pairs up to which the texts they need are picked out by a broadcast list of nodes.
BROADCAST_PAIRS = 50_000
#: Shingled texts that a verifying task remembers, of so many shingles at most.
KNOWN_TEXTS, KNOWN_SIZE = 2_000, 2_000

_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 4097, dtype=np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles in order, each labelled with its occurrence; of all words if there are fewer."""
    w = words.astype(np.uint64, copy=False)
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(w))):
        s = _mix(s + w[j : j + n] + np.uint64(j))
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return s
    at = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(occurrence > 0, _mix(s + occurrence * _K1), s)


def _sketch(s: np.ndarray, first: int, count: int, size: int) -> list[np.ndarray]:
    out, step = [], max(1, 2_000_000 // len(s))
    for a in range(first, first + count, step):
        seeds = _SEEDS[a : min(a + step, first + count)]
        x = (s[None, :] ^ seeds[:, None]) * _K2
        x ^= x >> np.uint64(32)
        at = np.argpartition(x, size - 1, axis=1)[:, :size] if size < len(s) else np.broadcast_to(np.arange(len(s)), x.shape).copy()
        at.sort(axis=1)
        key = seeds.copy()
        for j in range(at.shape[1]):
            key = _mix(key + s[at[:, j]] * _K1)
        out.append(key)
    return out


def sketches(s: np.ndarray) -> np.ndarray:
    """The order MinHash keys of a text's shingles."""
    if not len(s):
        return np.zeros(0, np.int64)
    out = _sketch(s, 0, SKETCHES, SIZE)
    if len(s) < SHORT:
        out += _sketch(s, SKETCHES, SHORT_SKETCHES, SHORT_SIZE)
    return np.concatenate(out).view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """c / (len(a) + len(b) - c): c shingles common to both, in order, within the band; 0 if under least for sure."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = len(a) + len(b)
    need = least / (1 + least) * both
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = both - 2 * need + 1e-9  # insertions and deletions that still leave enough in common
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    if len(ia) < need - 1e-9:
        return 0.0
    chain = ia[np.argsort(ib)]
    if (np.diff(chain) > 0).all():
        c = len(chain)
    else:
        tails: list[int] = []
        for x in chain.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        c = len(tails)
    return c / (both - c)


def _word_hashes(text: Column) -> Column:
    return F.transform(C.split_words(C.ascii_lower(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b].view(np.uint64) for a, b in zip(at, at[1:], strict=False)]


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct text: node, rep (its least id), keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketches(shingles(w)) for w in _lists(batch.column(2))]
            made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["node", "rep", "keys"])

    C.small_batches(docs.sparkSession, 256)
    rows = docs.select(_node(F.col(text_col)).alias("node"), F.col(id_col).alias("rep"), _word_hashes(F.col(text_col)).alias("w"))
    return C.cut(rows.mapInArrow(run, f"node binary, rep {kind}, keys array<bigint>").groupBy("node").agg(F.min("rep").alias("rep"), F.first("keys").alias("keys")))


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar, written once."""
    # _close() deals large groups out itself; where both sides of a join are one group, Spark would split it into as many tasks as its parts have pairs
    spark, key = pairs.sparkSession, "spark.sql.adaptive.skewJoin.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        pairs = C.cut(pairs)
    finally:
        spark.conf.set(key, before)
    if pairs.count() <= BROADCAST_PAIRS:  # of checked size
        texts = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # a text takes part in several pairs that follow each other

        def made(node: bytes, words: np.ndarray) -> np.ndarray:
            s = known.get(node)
            if s is None:
                if len(known) >= KNOWN_TEXTS:
                    known.clear()
                s = shingles(words)
                if len(s) <= KNOWN_SIZE:
                    known[node] = s
            return s

        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            same = [aligned_similarity(made(i, x), made(j, y), similarity) >= similarity for i, j, x, y in zip(a, b, _lists(batch.column(2)), _lists(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", _word_hashes(F.col("ta")).alias("wa"), _word_hashes(F.col("tb")).alias("wb"))
    return C.cut(both.mapInArrow(run, "a binary, b binary"))


def signature(s: np.ndarray) -> np.ndarray:
    """One bit for each of BITS MinHash functions of a text's shingles, as BITS / 64 int64."""
    bits, step, low = np.empty(BITS, np.uint8), max(1, 4_000_000 // max(1, len(s))), (s ^ (s >> np.uint64(32))).astype(np.uint32)
    seeds = _SEEDS[1024 : 1024 + BITS].astype(np.uint32)[:, None]
    for a in range(0, BITS, step):
        least = ((low ^ seeds[a : a + step]) * np.uint32(0x85EBCA6B)).min(axis=1)
        bits[a : a + step] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits).view("<i8")


def most_bits(similarity: float) -> int:
    """Bits in which the signatures of two texts of that similarity may differ."""
    p = (1 - similarity) / 2
    return int(BITS * p + SLACK * (BITS * p * (1 - p)) ** 0.5)


def similar_roots(docs: DataFrame, nodes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of every node that has a similar one: the same root for what verified links connect."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    drawn = F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))["node"]
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), drawn.alias("a")).where("n > 1")
    members = C.cut(keyed.join(shared, "key"))
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = docs.select(_node(F.col(text_col)).alias("node"), F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, (texts["node"] == wanted["node"]) & texts["__id"].eqNullSafe(wanted["rep"])).select(texts["node"], "text")
    texts = C.cut(texts.dropDuplicates(["node"]))
    roots = C.cut(graph.components(_verify(members.where("a <> node").select("a", F.col("node").alias("b")).distinct(), texts, similarity)))
    mixed = _unsettled(members, roots)
    groups = _rare_groups(mixed, C.cut(_by_words(mixed.select("node"), texts)), similarity)
    signed = _signed(groups.select("node").distinct(), texts)
    roots = _joined(roots, _verify(_led(groups, signed, similarity), texts, similarity))
    return _joined(roots, _verify(_close(_still_apart(groups, roots), signed, similarity), texts, similarity))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b): components are found among the roots that these connect."""
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
    among = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = graph.components(among).toDF("root", "top")
    known = roots.unionAll(among.select(F.explode(F.array("a", "b")).alias("node")).withColumn("root", F.col("node"))).distinct()
    return C.cut(known.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of all members of the buckets that have two components or more, connected ones too."""
    own = members.select("key", "node").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return C.cut(own.join(mixed, "key").select("node", "root").distinct())


def _by_words(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node and w, its hashed words, of those nodes."""
    return texts.join(nodes, "node", "left_semi").select("node", _word_hashes(F.col("text")).alias("w"))


def _frequencies(words: DataFrame) -> np.ndarray:
    """How many shingles of all words fall into each of SLOTS slots, frequent and rare ones apart however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for w in _lists(batch.column(1)):
                total += np.bincount((shingles(w) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["slot", "n"])

    found = words.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def prefix(s: np.ndarray, similarity: float, frequency: np.ndarray) -> np.ndarray:
    """The rarest shingles of a text, of which any text of that similarity has at least one among its own rarest."""
    n = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
    return s[np.lexsort((s, frequency[(s % np.uint64(len(frequency))).astype(np.int64)]))[:n]]


def _rare_groups(mixed: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, root, n): nodes that share one of their rarest shingles, n of them, in two components or more.

    Shingles that the same nodes share stand for each other, so one of them is kept.
    """
    frequency = mixed.sparkSession.sparkContext.broadcast(_frequencies(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [prefix(shingles(w), similarity, frequency.value).view(np.int64) for w in _lists(batch.column(1))]
            rows = np.repeat(np.arange(len(made)), [len(m) for m in made])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.int64), *made]))], names=["node", "shingle"])

    rare = C.cut(words.mapInArrow(run, "node binary, shingle bigint").join(mixed, "node"))
    who = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"who{k}") for k in (0, 1)]
    groups = rare.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *who).where("low <> high")
    one = groups.groupBy("n", "who0", "who1").agg(F.min("shingle").alias("shingle")).select("shingle", "n")
    return C.cut(rare.join(one, "shingle"))


_BITS = [f"s{k}" for k in range(BITS // 64)]


def _signed(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, size (its shingles) and signature of those nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(w) for w in _lists(batch.column(1))]
            bits = np.array([signature(s) for s in made], np.int64).reshape(len(made), -1)
            columns = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(bits.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in made], pa.int32()), *columns], names=["node", "size", *_BITS])

    return C.cut(_by_words(nodes, texts).mapInArrow(run, "node binary, size int, " + ", ".join(f"{s} bigint" for s in _BITS)))


def _may_be_similar(similarity: float) -> Column:
    """Sizes and signatures of x and y allow the similarity."""
    differ = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in _BITS[1:]), F.bit_count(F.col(f"x.{_BITS[0]}").bitwiseXOR(F.col(f"y.{_BITS[0]}"))))
    return (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size")) & (differ <= most_bits(similarity))


def _led(groups: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of a drawn member of each group and one of another component: no more than groups has rows."""
    drawn = groups.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("shingle", "node").alias("h"), "node", "root")).alias("d"))
    pairs = groups.join(drawn, "shingle").where("root <> d.root").select(F.least("node", "d.node").alias("a"), F.greatest("node", "d.node").alias("b")).distinct()
    x, y = signed.alias("x"), signed.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_may_be_similar(similarity)).select("a", "b")


def _still_apart(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of groups that still hold two components, by their roots now."""
    now = groups.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = now.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    return C.cut(now.join(apart, "shingle"))


def _close(groups: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of different components in one group whose sizes and signatures allow the similarity; each pair once.

    No pairs are made of what the signatures rule out: they are a condition of the join. A pair that shares several groups is made
    in the first of these, as far as the FIRST first groups that each row carries show. A large group is dealt
    over tasks: each row goes to one place in a row and a column of blocks.
    """
    own = groups.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("shingle")), 1, FIRST).alias("first"))
    rows = groups.join(own, "node").join(signed, "node").withColumn("blocks", F.ceil(F.col("n") / BUCKET_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x, y = rows.withColumns({"r": F.col("block"), "c": every}).alias("x"), rows.withColumns({"r": every, "c": F.col("block")}).alias("y")
    again = F.array_min(F.array_intersect("x.first", "y.first")) < F.col("x.shingle")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node"))
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "r", "c")] + [apart & _may_be_similar(similarity) & ~F.coalesce(again, F.lit(False))])
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """One row for each distinct text: node, root (of its class), class_id (the class's least id), chosen (the text of that id)."""
    if similarity < SIMILARITY:
        raise ValueError(f"similarity: {SIMILARITY} or more, as the sketches and bands are made for")
    nodes = _nodes(docs, id_col, text_col)
    roots = C.cut(similar_roots(docs, nodes, id_col=id_col, text_col=text_col, similarity=similarity))
    rooted = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("best"))
    return C.cut(rooted.join(best, "root").select("node", "root", F.col("best.rep").alias("class_id"), F.col("best.node").alias("chosen")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: id_col, class_id, class_docs, kept.

    Two texts are linked if their occurrence-labelled 5-word shingles (words at white space, A-Z
    lower-cased; all words of a shorter text make one shingle) agree in order to similarity;
    classes are what links connect. class_id is the least id of the class, class_docs its rows;
    kept marks the document of that id (rows that repeat id and text are one document). Equal
    texts are always one class: all null and empty texts are one. Null ids come last: a class of
    null ids only has a null class_id. An empty table gives an empty result.
    """
    classes = _classes(docs, id_col, text_col, similarity)
    rows = docs.select(F.col(id_col), _node(F.col(text_col)).alias("node"))
    copies = rows.groupBy("node").agg(F.count("*").alias("n"))
    sizes = copies.join(classes.select("node", "root"), "node").groupBy("root").agg(F.sum("n").alias("class_docs"))
    known = classes.join(sizes, "root")
    kept = (F.col("node") == F.col("chosen")) & F.col(id_col).eqNullSafe(F.col("class_id"))
    return rows.join(known, "node").select(id_col, "class_id", "class_docs", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps: one document of each class.

    Rows that repeat the chosen id and text all stay, as they are one document. Of null and empty texts, one class,
    the least id stays; a class of null ids only keeps its chosen text. An empty table gives an empty table.
    """
    classes = _classes(docs, id_col, text_col, similarity)
    own, node, least = C.unused(docs, 3)
    chosen = classes.where(F.col("node") == F.col("chosen")).select(F.col("node").alias(node), F.col("class_id").alias(least))
    keyed = docs.select("*", _node(F.col(text_col)).alias(own))
    return keyed.join(chosen, (F.col(own) == F.col(node)) & F.col(id_col).eqNullSafe(F.col(least)), "left_semi").select(*docs.columns)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"))
