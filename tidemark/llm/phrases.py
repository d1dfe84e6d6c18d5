"""Phrase collocations by direct-address tiling.

Texts become blocks of word ids: each block first codes its words by a dictionary of its own, counts of words meet by language
and word, and the frequent ones get ids by falling frequency, so the pairs of common words fall into a few tiles of the
(first id, second id) plane. A block counts a crowded tile with one dense ``numpy.bincount`` over the tile's cells and all other pairs as
sorted coordinates. Counts of a task are merged and dealt out by slices of tiles, so that no word, however common, and no
language meets in one task. Frequent pairs are ranked by frequency in their turn, and a phrase of k + 1 words is a pair of a
frequent phrase of k words and the word after it: the same tiles, one level up. A part of a frequent phrase is at
least as frequent, so nothing is lost on the way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common as C

#: Tokens of a block, and of all open blocks of a task; bytes of a text that are split at once.
BLOCK, OPEN, PART = 1 << 19, 1 << 22, 1 << 18
#: A tile has 2**BITS ids on each side. It is counted densely from so many pairs of a block on (a fixed share of its cells).
BITS = 9
DENSE = (1 << 2 * BITS) // 16
#: Blocks that a worker gets at once (a few MB each).
ROWS = 4
#: Distinct pairs that a task holds before it sends them on, and tokens of the corpus for each slice that they are dealt out to.
HELD, SLICE = 1 << 20, 1 << 20
#: Frequent phrases of one length up to which all their ids go to every worker (12 bytes each); beyond that each block fetches those it has by a join.
SENT = 1_000_000

_LOW = 0xFFFFFFFF
_BREAKS = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_BLOCKS = "lang string, block long, ids binary, words array<binary>, counts array<long>"
_LEVEL = "lang string, block long, w binary, c binary"


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, b"." between pieces; a long text in parts that end where a piece ends."""
    text, at = text.lower().translate(_BREAKS), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PART else text.find(b".", at + PART) + 1 or len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


class _Open:
    """A block that is being filled. Local id 0 is a break between pieces."""

    def __init__(self) -> None:
        self.ids, self.size = [], 0
        self.known = defaultdict(count(1).__next__, {b".": 0})

    def add(self, words: list[bytes]) -> None:
        self.ids += [np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.size += len(words) + 1


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def to_blocks(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Written once: lang, block, ids (int32 by the block's own dictionary), words and counts of the dictionary (from id 1)."""
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, number, size = {}, TaskContext.get().partitionId() << 32, 0

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number, size
            b = blocks.pop(lang)
            ids = np.concatenate(b.ids)
            number, size = number + 1, size - b.size
            return _row(schema, lang, number, ids.tobytes(), list(b.known)[1:], np.bincount(ids, minlength=len(b.known))[1:])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words in _parts(text):
                    b = blocks.setdefault(lang, _Open())
                    b.add(words)
                    size += len(words) + 1
                    if b.size >= BLOCK:
                        yield closed(lang)
                    elif size >= OPEN:
                        yield closed(max(blocks, key=lambda x: blocks[x].size))
        for lang in list(blocks):
            yield closed(lang)

    C.small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return C.cut(texts.toDF("lang", "text").mapInArrow(run, _BLOCKS))


def ranked(counts: DataFrame, *key: str) -> DataFrame:
    """counts (lang, key, n) with id, from 1 by falling n in each language (ties by key). A range sort: no task orders a language alone."""
    order = [F.col("lang"), F.col("n").desc(), *map(F.col, key)]
    placed = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = C.cut(placed)
    runs = placed.groupBy("lang", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))  # a row for each task, and more only as languages begin
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("lang", "part", (before - F.col("first") + 1).alias("shift"))
    return placed.join(F.broadcast(starts), ["lang", "part"]).select("lang", *key, "n", (F.col("at") + F.col("shift")).alias("id"))


def word_ids(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Written once: the blocks (lang, block, w, c) with w the ids (int32) of words (lang, word, id), 0 for breaks and all other words; runs of 0 are one. An empty c stands for w."""
    own = blocks.select("lang", "block", F.posexplode("words").alias("pos", "word")).withColumn("word", F.col("word").cast("string"))
    known = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("w", pa.binary()), ("c", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                lang, block, ids, size, known = (batch.column(k)[i] for k in range(5))
                table = np.zeros(size.as_py() + 1, np.int32)
                if known.is_valid:
                    pairs = known.values
                    table[pairs.field(0).to_numpy(zero_copy_only=False) + 1] = pairs.field(1).to_numpy(zero_copy_only=False)
                w = table[np.frombuffer(ids.as_py(), np.int32)]
                w = w[(w != 0) | np.concatenate([[True], w[:-1] != 0])]
                yield _row(schema, lang.as_py(), block.as_py(), w.tobytes(), b"")

    C.small_batches(blocks.sparkSession, ROWS)
    slim = blocks.select("lang", "block", "ids", F.size("words").alias("size"))
    return C.cut(slim.join(known, "block", "left").select("lang", "block", "ids", "size", "known").mapInArrow(run, _LEVEL))


def _pairs(w: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which phrases of k + 1 words start of which both parts of k words are frequent, and their keys: the first part's id, then the last word's."""
    at = np.flatnonzero((c[:-1] != 0) & (c[1:] != 0))
    at = at[at + k < len(w)]
    return at, (c[at].astype(np.int64) << 32) | w[at + k]


def _arrays(w: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(w, np.int32), np.frombuffer(c or w, np.int32)


def tile_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs: crowded tiles by bincount over their cells, all others as sorted coordinates."""
    first, last = keys >> 32, keys & _LOW
    head = (first < 16 << BITS) & (last < 16 << BITS)
    tile = np.where(head, (first >> BITS) * 16 + (last >> BITS), 256)
    crowded = np.bincount(tile, minlength=257) >= DENSE
    crowded[256] = False  # what lies outside the head
    found = []
    for t in np.flatnonzero(crowded):
        mine = tile == t
        cells = np.bincount(((first[mine] & (1 << BITS) - 1) << BITS) | (last[mine] & (1 << BITS) - 1), minlength=1 << 2 * BITS)
        full = np.flatnonzero(cells)
        found.append((((t // 16 << BITS) + (full >> BITS) << 32) | ((t % 16 << BITS) + (full & (1 << BITS) - 1)), cells[full]))
    rest = keys[~crowded[tile]]
    found.append((rest, np.ones(len(rest), np.int64)))
    return merged(*map(np.concatenate, zip(*found, strict=True)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where a pair is summed up: by its row and tile, so that the pairs of a common word are in many places."""
    mixed = (keys >> BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(slices)).astype(np.int64)


def _phrase_counts(level: DataFrame, k: int, least: int, slices: int) -> DataFrame:
    """(lang, key, n) of all phrases of k + 1 words that occur least times or more."""
    schema = pa.schema([("lang", pa.string()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    out = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = defaultdict(list), 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, runs in held.items():
                keys, counts = merged(*map(np.concatenate, zip(*runs, strict=True)))
                where = _slice_of(keys, slices)
                order = np.argsort(where, kind="stable")
                keys, counts, where = keys[order], counts[order], where[order]
                edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1), len(keys)]
                parts = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array([int(where[a]) for a, _ in parts], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in parts]), pa.array([counts[a:b].tobytes() for a, b in parts])], schema=schema)

        for batch in batches:
            for lang, w, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, keys = _pairs(*_arrays(w, c), k)
                if len(keys):
                    held[lang].append(tile_counts(keys))
                    total += len(held[lang][-1][0])
                if total >= HELD:
                    yield from sent()
                    held.clear()
                    total = 0
        yield from sent()

    def sum_slice(table: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(b"".join(table.column(x).to_pylist()), np.int64) for x in ("keys", "counts"))
        keys, counts = merged(keys, counts)
        keep = counts >= least
        return pa.table([pa.array([table.column("lang")[0].as_py()] * int(keep.sum()), pa.string()), pa.array(keys[keep]), pa.array(counts[keep])], schema=out)

    C.small_batches(level.sparkSession, ROWS)
    tasks = level.select("lang", "w", "c").mapInArrow(count_blocks, "lang string, slice long, keys binary, counts binary")
    return tasks.groupBy("lang", "slice").applyInArrow(sum_slice, "lang string, key long, n long")


def _next_level(level: DataFrame, found: DataFrame, k: int, sent: int) -> DataFrame:
    """Written once: the blocks with c the ids of found (lang, key, id), phrases of k + 1 words; what none of them covers is left out."""
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("w", pa.binary()), ("c", pa.binary())])

    def moved(of: Callable[[str, pa.Scalar | None], tuple[np.ndarray, np.ndarray]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    lang, block, w, c = (batch.column(x)[i].as_py() for x in range(4))
                    names, ids = of(lang, batch.column(4)[i] if batch.num_columns > 4 else None)
                    w, c = _arrays(w, c)
                    at, keys = _pairs(w, c, k)
                    place = np.minimum(np.searchsorted(names, keys), max(len(names) - 1, 0))
                    new = np.zeros(len(w), np.int32)
                    if len(names):
                        new[at] = np.where(names[place] == keys, ids[place], 0)
                    covered = np.zeros(len(w), bool)
                    for j in range(k + 1):
                        covered[j:] |= new[: len(w) - j] != 0
                    keep = covered | np.concatenate([[True], covered[:-1]])
                    yield _row(schema, lang, block, np.where(covered, w, 0)[keep].tobytes(), new[keep].tobytes())

        return run

    C.small_batches(level.sparkSession, ROWS)
    if found.count() <= sent:
        tables = {}
        for r in found.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("key", "id"))).alias("x")).toArrow().to_batches():  # sent rows at most
            for lang, x in zip(r.column(0).to_pylist(), r.column(1), strict=True):
                tables[lang] = tuple(x.values.field(j).to_numpy(zero_copy_only=False).copy() for j in (0, 1))
        shared, none = level.sparkSession.sparkContext.broadcast(tables), (np.zeros(0, np.int64),) * 2
        return C.cut(level.mapInArrow(moved(lambda lang, _: shared.value.get(lang, none)), _LEVEL))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, block, w, c in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
                keys = np.unique(_pairs(*_arrays(w, c), k)[1])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), block)), pa.array(keys, pa.int64())], names=["lang", "block", "key"])

    asked = level.mapInArrow(wanted, "lang string, block long, key long")
    own = asked.join(found.select("lang", "key", "id"), ["lang", "key"]).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "id"))).alias("own"))  # a block's own at most

    def fetched(_: str, x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x.values.field(j).to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64) for j in (0, 1))

    return C.cut(level.join(own, "block", "left").select("lang", "block", "w", "c", "own").mapInArrow(moved(fetched), _LEVEL))


def count_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, sent: int = SENT) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to longest words that occur least times or more in their language, and (lang, n): all its words."""
    blocks = to_blocks(docs, text_col=text_col, lang_col=lang_col)
    totals = C.cut(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")))
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    slices = max(tokens // SLICE, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").cast("string").alias("word")).agg(F.sum("x.counts").alias("n")).where(F.col("n") >= least)
    words = C.cut(ranked(words, "word"))
    level = word_ids(blocks, words)
    named = words.select("lang", "id", F.col("word").alias("phrase"))
    out = words.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), F.col("n").alias("f"))
    last = named.select("lang", F.col("id").alias("lo"), F.col("phrase").alias("word"))
    for k in range(1, longest):
        found = C.cut(ranked(_phrase_counts(level, k, least, slices), "key"))
        parts = found.select("lang", "id", "n", F.shiftright("key", 32).alias("hi"), F.col("key").bitwiseAND(F.lit(_LOW)).alias("lo"))
        named = C.cut(parts.join(named.withColumnRenamed("id", "hi"), ["lang", "hi"]).join(last, ["lang", "lo"]).select("lang", "id", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n"))
        out = out.unionAll(named.select("lang", F.lit(k + 1), "phrase", "n"))
        named = named.drop("n")
        if k + 1 < longest:
            level = _next_level(level, found, k, sent)
    return out, totals


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, sent: int = SENT) -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at ``.,;:!?`` and line ends into pieces, pieces at spaces and tabs into words, A-Z lower-cased. A candidate has 2 to longest words and occurs a times, least or more. Cut
    after its first words into parts that occur l and r times, it scores floor(2000000 * a / (l + r)); its lowest cut counts, the first of ties. A
    candidate that lies inside a longer one with at least four fifths of its occurrences is dropped. Ranks go by score, then a, both falling, then
    phrase. Null texts are empty, null languages ``und``; repeated rows all count; an empty table gives an empty result. Other columns of docs don't matter.
    """
    found, totals = count_phrases(docs, text_col=text_col, lang_col=lang_col, least=least, longest=longest, sent=sent)
    many = found.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = many.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.size("w") - F.col("k"))})
    counts = found.select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.withColumnsRenamed({"phrase": side, "f": name}), ["lang", side])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    inner = many.where(F.size("w") > 2).select("lang", F.col("a").alias("longer"), "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inner = inner.select("lang", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer").cast("decimal(20,0)") < 80 * F.col("a").cast("decimal(20,0)"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # a limit of its own in each task comes first
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.read(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{C.UPPER}', '{C.UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
           FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.lp JOIN counts r ON r.lang = c.lang AND r.phrase = c.rp
           QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.c) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM cand)) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
