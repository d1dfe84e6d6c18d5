"""Sequence packing by minimum bin slack.

Documents are cut into full windows and one remainder. Remainders are counted by length (at most
window - 1 lengths, whatever the input), and the counts are all the planner sees: a bitset
subset-sum over the remaining lengths picks the multiset that comes closest to the capacity,
backtracking gives how many of each length it takes, and the choice is repeated as often as the counts
allow. A choice that leaves slack is filled by cutting the next remainder, whose rest
goes back to the counts. Tasks then look up each remainder's place from its length and its rank
among those of that length; ranks come from counts for each task, so no length meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import vocab

WINDOW = 2048


@dataclass
class Step:
    """times windows from number first on, each with used[i] = (length, count) whole remainders, and cut (length, part) of one more."""

    times: int
    used: list[tuple[int, int]]
    cut: tuple[int, int] | None = None


@dataclass
class Plan:
    """Where the r-th remainder of each length goes: segments by length, sorted by their first rank."""

    #: length: [(first rank, end rank, first window, each window's count, offset of the first, part or 0, first rank of the rest)]
    places: dict[int, list[tuple[int, int, int, int, int, int, int]]] = field(default_factory=dict)
    windows: int = 0

    def lookup(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """The pieces of a remainder: (start in it, length, window, offset)."""
        out, start = [], 0
        while True:
            rows = self.places[length]
            i = int(np.searchsorted([r[0] for r in rows], rank, side="right")) - 1
            first, _, window, each, offset, part, rest = rows[i]
            at = rank - first
            if not part:
                return [*out, (start, length, window + at // each, offset + at % each * length)]
            out.append((start, part, window + at, offset))
            start, length, rank = start + part, length - part, rest + at


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Of all multisets within counts, one whose sum comes closest to capacity from below: (length, count)."""
    limit, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, bundle = min(counts[length], capacity // length), 1
        while left:  # 1, 2, 4, ... of a length at once
            take = min(bundle, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & limit
            left, bundle = left - take, bundle * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def make_plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Places for counts[length] remainders of each length, windows numbered from 0."""
    left = {n: c for n, c in counts.items() if c}
    taken: dict[int, int] = dict.fromkeys(left, 0)  # ranks given out
    made: dict[int, int] = dict(left)  # ranks there are, with the rests of cut ones
    plan = Plan()

    def give(length: int, n: int, first_window: int, each: int, offset: int, part: int = 0, rest: int = 0) -> None:
        plan.places.setdefault(length, []).append((taken[length], taken[length] + n, first_window, each, offset, part, rest))
        taken[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        anchor = max(left)
        left[anchor] -= 1
        used = dict(best_fill(left, window - anchor))
        left[anchor] += 1
        used[anchor] = used.get(anchor, 0) + 1
        slack = window - sum(n * c for n, c in used.items())
        spare = {n: c - used.get(n, 0) for n, c in left.items() if n > slack and c > used.get(n, 0)}
        cut = max(spare) if slack and spare else 0
        need = {n: c + (n == cut) for n, c in used.items()} | ({cut: 1} if cut and cut not in used else {})
        times = min(left[n] // c for n, c in need.items())
        offset, first = 0, plan.windows
        for n, c in sorted(used.items(), reverse=True):
            give(n, c * times, first, c, offset)
            offset += n * c
        if cut:
            rest = cut - slack
            give(cut, times, first, 1, offset, slack, made.get(rest, 0))
            made[rest] = made.get(rest, 0) + times
            left[rest] = left.get(rest, 0) + times
            taken.setdefault(rest, 0)
        plan.windows += times
    return plan


#: Cut pieces up to which they are sent to the tasks that hold the ids; beyond, both sides meet by key.
BROADCAST_CUTS = 100_000

ENCODED = "__part int, __row long, __id {}, __n long, __rest int, __rank long, __full long, __crc array<bigint>, __ids binary"


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Written once: each document's ids (little-endian uint32 packed as uint16 where they fit) by writing task and row.

    Also its remainder's length and rank in the task, the number of its first full window in the task,
    and the CRC-32 of each full window and of the remainder.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = vocab.encoder(vocabulary), TaskContext.get().partitionId()
        end, seen, full, row = np.array([end_id], enc.kind), [0] * window, 0, 0
        for batch in batches:
            rows = []
            for ids in enc.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.concatenate([ids, end])
                wide, n, rest = ids.astype("<u4"), len(ids), len(ids) % window
                rows.append((row, n, rest, seen[rest], full, [zlib.crc32(wide[a : a + window].tobytes()) for a in range(0, n, window)], ids.astype(ids.dtype.newbyteorder("<")).tobytes()))
                seen[rest] += 1
                full, row = full + n // window, row + 1
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), made[0], batch.column(0), *made[1:]], names=["__part", "__row", "__id", "__n", "__rest", "__rank", "__full", "__crc", "__ids"])

    C.small_batches(docs.sparkSession, 256)
    return C.cut(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, ENCODED.format(kind)))


def pack(rows: DataFrame, *, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, broadcast_cuts: int = BROADCAST_CUTS) -> DataFrame:
    """One row for each piece of the documents of encode(): __part, __row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Full windows come first (sequence_id from 0), packed remainders after them. All sequences
    but at most one are full. A null text is empty and still has its end id; repeated rows and
    null ids are packed like any other; an empty table gives no piece.
    """
    spark, kind = rows.sparkSession, rows.schema["__id"].dataType.simpleString()
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    by_part = rows.groupBy("__part", "__rest").agg(F.count("*").alias("n"))
    ranks = by_part.select("__part", "__rest", F.coalesce(F.sum("n").over(earlier.partitionBy("__rest")), F.lit(0)).alias("__before"))
    fulls = rows.groupBy("__part").agg(F.sum(F.floor(F.col("__n") / window)).alias("n"))
    firsts = fulls.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"))
    counts = {r["__rest"]: r["n"] for r in by_part.groupBy("__rest").agg(F.sum("n").alias("n")).collect()}  # a row for each length below window
    counts.pop(0, None)
    n_full = fulls.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    plan = make_plan(counts, window)
    shared = spark.sparkContext.broadcast(plan)
    names = ["__part", "__row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                n, rest = r["__n"], r["__rest"]
                pieces = [(k * window, window, r["__crc"][k], r["__first"] + r["__full"] + k, 0) for k in range(n // window)]
                if rest:
                    got = shared.value.lookup(rest, r["__before"] + r["__rank"])
                    pieces += [(n - rest + a, m, r["__crc"][-1] if m == rest else None, n_full + w, o) for a, m, w, o in got]
                out += [(r["__part"], r["__row"], r["__id"], a, m, crc, n, w, o) for a, m, crc, w, o in pieces]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [pa.int32(), pa.int64(), batch.schema.field("__id").type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    C.small_batches(spark, 2048)
    placed = rows.drop("__ids").join(ranks, ["__part", "__rest"]).join(firsts, "__part")
    pieces = placed.mapInArrow(run, f"__part int, __row long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    n_cut = sum(end - first for segments in plan.places.values() for first, end, _, _, _, part, _ in segments if part)
    if not n_cut:
        return pieces
    pieces = C.cut(pieces)
    cut = pieces.where("ids_crc32 IS NULL").drop("ids_crc32")
    ids = rows.select("__part", "__row", "__ids")
    found = ids.join(F.broadcast(cut), ["__part", "__row"]) if n_cut <= broadcast_cuts else ids.join(cut, ["__part", "__row"])
    return pieces.where("ids_crc32 IS NOT NULL").unionByName(_crc(found, vocabulary).select(*names))


def _crc(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """pieces with ids_crc32 in place of __ids."""
    kind = np.dtype(vocab.encoder(vocabulary).kind).newbyteorder("<")

    @F.pandas_udf("long")
    def crc(ids: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(b, kind)[a : a + n].astype("<u4").tobytes()) for b, a, n in zip(ids, start, length, strict=True)], dtype="int64")

    return pieces.withColumn("ids_crc32", crc("__ids", "start", "length")).drop("__ids")


def sequences(rows: DataFrame, pieces: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row for each sequence: sequence_id, ids (the pieces' ids side by side, unpadded)."""
    kind = np.dtype(vocab.encoder(vocabulary).kind).newbyteorder("<")

    @F.pandas_udf("array<int>")
    def piece(ids: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, kind)[a : a + n].astype(np.int32) for b, a, n in zip(ids, start, length, strict=True)])

    placed = pieces.join(rows.select("__part", "__row", "__ids"), ["__part", "__row"]).withColumn("ids", piece("__ids", "start", "length"))
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # a window's ids at most
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(encode(C.read(spark, sf_dir, "documents"))).drop("__part", "__row")
