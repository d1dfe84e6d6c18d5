"""Repair of conversation structure by a parallel Viterbi search with rank convergence.

The rows of all conversations are range-sorted by conversation and turn, so a conversation of any length lies in many tasks, and cut into
chunks of at most CHUNK rows. Each row is one of a few kinds (role initial; sound, truncated, or to be deleted). A vector holds, for each
state of the pattern ``(s?(ua)+)?``, the least cost from a row to the end. Chunks run backwards from a speculative vector, all at
once; where the next chunk begins with another vector than was assumed, a fix-up pass reruns a chunk until old and new vectors
differ only by a constant, as from there on nothing changes. Costs to the end then tell which edits are among the cheapest, and tracing
forward takes the least letter of these: each chunk traces from all four states, the states at chunk borders follow by
composition, and the chunk's edits are those of its state. Only summaries of chunks ever meet by conversation, but for
the digest of its repaired rows: SHA-256 has no parallel form, so they stream through it in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common as C

#: Rows of a chunk at most.
CHUNK = 8192
DROP, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a. Where s, u and a lead from each; which may end.
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ENDS = (0, 3)
#: Kinds of rows: initial "s", "u", "a" or "-" for any other, in capitals where truncated; "x" must be deleted.
_FIRST, _LAST = r"[^\x20\x09-\x0D]", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$"


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text of rows after damage by crc32 of "conv:turn" modulo 20 (nulls: one space): 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
    out = out.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return out.select("conv", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def placed(rows: DataFrame) -> DataFrame:
    """Written once: rows (conv, turn, role, text) with part and at, their place in the order of conversation and turn, null turns first; rows of one turn by role and text."""
    order = ["conv", "turn", "role", F.md5("text")]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # copies are alike, so any order of theirs does
    ranged = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    where = {"part": F.spark_partition_id().cast("long"), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    return C.cut(ranged.withColumns(where).withColumns({"said": F.sha2(F.to_json(F.array("role", "text")), 256), "initial": F.substring("role", 1, 1), "blank": ~F.col("text").rlike(_FIRST), "open": ~F.regexp_extract("text", _LAST, 1).isin(".", "!", "?")}))


def _place() -> Column:
    return F.struct("part", "at")


def chunks_of(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Written once: conv, part, chunk, first (its first row's at), kinds (a letter for each row), blank, duplicate, truncated, and illegal pairs of neighbours within, head and tail (initials), of rows that placed() gave."""
    slim = rows.select("conv", "part", "at", "said", "initial", "blank", "open")
    again = slim.groupBy("conv", "said").agg(F.min(_place()).alias("once"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c2"), F.col("said").alias("s2"), "once")
    seen = slim.join(again, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("said") == F.col("s2")), "left")
    twice = F.col("once").isNotNull() & (F.col("once") < _place()) & ~F.col("blank")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    marked = seen.select("conv", "part", "at", (F.col("at") / size).cast("long").alias("chunk"), initial.alias("i"), "blank", twice.alias("twice"), (F.col("open") & ~F.col("blank") & ~twice).alias("cut"))
    kind = F.when(F.col("blank") | F.col("twice"), "x").when(F.col("cut"), F.when(F.col("i") == "-", "+").otherwise(F.upper("i"))).otherwise(F.col("i"))
    ordered = F.array_sort(F.collect_list(F.struct("at", kind.alias("k"), "i")))  # size rows at most, a few bytes each
    count = lambda c: F.sum(F.col(c).cast("long"))
    sums = marked.groupBy("conv", "part", "chunk").agg(ordered.alias("r"), count("blank").alias("blank"), count("twice").alias("duplicate"), count("cut").alias("truncated"))
    initials = F.array_join(F.transform("r", lambda x: x["i"]), "")
    return C.cut(
        sums.select("conv", "part", "chunk", F.col("r")[0]["at"].alias("first"), F.array_join(F.transform("r", lambda x: x["k"]), "").alias("kinds"), initials.alias("i"), "blank", "duplicate", "truncated")
        .withColumn("illegal", (F.length("i") - 1 - F.regexp_count("i", F.lit("(?:s(?=u)|u(?=a)|a(?=u))"))).cast("long"))
        .select("*", F.left("i", F.lit(1)).alias("head"), F.right("i", F.lit(1)).alias("tail"))
        .drop("i")
    )


def _inserts(q: int) -> list[tuple[str, int, int]]:
    return [("I", INSERT, STEP[x][q]) for x in "ua" if STEP[x][q] is not None]


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Least costs where empty rows may be inserted before going on."""
    costs = list(costs)
    for _ in range(3):
        for q in range(4):
            costs[q] = min([costs[q], *(c + costs[t] for _, c, t in _inserts(q))])
    return tuple(costs)


def _edits(kind: str, q: int) -> list[tuple[str, int, int]]:
    """What may be done with a row in state q: letter, cost, next state."""
    out = [("D", DROP, q)]
    if kind != "x":
        initial, more = kind.lower(), TRUNCATED * (kind.isupper() or kind == "+")
        out += [("K", more, STEP[initial][q])] if initial in STEP and STEP[initial][q] is not None else []
        out += [("R", REROLE + more, STEP[x][q]) for x in "ua" if STEP[x][q] is not None]
    return out


_INFINITE = 10**9
#: The vector behind the last row: inserts alone.
END = _inserted([0 if q in ENDS else _INFINITE for q in range(4)])


@cache
def backward(kind: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector before a row from that behind it, less a constant, and that constant; vectors that differ by constants are few."""
    raw = _inserted([min(cost + after[t] for _, cost, t in _edits(kind, q)) for q in range(4)])
    return tuple(x - min(raw) for x in raw), min(raw)


def same_shape(v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(x - min(v) for x in v)


def start_vector(kinds: str, after: tuple[int, ...], assumed: tuple[int, ...] | None = None, begin: tuple[int, ...] | None = None) -> tuple[tuple[int, ...], int]:
    """The vector before a chunk, and the rows that were run; a rerun (what was assumed before, and what it gave) ends where old and new vectors are the same."""
    v, old = same_shape(after), same_shape(assumed) if assumed is not None else None
    for n, kind in enumerate(reversed(kinds)):
        if v == old:
            return begin, n
        v = backward(kind, v)[0]
        old = backward(kind, old)[0] if old is not None else None
    return (begin if v == old else v), len(kinds)


def trace(kinds: str, after: tuple[int, ...], state: int, last: bool) -> tuple[list[str], int, int]:
    """From state at the chunk's start the ASCII-least of its cheapest edits: those before and at each row and, where the conversation ends here, behind the last; their cost, and the state behind them."""
    vectors, gains = [same_shape(after)], []
    for kind in reversed(kinds):
        v, gain = backward(kind, vectors[-1])
        vectors.append(v)
        gains.append(gain)
    vectors.reverse()
    gains.reverse()
    rows, cost, q = [], 0, state
    for kind, here, then, gain in zip(kinds, vectors, vectors[1:], gains, strict=False):
        letters = ""
        while True:
            letter, c, t = min((e, c, t) for e, c, t in _edits(kind, q) + _inserts(q) if c + (here[t] + gain if e == "I" else then[t]) == here[q] + gain)
            letters, cost, q = letters + letter, cost + c, t
            if letter != "I":
                break
        rows.append(letters)
    rows.append("")
    while last and q not in ENDS:
        rows[-1], cost, q = rows[-1] + "I", cost + INSERT, _inserts(q)[0][2]
    return rows, cost, q


def end_vectors(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Written once: conv, part, chunk, after (the vector behind the chunk, less a constant), last (whether it ends its conversation); and the fix-up passes that were needed.

    A speculative vector is that of a conversation's end. Neighbours are found among conversations of several chunks only, a row for each chunk.
    """
    key = ["conv", "part", "chunk"]
    following = F.lead("chunk").over(Window.partitionBy("conv").orderBy("part", "chunk"))
    run = C.cut(_started(chunks.select(*key, "kinds", following.isNull().alias("last")).withColumns({"after": F.array(*map(F.lit, END)), "assumed": F.lit(None).cast("array<int>"), "begin": F.lit(None).cast("array<int>")})))
    passes = 0
    while True:
        many = run.where("NOT last").select(F.col("conv").alias("many")).distinct()
        linked = run.join(many, F.col("conv").eqNullSafe(F.col("many")), "left_semi").select(*key, F.lead("begin").over(Window.partitionBy("conv").orderBy("part", "chunk")).alias("next"))
        wrong = C.cut(run.alias("r").join(linked.alias("l"), F.col("r.conv").eqNullSafe(F.col("l.conv")) & (F.col("r.part") == F.col("l.part")) & (F.col("r.chunk") == F.col("l.chunk"))).where("l.next IS NOT NULL AND l.next <> r.after").select(*[F.col(f"r.{c}") for c in key], F.col("l.next").alias("next")))
        if wrong.isEmpty():
            return run.select(*key, "last", "after"), passes
        passes += 1
        w = wrong.select(F.col("conv").alias("c2"), F.col("part").alias("p2"), F.col("chunk").alias("k2"), "next")
        joined = run.join(w, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")) & (F.col("chunk") == F.col("k2")), "left")
        kept = joined.where("next IS NULL").select(*run.columns)
        again = joined.where("next IS NOT NULL").select(*key, "kinds", "last", F.col("next").alias("after"), F.col("after").alias("assumed"), "begin")
        run = C.cut(kept.unionByName(_started(again)))


def _started(chunks: DataFrame) -> DataFrame:
    """chunks (kinds, after, assumed, begin) with begin, the vector before each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            vector = lambda v: None if v is None else tuple(map(int, v))
            df["begin"] = [list(start_vector(k, vector(a), vector(b), vector(c))[0]) for k, a, b, c in zip(df["kinds"], df["after"], df["assumed"], df["begin"], strict=True)]
            df["after"] = [list(same_shape(vector(a))) for a in df["after"]]
            yield df

    return chunks.mapInPandas(run, chunks.schema)


def _entries(ways: DataFrame) -> DataFrame:
    """conv, part, chunk, state: the state at each chunk's start, from ways (the state behind it for each before it), composed in order. One row for a chunk is all that meets by conversation."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df, q, states = df.sort_values(["part", "chunk"]), 0, []
        for w in df["ways"]:
            states.append(q)
            q = int(w[q])
        return df[["conv", "part", "chunk"]].assign(state=states)

    return ways.groupBy("conv").applyInPandas(run, f"conv {ways.schema['conv'].dataType.simpleString()}, part long, chunk long, state int")


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation of rows: conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256, passes.

    Rows of a conversation go by turn, nulls first, rows of one turn by role and text. Null roles and texts are one space; a null conversation is one like others. The first fault of
    a row counts: blank, a duplicate of an earlier row's role and text, or truncated (its last visible character is no ``.!?``). Edits keep a row, change its role to user or assistant (1), delete it
    (2; blank and duplicate rows must be), or insert an empty row (5); truncated rows that stay add 5. The cheapest edits whose role initials give ``(s?(ua)+)?`` are told
    by their letters D, I, K, R, the ASCII-least of ties. Initials other than s, u and a, as those of empty roles, can't be kept. A conversation without rows after damage has zeros, an empty audit and the digest of
    an empty text; an empty table gives an empty result. Other columns of rows don't matter.
    """
    every = rows.select(F.col(conv_col).alias("conv")).distinct()
    clean = damaged(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col) if damage else rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    sorted_rows = placed(clean)
    turns = sorted_rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    chunks = chunks_of(sorted_rows, chunk)
    ends, passes = end_vectors(chunks)
    key = ["conv", "part", "chunk"]

    def on(a: str, b: str) -> Column:
        return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.part") == F.col(f"{b}.part")) & (F.col(f"{a}.chunk") == F.col(f"{b}.chunk"))

    def ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            df["ways"] = [[trace(k, tuple(map(int, a)), q, False)[2] for q in range(4)] for k, a in zip(df["kinds"], df["after"], strict=True)]
            yield df[[*key, "ways"]]

    both = chunks.alias("c").join(ends.alias("e"), on("c", "e")).select("c.*", "e.after", "e.last")
    several = both.where("NOT last").select(F.col("conv").alias("many")).distinct()
    long_ones = both.join(several, F.col("conv").eqNullSafe(F.col("many")), "left_semi")
    kind = chunks.schema["conv"].dataType.simpleString()
    states = _entries(long_ones.select(*key, "kinds", "after").mapInPandas(ways, f"conv {kind}, part long, chunk long, ways array<int>"))

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [trace(k, tuple(map(int, a)), int(q), bool(last)) for k, a, q, last in zip(df["kinds"], df["after"], df["state"], df["last"], strict=True)]
            df["audit"], df["edits"], df["cost"], df["start"] = ["".join(x[0]) for x in found], [x[0] for x in found], [x[1] for x in found], df["state"]
            yield df[[*key, "first", "start", "edits", "audit", "cost"]]

    todo = both.alias("b").join(states.alias("s"), on("b", "s"), "left").select("b.conv", "b.part", "b.chunk", "b.first", "b.kinds", "b.after", "b.last", F.coalesce("s.state", F.lit(0)).alias("state"))
    plan = C.cut(todo.mapInPandas(traced, f"conv {kind}, part long, chunk long, first long, start int, edits array<string>, audit string, cost long"))

    neighbours = Window.partitionBy("conv").orderBy("part", "chunk")
    summed = chunks.alias("c").join(plan.alias("p"), on("c", "p")).select("c.*", "p.audit", "p.cost")
    across = F.concat(F.lag("tail").over(neighbours), F.col("head"))
    summed = summed.withColumn("border", (across.isNotNull() & ~across.isin("su", "ua", "au")).cast("long"))
    totals = summed.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("border")).alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))

    out = every.alias("v")
    for name, part in (("t", turns), ("s", totals), ("d", _digests(sorted_rows, plan, chunk))):
        out = out.join(part.alias(name), F.col("v.conv").eqNullSafe(F.col(f"{name}.conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.split(".")[1])
    return out.select("v.conv", zero("t.gaps"), *[zero(f"s.{c}") for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("d.digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"), F.lit(passes).cast("long").alias("passes"))


def repaired_rows(rows: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """conv, part, at, lines: what each row, and at its chunk's end the inserts behind it, leave as ``role:text``, in order; rows are those of placed()."""
    left = rows.select("conv", "part", "at", (F.col("at") / size).cast("long").alias("chunk"), "role", "text")
    joined = left.alias("r").join(plan.select(F.col("part").alias("p2"), F.col("chunk").alias("k2"), F.col("conv").alias("c2"), "first", "edits", "start").alias("p"), (F.col("part") == F.col("p2")) & (F.col("chunk") == F.col("k2")) & F.col("conv").eqNullSafe(F.col("c2")))
    return joined.select("conv", "part", "at", "chunk", "first", "start", "role", "text", F.when(F.col("at") == F.col("first"), F.col("edits")).alias("edits"))


def _digests(rows: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """(conv, digest): SHA-256 of each conversation's repaired rows. They stream in order; nothing of a conversation is held but the state of its hash and its chunk's edits."""
    kind = rows.schema["conv"].dataType.simpleString()
    ready = repaired_rows(rows, plan, size).drop("chunk")
    ready = ready.repartition(F.col("conv")).sortWithinPartitions("conv", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, now, digest, some, edits, state = False, None, None, False, [], 0

        def line(role: str, text: str) -> None:
            nonlocal some
            digest.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            some = True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], schema_type), pa.array([digest.hexdigest()])], names=["conv", "digest"])

        for batch in batches:
            schema_type = batch.schema.field(0).type
            for conv, at, first, start, role, text, new in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "first", "start", "role", "text", "edits")), strict=True):
                if not began or conv != now:
                    if began:
                        yield done()
                    began, now, digest, some = True, conv, hashlib.sha256(), False
                if new is not None:
                    edits, state = new, start
                for place in (at - first, *((len(edits) - 1,) if at - first == len(edits) - 2 else ())):
                    for e in edits[place]:
                        if e == "D":
                            continue
                        to = next(x for x in "ua" if STEP[x][state] is not None)
                        if e == "K":
                            to = role[0]
                            line(role, text)
                        else:
                            line({"u": "user", "a": "assistant"}[to], "" if e == "I" else text)
                        state = STEP[to][state]
        if began:
            yield done()

    C.small_batches(rows.sparkSession)
    return ready.select("conv", "at", "first", "start", "role", "text", "edits").mapInArrow(run, f"conv {kind}, digest string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(C.read(spark, sf_dir, "conversations"), damage=True).withColumnRenamed("conv", "conv_id").drop("passes")
