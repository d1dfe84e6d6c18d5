"""Conversation repair against plain dynamic programming over whole conversations; chunks of any size, fix-up passes, odd tables."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as V
from tidemark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def space(x):
    return " " if x is None else x


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows, damaged=True):
    every, found = {r[0] for r in rows}, {}
    for r in damage(rows) if damaged else [(c, t, space(r), space(x)) for c, t, r, x in rows]:
        found.setdefault(r[0], []).append(r)
    out = []
    for conv in every:
        mine = sorted(found.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        turns, seen, faults = {r[1] for r in mine if r[1] is not None}, set(), []
        for _, _, role, text in mine:
            shown = re.sub("[ \t-\r]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))

        @cache
        def best(i, q, mine=mine, faults=faults, least=4):
            """(cost, audit, output) from row i on; q: roles given so far end with nothing, s, u or a; at most least inserts in a row."""
            ways = [(0, "", ())] if i == len(mine) and q in "-a" else []
            nexts = {"-": "su", "s": "u", "u": "a", "a": "u"}[q]
            if least:
                for x in set(nexts) - {"s"}:
                    c, a, o = best(i, x, least=least - 1)
                    ways.append((c + 5, "I" + a, ({"u": "user:", "a": "assistant:"}[x], *o)))
            if i < len(mine):
                role, text = mine[i][2:]
                c, a, o = best(i + 1, q)
                ways.append((c + 2, "D" + a, o))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    for x in nexts:
                        if role[:1] == x:
                            c, a, o = best(i + 1, x)
                            ways.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                        if x != "s":
                            c, a, o = best(i + 1, x)
                            ways.append((c + 1 + more, "R" + a, ({"u": "user:", "a": "assistant:"}[x] + text, *o)))
            return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

        for i in range(len(mine), -1, -1):  # keeps recursion shallow
            for q in "-sua":
                best(i, q)
        cost, audit, lines = best(0, "-") if mine else (0, "", ())
        initials = [r[2][:1] for r in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def random_rows(n, convs, seed):
    rng, words = random.Random(seed), ["Yes.", "no", "Why?", "", " \t", None, "ok!", "ok! ", "maybe. \n", "so .. x", "é?", " "]
    return [(rng.randrange(convs), rng.choice([i, i // 2, None, i + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Uncle", "ant"]), rng.choice(words) if rng.random() < 0.4 else f"text {i}" + rng.choice([".", "?", ""])) for i in range(n)]


def test_whole_table_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, SF_DIR)) == brute(rows)


@pytest.mark.parametrize("chunk", [1, 3, 8192])
def test_damaged_random_conversations(spark, chunk):
    rows = random_rows(900, 60, 1) + random_rows(600, 1, 2) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)] + [(77, 5, "user", "same.")] * 20
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit("x") for c in ("conv", "part", "at", "chunk", "kinds", "audit", "kind")})
    out = V.repair(df, damage=True, chunk=chunk)
    assert found(out.withColumnRenamed("conv", "conv_id")) == brute(rows)
    assert out.select("passes").first()[0] > 0 or chunk > 3


def test_one_long_conversation(spark):
    """Alternating roles out of step with the pattern at their end: the speculative vector is wrong in every chunk."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(4000)] + [(2, i, "user", f"t{i}.") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = V.repair(df, chunk=64).withColumnRenamed("conv", "conv_id")
    assert found(got) == brute(rows, False)


def test_no_rows_and_all_dropped(spark):
    assert V.repair(spark.createDataFrame([], SCHEMA), damage=True).count() == 0
    gone = [(c, t, "user", "Hi.") for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    assert found(V.repair(spark.createDataFrame(gone, SCHEMA), damage=True).withColumnRenamed("conv", "conv_id")) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in gone}], key=repr)


def test_reruns_stop_where_vectors_meet():
    kinds = "ua" * 2000
    first, n = V.start_vector(kinds, V.END)
    again, rerun = V.start_vector(kinds, (5, 0, 0, 2), V.END, first)
    assert n == 4000 and rerun < 20 and again == V.start_vector(kinds, (5, 0, 0, 2))[0]
    assert all(V.start_vector(k, a)[0] == V.start_vector(k, a, V.END, V.start_vector(k, V.END)[0])[0] for k in ("usaxUA-+", "aaaa", "xxx", "u") for a in ((0, 9, 4, 1), (3, 0, 7, 2)))
