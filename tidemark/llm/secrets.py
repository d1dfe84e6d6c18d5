"""Secret scans: credential patterns and a token-efficiency test for random strings.

A string that a public vocabulary can only cut into very short tokens is unlike anything the
vocabulary was learnt from: few characters a token, mixed character kinds and high variety mean a
random string. Digests and identifiers of known shape (hex of digest length, UUIDs, dates, words
joined by dots or dashes) are excluded, as they are as inefficient without being secret.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import vocab

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that may be random strings or hold one between separators, and what lies between these. Each place is looked at once.
RUN, PART = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), re.compile(r"[A-Za-z0-9+]{20,}")
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})")
#: Words, capitals and short numbers between separators: each part can be read in one way only, so failing takes no longer than matching.
NAMED = re.compile(r"[+/_=-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,8}+)(?:[+/_=-]++|\Z))+")
#: Characters a token below which a run is a random string (LETTERS_RATIO: one without digits, which may be a long word), and the least share of distinct characters.
MAX_RATIO, LETTERS_RATIO, MIN_VARIETY = 2.0, 1.6, 0.3
#: Tokens are counted in slices of so many characters.
SLICE = 4096

KINDS = ("assign", "access", "hex", "random")
SCHEMA = "n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds; kind indexes KINDS. Failing matches use up their text."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(s: str, count_tokens, max_ratio: float = MAX_RATIO) -> bool:
    """Whether s has too few characters a token, and is no known digest and no name."""
    digits = any(map(str.isdigit, s))
    if not any(map(str.isalpha, s)) or len(set(s)) < MIN_VARIETY * min(len(s), 30) or digits and (KNOWN.fullmatch(s) or NAMED.fullmatch(s)):
        return False
    return len(s) < (max_ratio if digits else min(max_ratio, LETTERS_RATIO)) * sum(count_tokens(s[i : i + SLICE]) for i in range(0, len(s), SLICE))


def random_spans(text: str, count_tokens, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Runs that are random strings; else their parts between / _ = - that are, so that wording beside a secret doesn't hide it."""
    found = []
    for run in RUN.finditer(text):
        if is_random(run[0], count_tokens, max_ratio):
            found.append((run.start(), 3, run.end()))
        elif not KNOWN.fullmatch(run[0]):
            found += [(m.start(), 3, m.end()) for m in PART.finditer(text, run.start(), run.end()) if m[0] != run[0] and is_random(m[0], count_tokens, max_ratio)]
    return found


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, n_random (long), base_spans, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A random
    span that lies inside a pattern span is the same secret and is left out. A null or empty
    text has none; repeated rows and null ids give a row each; other columns are ignored.
    """
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(SCHEMA).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocab.tiktoken_encoding(vocabulary).encode_ordinary

        def one(text: str | None) -> tuple:
            base = base_spans(text or "")
            extra = [r for r in random_spans(text or "", lambda s: len(encode(s)), max_ratio) if not any(a <= r[0] and r[2] <= b for a, _, b in base)]
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            return *n, len(extra), _line(base), _line(sorted(base + extra))

        for batch in batches:
            out = pd.DataFrame([one(t) for t in batch["__text"]], columns=[f.name for f in schema.fields[1:]])
            out.insert(0, id_col, batch[id_col].values)
            yield out

    C.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInPandas(run, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def brute_base(text: str | None) -> tuple[int, int, int, str]:
    """The base columns straight from their definition, for tests."""
    text, spans = text or "", []
    spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return *[sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(_line(sorted(spans)).encode()).hexdigest()
