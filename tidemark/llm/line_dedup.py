"""Line de-duplication by range-partitioned hashes; DataFrame functions only.

Line hashes are written once and range-partitioned by (hash, document, position), so a line that a third of
all documents share is spread over many tasks. Each sorted range streams to its first occurrence for each
(line, document), then to one partial count and first occurrence for each line; only those meet by line. The few lines
that are common go to every executor if their number allows it, so no line ever gathers its documents. The
result is a run-length compressed keep bitmap for each document, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Common lines (two hashes and a place each) up to which they are sent to every executor; beyond that they are joined.
BROADCAST_LINES = 500_000
#: Columns that dedup_lines() adds.
OWN = ("n_lines", "n_dropped", "keep_runs", "kept_text")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each line whose key has min_chars: __h1, __h2 (hash of the key), __id, __th (the row), __pos, __n (its lines)."""
    text = F.col(text_col)
    split = docs.select(*C.row_key(F.col(id_col), text), _lines(C.ascii_lower(F.coalesce(text, F.lit("")))).alias("__lines"))
    lines = split.select("__id", "__th", F.size("__lines").alias("__n"), F.posexplode("__lines").alias("__pos", "__line"))
    keyed = lines.select("__id", "__th", "__pos", "__n", F.btrim("__line", F.lit(C.SPACES)).alias("__key")).where(F.char_length("__key") >= min_chars)
    return keyed.select(F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"), "__id", "__th", "__pos", "__n")


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, keep: str = "first", min_chars: int = 1, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row for each distinct (id, text) that loses a line: __id, __th, n_dropped, keep_runs.

    A line's key is the line stripped of white space with A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs rows lose their lines: all of them with
    keep="none", all but the first by (id, text hash, position) with keep="first".
    keep_runs lists the kept lines as runs (start, length) from 0. Every row counts as a document, but copies of one row (same id and
    text) count as one. A null text is one empty line; null ids sort first; an empty
    table gives an empty result.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep: first or none, not {keep!r}")
    lines = C.cut(_hashed(docs, id_col, text_col, min_chars))
    ranged = lines.repartitionByRange("__h1", "__h2", "__id", "__th").sortWithinPartitions("__h1", "__h2", "__id", "__th", "__pos")
    per_doc = ranged.groupBy("__h1", "__h2", "__id", "__th").agg(F.min("__pos").alias("__pos"))
    first = [F.min(F.struct("__id", "__th", "__pos")).alias("__first")] if keep == "first" else []
    common = C.cut(per_doc.groupBy("__h1", "__h2").agg(F.count("*").alias("__docs"), *first).where(F.col("__docs") >= min_docs).drop("__docs"))
    hits = lines.join(F.broadcast(common) if common.count() <= broadcast_lines else common, ["__h1", "__h2"])  # of checked size
    if keep == "first":
        hits = hits.where(~F.struct("__id", "__th", "__pos").eqNullSafe(F.col("__first")))
    dropped = hits.groupBy("__id", "__th").agg(F.array_sort(F.collect_set("__pos")).alias("__dropped"), F.max("__n").alias("__n"))
    return dropped.select("__id", "__th", F.size("__dropped").cast("long").alias("n_dropped"), _runs(F.col("__dropped"), F.col("__n")).alias("keep_runs"))


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Kept lines as runs (start, length), from the sorted positions of those dropped."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))

    def gaps(e: Column) -> Column:
        all_gaps = F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e) - 1), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
        return F.filter(all_gaps, lambda g: g["length"] > 0)

    return C.let(edges, gaps)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, keep: str = "first", min_chars: int = 1) -> DataFrame:
    """All columns of docs and n_lines, n_dropped (long), keep_runs and kept_text; see keep_bitmaps().

    Columns of docs with those names are replaced.
    """
    names = [c for c in docs.columns if c not in OWN]
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, keep=keep, min_chars=min_chars)
    i, h, bi, bh = C.unused(docs, 4)
    left = docs.select(*names, *[c.alias(x) for c, x in zip(C.row_key(F.col(id_col), F.col(text_col)), (i, h), strict=True)])
    maps = maps.withColumnsRenamed({"__id": bi, "__th": bh})
    found = left.join(maps, F.col(i).eqNullSafe(F.col(bi)) & (F.col(h) == F.col(bh)), "left").drop(i, h, bi, bh)
    n_lines, untouched = F.size(_lines(F.col(text_col))), F.col("n_dropped").isNull()
    kept = C.let(_lines(F.col(text_col)), lambda ls: F.flatten(F.transform(F.col("keep_runs"), lambda r: F.slice(ls, r["start"] + 1, r["length"]))))
    whole = F.array(F.struct(F.lit(0).alias("start"), n_lines.alias("length")))
    return found.select(
        *names,
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("keep_runs", whole).alias("keep_runs"),
        F.when(untouched, F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.read(spark, sf_dir, "documents"), min_docs=10, keep="none", min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.k = c.k GROUP BY doc_id
"""
