"""Benchmark decontamination by winnowed fingerprints; DataFrame functions only.

Words are hashed as 5-grams. Of each 9 consecutive 5-grams the least is a fingerprint, written down once with its place
for all windows that share it, so two texts that share 13 words share a fingerprint at the same place of them. Fingerprints of
documents meet those of benchmark items, which carry the words around them, and a meeting is extended word by word to both sides: 13
equal words and more are a hit, equal hashes alone are not. Items of fewer than 13 words are one window, found by their
first 5-gram (or first word, under five words).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a k-gram and in a window; a window has WINDOW - K + 1 k-grams.
K, WINDOW = 5, 13
#: Words that a fingerprint carries on each side of its 5-gram: as many as a window that contains it can reach.
REACH = WINDOW - K
#: Fingerprints and short windows of the benchmark up to which they are sent to every executor (about 300 bytes each).
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return C.split_words(C.ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _count_words(text: Column) -> Column:
    """size(words_of(text)) without lower-casing: only what separates words matters here."""
    return F.size(C.split_words(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def _each(size: Column, body) -> Column:
    """[body(0), ..., body(size - 1)]."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), body)).otherwise(F.array())


def _kgrams(words: Column) -> Column:
    return _each(F.size(words) - (K - 1), lambda i: F.xxhash64(*[words[i + j] for j in range(K)]))


def _sliding(values: Column, pick) -> Column:
    """pick of each WINDOW - K + 1 = 9 consecutive values: of 2, of 4, of 8, then of the ninth too."""

    def step(a: Column, b: Column, apart: int) -> Column:
        n = F.greatest(F.size(b) - apart, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + apart, n), pick)

    eight = C.let(step(values, values, 1), lambda two: C.let(step(two, two, 2), lambda four: step(four, four, 4)))
    return C.let(eight, lambda e: step(e, values, 8))


def _prints(kgrams: Column) -> Column:
    """The places of all k-grams that are the least of a window, ties included; none in a text without a window."""
    edge = F.array_repeat(F.lit(-(1 << 63)).cast("bigint"), REACH)
    highest = C.let(_sliding(kgrams, lambda a, b: F.least(a, b)), lambda m: _sliding(F.concat(edge, m, edge), lambda a, b: F.greatest(a, b)))
    places = C.let(highest, lambda h: F.filter(F.sequence(F.lit(0), F.size(kgrams) - 1), lambda i: F.get(kgrams, i) == F.get(h, i)))
    return F.when(F.size(kgrams) > REACH, places).otherwise(F.array().cast("array<int>"))


def _item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, kind (which anchor finds it), anchor, window and left of each distinct benchmark window or fingerprint.

    A fingerprint's window is its 5-gram with up to REACH words on both sides, left of them before it. Where equal
    5-grams are the least of one window the documents' prints hold all of them, so any of the item's will do.
    """
    base = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    long = base.where(F.size("w") >= WINDOW).withColumn("g", _kgrams(F.col("w")))
    placed = long.select("item", "w", "g", F.explode(_prints(F.col("g"))).alias("at"))
    left = F.least(F.col("at"), F.lit(REACH))
    prints = placed.select("item", F.lit("winnow").alias("kind"), F.get("g", F.col("at")).alias("anchor"), F.slice("w", F.col("at") - left + 1, left + WINDOW).alias("window"), left.alias("left"))
    size = F.size("w")
    first = F.when(size >= K, F.xxhash64(*[F.get("w", F.lit(j)) for j in range(K)])).otherwise(F.xxhash64(F.col("w")[0]))
    short = base.where(size < WINDOW).select("item", F.when(size >= K, "kgram").otherwise("word").alias("kind"), first.alias("anchor"), F.col("w").alias("window"), F.lit(0).alias("left"))
    return prints.unionByName(short).distinct()


def _anchors(words: DataFrame, kind: str) -> DataFrame:
    """The columns of words and pos, anchor: one row for each fingerprint, or each place where a short window may start."""
    if kind == "word":
        return words.select("*", F.posexplode(F.transform("w", lambda w: F.xxhash64(w))).alias("pos", "anchor"))
    if kind == "kgram":
        return words.select("*", F.posexplode(_kgrams(F.col("w"))).alias("pos", "anchor"))
    found = C.let(_kgrams(F.col("w")), lambda g: C.let(_prints(g), lambda at: F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(g, i).alias("anchor")))))
    return words.select("*", F.inline(found))


def _extended(kind: str) -> tuple[Column, Column]:
    """(start, len) of the equal words around a meeting at pos of w and window; of a short window len is 0 unless it is there whole."""
    if kind != "winnow":
        n = F.size("window")
        return F.col("pos"), F.when(F.slice("w", F.col("pos") + 1, n) == F.col("window"), n).otherwise(0)
    start, n = F.col("pos") - F.col("left"), F.size("window")
    same = F.transform("window", lambda x, j: F.coalesce(F.get("w", start + j) == x, F.lit(False)))

    def run(flags: Column) -> Column:
        return F.when(F.array_position(flags, False) > 0, F.array_position(flags, False).cast("int") - 1).otherwise(F.size(flags))

    def grown(e: Column) -> Column:
        before, after = run(F.reverse(F.slice(e, 1, F.col("left")))), run(F.slice(e, F.col("left") + 1, n))
        return F.struct((F.col("pos") - before).alias("start"), F.when(after >= K, before + after).otherwise(0).alias("len"))

    both = C.let(same, grown)
    return both["start"], both["len"]


def _hits(words: DataFrame, windows: DataFrame, kinds: list[str], small: bool) -> DataFrame:
    """__id, __th, n_words, pos, len, item for each run of equal words of a document and an item that holds a window.

    Small benchmarks are broadcast and documents stream past them. Larger ones first leave the
    documents that share a fingerprint at all, and only their hits meet the words again.
    """
    found = []
    for kind in kinds:
        own = windows.where(F.col("kind") == kind).select("anchor", "window", "left", "item")
        if small:
            meets = _anchors(words, kind).join(F.broadcast(own), "anchor")  # of checked size
        else:
            prints = own.select("anchor").distinct()
            distinct = _anchors(words, kind).select("__id", "__th", "anchor").distinct()
            sharing = C.cut(distinct.join(prints, "anchor", "left_semi").select("__id", "__th").distinct())
            near = C.cut(words.join(sharing, C.on_key(words, sharing), "left_semi"))
            met = _anchors(near, kind).drop("w").join(own, "anchor").withColumnsRenamed({"__id": "__i", "__th": "__t"})
            meets = met.join(near, met["__i"].eqNullSafe(near["__id"]) & (met["__t"] == near["__th"]))
        start, length = _extended(kind)
        found.append(meets.select("__id", "__th", F.size("w").cast("long").alias("n_words"), start.alias("__start"), length.alias("len"), "item").where(F.col("len") >= (WINDOW if kind == "winnow" else 1)).withColumnRenamed("__start", "pos"))
    return reduce(DataFrame.unionAll, found)


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans (pos, len)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(end - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, zero, add, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each distinct (id, text) that holds a benchmark window: __id, __th, n_words, n_hit, items.

    A window is WINDOW consecutive words of an item, or all words of a shorter one; items
    without words have none. n_hit counts the document's words inside any occurrence of a
    window; items are the ids (as text, null ids as "") of the items that occur. Null and
    empty texts hold nothing; copies of a row are one row here; copies of an item all count.
    """
    windows = C.cut(_item_windows(items.withColumn(item_id_col, F.coalesce(F.col(item_id_col).cast("string"), F.lit(""))), item_id_col, item_text_col))
    sizes = {r["kind"]: r["count"] for r in windows.groupBy("kind").count().collect()}  # three rows at most
    words = docs.select(*C.row_key(F.col(id_col), F.col(text_col)), words_of(F.col(text_col)).alias("w"))
    if not sizes:
        return words.where("false").select("__id", "__th", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    hits = _hits(words, windows, sorted(sizes), sum(sizes.values()) <= broadcast_windows)
    by_doc = hits.groupBy("__id", "__th").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return by_doc.select("__id", "__th", "n_words", _covered(F.col("spans")).alias("n_hit"), "items")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns whatever their names, that are not contaminated; options as of contamination().

    Null and empty texts stay, and rows of the same id and text stay or go together; without items all rows stay.
    """
    i, h, bi, bh = C.unused(docs, 4)
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **options).where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("__id").alias(bi), F.col("__th").alias(bh))
    keyed = docs.select("*", *[c.alias(x) for c, x in zip(C.row_key(F.col(id_col), F.col(text_col)), (i, h), strict=True)])
    return keyed.join(bad, F.col(i).eqNullSafe(F.col(bi)) & (F.col(h) == F.col(bh)), "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    found = contamination(docs, C.read(spark, sf_dir, "benchmark")).drop("n_words")
    counted = docs.select("doc_id", *C.row_key(F.col("doc_id"), F.col("text")), _count_words(F.col("text")).cast("long").alias("n_words"))
    out = counted.join(found, C.on_key(counted, found), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[pos:pos + l - 1], ' ') AS win
       FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS pos FROM bw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, pos, l, array_to_string(w[pos:pos + l - 1], ' ') AS win
         FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS pos FROM dw, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hits AS (SELECT DISTINCT doc_id, pos, l, item_id FROM dwin JOIN iw USING (l, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + l - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
