"""Quality rules with robust multivariate outliers; DataFrame functions only.

Six transformed statistics of a text are held against minimum-covariance-determinant estimates of its
language and source. Each stratum (language and source; language; the whole table) starts twice: at medians
and MADs, and at spatial signs. Concentration steps then re-estimate from the nearest share of rows, and the start
whose covariance has the smaller determinant counts. A stratum's estimate counts with its number of rows, that of
its language with PRIOR rows and, within that, that of the table likewise, so a stratum of few rows leans on its
language smoothly: no number of rows changes the rule. Every estimate is a group-by, so a hot source costs no more
than any other; only rows of estimates are ever joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

SYMBOLS = r"[#*$%&|<>]"
#: The vector: name, and the least standard deviation that counts as spread when a row is judged (keeps near-constant statistics from rejecting everything).
VECTOR = (("x_words", 0.5), ("x_word_len", 0.1), ("x_line_len", 0.5), ("x_symbols", 0.05), ("x_repeats", 0.1), ("x_dup_lines", 0.25))
#: Share of a stratum that the estimate is made from, and concentration steps of each start.
SHARE, STEPS = 0.75, 3
#: Of the least spread, what concentration steps add to keep a covariance regular; of the least spread, the spread that a table without rows would have.
RIDGE, WIDE = 0.1, 3.0
#: Rows that the estimate one level up counts for.
PRIOR = 60
#: Strata up to which their estimates (28 numbers each) are sent to every executor; beyond that they are joined.
BROADCAST_STRATA = 50_000
#: Squared Mahalanobis distance beyond which a row is rejected: chi-square, six degrees of freedom, upper tail 1e-5 (a conventional choice, not fitted to labels).
CUTOFF = 33.1
#: Median of that chi-square: a covariance is scaled so that its stratum's median distance meets it.
CHI2_MEDIAN = 5.348


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Columns of docs with those names are replaced. A null or empty text has zeros.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.drop(*own).withColumn("__w", C.split_words(text)).withColumn("__l", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(C.SPACES)) != ""))
    return found.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": C.let(F.col("__w"), _repeated).cast("long"),
        }
    ).drop("__w", "__l")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows found twice or more: windows sorted by hash, neighbours with equal words marked, their places merged."""
    n = F.size(words) - 2
    hashed = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def marked(s: Column) -> Column:
        same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda a, g: a + g))

    return F.when(n < 2, 0).otherwise(C.let(C.let(F.array_sort(hashed), marked), lambda p: F.when(F.size(p) == 0, 0).otherwise(covered(p))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    x = {
        "x_words": F.log(words),
        "x_word_len": F.log(chars / words),
        "x_line_len": F.log(words / F.greatest("n_lines", F.lit(1))),
        "x_symbols": F.sqrt(F.col("n_symbols") / chars),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        "x_dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
    }
    return stats.withColumns(x)


def _p() -> range:
    return range(len(VECTOR))


def _cell(i: int, j: int) -> int:
    """Place of row i, column j of a lower triangle in its array."""
    return i * (i + 1) // 2 + j


def _cells() -> list[tuple[int, int]]:
    return [(i, j) for i in _p() for j in range(i + 1)]


def _cholesky(v: str) -> Column:
    """The lower triangle whose square is the covariance in column v, cell by cell in one fold: the plan has one expression, whatever the vector's length."""
    pairs = lambda i, j: ", ".join(f"named_struct('a', {_cell(i, k)}, 'b', {_cell(j, k)})" for k in range(j))
    cells = ", ".join(f"named_struct('at', {_cell(i, j)}, 'under', {_cell(j, j)}, 'diagonal', {i == j}, 'pairs', CAST(array({pairs(i, j)}) AS ARRAY<STRUCT<a: INT, b: INT>>))" for i, j in _cells())
    rest = f"aggregate(c.pairs, get({v}, c.at), (r, p) -> r - get(done, p.a) * get(done, p.b))"
    return F.expr(f"aggregate(array({cells}), CAST(array() AS ARRAY<DOUBLE>), (done, c) -> concat(done, array(IF(c.diagonal, sqrt(greatest({rest}, 1e-12D)), {rest} / get(done, c.under)))))")


def _distance(df: DataFrame) -> DataFrame:
    """df with d2, the squared Mahalanobis distance from m by the triangle l, by forward substitution."""
    for i, (x, _) in enumerate(VECTOR):
        df = df.withColumn(f"z{i}", F.expr(f"({x} - m[{i}]{''.join(f' - l[{_cell(i, k)}] * z{k}' for k in range(i))}) / l[{_cell(i, i)}]"))
    return df.withColumn("d2", F.expr(" + ".join(["0.0D", *(f"z{i} * z{i}" for i in _p())]))).drop(*[f"z{i}" for i in _p()])


def mcd_estimates(rows: DataFrame, *, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """One row for each stratum of rows (stratum, and the columns of VECTOR): stratum, n, m* (mean), v* (covariance, lower triangle), det (its log)."""
    est = _estimates(rows, share, steps)
    return est.select("stratum", "n", *[F.col("m")[i].alias(f"m{i}") for i in _p()], *[F.col("v")[_cell(i, j)].alias(f"v{i}{j}") for i, j in _cells()], "det")


def _estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """What mcd_estimates() gives, with arrays m and v.

    The covariance is that of the nearest share of rows, scaled so that the median distance is a chi-square's. Medians and the
    share's distance are approximate percentiles, exact up to 10,000 rows of a stratum.
    """
    names, key = [x for x, _ in VECTOR], ["stratum", "start"]
    ridge = [(RIDGE * s) ** 2 for _, s in VECTOR]
    means = lambda of: F.expr(f"array({', '.join(map(of, _p()))}) AS m")
    triangle = lambda of, name: F.expr(f"array({', '.join(of(i, j) for i, j in _cells())}) AS {name}")
    each = lambda of: [F.expr(of(i, x)) for i, x in enumerate(names)]
    centre = C.cut(rows.groupBy("stratum").agg(F.count("*").alias("n"), *each(lambda i, x: f"percentile_approx({x}, 0.5D) AS m{i}")).select("stratum", "n", means(lambda i: f"m{i}")))
    small = centre.count() <= BROADCAST_STRATA
    held = lambda est: rows.join(F.broadcast(est) if small else est, "stratum")  # noqa: E731  of checked size
    mads = held(centre).groupBy("stratum").agg(F.first("m").alias("m"), *each(lambda i, x: f"percentile_approx(abs({x} - m[{i}]), 0.5D) AS a{i}"))
    spread = triangle(lambda i, j: f"sqrt(power(a{i} * 1.4826D, 2) + {VECTOR[i][1] ** 2!r}D)" if i == j else "0.0D", "l")
    first = C.cut(mads.select("stratum", F.lit(0).alias("start"), "m", spread))
    signs = held(first).withColumns({f"u{i}": F.expr(f"({x} - m[{i}]) / l[{_cell(i, i)}]") for i, x in enumerate(names)})
    length = f"greatest({' + '.join(['0.0D', *(f'u{i} * u{i}' for i in _p())])}, 1e-12D)"
    second = signs.groupBy("stratum").agg(F.first("m").alias("m"), F.first("l").alias("s"), *[F.expr(f"avg(u{i} * u{j} / {length}) AS c{i}{j}") for i, j in _cells()])
    shape = triangle(lambda i, j: f"{len(names)} * c{i}{j} * s[{_cell(i, i)}] * s[{_cell(j, j)}]" + (f" + {ridge[i]!r}D" if i == j else ""), "v")
    now = C.cut(first.unionByName(second.select("stratum", F.lit(1).alias("start"), "m", shape).select(*key, "m", _cholesky("v").alias("l"))))
    for _ in range(steps):
        reach = _distance(held(now)).groupBy(key).agg(F.percentile_approx("d2", share).alias("reach"))
        # sums of deviations from where the step starts; a filter on d2 would be written out over all the distance is made of
        inner = _distance(held(now.join(reach, key)).withColumns({f"e{i}": F.expr(f"{x} - m[{i}]") for i, x in enumerate(names)}))
        inner = inner.withColumn("inside", F.col("d2") <= F.col("reach")).select(*key, F.expr("IF(inside, 1D, 0D) AS w"), *each(lambda i, x: f"IF(inside, e{i}, 0D) AS e{i}"))
        sums = inner.groupBy(key).agg(F.sum("w").alias("w"), *each(lambda i, x: f"sum(e{i}) AS s{i}"), *[F.expr(f"sum(e{i} * e{j}) AS c{i}{j}") for i, j in _cells()])
        core = sums.join(now.select(*key, "m"), key)
        core = core.select(*key, means(lambda i: f"m[{i}] + s{i} / w"), triangle(lambda i, j: f"c{i}{j} / w - s{i} / w * (s{j} / w)" + (f" + {ridge[i]!r}D" if i == j else ""), "v"))
        now = C.cut(core.select("*", _cholesky("v").alias("l")))
    log_det = F.expr(f"2 * ({' + '.join(['0.0D', *(f'ln(l[{_cell(i, i)}])' for i in _p())])})")
    best = now.withColumn("det", log_det).groupBy("stratum").agg(F.min_by(F.struct("m", "v", "l", "det"), F.struct("det", "start")).alias("best"))
    best = C.cut(best.select("stratum", "best.*"))
    half = _distance(held(best)).groupBy("stratum").agg(F.percentile_approx("d2", 0.5).alias("half"))
    scale = F.when(F.col("half") > 1e-6, F.col("half") / CHI2_MEDIAN).otherwise(1.0)
    scaled = best.join(half, "stratum").select("stratum", "m", "det", F.transform("v", lambda x: x * scale).alias("v"))
    return scaled.join(centre.select("stratum", "n"), "stratum").select("stratum", "n", "m", "v", "det")


def _leaning(own: Column, upper: Column | None) -> Column:
    """Struct own (n, m, v; null: no rows) moved towards struct upper as PRIOR rows; towards a wide spread about its own mean without one."""
    n, wide = F.coalesce(own["n"], F.lit(0)), F.lit([(WIDE * VECTOR[i][1]) ** 2 if i == j else 0.0 for i, j in _cells()])

    def moved(name: str, size: int, target: Column) -> Column:
        nothing = F.array_repeat(F.lit(0.0), size)
        return F.zip_with(F.coalesce(own[name], nothing), target, lambda a, b: (n * a + PRIOR * b) / (n + PRIOR)).alias(name)

    return F.struct(n.alias("n"), moved("m", len(VECTOR), upper["m"] if upper is not None else own["m"]), moved("v", len(_cells()), upper["v"] if upper is not None else wide))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of docs: __id, __th, the statistics, base_failed, d2, kept.

    base_failed rows are not kept and shape no estimate. Every other row is held against the estimate of its language and
    source, which leans on that of the language and of the table as far as it has few rows; a null language or source is a
    value of its own. d2 is null where no row of the whole table shapes an estimate; then no row is kept, as all have
    base_failed. Copies of a row all count. An empty table gives an empty result.
    """
    text = F.col(text_col)
    lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(C.SPACES)) != ""))
    picked = docs.select(*C.row_key(F.col(id_col), text), text.alias("__text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), lines.alias("n_lines"))
    stats = C.cut(_vector(statistics(picked, "__text").drop("__text")).withColumn("base_failed", base_failed()))
    levels = F.array(F.to_json(F.array("__lang", "__source")), F.to_json(F.array("__lang")), F.lit("[]"))
    out = ("__id", "__th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    fit = stats.where(~F.col("base_failed")).select(F.explode(levels).alias("stratum"), *[x for x, _ in VECTOR])
    if fit.isEmpty():
        return stats.select(*out, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    est = C.cut(_estimates(fit))
    small = est.count() <= BROADCAST_STRATA
    strata = stats.select("__lang", "__source").distinct()
    for k, name in enumerate(("own", "mid", "top")):
        level = est.select(F.col("stratum").alias("__s"), F.struct("n", "m", "v").alias(name))
        strata = strata.join(level, levels[k] == F.col("__s"), "left").drop("__s")
    for name, upper in (("top", None), ("mid", "top"), ("own", "mid")):
        strata = C.cut(strata.withColumn(name, _leaning(F.col(name), F.col(upper) if upper else None)))
    floors = F.lit([VECTOR[i][1] ** 2 if i == j else 0.0 for i, j in _cells()])
    floored = strata.select("__lang", "__source", "own.m", F.zip_with("own.v", floors, lambda a, b: a + b).alias("v"))
    final = C.cut(floored.select("__lang", "__source", "m", _cholesky("v").alias("l")))
    far = _distance(stats.join(F.broadcast(final) if small else final, ["__lang", "__source"]))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cutoff))
    return far.select(*out, "d2", kept.alias("kept"))


def drop_low_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps; whatever their names are. Rows of the same id and text stay or go together."""
    i, h, bi, bh = C.unused(docs, 4)
    judged = C.cut(judge(docs, id_col=id_col, text_col=text_col, **options).select("__id", "__th", "kept"))  # else the filter below is written out over all that leads to a distance
    bad = judged.where(~F.col("kept")).select(F.col("__id").alias(bi), F.col("__th").alias(bh)).distinct()
    keyed = docs.select("*", *[c.alias(x) for c, x in zip(C.row_key(F.col(id_col), F.col(text_col)), (i, h), strict=True)])
    return keyed.join(bad, F.col(i).eqNullSafe(F.col(bi)) & (F.col(h) == F.col(bh)), "left_anti").select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.read(spark, sf_dir, "documents")).withColumnRenamed("__id", "doc_id").drop("__th")
