"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Five transformed statistics describe a text: log of the mean word length, and the inverse hyperbolic sines of the
shares of symbols, capitals, duplicate lines and repeated words. Per language and source a minimum covariance
determinant estimate is made: from several starts (the texts nearest to the coordinatewise medians, and two draws of
about `DRAWN` texts by hash) concentration steps take mean and covariance of the `SHARE` nearest by Mahalanobis
distance; after two steps the start of least determinant is kept and goes on until no determinant falls any more. The covariance is scaled by
the consistency factor of that share at the normal law. Texts beyond the chi-square quantile of tail `TAIL` on five
degrees are rejected; the tail is that small because the statistics have heavier tails than a normal law.

The same is done per language and over all texts, and each estimate is drawn to the next wider one: its weight is
n^2 / (n^2 + `PRIOR`^2), half at `PRIOR` texts. In a group of thousands this does nothing, a small one, whose own
estimate is not robust, is judged by its language, a small language by all texts, and the weight passes without a jump
and without a least group size from the one to the other. Every text with a word gets a verdict.

All moments and quantiles are map-side combined aggregates over a narrow table of statistics, so a source with a third
of all rows costs no more than others. The estimates (one row a group) are joined back by broadcast if their measured
size allows, else on a salt too (see `join_measured`).

Edge cases: a null text has no words and fails the base rules; null languages and sources are groups of their own;
statistics without spread get a floor on their deviation; texts of any length are taken whole; repeated rows are
judged alike; a text at exactly the cutoff is kept; null ids stay null; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import join_measured, materialize, table

SPACE = "[ \\t-\\r]+"
SYMBOLS = "[^#*$%&|<>]+"
STATISTICS = ("x_length", "x_symbols", "x_capitals", "x_lines", "x_repeats")
#: Share of a group that a concentration step keeps, and texts of a drawn start.
SHARE = 0.75
DRAWN = 12
STARTS = (0, 1, 2)
#: Steps of all starts, the most steps that are made, and the fall of a log determinant that calls for another.
FIRST_STEPS, STEPS, FALL = 2, 10, 0.01
#: Texts at which an estimate counts as much as that of the next wider group.
PRIOR = 40
#: Least standard deviation of a statistic, and the chi-square tail beyond which a text is rejected.
FLOOR = 0.15
TAIL = 1e-16
#: Level 2 is a language and source, 1 a language, 0 all texts.
GROUP = ["level", "lang_key", "source_key"]
RUN = [*GROUP, "start"]


def chi_square_tail(x: float, degrees: int) -> float:
    """Upper tail of the chi-square law of odd degrees."""
    tail, half = math.erfc(math.sqrt(x / 2)), x / 2
    for k in range(1, degrees, 2):
        tail += half ** (k / 2) * math.exp(-half) / math.gamma(k / 2 + 1)
    return tail


def chi_square_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, degrees) > tail else (low, mid)
    return high


#: What the covariance of the nearest `SHARE` of a normal law is to be multiplied by.
CONSISTENCY = SHARE / (1 - chi_square_tail(chi_square_quantile(1 - SHARE, len(STATISTICS)), len(STATISTICS) + 2))
CUTOFF = chi_square_quantile(TAIL, len(STATISTICS))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        # Words as numbers, then windows as numbers: equal windows are found by value.
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = F.when(
        F.size("h") >= 5,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("h") - 5, F.lit(0))),
            lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(5))),
        ),
    )
    rows = rows.withColumn("w", windows)
    # Each step is a column of its own: an expression inside a lambda would be evaluated again for every element.
    rows = rows.withColumn("again", F.coalesce(F.size(F.array_distinct("w")) < F.size("w"), F.lit(False)))
    placed = F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.col("again"), placed))
    rows = rows.withColumn("starts", F.when(F.col("again"), _repeated_starts("placed")))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), _covered("starts")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _repeated_starts(placed: str) -> Column:
    """Sorted places of the windows that equal a neighbour in an array sorted by value."""
    equal = F.transform(
        placed,
        lambda s, k: F.when(
            F.coalesce(F.get(placed, k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(placed, k + 1)["h"] == s["h"], F.lit(False)),
            s["i"],
        ),
    )
    return F.sort_array(F.array_compact(equal))


def _covered(starts: str) -> Column:
    """Number of words in the union of windows of five."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(5), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )


def with_vector(stats: DataFrame) -> DataFrame:
    """Add the base verdict and the five transformed statistics (null where a text has no word)."""
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    some = F.col("n_words") > 0
    return stats.withColumns(
        {
            "base_failed": failed,
            "x_length": F.when(some, F.log(chars / words)),
            "x_symbols": F.when(some, F.asinh(100 * F.col("n_symbols") / chars)),
            "x_capitals": F.when(some, F.asinh(10 * F.col("n_capitals") / chars)),
            "x_lines": F.when(some, F.asinh(20 * F.col("n_dup_lines") / words)),
            "x_repeats": F.when(some, F.asinh(10 * F.col("n_repeat_words") / words)),
        }
    )


def _sums() -> list[Column]:
    """Number, means m_i and second moments q_ij of the statistics."""
    d = len(STATISTICS)
    sums = [F.count("*").alias("n")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(STATISTICS)]
    return sums + [F.avg(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"q{i}{j}") for i in range(d) for j in range(i + 1)]


def _moment_names() -> list[str]:
    d = len(STATISTICS)
    return [f"m{i}" for i in range(d)] + [f"q{i}{j}" for i in range(d) for j in range(i + 1)]


def _factored(moments: DataFrame) -> DataFrame:
    """Add the log determinant of the covariance, floor included, and its inverse p_ij, by way of the Cholesky factor."""
    d, out = len(STATISTICS), moments
    for i in range(d):
        for j in range(i + 1):
            cov = F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + FLOOR * FLOOR
            for k in range(j):
                cov = cov - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-6))) if i == j else cov / F.col(f"c{j}{j}"))
    out = out.withColumn("logdet", 2 * sum((F.log(f"c{i}{i}") for i in range(1, d)), F.log("c00")))
    for i in range(d):
        out = out.withColumn(f"l{i}{i}", 1 / F.col(f"c{i}{i}"))
        for j in range(i - 1, -1, -1):
            out = out.withColumn(f"l{i}{j}", -sum((F.col(f"c{i}{k}") * F.col(f"l{k}{j}") for k in range(j + 1, i)), F.col(f"c{i}{j}") * F.col(f"l{j}{j}")) / F.col(f"c{i}{i}"))
    for i in range(d):
        for j in range(i + 1):
            out = out.withColumn(f"p{i}{j}", sum((F.col(f"l{k}{i}") * F.col(f"l{k}{j}") for k in range(i + 1, d)), F.col(f"l{i}{i}") * F.col(f"l{i}{j}")))
    return out.select(*moments.columns, "logdet", *_inverse_names())


def _inverse_names() -> list[str]:
    return [f"p{i}{j}" for i in range(len(STATISTICS)) for j in range(i + 1)]


def _distance(rows: DataFrame, estimate: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Squared Mahalanobis distances to written estimates; null where there is none."""
    d = len(STATISTICS)
    out = join_measured(rows, estimate.select(*key, *(f"m{i}" for i in range(d)), *_inverse_names()), key, how)
    z = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(STATISTICS)]
    total = z[0] * z[0] * F.col("p00")
    for i in range(1, d):
        total = total + z[i] * z[i] * F.col(f"p{i}{i}")
        for j in range(i):
            total = total + 2 * z[i] * z[j] * F.col(f"p{i}{j}")
    return out.withColumn("d2", F.greatest(total, F.lit(0.0))).select(*rows.columns, "d2")


def _moments_of_nearest(rows: DataFrame) -> DataFrame:
    """Moments and factors of the share of every run that lies nearest, written to the shared folder.

    One pass: moments are summed by rings of equal distance (3 % wide), and the inner rings are added up until they hold the share.
    """
    d = len(STATISTICS)
    ring = F.floor(F.log(F.col("d2") + 1e-6) * 32).cast("int")
    parts = [F.count("*").alias("n")] + [F.sum(x).alias(f"m{i}") for i, x in enumerate(STATISTICS)]
    parts += [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"q{i}{j}") for i in range(d) for j in range(i + 1)]
    rings = materialize(rows.groupBy(*RUN, ring.alias("ring")).agg(*parts))
    inner = Window.partitionBy(*RUN).orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    near = rings.withColumns({"inside": F.coalesce(F.sum("n").over(inner), F.lit(0)), "size": F.sum("n").over(Window.partitionBy(*RUN))})
    near = near.where(F.col("inside") < SHARE * F.col("size")).groupBy(*RUN).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _moment_names()))
    return materialize(_factored(near.select(*RUN, "n", *((F.col(c) / F.col("n")).alias(c) for c in _moment_names()))))


def _starts(members: DataFrame) -> DataFrame:
    """The first estimate of every run."""
    middle = [F.percentile_approx(x, 0.5).alias(f"p{i}") for i, x in enumerate(STATISTICS)]
    middle = materialize(members.groupBy(*GROUP).agg(F.count("*").alias("size"), *middle))
    apart = join_measured(members, middle, GROUP)
    spread = [F.percentile_approx(F.abs(F.col(x) - F.col(f"p{i}")), 0.5).alias(f"s{i}") for i, x in enumerate(STATISTICS)]
    spread = materialize(apart.groupBy(*GROUP).agg(*spread))
    total = F.lit(0.0)
    for i, x in enumerate(STATISTICS):
        z = (F.col(x) - F.col(f"p{i}")) / F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOOR))
        total = total + z * z
    first = join_measured(apart, spread, GROUP).withColumns({"d2": total, "start": F.lit(STARTS[0])}).select(*RUN, *STATISTICS, "d2")
    draw = F.pmod(F.xxhash64("start", "doc_id", *STATISTICS), F.lit(1 << 30)) * F.col("size") < DRAWN * (1 << 30)
    drawn = apart.withColumn("start", F.explode(F.array(*map(F.lit, STARTS[1:])))).where(draw)
    return _moments_of_nearest(first).unionByName(materialize(_factored(drawn.groupBy(*RUN).agg(*_sums()))))


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """The estimate of least determinant of every group that rows (lang_key, source_key, statistics) belong to."""
    none = F.lit("")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), none.alias("lang_key"), none.alias("source_key")),
        F.struct(F.lit(1).alias("level"), F.col("lang_key"), none.alias("source_key")),
        F.struct(F.lit(2).alias("level"), F.col("lang_key"), F.col("source_key")),
    )
    members = rows.where("x_length is not null").select(F.explode(levels).alias("g"), "doc_id", *STATISTICS).select("g.*", "doc_id", *STATISTICS)
    members = materialize(members)
    now = materialize(_starts(members))
    held = [c for c in now.columns if c not in RUN]
    for step in range(STEPS):
        if step == FIRST_STEPS:
            # Only the best start of a group goes on.
            now = materialize(now.groupBy(*GROUP).agg(F.min_by(F.struct("start", *held), F.struct("logdet", "start")).alias("b")).select(*GROUP, "b.*"))
        runs = members.withColumn("start", F.explode(F.array(*map(F.lit, STARTS)))) if step < FIRST_STEPS else join_measured(members, now.select(*RUN), GROUP)
        fresh = _moments_of_nearest(_distance(runs, now, RUN, "inner"))
        both = now.withColumn("new", F.lit(0)).unionByName(fresh.withColumn("new", F.lit(1)))
        # Steps can't raise a determinant but for the width of the rings; a run that does not fall has converged.
        best = both.groupBy(*RUN).agg(F.min_by(F.struct(*held), F.struct(F.round("logdet", 9), "new")).alias("b"), (F.max_by("logdet", F.lit(0) - F.col("new")) - F.min("logdet")).alias("fell"))
        best = materialize(best)
        now = best.select(*RUN, "b.*")
        if step >= FIRST_STEPS and not best.where(F.col("fell") > FALL).head(1):
            break
    return materialize(now.select(*GROUP, *held))


def _drawn_to_wider(estimates: DataFrame) -> DataFrame:
    """Estimates of languages and sources, drawn to those of the language and of all texts; scaled for consistency."""
    names = _moment_names()
    square = F.col("n").cast("double") * F.col("n")
    share = square / (square + PRIOR * PRIOR)
    mixed = [(share * F.col(c) + (1 - share) * F.col(f"w_{c}")).alias(c) for c in names]
    wide = lambda df, *key: df.select(*key, *(F.col(c).alias(f"w_{c}") for c in names))
    level = lambda i: estimates.where(F.col("level") == i).select("lang_key", "source_key", "n", *names)
    whole = materialize(wide(level(0), F.lit(1).alias("one")))
    langs = materialize(join_measured(level(1).withColumn("one", F.lit(1)), whole, ["one"]).select("lang_key", *mixed))
    own = join_measured(level(2), wide(langs, "lang_key"), ["lang_key"])
    return materialize(_factored(own.select("lang_key", "source_key", *mixed)))


def judge(docs: DataFrame) -> DataFrame:
    """Base statistics, squared distance (consistent at the normal law) and verdict of every row of `docs`."""
    stats = materialize(base_statistics(docs))
    rows = with_vector(stats).withColumns({"lang_key": F.coalesce("lang", F.lit("\x00")), "source_key": F.coalesce("source", F.lit("\x00"))})
    estimate = _drawn_to_wider(minimum_covariance(rows))
    judged = _distance(rows, estimate, ["lang_key", "source_key"]).withColumn("d2", F.col("d2") / CONSISTENCY)
    outlier = F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~outlier)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
