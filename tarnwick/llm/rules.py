"""Quality rules: base counts of a text, and robust multivariate outliers within language and source.

All of it is DataFrame expressions.  Four transformed statistics of each text that passes the base
rule (word length, symbols, repeated lines, repeated words) form a vector of whole numbers.  For each
language and source the minimum-covariance-determinant estimate is found from two starts (medians with absolute
deviations; mean and covariance) by concentration steps: Mahalanobis distances under the present estimate,
counted in fine bins, give the half-space that holds ``COVER`` of the documents, whose mean and covariance are the
next estimate, until nothing new comes.  The start with the smaller determinant wins, and texts beyond ``CUTOFF`` are rejected.

Every group has an estimate of its own, whatever its size.  Its mean and covariance are those of its documents and of
``PRIOR`` more that agree with the estimate of the whole language, which itself leans on that of all documents in the same way; so a group of
a few texts is judged nearly by its language, and one of thousands by itself alone.

Vectors are whole numbers and most statistics are mostly zero, so texts are first counted by vector: all steps run on different vectors with
their counts.  A step is one join and one aggregation to bins; sums are of whole numbers, so the result depends
neither on the order of rows nor on their partitioning.  A group of any size is reduced before it is shuffled.
Should steps still change something after ``MOST_STEPS``, a warning says so and the last estimate is used.

Cases: null text counts as empty and fails the base rule.  Null languages and sources are groups of
their own.  A least variance in each direction keeps estimates of constant statistics from rejecting the first
text that differs.  Repeated rows count and are answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import forget, materialise

WORD = r"[^\x20\x09-\x0D]+"
STATS = ("x1", "x2", "x3", "x4")
UNIT = 128.0  # vectors are whole numbers of 1 / UNIT
#: Added before distances are divided by ``consistency(COVER)``; 0.06, 0.08, 0.08 and 0.12 beside a covariance made consistent.
LEAST_DEVIATION = (0.0492, 0.0656, 0.0656, 0.0984)
COVER, MOST_STEPS, PRIOR = 0.75, 40, 20.0
#: Deviations that a table of very few documents is taken to have.
PRIOR_DEVIATION = (0.2, 0.25, 0.25, 0.35)
CUTOFF = 18.47  # the quantile 0.999 of chi-square with 4 degrees of freedom
FINE = 32.0


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the array."""

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(w[i - 1], w[i], w[i + 1]).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(bind(windows, covered))

    def covered(t: Column) -> Column:
        fresh = F.size(F.array_distinct(F.transform(t, lambda x: x["h"]))) == F.size(t)
        return F.when(fresh, F.lit(0)).otherwise(bind(F.array_sort(t), by_place))

    def by_place(s: Column) -> Column:
        n = F.size(s)
        twice = lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < n - 1) & (s[F.least(k + 1, n - 1)]["h"] == x["h"]))
        places = F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
        add = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(places, start, add)["n"]

    return bind(words, count)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return docs.select(
        "doc_id", "lang", "source",
        bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ).select(
        "doc_id", "lang", "source", F.col("w.n_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.n_repeat_words").cast("bigint").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` plus the transformed statistics in whole units."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *(F.sqrt(F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))]
    return stats.withColumns({x: F.round(UNIT * v).cast("bigint") for x, v in zip(STATS, parts, strict=True)})


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(4) for j in range(i + 1)]


def _sums() -> list[Column]:
    """Sums over texts of rows of vectors with their ``times``."""
    x, k = [F.col(c) for c in STATS], F.col("times")
    return [F.sum(k).alias("n"), *(F.sum(k * x[i]).alias(f"s{i}") for i in range(4)), *(F.sum(k * x[i] * x[j]).alias(f"p{i}{j}") for i, j in _pairs())]


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``times``, how many texts a row stands for: 1 where it isn't there yet."""
    return rows if "times" in rows.columns else rows.withColumn("times", F.lit(1).cast("bigint"))


def _estimates(sums: DataFrame, prior: DataFrame, *keys: str) -> DataFrame:
    """Keys, mean m, covariance c and its factor l from sums of documents and the prior (grp, q: mean, r: covariance)."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}") / n for i in range(4)]
    cov = {f"v{i}{j}": F.col(f"p{i}{j}") / n - mean[i] * mean[j] for i, j in _pairs()}
    return _with_prior(sums.select(*keys, n.alias("n"), *(mean[i].alias(f"g{i}") for i in range(4)), *(v.alias(k) for k, v in cov.items())), prior, *keys)


def _with_prior(own: DataFrame, prior: DataFrame, *keys: str) -> DataFrame:
    """The estimate of ``own`` (n, g: mean, v: covariance) and of ``PRIOR`` documents that agree with the prior."""
    both, n = own.join(prior, "grp"), F.col("n")
    mean = {f"m{i}": (n * F.col(f"g{i}") + PRIOR * F.col(f"q{i}")) / (n + PRIOR) for i in range(4)}
    gap = [F.col(f"g{i}") - F.col(f"q{i}") for i in range(4)]
    cov = {f"c{i}{j}": (n * F.col(f"v{i}{j}") + PRIOR * F.col(f"r{i}{j}") + n * PRIOR / (n + PRIOR) * gap[i] * gap[j]) / (n + PRIOR) for i, j in _pairs()}
    return _factored(both.select(*keys, *(v.alias(k) for k, v in (mean | cov).items())), *keys)


def _factored(params: DataFrame, *keys: str) -> DataFrame:
    """``params`` with the Cholesky factor l of the covariance c and its least variances, and the log of its determinant."""
    for i in range(4):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit((UNIT * LEAST_DEVIATION[i]) ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum(2 * F.log(f"l{i}{i}") for i in range(4))
    return params.select(*keys, *_names("m"), *_names("c"), *_names("l"), logdet.alias("logdet"))


def _names(kind: str) -> list[str]:
    return [f"m{i}" for i in range(4)] if kind == "m" else [f"{kind}{i}{j}" for i, j in _pairs()]


def distance() -> Column:
    """Squared Mahalanobis distance of a row that stands beside its group's estimate."""
    y: list[Column] = []
    for i in range(4):
        rest = F.col(STATS[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum(v * v for v in y)


def consistency(cover: float) -> float:
    """What makes the covariance of the innermost ``cover`` of a four-dimensional normal cloud unbiased."""
    low, high = 0.0, 100.0
    for _ in range(200):  # the quantile of chi-square with 4 degrees of freedom
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < cover else (low, mid)
    half = low / 2
    return cover / (1 - math.exp(-half) * (1 + half + half * half / 2))


def medians(rows: DataFrame) -> DataFrame:
    """(grp, n, med0 to med3): the middle of each statistic; whole numbers, so that a group's counts of values are few."""
    return counted(rows).groupBy("grp").agg(F.sum("times").cast("double").alias("n"), *(F.percentile(x, 0.5, F.col("times")).alias(f"med{i}") for i, x in enumerate(STATS)))


def estimate(rows: DataFrame, middle: DataFrame, prior: DataFrame, cover: float = COVER, most_steps: int = MOST_STEPS) -> DataFrame:
    """(grp, m, c, l) of each group of ``rows`` (grp, statistics, and perhaps ``times``) by concentration steps from two starts.

    ``middle``: the groups' :func:`medians`.  ``prior``: (grp, q, r), mean and covariance that a group leans on.  Steps end when
    all groups hold what they held after an earlier step.
    """
    rows = counted(rows)
    key, sums = ["grp", "start"], ["n", *(f"s{i}" for i in range(4)), *(f"p{i}{j}" for i, j in _pairs())]
    spread = rows.join(middle, "grp").groupBy("grp").agg(
        F.first("n").alias("n"), *(F.first(f"med{i}").alias(f"g{i}") for i in range(4)),
        *((F.percentile(F.abs(F.col(x) - F.col(f"med{i}")), 0.5, F.col("times")) * 1.4826).alias(f"d{i}") for i, x in enumerate(STATS)),
    )
    flat = spread.select("grp", F.lit(0).alias("start"), "n", *(f"g{i}" for i in range(4)), *((F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _pairs()))
    mean = rows.groupBy("grp").agg(*_sums()).withColumn("start", F.lit(1))
    now = materialise(_estimates(mean, prior, *key).unionByName(_with_prior(flat, prior, *key)), "estimate")
    seen, old = set(), now
    for _ in range(most_steps):
        bins = rows.join(now.select(*key, *_names("m"), *_names("l")), "grp").withColumn("bin", F.floor(FINE * F.log1p(distance()))).groupBy(*key, "bin").agg(*_sums())
        w = Window.partitionBy(*key)
        inner = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)}).where(F.col("upto") - F.col("n") < F.ceil(F.col("total") * cover))
        held = materialise(inner.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums)), "held")
        forget(old)
        old = held
        now, mark = _estimates(held, prior, *key), held.agg(F.bit_xor(F.xxhash64(*key, *sums))).first()[0]
        if mark in seen:
            break
        seen.add(mark)
    else:
        warnings.warn(f"estimates still change after {most_steps} steps", RuntimeWarning, stacklevel=2)
    columns = [*_names("m"), *_names("c"), *_names("l")]
    best = now.groupBy("grp").agg(F.min(F.struct("logdet", "start", *columns)).alias("b"))
    return materialise(best.select("grp", *(f"b.{c}" for c in columns)), "estimate")


def _leaning(groups: DataFrame, params: DataFrame) -> DataFrame:
    """The prior of ``groups`` (grp, above): the estimate of the group above."""
    above = params.select(F.col("grp").alias("above"), *(F.col(f"m{i}").alias(f"q{i}") for i in range(4)), *(F.col(f"c{i}{j}").alias(f"r{i}{j}") for i, j in _pairs()))
    return materialise(groups.join(above, "above").drop("above"), "prior")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``distance`` (null where the base rule failed) and ``kept`` for every row of ``docs``."""
    levels = {"__all": F.lit("{}"), "__lang": F.to_json(F.struct("lang")), "__source": F.to_json(F.struct("lang", "source"))}
    stats = materialise(vectors(base_statistics(docs)).withColumns(levels), "statistics")
    fit = stats.where("not base_failed").groupBy(*levels, *STATS).agg(F.count("*").alias("times"))
    fit = materialise(fit, "vectors")
    params, above = None, None
    for level in levels:
        rows = fit.select(F.col(level).alias("grp"), *STATS, "times")
        middle = materialise(medians(rows), "medians")
        if params is None:
            wide = [F.lit((UNIT * PRIOR_DEVIATION[i]) ** 2 if i == j else 0.0).alias(f"r{i}{j}") for i, j in _pairs()]
            prior = middle.select("grp", *(F.col(f"med{i}").alias(f"q{i}") for i in range(4)), *wide)
        else:
            prior = _leaning(fit.select(F.col(level).alias("grp"), F.col(above).alias("above")).distinct(), params)
        params, above = estimate(rows, middle, prior), level
    beside = stats.join(params.select(F.col("grp").alias("__source"), *_names("m"), *_names("l")), "__source", "left")
    far = F.when(~F.col("base_failed"), distance() / consistency(COVER))
    judged = beside.withColumn("distance", far)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
    )
