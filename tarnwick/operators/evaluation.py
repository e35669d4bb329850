"""Evaluating embeddings: centroids, similarity, average precision, predictions, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

#: A table of class vectors is broadcast only up to this many classes.
MOST_CLASSES = 4096


def centroids(features: DataFrame, size: int, vector: str = "embedding", label: str = "label", classes: DataFrame | None = None) -> DataFrame:
    """(class_id, centroid): the mean vector of each class; zeros for a class of ``classes`` without rows.

    One aggregation with a column for each dimension: rows are not exploded.
    """
    means = features.groupBy(F.col(label).alias("class_id")).agg(*(F.avg(F.col(vector)[i].cast("double")).alias(f"d{i}") for i in range(size)))
    means = means.select("class_id", F.array(*(f"d{i}" for i in range(size))).alias("centroid"))
    if classes is None:
        return means
    zero = F.array_repeat(F.lit(0.0), size)
    return classes.join(means, "class_id", "left").select("class_id", F.coalesce("centroid", zero).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length, at least 1e-8."""
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8))


def class_scores(features: DataFrame, class_vectors: DataFrame, vector: str = "embedding", scale: float = 10.0) -> DataFrame:
    """Each row of ``features`` with every class: ``score`` is the scaled cosine similarity.

    Class vectors are few: they are counted, and broadcast up to ``MOST_CLASSES``.  Beyond that they make blocks of as many, and each row is sent
    once to each block.
    """
    parts = -(-class_vectors.count() // MOST_CLASSES)
    scaled = class_vectors.withColumn("__norm", norm(F.col("centroid")))
    rows = features.withColumn("__own", norm(F.col(vector)))
    if parts <= 1:
        pairs = rows.crossJoin(F.broadcast(scaled))
    else:
        # a block's rows are dealt to 64 parts, each of which holds a copy of the block's classes
        deal = F.pmod(F.xxhash64(vector), F.lit(64)).alias("__deal")
        scaled = scaled.withColumn("__block", F.pmod(F.xxhash64("class_id"), F.lit(parts))).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")))
        rows = rows.withColumn("__deal", deal).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
        pairs = rows.join(scaled, ["__block", "__deal"]).drop("__block", "__deal")
    return pairs.withColumn("score", scale * dot(F.col(vector), F.col("centroid")) / (F.col("__own") * F.col("__norm"))).drop("centroid", "__norm", "__own")


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1 / (1 + F.exp(-x))


def average_precision(scores: DataFrame, score: str = "score", truth: str = "truth", by: str = "class_id", range_rows: int = ordered.RANGE_ROWS) -> DataFrame:
    """(class_id, ap, n_positive): the sum of precision times gain in recall over falling thresholds.

    Rows with equal scores share a threshold, so they are summed before the running totals, which ranges of thresholds share; classes without positives are left out.
    """
    at = scores.groupBy(by, score).agg(F.sum(F.col(truth).cast("bigint")).alias("tp"), F.count("*").alias("n"))
    run = ordered.running_sums(at, {"ctp": "tp", "cn": "n"}, (F.desc(score),), (by,), range_rows)
    out = run.groupBy(by).agg(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s"), F.sum("tp").alias("n_positive")).where("n_positive > 0")
    return out.select(by, (F.col("s") / F.col("n_positive")).alias("ap"), "n_positive")


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """(cmap, n_classes): the mean over evaluated classes, 0 if there are none."""
    return ap.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("cmap"), F.count("ap").alias("n_classes"))


def multi_hot(classes: Column, n: int) -> Column:
    """0/1 array of ``n`` classes from a list of class numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.array_contains(classes, c).cast("int"))


def above(probabilities: Column, threshold: float = 0.5) -> Column:
    """Positions whose value exceeds ``threshold``."""
    marked = F.transform(probabilities, lambda p, i: F.when(p > threshold, i))
    return F.filter(marked, lambda i: i.isNotNull())


def arg_max(values: Column) -> Column:
    """Position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def accuracy(batches: DataFrame) -> DataFrame:
    """(accuracy, loss) over batches (correct, total, loss): of all rows, and the mean of the batch means."""
    return batches.agg((F.sum("correct") / F.greatest(F.sum("total"), F.lit(1))).alias("accuracy"), (F.sum("loss") / F.greatest(F.count("*"), F.lit(1))).alias("loss"))


#: The defaults of the asymmetric loss.
def asymmetric_loss(p: Column, y: Column, minus: float = 4.0, plus: float = 1.0, clip: float = 0.05, eps: float = 1e-8) -> Column:
    """Loss of a probability that focuses negatives by ``minus`` and positives by ``plus``, with shifted negatives."""
    q = F.least(1 - p + clip, F.lit(1.0))
    pt = F.when(y == 1, p).otherwise(q)
    weight = F.pow(1 - pt, F.when(y == 1, F.lit(plus)).otherwise(F.lit(minus)))
    return -weight * F.log(F.greatest(pt, F.lit(eps)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Natural-log loss of the target's position under a softmax of ``logits``."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.log(total) + top - F.element_at(logits, target + 1)


def l2_norms(leaves: DataFrame) -> DataFrame:
    """(component, l2) of (component, values) rows."""
    squares = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return leaves.groupBy("component").agg(F.sqrt(F.sum(squares)).alias("l2"))


def optimizer_stats(leaves: DataFrame, by: str = "state") -> DataFrame:
    """(state, l2, abs_mean, abs_max, counts) of leaves (state, component, values, count): floating-point ``values``, or a whole number alone.

    ``counts``: the whole numbers in order of component.  A state without floating-point values has nulls; one without whole numbers an empty list.
    """
    x = F.transform("values", lambda v: F.abs(v.cast("double")))
    own = leaves.select(by, "component", "count", F.size("values").alias("n"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("a"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v).alias("q"), F.array_max(x).alias("top"))
    some = F.when(F.col("values_n") > 0, F.col("values_n"))
    numbers = F.array_sort(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("component", "count"))))  # a state has a few scalars
    rows = own.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("values_n"), F.sum("a").alias("a"), F.sum("q").alias("q"), F.max("top").alias("top"), numbers.alias("numbers"))
    return rows.select(
        by, F.when(some.isNotNull(), F.sqrt("q")).alias("l2"), (F.col("a") / some).alias("abs_mean"), F.when(some.isNotNull(), F.col("top")).alias("abs_max"), F.transform("numbers", lambda s: s["count"]).alias("counts")
    )


def sigreg(features: DataFrame, directions: DataFrame, knots: int = 17, reach: float = 3.0, vector: str = "embedding") -> DataFrame:
    """(projection, statistic): how far projected vectors are from a standard normal, by their characteristic function.

    ``directions`` (projection, direction) are counted and must be at most ``MOST_CLASSES``, which are broadcast; cosines and sines are averaged at each knot.
    """
    if directions.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} directions")
    t = [reach * k / (knots - 1) for k in range(knots)]
    p = features.crossJoin(F.broadcast(directions)).select("projection", dot(F.col(vector), F.col("direction")).alias("x"))
    means = p.groupBy("projection").agg(*(F.avg(F.cos(F.col("x") * k)).alias(f"c{i}") for i, k in enumerate(t)), *(F.avg(F.sin(F.col("x") * k)).alias(f"s{i}") for i, k in enumerate(t)))
    gap = t[1] - t[0]
    parts = []
    for i, k in enumerate(t):
        target = F.exp(F.lit(-k * k / 2))
        weight = gap * (1.0 if 0 < i < knots - 1 else 0.5) * F.exp(F.lit(-k * k / 2))
        parts.append(weight * (F.pow(F.col(f"c{i}") - target, 2) + F.pow(F.col(f"s{i}"), 2)))
    return means.select("projection", sum(parts[1:], parts[0]).alias("statistic"))
