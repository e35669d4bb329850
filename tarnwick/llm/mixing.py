"""Mixing sources to target weights: hash-random order, prefix sums of word counts, a cut at each source's exact budget.

1.  Sources in code-point order take the ``weights`` in turn and share ``share`` times all words.  A target stops at
    ``most`` times its source's words, and what is above is shared again by weight: the level at which this ends is the largest
    of those that sorting by words per weight gives, so no loop over sources is needed.
2.  Each row gets a random key, a hash of seed, id and text.  Keys are uniform, so their leading digits cut a source into
    ranges of about ``RANGE_ROWS`` rows without sampling, however hot the source is.
3.  Rows are sorted within each range; sums of the ranges before give each row the words that stand before it in its source.
4.  A source takes as many whole epochs as its budget holds, and of the next one what lies before the cut.  The row across the cut
    is taken in part, so that what a source gives is its budget to the word.

The driver gets the number of sources and nothing else.  Only rows without their texts are sorted unless ``keep`` asks for more.

Cases: a null text is empty; it has no words and nothing is taken from it.  A null source is a source, the last.  A null id is a value like
any other.  Rows that agree in id and text have one key and stand side by side in any order; all of them count.  A source without words has
the target 0.  An empty table gives an empty result.  Columns of ``docs`` named like the result's give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialise

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix"
RANGE_ROWS = 8192
#: The table of sources is broadcast up to this many; beyond it a shuffled join follows, whose hot keys Spark splits.
MOST_SOURCES = 65_536
WORD = r"[^\x20\x09-\x0D]+"
_ADDED = ("size", "key", "source_size", "target", "budget", "epochs", "before", "taken")


def words(text: str | Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def random_key(doc_id: str, text: str, seed: str = SEED) -> Column:
    """32 hexadecimal digits that seed, id and text decide."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target, budget, epochs, rest) of (source, source_size, n): a row for each source.

    ``target``: ``share`` of all words by weight, none above ``most`` times its source's; ``budget``: the nearest whole number.
    """
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))) + 1).cast("double")
    rows = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size").cast("double") * most)
    rows = rows.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__ratio", F.asc_nulls_last("source"))
    above = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * share
    # the level if this source were the first that isn't stopped: it rises while sources are, and falls after
    rows = rows.withColumn("__level", (total - above) / left)
    rows = rows.withColumn("target", F.least("__cap", F.max("__level").over(Window.partitionBy()) * F.col("__w")))
    rows = rows.withColumn("budget", F.floor(F.col("target") + 0.5).cast("bigint"))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("bigint"))
    rows = rows.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    return rows.select("source", "source_size", "n", "target", "budget", "epochs", "rest")


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (doc_id, text, source) plus ``source``, size, key, source_size, target, budget, epochs, before and taken.

    ``before``: the words that stand before the row in its source's random order; ``taken``: how many of its words the mix takes, each epoch counted.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in (*_ADDED, "source"))
    rows = docs.select(*keep, "source", words("text").alias("size"), random_key("doc_id", "text", seed).alias("key"))
    rows = materialise(rows, "sized")
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    plan = materialise(targets(sizes, weights, share, most).withColumn("ranges", F.ceil(F.col("n") / range_rows).cast("bigint")), "targets")
    plan = plan.select(F.col("source").alias("__source"), "source_size", "target", "budget", "epochs", F.col("rest").alias("__rest"), F.col("ranges").alias("__ranges"))
    few = plan.count() <= MOST_SOURCES
    # a row's range: its place among all 2 ** 32 values of eight digits, in as many equal parts as its source has
    digits = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    rows = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("__range", F.shiftright(digits * F.col("__ranges"), 32))
    sums = rows.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    order = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__source"), F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__first"))
    within = Window.partitionBy("source", "__range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__of")))
    rows = rows.withColumn("before", F.col("before") + F.col("__first"))
    part = F.least(F.greatest(F.col("__rest") - F.col("before"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + part)
    return rows.select(*keep, "source", "size", "key", "source_size", "target", "budget", "epochs", "before", "taken")


def copies(mixed: DataFrame, seed: str = SEED) -> DataFrame:
    """What is trained on: a row for each epoch in which a row of ``mixed`` (with ``text``) is taken, with its ``epoch``, ``words`` and ``turn``.

    ``text`` ends after the words that are taken.  Ordering an epoch by ``turn`` deals all sources out at random, in another order each time.
    """
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    rows = rows.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    spelled = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), F.array_join(F.slice(spelled, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col("text")))
    return rows.withColumn("turn", F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col("key"))))
