"""Spelling variants: pairs of words at one edit by an even-partition pigeonhole join, and the form that each word varies.

1.  Words are counted over all texts; those of enough letters and occurrences are the vocabulary.
2.  A word of length L is cut into two segments, of L // 2 and of the other code points.  One edit leaves one of them whole: in a word of
    the same length it stands at the same place, in a word that is one longer the second one is shifted by one.  So each word is
    indexed by its two segments, and probes those of its own length and, at both places, those of the length below.
3.  Words that meet in a segment must differ by one edit in what is left of them, which is the same task for shorter strings.  A
    segment that very many words share is therefore cut again, and its words meet in a segment of their rest, until few pairs are
    left to a key or the rest is one letter.  No pair is lost and no key gathers pairs without limit.
4.  Candidates are verified on the whole words, and a pair that met in both segments counts once.
5.  A word's form is its near word of largest count if that is at least ``RATIO`` times its own.  Counts grow along forms, so following
    them ends; it is done by doubling: each round goes twice as far.

Lengths, places and order are those of code points.

Cases: a null or empty text has no words; a null id counts as an empty one in the checksum.  Repeated rows count each.  An empty table, or one
without words that are frequent enough, gives an empty result.  A run of letters of any length is a word like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

LETTERS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: A key with more pairs than this is cut again.
KEY_PAIRS = 10_000


def with_slips(doc_id: Column, word: Column, every: int = 97) -> Column:
    """``word``, or ``word`` without one letter: a checksum of document and word decides whether, and which."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word).cast("bigint")).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slips: int | None = None) -> DataFrame:
    """(word, n): words of whole texts with A-Z in lower case, how often each occurs.  ``slips``: one of so many loses a letter, see :func:`with_slips`."""
    runs = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).where(F.length("run") >= least_letters)
    word = F.col("run") if slips is None else with_slips(F.col("doc_id"), F.col("run"), slips)
    return rows.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _whole(words: DataFrame) -> DataFrame:
    """Words before any cut: each under its own length, and as one that is a letter longer under the length below."""
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    return rows.select("word", "n", "longer", F.xxhash64(F.length("word") - F.col("longer")).alias("key"), F.col("word").alias("rest"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice: under the first segment of its rest and under the second one, with what is left."""
    rows = rows.withColumn("__half", F.expr("cast((length(rest) - longer) div 2 AS int)"))
    part = lambda k, segment, rest: F.struct(F.xxhash64("key", F.lit(k), F.expr(segment)).alias("key"), F.expr(rest).alias("rest"))
    both = F.array(
        part(0, "substring(rest, 1, __half)", "substring(rest, __half + 1, length(rest))"),
        part(1, "substring(rest, __half + longer + 1, length(rest))", "substring(rest, 1, __half + longer)"),
    )
    return rows.select("word", "n", "longer", F.explode(both).alias("p")).select("word", "n", "longer", "p.key", "p.rest")


def _meet(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs at one edit among the rows of each key; a is the shorter one, or the first of two equally long ones."""
    a = rows.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = a.join(b, "key").where((F.col("longer") == 1) | (F.col("a") < F.col("b")))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words`` (word, n; each word once) that one inserted, deleted or replaced code point tells apart."""
    rows = materialise(_cut(_whole(words)), "segments")
    found = []
    while True:
        of = rows.groupBy("key").agg(F.count_if(F.col("longer") == 0).alias("x"), F.sum("longer").alias("y"), F.min(F.length("rest") - F.col("longer")).alias("left"))
        of = of.where((F.col("x") > 0) & (F.col("x") + F.col("y") > 1))
        crowded = (F.col("x") * (F.col("x") - 1) / 2 + F.col("x") * F.col("y") > key_pairs) & (F.col("left") > 1)
        of = materialise(of.select("key", crowded.alias("crowded")), "keys")
        found.append(_meet(rows.join(of.where(~F.col("crowded")).select("key"), "key", "left_semi")))
        if not of.where("crowded").take(1):
            break
        rows = materialise(_cut(rows.join(of.where("crowded").select("key"), "key", "left_semi")), "segments")
    return materialise(reduce(DataFrame.unionByName, found).distinct(), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form), which have no cycle, ends."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        far = materialise(now.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "roots")
        if not far.where("moved").take(1):
            return far.drop("moved")
        now = far.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n): the form it is a variant of, and where forms end."""
    words = materialise(words.select("word", "n"), "words")
    pairs = near_pairs(words, key_pairs)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    of = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    of = materialise(of.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    end = roots(of.where("form is not null"))
    out = words.join(of, "word", "left").join(end, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
