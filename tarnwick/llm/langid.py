"""Language identification by prediction by partial matching.

For each language a byte context tree of order 3 is counted on labelled texts and then frozen.  A
byte's code length is that of escape method C: in a context seen ``n`` times with ``t`` different
bytes after it, a byte seen ``c`` times costs ``log2((n + t) / c)`` bits, and a new one costs
``log2((n + t) / t)`` bits to escape to the context one byte shorter; below order 0 all 256 bytes
cost 8 bits.  A context never seen is left free of charge.  The language with the shortest code for
the whole text wins; ``score`` is its posterior under equal priors, and ``bits_per_byte`` and ``margin_per_byte`` are its mean
code length and how much longer the next one's is, which do not saturate with a text's length.

Cases: a null text, or one without a letter, is ``und`` with score 0.  Equal code lengths go to the
language first in order.  Without labelled texts every text is ``und``.  Repeated rows are each
answered; rows with a null ``doc_id`` are never learned from and are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .textbuf import LOWER, blocks, sums

ORDER = 3
#: Rows of a sample's keys that may be broadcast (16 MB at most).
SMALL = 200_000


def grams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text, the byte itself lowest; 0 stands before a text."""
    g = raw.astype(np.uint32)
    out = g.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= g[:-k] << np.uint32(8 * k)
    for k in range(ORDER):
        at = off[:-1][np.diff(off) > k] + k
        out[at] &= np.uint32((1 << 8 * (k + 1)) - 1)
    return out


class HashTable:
    """Open addressing for 32-bit keys; ``find`` gives each key's row, or the number of keys if absent."""

    def __init__(self, keys: np.ndarray):
        self.n, self.bits = len(keys), max(4, int(3 * len(keys) + 1).bit_length())
        self.row = np.full(1 << self.bits, self.n, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.row[slot] == self.n
            self.row[slot[free]] = left[free]
            self.key[slot[free]] = keys[left[free]]
            lost = self.row[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        row = self.row[slot]
        on = np.flatnonzero((row != self.n) & (self.key[slot] != keys))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            row[on] = self.row[slot]
            more = (self.row[slot] != self.n) & (self.key[slot] != keys[on])
            on, slot = on[more], slot[more]
        return row


@dataclass
class Model:
    """Frozen code lengths of all languages, by level: whole grams, and the escape from each context."""

    langs: list[str]
    tables: list[HashTable]
    codes: list[np.ndarray]
    context_tables: list[HashTable]
    escapes: list[np.ndarray]

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte in each language."""
        row = self.tables[0].find(g)
        out = self.codes[0][row]
        miss = np.flatnonzero(row == len(self.codes[0]) - 1)
        cost = np.zeros((len(miss), len(self.langs)), np.float32)
        for level in range(ORDER):
            if not len(miss):
                break
            keep = 8 * (ORDER - level)
            short = g[miss] & np.uint32((1 << keep) - 1)
            context = (g[miss] >> np.uint32(8)) & np.uint32((1 << keep) - 1)
            cost += self.escapes[level][self.context_tables[level].find(context)]
            row = self.tables[level + 1].find(short)
            hit = row != len(self.codes[level + 1]) - 1
            out[miss[hit]] = cost[hit] + self.codes[level + 1][row[hit]]
            miss, cost = miss[~hit], cost[~hit]
        if len(miss):
            out[miss] = cost + self.escapes[ORDER] + np.float32(8)
        return out


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Freeze a model from each language's grams (of four bytes) and their counts."""
    langs = sorted(counts)
    by_level = []
    for level in range(ORDER + 1):
        mask = np.uint32((1 << 8 * (ORDER + 1 - level)) - 1) if level else np.uint32(0xFFFFFFFF)
        by_level.append([_summed(counts[x][0] & mask, counts[x][1]) for x in langs])
    contexts = [[_context(*x) for x in one] for one in by_level]  # (contexts, n, t)
    keys = [_union([x[0] for x in one]) for one in by_level]
    context_keys = [_union([x[0] for x in one]) for one in contexts]
    codes, escapes = [], []
    for level in range(ORDER + 1):
        out = np.zeros((len(context_keys[level]) + 1, len(langs)), np.float32)
        for k, (c, n, t) in enumerate(contexts[level]):
            out[np.searchsorted(context_keys[level], c), k] = np.log2((n + t) / t)
        escapes.append(out if level < ORDER else out[0])
    for level in range(ORDER, -1, -1):
        out = np.zeros((len(keys[level]) + 1, len(langs)), np.float32)
        key = keys[level]
        if level < ORDER:  # what a byte not seen here costs: escape, then one order less
            rest = np.searchsorted(keys[level + 1], key & np.uint32((1 << 8 * (ORDER - level)) - 1))
            place = np.searchsorted(context_keys[level], key >> np.uint32(8))
            out[:-1] = escapes[level][place] + codes[0][rest]
        else:
            out[:-1] = escapes[level] + np.float32(8)
        for k, ((g, c), (context, n, t)) in enumerate(zip(by_level[level], contexts[level], strict=True)):
            of = np.searchsorted(context, g >> np.uint32(8))
            out[np.searchsorted(key, g), k] = np.log2((n[of] + t[of]) / c)
        codes.insert(0, out)
    return Model(langs, [HashTable(k) for k in keys], codes, [HashTable(k) for k in context_keys[:ORDER]], escapes)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u))


def _context(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, at = np.unique(g >> np.uint32(8), return_inverse=True)
    return u, np.bincount(at, weights=c, minlength=len(u)), np.bincount(at, minlength=len(u)).astype(float)


def _union(arrays: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(arrays)).astype(np.uint32)


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are at most ``SMALL``."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def train(docs: DataFrame, max_docs: int = 1500) -> Model | None:
    """Count grams on about ``max_docs`` labelled texts a language: those whose hashed ``doc_id`` is below a share.

    The bound holds at every input size; the counts are summed by Spark, and their number is bounded
    by the bytes of the sample.
    """
    rows = docs.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    ids = rows.select("doc_id", "lang").join(_small(sizes), "lang").where(place < max_docs / F.col("n")).select("doc_id", "lang").distinct()
    sample = rows.join(_small(materialise(ids, "sample")), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            lang = np.array(batch["lang"].to_pylist(), object)
            for at, raw, off in blocks(batch["text"]):
                g = grams(LOWER[raw], off)
                own = np.repeat(lang[at : at + len(off) - 1], np.diff(off))
                for x in set(lang[at : at + len(off) - 1]):
                    u, c = np.unique(g[own == x], return_counts=True)
                    total.setdefault(x, []).append((u, c.astype(float)))
            for x, parts in total.items():
                total[x] = [_summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
        for x, ((u, c),) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    got = sample.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(got["lang"].to_pylist(), object)
    gram, n = got["gram"].to_numpy().astype(np.uint32), got["n"].to_numpy().astype(float)
    return build({x: (gram[lang == x], n[lang == x]) for x in sorted(set(lang))}) if len(gram) else None


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns ``keep``, ``lang_pred``, ``score``, ``bits_per_byte`` and ``margin_per_byte`` for the whole ``text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = np.array(batch["__letter"].to_pylist(), bool)
            for at, raw, off in blocks(batch["__text"], 1 << 20):
                n = len(off) - 1
                if model is None:
                    best, p, length, margin = np.zeros(n, int), *np.zeros((3, n))
                else:
                    total = sums(model.bits(grams(LOWER[raw], off)), off)
                    best = total.argmin(axis=1)
                    length = total.min(axis=1) / np.maximum(np.diff(off), 1)
                    second = np.partition(total, 1, axis=1)[:, 1] if total.shape[1] > 1 else total[:, 0]
                    margin = second / np.maximum(np.diff(off), 1) - length
                    p = 1 / np.exp2(np.minimum(total.min(axis=1, keepdims=True) - total, 0)).sum(axis=1)
                ok = letter[at : at + n] & (model is not None)
                names = [*(model.langs if model else []), "und"]
                pred = pa.array([names[k] for k in np.where(ok, best, len(names) - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, n) for c in keep), pred, *(pa.array(np.where(ok, x, 0.0)) for x in (p, length, margin))], names=[*keep, "lang_pred", "score", "bits_per_byte", "margin_per_byte"])

    schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep) + "lang_pred string, score double, bits_per_byte double, margin_per_byte double"
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    return docs.select(*keep, F.col("text").alias("__text"), letter).mapInArrow(run, schema)


def identify(docs: DataFrame, max_docs: int = 1500, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the rows that are not held out, then answer for every row."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    held = F.coalesce(crc == 0, F.lit(False))
    return predict(docs, train(docs.where(crc != 0), max_docs), *keep).select(*keep, held.alias("held_out"), "lang_pred", "score", "bits_per_byte", "margin_per_byte")
