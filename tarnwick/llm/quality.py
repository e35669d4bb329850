"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are hashed into ``2 ** bits`` coordinates: each word, each pair of neighbouring
words, and single, double and triple word *forms* (case, punctuation at the end, repetition of the
word before), so that unseen junk words still count.  A text's vector is the mean of its features.

Cases: a null text is an empty one; an empty text gets the score of the bias alone.  A null
``doc_id`` is never learned from and is not held out.  Repeated rows are scored each; a
``doc_id`` with several labels counts with its smallest.  Without any label, all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialise
from .textbuf import LOWER, SPACE, blocks, hashes, mix, sums, words

SCALE = 16.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def _features(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts of a block, and each text's first (one more at the end)."""
    start, end, first = words(raw, off)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    low = LOWER[raw]
    h = hashes(low, start, end)
    up = (raw >= 65) & (raw <= 90)
    up[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    mark = ((raw < 48) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | (raw > 122)) & (raw < 128)
    count = lambda x: np.add.reduceat(x.astype(np.int32), start)  # noqa: E731  what lies between words counts nowhere
    ups, marks = count(up), count(mark & ~SPACE[raw])
    head = np.zeros(len(start), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    again = np.zeros(len(start), bool)
    again[1:] = (h[1:] == h[:-1]) & ~head[1:]
    last = raw[end - 1]
    form = np.minimum(ups, 2) + 3 * np.minimum(marks, 4) + 15 * again
    form = form.astype(np.uint64) * np.uint64(256) + np.where(mark[end - 1], last, 0).astype(np.uint64)
    one = mix(form + np.uint64(1))
    shift = np.uint64(64 - bits)
    back = lambda x, k: np.concatenate([np.zeros(k, np.uint64), x[:-k]])[: len(x)]
    at = np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))
    b1, f1, f2 = back(h, 1), back(one, 1), back(one, 2)
    b1[at < 1] = 1
    f1[at < 1] = 1
    f2[at < 2] = 1
    odd = [np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in range(6)]
    out = np.empty((len(start), 5), np.int32)
    out[:, 0] = mix(h + odd[0]) >> shift
    out[:, 1] = mix(h * odd[1] + b1) >> shift
    out[:, 2] = mix(one + odd[2]) >> shift
    out[:, 3] = mix(one * odd[3] + f1) >> shift
    out[:, 4] = mix((one * odd[4] + f1) * odd[5] + f2) >> shift
    return out.reshape(-1), first * 5


def featurise(docs: DataFrame, bits: int, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``features``, the list of hashed feature numbers of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in blocks(batch["__text"]):
                idx, first = _features(raw, off, bits)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(idx))
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, n) for c in keep), lists], names=[*keep, "features"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", features array<int>"
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def fit_ftrl(features: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3) -> Model:
    """Follow-the-regularised-leader with a learning rate of its own for each coordinate."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def vector(idx):  # made anew in each epoch: only the feature numbers stay in memory
        u, c = np.unique(idx, return_counts=True)
        return np.append(u, size), np.append(c * (SCALE / max(1, len(idx))), 1.0)

    def weights(i):
        return np.where(np.abs(z[i]) > l1, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for idx, y in zip(features, labels, strict=True):
            i, x = vector(idx)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 6000, max_bytes: int = 1 << 26, bits: int = 18) -> Model:
    """Fit on at most ``max_docs`` labelled documents, those whose ``doc_id`` hashes lowest, and ``max_bytes`` of their texts.

    Texts of more than a 16th of ``max_bytes`` are left out.  The bounds hold at every input size, so what reaches the driver is bounded too.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
        .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("size") <= max_bytes // 16)
    )
    rows = materialise(rows, "sample")
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of max_docs narrow rows at most
    taken = rows.select("doc_id", "size").withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id")
    got = featurise(rows.join(F.broadcast(taken), "doc_id"), bits, "doc_id", "y").toArrow()
    order = np.argsort(_id_order(got["doc_id"].to_numpy()))
    y = got["y"].to_numpy()
    # views of what was received, not copies
    lists = [x.values.to_numpy()[a:b] for x in got["features"].chunks for off in [x.offsets.to_numpy()] for a, b in zip(off[:-1], off[1:], strict=True)]
    model = fit_ftrl([lists[k] for k in order], y[order], bits)
    del got, lists
    pa.default_memory_pool().release_unused()
    return model


def _id_order(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``score``, the probability of label 1 for the whole ``text``."""
    weights, bias, bits = model.weights, model.bias, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in blocks(batch["__text"]):
                idx, first = _features(raw, off, bits)
                dot = sums(weights[idx], first) * (SCALE / np.maximum(np.diff(first), 1))
                p = 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35)))
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, n) for c in keep), pa.array(p)], names=[*keep, "score"])

    schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep) + "score double"
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_docs: int = 6000, bits: int = 18, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on the labels that are not held out, then score every row of ``docs``.

    Returns ``keep`` plus ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).
    """
    rest = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = train(docs, rest, max_docs=max_docs, bits=bits)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return score(docs, model, *keep).select(
        *keep, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
