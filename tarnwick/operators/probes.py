"""Linear and one-hidden-layer probes on embeddings, trained as defined: asymmetric loss, seeded mini-batches, clipped gradients, decoupled weight decay.

An epoch deals rows to batches by a keyed permutation, writes them once in batch order, and takes a step for each batch.  A step is one job that reads the
files of its batch; partitions sum the batch's gradient, and what reaches the driver is one number for each weight.  The steps of one training follow each
other by their nature; what grows with the data is the length of an epoch, never what a step holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import forget, written
from . import ordered
from .sampling import mini_batches

#: The defaults of the loss, the optimiser, the starting weights' deviation and the norm's least variance.
MINUS, PLUS, SHIFT, EPS = 4.0, 1.0, 0.05, 1e-8
RATE, DECAY, CLIP, BETAS, EPOCHS, BATCH = 4e-4, 3e-4, 2.0, (0.9, 0.95), 30, 64
START, NORM_EPS = 0.02, 1e-6

Weights = dict[str, np.ndarray]


def linear_probe(size: int, classes: int, seed: int = 0) -> Weights:
    """Starting weights: a norm over the vector with scales and shifts, then one linear layer."""
    r = np.random.default_rng(seed)
    return {"scale": np.ones(size), "shift": np.zeros(size), "w": r.standard_normal((classes, size)) * START, "b": np.zeros(classes)}


def mlp_probe(size: int, classes: int, seed: int = 0, hidden: int | None = None) -> Weights:
    """Starting weights: a norm, a hidden layer of twice the size unless given, the Gaussian error unit, and a linear layer."""
    r, hidden = np.random.default_rng(seed), hidden or 2 * size
    first = {"scale": np.ones(size), "shift": np.zeros(size), "w1": r.standard_normal((hidden, size)) * START, "b1": np.zeros(hidden)}
    return first | {"w": r.standard_normal((classes, hidden)) * START, "b": np.zeros(classes)}


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Gaussian error unit by its usual approximation, and its slope."""
    k = np.sqrt(2 / np.pi)
    t = np.tanh(k * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * k * (1 + 3 * 0.044715 * x * x)


def forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Logits [rows, classes], and what the gradient needs."""
    normal = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + NORM_EPS)
    at = {"normal": normal, "in": normal * w["scale"] + w["shift"]}
    last = at["in"]
    if "w1" in w:
        last, at["slope"] = _unit(last @ w["w1"].T + w["b1"])
    at["last"] = last
    return last @ w["w"].T + w["b"], at


def loss_and_slope(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The asymmetric loss of each logit ``z`` for targets ``y`` (0 or 1), and its derivative."""
    p = 1 / (1 + np.exp(-z))
    q = np.minimum(1 - p + SHIFT, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.log(np.maximum(p, EPS))
        miss = np.log(np.maximum(q, EPS))
        up = -np.where(p > EPS, (1 - p) ** PLUS / p, 0) + hit * PLUS * (1 - p) ** (PLUS - 1)
        down = -np.where(q > EPS, (1 - q) ** MINUS / q, 0) + miss * MINUS * (1 - q) ** (MINUS - 1)
    down = np.where(q < 1, -down, 0)  # q falls as p rises, until it is cut
    loss = np.where(y == 1, -hit * (1 - p) ** PLUS, -miss * (1 - q) ** MINUS)
    return loss, np.where(y == 1, up, down) * p * (1 - p)


def gradient(w: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
    """Sums over rows of the derivatives of each row's summed loss."""
    z, at = forward(w, x)
    _, dz = loss_and_slope(z, y)
    g = {"w": dz.T @ at["last"], "b": dz.sum(axis=0)}
    back = dz @ w["w"]
    if "w1" in w:
        back = back * at["slope"]
        g |= {"w1": back.T @ at["in"], "b1": back.sum(axis=0)}
        back = back @ w["w1"]
    g |= {"scale": (back * at["normal"]).sum(axis=0), "shift": back.sum(axis=0)}
    return {k: g[k] for k in w}


class Adam:
    """Steps with adaptive moments, after clipping the norm of all gradients together; the decay of weights stands beside the moments, not in them."""

    def __init__(self, w: Weights, rate: float = RATE, decay: float = DECAY, clip: float = CLIP, betas: tuple[float, float] = BETAS):
        self.w, self.rate, self.decay, self.clip, self.betas, self.t = w, rate, decay, clip, betas, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, g: Weights) -> None:
        norm = np.sqrt(sum((x * x).sum() for x in g.values()))
        g = {k: x * min(1.0, self.clip / norm) if norm else x for k, x in g.items()}
        self.t += 1
        (a, b), new = self.betas, {}
        for k, x in self.w.items():
            self.m[k], self.s[k] = a * self.m[k] + (1 - a) * g[k], b * self.s[k] + (1 - b) * g[k] ** 2
            move = (self.m[k] / (1 - a**self.t)) / (np.sqrt(self.s[k] / (1 - b**self.t)) + EPS)
            new[k] = x - self.rate * (move + self.decay * x)
        self.w = new


def _hot(labels: pa.Array, classes: int) -> np.ndarray:
    """Targets [rows, classes] of class numbers, or of lists of them."""
    out = np.zeros((len(labels), classes))
    for row, y in zip(out, labels.to_pylist(), strict=True):
        row[y] = 1
    return out


def fit(
    features: DataFrame, weights: Weights, key: str, epochs: int = EPOCHS, batch: int = BATCH, seed: int = 42, rate: float = RATE, decay: float = DECAY, clip: float = CLIP,
    vector: str = "embedding", label: str = "label",
) -> Weights:
    """The weights after ``epochs`` epochs from ``weights``.

    ``key`` orders the rows, whose places in it the permutations of seed and epoch deal to batches; rows with a null vector or label take no part.  ``label``: a class
    number, or a list of them.
    """
    rows = features.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, vector, label)
    rows = written(ordered.numbered(rows, (key,), name="__row"), "probe")
    n, adam = rows.count(), Adam(weights, rate, decay, clip)
    classes, batch = len(weights["b"]), min(batch, n)
    for epoch in range(epochs if n else 0):
        dealt = mini_batches(rows, "__row", n, batch, seed, epoch).drop("slot", "__row", key)
        files = max(1, min(-(-n // batch), n // 4096))
        dealt = written(dealt.repartitionByRange(files, "batch_id").sortWithinPartitions("batch_id"), "epoch")
        for k in range(-(-n // batch)):

            def run(parts: Iterator[pa.RecordBatch], w=adam.w) -> Iterator[pa.RecordBatch]:
                g, seen = {name: np.zeros_like(x) for name, x in w.items()}, 0
                for part in parts:
                    if len(part):
                        x = np.stack([np.asarray(v, float) for v in part[vector].to_pylist()])
                        for name, d in gradient(w, x, _hot(part[label], classes)).items():
                            g[name] += d
                        seen += len(part)
                if seen:
                    flat = np.concatenate([x.ravel() for x in g.values()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "g"])

            of = dealt.where(F.col("batch_id") == k).select(vector, label).mapInArrow(run, "i bigint, g double")
            sums = of.groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
            many, at, g = min(batch, n - k * batch) * classes, 0, {}
            for name, x in adam.w.items():
                g[name] = sums[at : at + x.size].reshape(x.shape) / many  # the loss is a mean over rows and classes
                at += x.size
            adam.step(g)
        forget(dealt)
    forget(rows)
    return adam.w


def scores(features: DataFrame, weights: Weights, vector: str = "embedding") -> DataFrame:
    """Each row of ``features`` with every class and its ``score``, the probe's logit."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def logits(x: pd.Series) -> pd.Series:
        return pd.Series(list(forward(weights, np.stack(x.to_list()).astype(float))[0])) if len(x) else pd.Series([], dtype=object)

    return features.where(F.col(vector).isNotNull()).select("*", F.posexplode(logits(vector)).alias("class_id", "score"))
