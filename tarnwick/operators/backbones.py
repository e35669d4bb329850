"""Encoders by name, and a linear probe on what they give."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Loaders of encoders [rows, values] -> [rows, size], by name; a loader takes the checkpoint's name.
_LOADERS: dict[str, Callable[[str], Callable[[np.ndarray], np.ndarray]]] = {}


def register(name: str, loader: Callable[[str], Callable[[np.ndarray], np.ndarray]]) -> None:
    """Add an encoder; one of the same name is replaced with a warning."""
    if name in _LOADERS:
        warnings.warn(f"{name} is registered already and is replaced", stacklevel=2)
    _LOADERS[name] = loader


def names() -> list[str]:
    """The registered encoders."""
    return sorted(_LOADERS)


def loader(name: str) -> Callable[[str], Callable[[np.ndarray], np.ndarray]]:
    """The loader of an encoder; an unknown name is an error."""
    if name not in _LOADERS:
        raise KeyError(f"{name} is none of {', '.join(names())}")
    return _LOADERS[name]


def patch_projection(weights: Callable[[str], np.ndarray]) -> Callable[[str], Callable[[np.ndarray], np.ndarray]]:
    """A loader of linear projections of patches, averaged over the patches; ``weights`` gives [values of a patch, size] for a checkpoint's name."""

    def load(checkpoint: str) -> Callable[[np.ndarray], np.ndarray]:
        w = weights(checkpoint)

        def encode(x: np.ndarray) -> np.ndarray:
            x = np.pad(x, ((0, 0), (0, -x.shape[1] % len(w))))
            return x.reshape(len(x), -1, len(w)).mean(axis=1) @ w

        return encode

    return load


register("patch_mean", patch_projection(lambda checkpoint: np.random.default_rng(sum(map(ord, checkpoint))).standard_normal((16, 32)) / 4))
register("identity", lambda checkpoint: lambda x: x)


def encoded(name: str, checkpoint: str, values: str | Column) -> Column:
    """An array column through an encoder that each task loads once; rows of one batch must be of one length."""
    load = loader(name)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(checkpoint)
        for batch in batches:
            yield pd.Series(list(encode(np.stack(batch.to_list()).astype(float))), index=batch.index) if len(batch) else pd.Series([], dtype=object)

    return run(values)


def fit_linear(features: DataFrame, size: int, classes: int, rounds: int = 30, rate: float = 1.0, decay: float = 1e-4, vector: str = "embedding", label: str = "label") -> np.ndarray:
    """Weights [classes, size + 1] of independent logistic classifiers, by full-batch descent.

    A round is one job: every partition sums its gradient, and the sums, of the weights' fixed size, are added by
    Spark before they reach the driver.
    """
    rows = features.select(vector, F.col(label).cast("int").alias("y")).where(F.col(vector).isNotNull() & F.col("y").isNotNull())
    total, weights, speed = rows.count(), np.zeros((classes, size + 1)), np.zeros((classes, size + 1))
    parts = max(1, min(64, rows.rdd.getNumPartitions()))
    rows = rows.coalesce(parts)
    for _ in range(rounds if total else 0):

        def run(batches: Iterator[pa.RecordBatch], w=weights) -> Iterator[pa.RecordBatch]:
            g = np.zeros_like(w)
            for batch in batches:
                x = np.column_stack([np.array(batch[vector].to_pylist(), float).reshape(len(batch), size), np.ones(len(batch))])
                hot = np.arange(classes) == batch["y"].to_numpy()[:, None]
                g += (1 / (1 + np.exp(-x @ w.T)) - hot).T @ x
            yield pa.RecordBatch.from_arrays([pa.array(range(classes)), pa.array(g.tolist(), pa.list_(pa.float64()))], names=["c", "g"])

        sums = rows.mapInArrow(run, "c bigint, g array<double>").groupBy("c").agg(*(F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(size + 1)))
        got = sums.toPandas().sort_values("c")
        speed = 0.9 * speed - rate * (got[[f"g{i}" for i in range(size + 1)]].to_numpy() / total + decay * weights)
        weights = weights + speed
    return weights


def gelu(x: np.ndarray) -> np.ndarray:
    """The Gaussian error linear unit, by the usual approximation with a hyperbolic tangent."""
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def _mlp(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Normalised input, hidden values before and after the unit, and logits."""
    norm = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-6)
    pre = norm @ w["a"] + w["a0"]
    hidden = gelu(pre)
    return norm, pre, hidden, hidden @ w["b"] + w["b0"]


def fit_mlp(features: DataFrame, size: int, classes: int, hidden: int = 32, rounds: int = 60, rate: float = 0.02, seed: int = 1, vector: str = "embedding", label: str = "label") -> dict[str, np.ndarray]:
    """Weights of independent logistic classifiers on one hidden layer over normalised vectors, by full-batch steps with adaptive moments.

    A round is one job, as in :func:`fit_linear`: gradients of the weights' fixed size are summed by Spark.
    """
    r = np.random.default_rng(seed)
    w = {"a": r.standard_normal((size, hidden)) / np.sqrt(size), "a0": np.zeros(hidden), "b": r.standard_normal((hidden, classes)) / np.sqrt(hidden), "b0": np.zeros(classes)}
    rows = features.select(vector, F.col(label).cast("int").alias("y")).where(F.col(vector).isNotNull() & F.col("y").isNotNull())
    total = rows.count()
    rows = rows.coalesce(64)
    m, s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for t in range(1, rounds + 1 if total else 1):

        def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            g = {k: np.zeros_like(x) for k, x in w.items()}
            for batch in batches:
                x = np.array(batch[vector].to_pylist(), float).reshape(len(batch), size)
                norm, pre, up, z = _mlp(w, x)
                dz = 1 / (1 + np.exp(-z)) - (np.arange(classes) == batch["y"].to_numpy()[:, None])
                u = np.sqrt(2 / np.pi) * (pre + 0.044715 * pre**3)
                slope = 0.5 * (1 + np.tanh(u)) + 0.5 * pre * (1 - np.tanh(u) ** 2) * np.sqrt(2 / np.pi) * (1 + 3 * 0.044715 * pre**2)
                dp = (dz @ w["b"].T) * slope
                for k, d in (("a", norm.T @ dp), ("a0", dp.sum(axis=0)), ("b", up.T @ dz), ("b0", dz.sum(axis=0))):
                    g[k] += d
            flat = np.concatenate([g[k].ravel() for k in w])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "g"])

        got = rows.mapInArrow(run, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy() / total
        at = 0
        for k, x in w.items():
            g = got[at : at + x.size].reshape(x.shape)
            at += x.size
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.95 * s[k] + 0.05 * g * g
            w = w | {k: w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.95**t)) + 1e-8)}
    return w


def mlp_scores(features: DataFrame, weights: dict[str, np.ndarray], vector: str = "embedding") -> DataFrame:
    """Each row with every class and its ``score`` under an MLP probe."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def logits(x: pd.Series) -> pd.Series:
        return pd.Series(list(_mlp(weights, np.stack(x.to_list()).astype(float))[3])) if len(x) else pd.Series([], dtype=object)

    return features.select("*", F.posexplode(logits(vector)).alias("class_id", "score"))


def linear_scores(features: DataFrame, weights: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Each row with every class and its ``score`` under a linear probe."""
    table = F.array(*(F.array(*map(F.lit, w.tolist())) for w in weights))
    x = F.concat(F.transform(vector, lambda v: v.cast("double")), F.array(F.lit(1.0)))
    score = F.transform(table, lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return features.select("*", F.posexplode(score).alias("class_id", "score"))
