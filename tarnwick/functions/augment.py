"""Augmentations of two-dimensional examples, seeded by key so that any partitioning gives the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def _zoom(x: np.ndarray, h: int, w: int) -> np.ndarray:
    y, z = (np.linspace(0, n - 1, m) for n, m in zip(x.shape, (h, w), strict=True))
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(z0 + 1, x.shape[1] - 1)
    a, b = (y - y0)[:, None], z - z0
    return (x[np.ix_(y0, z0)] * (1 - b) + x[np.ix_(y0, z1)] * b) * (1 - a) + (x[np.ix_(y1, z0)] * (1 - b) + x[np.ix_(y1, z1)] * b) * a


def resized(x: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    """A part of ``x`` drawn out to its whole size, linearly between values."""
    return _zoom(x[top : top + height, left : left + width], *x.shape)


def adjusted(x: np.ndarray, brightness: float, contrast: float) -> np.ndarray:
    """Values times ``brightness``, then their distance from the mean times ``contrast``."""
    x = x * brightness
    return (x - x.mean()) * contrast + x.mean()


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means of neighbours up to four deviations away; edges are reflected."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        x = np.apply_along_axis(np.convolve, axis, np.pad(x, pad, mode="symmetric"), kernel, "valid")
    return x


def random_crop(padding: int = 4) -> Step:
    def step(x, r):
        y, z = r.integers(0, 2 * padding + 1, 2)
        return np.pad(x, padding)[y : y + x.shape[0], z : z + x.shape[1]]

    return step


def flip(p: float = 0.5) -> Step:
    return lambda x, r: x[:, ::-1] if r.random() < p else x


def noise(std: float = 0.1) -> Step:
    return lambda x, r: x + std * r.standard_normal(x.shape)


def _stripes(axis: int, max_width: int, n: int) -> Step:
    def step(x, r):
        x = x.copy()
        lines = np.moveaxis(x, axis, 0)
        for _ in range(n):
            width = min(int(r.integers(0, max_width + 1)), len(lines))
            start = int(r.integers(0, len(lines) - width + 1))
            lines[start : start + width] = 0
        return x

    return step


def freq_mask(max_width: int = 10, n_masks: int = 2) -> Step:
    return _stripes(0, max_width, n_masks)


def time_mask(max_width: int = 20, n_masks: int = 2) -> Step:
    return _stripes(1, max_width, n_masks)


def resized_crop(low: float = 0.08, high: float = 1.0, narrow: float = 0.75, wide: float = 1.333, tries: int = 10) -> Step:
    def step(x, r):
        h, w = x.shape
        for _ in range(tries):
            area, aspect = h * w * r.uniform(low, high), np.exp(r.uniform(np.log(narrow), np.log(wide)))
            ch, cw = int(round(np.sqrt(area / aspect))), int(round(np.sqrt(area * aspect)))
            if 0 < ch <= h and 0 < cw <= w:
                return resized(x, r.integers(0, h - ch + 1), r.integers(0, w - cw + 1), ch, cw)
        return x

    return step


def jitter(brightness: float = 0.8, contrast: float = 0.8) -> Step:
    return lambda x, r: adjusted(x, r.uniform(max(0, 1 - brightness), 1 + brightness), r.uniform(max(0, 1 - contrast), 1 + contrast))


def blur(low: float = 0.1, high: float = 2.0) -> Step:
    return lambda x, r: blurred(x, r.uniform(low, high))


def solarize(threshold: float = 0.5, p: float = 0.2) -> Step:
    return lambda x, r: np.where(x > threshold, 1 - x, x) if r.random() < p else x


def apply_steps(x: np.ndarray, steps: list[Step], seed: int) -> np.ndarray:
    """``x`` after all steps from left to right."""
    r = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    for step in steps:
        x = step(x, r)
    return x


def augmented(steps: list[Step], height: int, width: int, kind: str = "float") -> Callable[[Column, Column], Column]:
    """A column function of (flat row-major array, whole-number seed), giving arrays of ``kind``."""
    number = {"float": np.float32, "double": np.float64}[kind]

    @F.arrow_udf(f"array<{kind}>")
    def run(values: pa.Array, seeds: pa.Array) -> pa.Array:
        flat, off, none = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy(), values.is_null().to_numpy(zero_copy_only=False)
        out = [np.empty(0, number)]  # rows lie in one buffer, without an object for each value that goes in
        ends = np.zeros(len(values) + 1, np.int32)
        for i, seed in enumerate(seeds.to_pylist()):
            if not none[i]:
                out.append(apply_steps(np.asarray(flat[off[i] : off[i + 1]], float).reshape(height, width), steps, seed).astype(number).ravel())
                ends[i + 1] = len(out[-1])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(np.concatenate(out)), mask=pa.array(none))

    return run
