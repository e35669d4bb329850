"""Waveforms and spectrograms as flat arrays: cropping, padding, patches, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """A double to ``digits`` decimals as SQL engines do it that scale, round and scale back: halves away from zero, and what becomes zero keeps its sign."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.round(x * 10.0**digits, 0) / 10.0**digits
    return F.when(near == 0, x * 0.0).otherwise(near)


def zeros(like: Column, n: Column) -> Column:
    """``n`` zeros (none if negative), to stand beside ``like``."""
    return F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n, F.lit(0)).cast("int"))


def center_crop(a: Column, n: int) -> Column:
    """The middle ``n`` values, or all with zeros on both sides, the odd one on the right."""
    left = F.floor((n - F.size(a)) / 2)
    padded = F.concat(zeros(a, left), a, zeros(a, n - F.size(a) - left))
    return F.when(F.size(a) >= n, F.slice(a, F.floor((F.size(a) - n) / 2).cast("int") + 1, n)).otherwise(padded)


def crop_or_pad(a: Column, start: Column, n: int) -> Column:
    """``n`` values from ``start`` on; a shorter array keeps all and gets zeros on the right."""
    return F.when(F.size(a) >= n, F.slice(a, start.cast("int") + 1, n)).otherwise(F.concat(a, zeros(a, n - F.size(a))))


def truncate(a: Column, n: int, mode: str, draw: Column | None = None) -> Column:
    """``n`` values from the start, the end, or a place chosen by ``draw`` (a whole number); short ones are padded right."""
    spare = F.greatest(F.size(a) - n, F.lit(0))
    start = {"start": F.lit(0), "end": spare}.get(mode)
    if start is None:
        start = F.when(spare > 0, F.pmod(draw, F.greatest(spare, F.lit(1)))).otherwise(F.lit(0))
    return crop_or_pad(a, start, n)


def mono(a: Column, channels: Column) -> Column:
    """The mean over interleaved channels; a part of a frame at the end is left out."""
    frames = F.floor(F.size(a) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(a, (i * channels).cast("int") + 1, channels.cast("int")), F.lit(0.0), lambda s, x: s + x) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mean)).otherwise(F.array().cast("array<double>"))


def frames(a: Column, window: int, hop: int) -> Column:
    """Whole windows of ``window`` values every ``hop``."""
    n = F.floor((F.size(a) - window) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(a, i * hop + 1, window))).otherwise(F.array().cast("array<array<float>>"))


def patchify(a: Column, height: int, width: int, ph: int, pw: int) -> Column:
    """Patches of a row-major image, by rows: structs of row, column and pixels."""
    if height % ph or width % pw:
        raise ValueError("patches must divide the image")
    across = width // pw

    def patch(i: Column) -> Column:
        row, col = F.floor(i / across).cast("int"), (i % across).cast("int")
        line = lambda k: F.slice(a, ((row * ph + k) * width + col * pw + 1).cast("int"), pw)
        return F.struct(row.alias("row"), col.alias("col"), F.flatten(F.array(*(line(k) for k in range(ph)))).alias("px"))

    return F.transform(F.sequence(F.lit(0), F.lit(height // ph * across - 1)), patch)


def unpatchify(patches: Column, height: int, width: int, ph: int, pw: int) -> Column:
    """The row-major image of all patches."""
    across = width // pw

    def line(y: Column) -> Column:
        first = F.floor(y / ph).cast("int") * across
        piece = lambda c: F.slice(patches[first + c]["px"], ((y % ph) * pw + 1).cast("int"), pw)
        return F.flatten(F.array(*(piece(c) for c in range(across))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), line))


def active_segments(a: Column, active: Column, per_time: int = 8, samples: int = 5120) -> Column:
    """The samples of the time steps of which any patch is active, joined; patch i lies at time i div ``per_time``."""
    times = F.sequence(F.lit(0), F.floor((F.size(active) - 1) / per_time).cast("int"))
    on = F.filter(times, lambda t: F.exists(F.slice(active, t * per_time + 1, per_time), lambda x: x))
    return F.flatten(F.transform(on, lambda t: F.slice(a, t * samples + 1, samples)))


def visible(patches: Column, masked: Column) -> Column:
    """The patches that are not masked, in their order."""
    kept = F.filter(F.arrays_zip(patches.alias("p"), masked.alias("m")), lambda t: ~t["m"])
    return F.transform(kept, lambda t: t["p"])


def lowest(priorities: Column, n: int) -> Column:
    """The places of the ``n`` least values, ascending; of equal ones the first."""
    order = F.array_sort(F.transform(priorities, lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(order, 1, n), lambda t: t["i"]))


def mean_pool(tokens: Column, size: int) -> Column:
    """The mean of an array of tokens of ``size`` values each."""
    total = lambda k: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + t[k])
    return F.array(*(total(k) / F.size(tokens) for k in range(size)))


def layer_norm(x: Column, eps: float = 1e-6) -> Column:
    """Values less their mean, over their population deviation."""
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  a value that is computed once, not for each item
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    spread = lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / n + eps)
    return once(mean, lambda m: once(spread(m), lambda d: F.transform(x, lambda v: (v - m) / d)))


def mel(hz: Column, natural: bool = True) -> Column:
    """Mel of a frequency: 1127 ln(1 + f / 700), or 2595 log10(1 + f / 700)."""
    return F.lit(1127.0) * F.log1p(hz / 700) if natural else F.lit(2595.0) * F.log10(1 + hz / 700)


def gray(rgb: Column, mean: float = 0.4914, std: float = 0.2470) -> Column:
    """Standardised luminance of interleaved 8-bit RGB values."""
    n = F.floor(F.size(rgb) / 3).cast("int")
    value = lambda i: ((0.299 * rgb[i * 3] + 0.587 * rgb[i * 3 + 1] + 0.114 * rgb[i * 3 + 2]) / 255 - mean) / std
    return F.transform(F.sequence(F.lit(0), n - 1), value)


def masked_error(predicted: Column, actual: Column, masked: Column, eps: float = 1e-6) -> Column:
    """Mean squared error over masked patches of arrays of patches; actual ones are standardised each."""

    def standard(p: Column) -> Column:
        n = F.size(p)
        mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / n
        var = F.aggregate(p, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
        return F.transform(p, lambda x: (x - mean) / F.sqrt(var + eps))

    error = lambda p, q: F.aggregate(F.zip_with(p, standard(q), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(p)
    on = F.filter(F.arrays_zip(predicted.alias("p"), actual.alias("q"), masked.alias("m")), lambda t: t["m"])
    return F.aggregate(on, F.lit(0.0), lambda s, t: s + error(t["p"], t["q"])) / F.greatest(F.size(on), F.lit(1))
