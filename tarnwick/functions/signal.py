"""Log-mel features, resampling and decoding of waveforms, as Arrow-batched functions."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from threading import get_ident

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flac import decode_flac

FLOATS = T.ArrayType(T.FloatType())
DECODED = T.StructType([
    T.StructField("samples", FLOATS), T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()),
])

#: Mean and twice the deviation by which log-mel features are standardised, and their frames.
FEATURE_MEAN, FEATURE_SPAN, FEATURE_FRAMES = -7.2, 4.43 * 2, 512


@lru_cache(8)
def mel_filters(n_fft: int, rate: int, n_mels: int, low: float = 20.0, high: float = 0.0) -> np.ndarray:
    """Triangles in mel space over the bins [n_mels, n_fft // 2 + 1]; the last bin gets nothing."""
    top = high + rate / 2 if high <= 0 else high
    to_mel = lambda f: 1127.0 * np.log1p(np.asarray(f) / 700.0)
    edges = np.linspace(to_mel(low), to_mel(top), n_mels + 2)
    at = to_mel(np.arange(n_fft // 2) * rate / n_fft)
    rise = (at - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - at) / np.diff(edges)[1:, None]
    return np.pad(np.maximum(0, np.minimum(rise, fall)), ((0, 0), (0, 1)))


#: Frames that are transformed at once, and bands of them that are one product of matrices.
FRAME_BLOCK, RUN_BANDS = 128, 16


@lru_cache(8)
def _band_runs(n_fft: int, rate: int, n_mels: int, low: float, high: float) -> list[tuple[slice, slice, np.ndarray]]:
    """The filters in runs of bands, each with the bins that it reaches: neighbours share their bins, and most of the whole matrix is zeros."""
    filters, out = mel_filters(n_fft, rate, n_mels, low, high), []
    for a in range(0, n_mels, RUN_BANDS):
        run = filters[a : a + RUN_BANDS]
        at = np.flatnonzero(run.any(axis=0))
        bins = slice(at[0], at[-1] + 1) if len(at) else slice(0, 0)
        out.append((slice(a, a + len(run)), bins, np.ascontiguousarray(run[:, bins])))
    return out


@lru_cache(8)
def _hann(window: int) -> np.ndarray:
    return np.hanning(window)


@lru_cache(8)
def _room(window: int, n_fft: int, thread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames, zero past their window, spectra and powers of a block, of one thread: memory that is mapped once, not for each recording."""
    bins = n_fft // 2 + 1
    return np.zeros((FRAME_BLOCK, n_fft)), np.empty((FRAME_BLOCK, bins), complex), np.empty((FRAME_BLOCK, bins))


def mel_power(x: np.ndarray, rate: int = 32000, window_ms: float = 25, hop_ms: float = 10, n_mels: int = 128, low: float = 20.0, high: float = 0.0, emphasis: float = 0.97, dither: float = 0.0, remove_mean: bool = True, energy: bool = False, seed: int = 0, raw_energy: bool = True) -> np.ndarray:
    """Energies [frames, n_mels] of one waveform in mel bands, the least of them the rounding of single precision; with ``energy`` the frame's own comes first.

    It is taken before the high frequencies are raised and the window is laid over, or after it without ``raw_energy``.
    """
    window, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    frames = mel_shape(len(x), rate, window_ms, hop_ms)[1]
    out = np.empty((energy + n_mels, frames))  # bands are written one after the other
    if not frames:
        return out.T
    n_fft, hann, noise = 1 << (window - 1).bit_length(), _hann(window), np.random.default_rng(seed) if dither else None
    runs, room = _band_runs(n_fft, rate, n_mels, low, high), _room(window, n_fft, get_ident())
    x = np.ascontiguousarray(x, np.float64)
    raised = x.copy()
    raised[1:] -= emphasis * x[:-1]  # but for the first sample of a frame, which has none before it
    for a in range(0, frames, FRAME_BLOCK):
        m = min(FRAME_BLOCK, frames - a)
        whole, spectra, power = (r[:m] for r in room)
        f = whole[:, :window]
        raw, high_raised = (np.ndarray((m, window), buffer=v, offset=8 * a * hop, strides=(8 * hop, 8)) for v in (x, raised))
        if noise:
            raw = raw + dither * noise.standard_normal(raw.shape)
            high_raised = np.pad(raw[:, 1:] - emphasis * raw[:, :-1], ((0, 0), (1, 0)))
        mean = raw.mean(axis=1, keepdims=True) if remove_mean else np.zeros((m, 1))
        if energy and raw_energy:
            out[0, a : a + m] = ((raw - mean) ** 2).sum(axis=1)
        np.subtract(high_raised, (1 - emphasis) * mean, out=f)
        f[:, 0] = (1 - emphasis) * (raw[:, 0] - mean[:, 0])
        f *= hann
        if energy and not raw_energy:
            out[0, a : a + m] = (f * f).sum(axis=1)
        np.fft.rfft(whole, axis=1, out=spectra)
        parts = spectra.view(np.float64)
        parts *= parts
        np.add(parts[:, ::2], parts[:, 1::2], out=power)
        bands = out[int(energy) :, a : a + m]
        for mels, bins, filters in runs:
            np.matmul(filters, power[:, bins].T, out=bands[mels])
    return np.maximum(out, np.finfo(np.float32).eps, out=out).T


def log_mel(x: np.ndarray, rate: int = 32000, window_ms: float = 25, hop_ms: float = 10, n_mels: int = 128, low: float = 20.0, high: float = 0.0, emphasis: float = 0.97, dither: float = 0.0, remove_mean: bool = True, energy: bool = False, seed: int = 0, raw_energy: bool = True, energy_last: bool = False) -> np.ndarray:
    """Log-mel energies [frames, n_mels] of one waveform, the logarithms of :func:`mel_power`; with ``energy`` the frame's log energy comes first, or last."""
    out = np.log(mel_power(x, rate, window_ms, hop_ms, n_mels, low, high, emphasis, dither, remove_mean, energy, seed, raw_energy))
    return (np.roll(out, -1, axis=1) if energy and energy_last else out).astype(np.float32)


def log_mel_range(x: np.ndarray, rate: int = 32000, **options) -> tuple[int, np.float32, np.float32]:
    """How many log-mel energies there are, the highest and the lowest; a logarithm rises with its number, so only these two are taken."""
    m = mel_power(x, rate, **options)
    top, low = np.log([m.max(), m.min()]).astype(np.float32)
    return m.size, top, low


#: The clip that is filtered (samples, rate), its transform (bins, hop, window), and its grid of patches.
FILTER_SAMPLES, FILTER_RATE, FILTER_FFT, FILTER_HOP, FILTER_WINDOW, FILTER_LOW = 160_000, 32_000, 1024, 320, 800, 20.0
FILTER_TIMES, FILTER_BANDS, FILTER_FRAMES = 32, 8, 16


def _periodic_hann(window: int, n_fft: int) -> np.ndarray:
    """A Hann window of ``window`` samples in the middle of ``n_fft``."""
    left = (n_fft - window) // 2
    return np.pad(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window), (left, n_fft - window - left))


def stft(x: np.ndarray, n_fft: int, hop: int, window: int) -> np.ndarray:
    """Spectra [frames, n_fft // 2 + 1] of frames around every ``hop``-th sample, under a Hann window; the ends are reflected."""
    padded = np.pad(np.asarray(x, np.float64), n_fft // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    return np.fft.rfft(frames * _periodic_hann(window, n_fft), axis=1)


def istft(spectra: np.ndarray, n_fft: int, hop: int, window: int, length: int) -> np.ndarray:
    """The signal of :func:`stft`: frames under the window again, added up, and divided by the sum of the squared windows there."""
    w = _periodic_hann(window, n_fft)
    frames = np.fft.irfft(spectra, n_fft, axis=1) * w
    total, weight = np.zeros(n_fft + hop * (len(frames) - 1)), np.zeros(n_fft + hop * (len(frames) - 1))
    many = -(-n_fft // hop)  # frames that lie over a sample
    for k in range(many):  # each many-th frame: these do not overlap by more than their hop's rest
        for at, frame in zip(range(k * hop, len(total) - n_fft + 1, many * hop), frames[k::many], strict=True):
            total[at : at + n_fft] += frame
            weight[at : at + n_fft] += w * w
    out = total[n_fft // 2 :][:length] / np.maximum(weight[n_fft // 2 :][:length], 1e-11)
    return np.pad(out, (0, length - len(out)))


@dataclass(frozen=True)
class PatchGrid:
    """A clip of ``samples`` at ``rate``, its transform, and its grid of patches: ``times`` of ``frames`` frames each, by ``bands`` from ``low`` to half the rate."""

    samples: int = FILTER_SAMPLES
    rate: int = FILTER_RATE
    n_fft: int = FILTER_FFT
    hop: int = FILTER_HOP
    window: int = FILTER_WINDOW
    low: float = FILTER_LOW
    times: int = FILTER_TIMES
    bands: int = FILTER_BANDS
    frames: int = FILTER_FRAMES


def mel_band_edges(bands: int = FILTER_BANDS, low: float = FILTER_LOW, high: float = FILTER_RATE / 2) -> np.ndarray:
    """The frequencies that cut ``low`` to ``high`` in bands equally wide on the decimal mel scale."""
    mel = np.linspace(2595 * np.log10(1 + low / 700), 2595 * np.log10(1 + high / 700), bands + 1)
    return 700 * (10 ** (mel / 2595) - 1)


def patch_mask(active: np.ndarray, frames: int, form: PatchGrid = PatchGrid()) -> np.ndarray:
    """Which bins of which frames [frames, bins] lie in an active patch: patch i is at time i div bands, band i mod bands; frames past the last time are in none."""
    grid = np.asarray(active, bool).reshape(form.times, form.bands)
    hz, edges = np.linspace(0, form.rate / 2, form.n_fft // 2 + 1), mel_band_edges(form.bands, form.low, form.rate / 2)
    band = np.searchsorted(edges, hz, side="right") - 1  # a band has its lower edge, not its upper one
    time = np.arange(frames) // form.frames
    inside = (time < form.times)[:, None] & ((band >= 0) & (band < form.bands))
    return grid[np.minimum(time, form.times - 1)][:, np.clip(band, 0, form.bands - 1)] & inside


def filter_audio(x: np.ndarray, active: np.ndarray, spectrum: bool = True, form: PatchGrid = PatchGrid()) -> np.ndarray:
    """The times of ``x`` with an active patch, one after the other; with ``spectrum`` only the mel bands of active patches are left in them.

    ``x``, at the rate of ``form`` (32 kHz), is filled up with zeros or cut to its samples (five seconds) first.
    """
    if len(active) != form.times * form.bands:
        raise ValueError(f"{form.times * form.bands} patches are needed")
    x = np.pad(np.asarray(x, np.float64)[: form.samples], (0, max(0, form.samples - len(x))))
    if spectrum:
        s = stft(x, form.n_fft, form.hop, form.window)
        x = istft(s * patch_mask(active, len(s), form), form.n_fft, form.hop, form.window, len(x))
    step = form.frames * form.hop
    times = np.flatnonzero(np.asarray(active, bool).reshape(form.times, form.bands).any(axis=1))
    return np.concatenate([np.zeros(0), *(x[t * step : (t + 1) * step] for t in times)]).astype(np.float32)


def mel_by_frame(x: np.ndarray, rate: int = 32000, **options) -> np.ndarray:
    """Log-mel energies [n_mels, frames]."""
    return log_mel(x, rate, **options).T


def mel_shape(n: int, rate: int = 32000, window_ms: float = 25, hop_ms: float = 10, n_mels: int = 128) -> tuple[int, int]:
    """The shape that :func:`mel_by_frame` gives for ``n`` samples."""
    window, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    return n_mels, 0 if n < window else 1 + (n - window) // hop


def clip_features(x: np.ndarray, rate: int = 32000, seconds: float = 5.0, center: bool = True, **options) -> np.ndarray:
    """Standardised log-mel features [512, n_mels] of a clip of fixed length; missing frames get the least value.

    Frames of nothing but the zeros after a short recording are all the same, unless there is dither: one is computed and repeated.
    """
    n = int(rate * seconds)
    window, hop = int(rate * options.get("window_ms", 25) / 1000), int(rate * options.get("hop_ms", 10) / 1000)
    _, frames = mel_shape(n, rate, options.get("window_ms", 25), options.get("hop_ms", 10))
    silent = -(-len(x) // hop)  # the first frame of zeros
    size = silent * hop + window if silent + 1 < frames and not options.get("dither") else n
    x = x[:n].astype(np.float32)
    mean = x.sum(dtype=np.float64) / n if center else 0.0
    centred = np.full(size, -mean)
    centred[: len(x)] += x
    m = log_mel(centred, rate, **options)[:FEATURE_FRAMES]
    least, m = ((v - FEATURE_MEAN) / FEATURE_SPAN for v in (m.min(initial=0.0), m))
    out = np.empty((FEATURE_FRAMES, m.shape[1]), np.float32)
    out[: len(m)], out[len(m) : frames], out[frames:] = m, m[-1:], least
    return out


def array_udf(f: Callable[..., np.ndarray], kind: str = "float") -> Callable[..., Column]:
    """A column function that applies ``f`` to waveforms (and more columns) of the type ``kind``, giving flat arrays of it."""
    number = {"float": np.float32, "double": np.float64}[kind]

    @F.pandas_udf(f"array<{kind}>")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else np.asarray(f(np.asarray(row[0], number), *row[1:]), number).ravel() for row in zip(*columns, strict=True)])

    return run


#: Taps of the resampler, places between two samples for which they are tabled, and the share of the lower rate's band that passes.
SINC_TAPS, SINC_PLACES, SINC_CUT = 256, 256, 0.95


def blackman_harris(n: int) -> np.ndarray:
    """A four-term Blackman-Harris window over ``n`` places, periodic."""
    a = 2 * np.pi * np.arange(n) / n
    return 0.35875 - 0.48829 * np.cos(a) + 0.14128 * np.cos(2 * a) - 0.01168 * np.cos(3 * a)


@lru_cache(16)
def sinc_table(ratio: float) -> np.ndarray:
    """Taps [SINC_PLACES + 1, SINC_TAPS] for output at each place between two samples, under a squared Blackman-Harris window; a low-pass below the lower rate."""
    cut = SINC_CUT * min(1.0, ratio)
    n = SINC_TAPS * SINC_PLACES
    at = np.arange(n) - n / 2
    taps = blackman_harris(n) ** 2 * np.sinc(at * cut / SINC_PLACES)
    taps = np.append(taps / (np.cumsum(taps)[-1] / SINC_PLACES), 0.0)  # added one by one, as SQL's sum does: a sum by halves is off by 2e-14 of it
    # row p: the taps of the samples from SINC_TAPS / 2 - 1 before to SINC_TAPS / 2 after, for an output p places behind a sample
    place = SINC_PLACES * np.arange(1, SINC_TAPS + 1)[None, :] - np.arange(SINC_PLACES + 1)[:, None]
    return taps[place]


def _taps_at(time: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """For each output time, in samples of the input: its first sample, and its taps between those of the two nearest places."""
    table = sinc_table(ratio)
    whole = np.floor(time)
    place = (time - whole) * SINC_PLACES
    low = np.minimum(place.astype(np.int64), SINC_PLACES - 1)
    share = (place - low)[:, None]
    return whole.astype(np.int64) - (SINC_TAPS // 2 - 1), (1 - share) * table[low] + share * table[low + 1]


#: Outputs of a cycle that are one product of matrices.
RUN_OUTPUTS = 64


@lru_cache(8)
def _cycle(source: int, target: int, kind: str) -> tuple[int, int, np.ndarray] | None:
    """Outputs and inputs after which a rational ratio's places repeat, and the matrix from these inputs (and those that the taps reach) to the outputs."""
    g = math.gcd(source, target)
    up, down = target // g, source // g
    if up * (down + SINC_TAPS) > 1 << 20:
        return None
    first, taps = _taps_at(np.arange(up) * (down / up), target / source)
    out = np.zeros((down + SINC_TAPS, up), kind)
    rows = first[:, None] + SINC_TAPS // 2 - 1 + np.arange(SINC_TAPS)
    out[rows, np.arange(up)[:, None]] = taps
    return up, down, out


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Band-limited resampling to ``round(len * target / source)`` samples; output k lies at the time of input k * source / target.

    Each output is a sum of ``SINC_TAPS`` samples with taps that are interpolated between tabled places.  A ratio of small numbers is one
    product of matrices, any other goes in runs.  Sums have double precision for samples in double precision, single for all others.
    """
    if source == target or not len(x):
        return x
    kind = "f8" if x.dtype == np.float64 else "f4"
    n, before = int(len(x) * target / source + 0.5), SINC_TAPS // 2 - 1
    if (cycle := _cycle(source, target, kind)) is not None:
        up, down, matrix = cycle
        runs = -(-n // up)
        padded = np.zeros(runs * down + SINC_TAPS, kind)
        some = min(len(x), len(padded) - before)
        padded[before : before + some] = x[:some]
        view = np.lib.stride_tricks.sliding_window_view(padded, down + SINC_TAPS)[::down]
        out = np.empty((runs, up), kind)
        for a in range(0, up, RUN_OUTPUTS):  # outputs near each other share their inputs: most of the whole matrix is zeros
            b = min(up, a + RUN_OUTPUTS)
            low, high = a * down // up, min((b - 1) * down // up + SINC_TAPS + 1, len(matrix))
            out[:, a:b] = view[:, low:high] @ matrix[low:high, a:b]
        return out.ravel()[:n]
    out = np.empty(n, kind)
    padded = np.pad(x.astype(kind), (before, SINC_TAPS))
    view = np.lib.stride_tricks.sliding_window_view(padded, SINC_TAPS)
    for a in range(0, n, 4096):
        first, taps = _taps_at(np.arange(a, min(n, a + 4096)) * (source / target), target / source)
        out[a : a + 4096] = np.einsum("ij,ij->i", view[np.minimum(first + before, len(view) - 1)], taps)
    return out


def pcm(raw: bytes, width: int, floating: bool = False) -> np.ndarray:
    """Samples between -1 and 1 from little-endian PCM of 1 (unsigned), 2 or 4 bytes; floating-point ones as they are."""
    if floating:
        if width not in (4, 8):
            raise ValueError(f"floating-point PCM of {width} bytes is not read")
        return np.frombuffer(raw, f"<f{width}").astype(np.float32)
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if width in (2, 4):
        return (np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))).astype(np.float32)
    raise ValueError(f"PCM of {width} bytes is not read")


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """Interleaved samples, rate and channels of a WAV file; an empty one is an error."""
    if data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            tag = int.from_bytes(body[24:26], "little") if tag == 0xFFFE else tag  # the real one of an extended head
            form = tag, channels, rate, bits // 8
        elif name == b"data" and form:
            tag, channels, rate, width = form
            if tag not in (1, 3):
                raise ValueError(f"WAV format {tag} is not read")
            x = pcm(body[: len(body) // width * width], width, tag == 3)
            if not len(x):
                raise ValueError("no samples")
            return x, rate, channels
        at += 8 + size + size % 2
    raise ValueError("no samples")


def encode_wav(x: np.ndarray, rate: int, channels: int = 1, width: int = 2, floating: bool = False) -> bytes:
    """A WAV file of interleaved samples between -1 and 1, that :func:`decode_wav` reads: PCM of 1, 2 or 4 bytes rounded down, or floating-point."""
    x = np.asarray(x, np.float64)
    if floating:
        body = x.astype(f"<f{width}").tobytes()
    else:
        full = 1 << (8 * width - 1)
        whole = np.clip(np.floor(x * full), -full, full - 1).astype(np.int64)
        body = (whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.astype(f"<i{width}").tobytes()
    form = struct.pack("<HHIIHH", 3 if floating else 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    parts = b"".join(name + struct.pack("<I", len(part)) + part + b"\0" * (len(part) % 2) for name, part in ((b"fmt ", form), (b"data", body)))
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int, int]]] = {"RIFF": decode_wav, "fLaC": decode_flac}


def audio_array(audio: dict) -> np.ndarray:
    """Mono samples of an audio value: of its ``array``, or decoded from its ``bytes``; neither is an error."""
    if audio.get("array") is not None:
        x = np.asarray(audio["array"], np.float32)
        return x.mean(axis=int(x.shape[0] > x.shape[1])).astype(np.float32) if x.ndim == 2 else x
    if audio.get("bytes") is None:
        raise ValueError("audio has neither an array nor bytes")
    x, _, channels = decode(bytes(audio["bytes"]))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """Decode by the container's first four bytes; more containers can be added to ``DECODERS``."""
    kind = bytes(data[:4]).decode("latin-1")
    if kind not in DECODERS:
        raise ValueError(f"no decoder for {kind!r}")
    return DECODERS[kind](bytes(data))


@F.pandas_udf(DECODED)
def decode_audio(data: pd.Series) -> pd.DataFrame:
    """Samples of each file, or ``ok`` false and the error: a broken file never fails its task."""
    rows = []
    for d in data:
        try:
            x, rate, channels = decode(d)
            rows.append((x, rate, channels, True, None))
        except Exception as e:  # what a decoder raises on broken bytes is open
            rows.append((None, None, None, False, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["samples", "rate", "channels", "ok", "error"])


@F.pandas_udf(FLOATS)
def resample_to(samples: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    """Samples at another rate."""
    return pd.Series([None if x is None else resample(np.asarray(x, np.float32), int(a), int(b)) for x, a, b in zip(samples, source, target, strict=True)])


def block_mask(n_h: int, n_w: int, block: int, ratio: float, seed: int) -> np.ndarray:
    """A grid with exactly ``int(n_h * n_w * ratio)`` masked patches: whole blocks first, then single ones."""
    r = np.random.default_rng(seed)
    mask, left = np.zeros((n_h, n_w), bool), int(n_h * n_w * ratio)
    corners = [(y, x) for y in range(0, n_h, block) for x in range(0, n_w, block)]
    for y, x in (corners[k] for k in r.permutation(len(corners))):
        part = mask[y : y + block, x : x + block]
        if part.size <= left:
            part[:] = True
            left -= part.size
    free = np.flatnonzero(~mask)
    mask.reshape(-1)[r.permutation(free)[:left]] = True
    return mask
