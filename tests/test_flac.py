"""FLAC decoding against an encoder of this test: every kind of subframe, partition and channel code comes back bit by bit."""

import hashlib

import numpy as np
import pytest

from tarnwick.functions import flac
from tarnwick.functions import signal as S


class Writer:
    def __init__(self):
        self.out = []

    def put(self, x, n):
        self.out += [(int(x) >> (n - 1 - k)) & 1 for k in range(n)]

    def pad(self):
        self.out += [0] * (-len(self.out) % 8)

    def bytes(self):
        return np.packbits(np.array(self.out, np.uint8)).tobytes()


def put_residual(w, res, order, parts, escape):
    method = 1 if parts == 4 else 0
    w.put(method, 2)
    w.put(parts.bit_length() - 1, 4)
    n = len(res) + order
    ends = [n // parts * (k + 1) - order for k in range(parts)]
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        part = res[a:b]
        if escape and k == 0:
            bits = max([1, *(int(abs(int(x))).bit_length() + 1 for x in part)])
            w.put((1 << (4 + method)) - 1, 4 + method)
            w.put(bits, 5)
            for x in part:
                w.put(x, bits)
            continue
        u = [2 * int(x) if x >= 0 else -2 * int(x) - 1 for x in part]
        rice = max(0, int(np.log2(np.mean(u) + 1))) if len(u) else 0
        rice = min(rice, 14)
        w.put(rice, 4 + method)
        for x in u:
            w.put(1, (x >> rice) + 1)
            w.put(x, rice)


def put_subframe(w, x, bits, kind, parts=1, escape=False, wasted=0):
    w.put(0, 1)
    name, order = kind
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + order, "linear": 31 + order}[name]
    w.put(code, 6)
    w.put(wasted > 0, 1)
    if wasted:
        w.put(1, wasted)
        x, bits = x >> wasted, bits - wasted
    if name == "constant":
        return w.put(x[0], bits)
    for v in x[: len(x) if name == "verbatim" else order]:
        w.put(v, bits)
    if name == "fixed":
        put_residual(w, np.diff(x, order), order, parts, escape)
    if name == "linear":
        taps, shift = np.array([int(900 / (k + 1)) * (-1) ** k for k in range(order)]), 10
        w.put(12 - 1, 4)
        w.put(shift, 5)
        for t in taps:
            w.put(t, 12)
        guess = np.array([int((taps * x[i - order : i][::-1]).sum()) >> shift for i in range(order, len(x))])
        put_residual(w, x[order:] - guess, order, parts, escape)


def encode(x, rate=44100, bits=16, block=192, code=None, kind=("fixed", 2), total=True, digest=True, **how):
    """``x``: [samples, channels]."""
    n, channels = x.shape
    w = Writer()
    for k, at in enumerate(range(0, n, block)):
        part = x[at : at + block].astype(np.int64)
        w.put(0x3FFE, 14)
        w.put(0, 2)
        w.put(7, 4)
        w.put(0, 4)
        w.put(channels - 1 if code is None else code, 4)
        w.put({8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits], 3)
        w.put(0, 1)
        for byte in (chr(k) if k < 0x800 else "ࠀ").encode("utf-8"):
            w.put(byte, 8)
        w.put(len(part) - 1, 16)
        w.put(0, 8)
        a = part[:, 0]
        if code is None:
            sides = [(part[:, c], bits) for c in range(channels)]
        else:
            b = part[:, 1]
            sides = {8: [(a, bits), (a - b, bits + 1)], 9: [(a - b, bits + 1), (b, bits)], 10: [((a + b) >> 1, bits), (a - b, bits + 1)]}[code]
        for s, width in sides:
            put_subframe(w, s, width, kind if len(part) == block else ("verbatim", 0), **(how if len(part) == block else {}))
        w.pad()
        w.put(0, 16)
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | (n if total else 0)
    raw = x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : (bits + 7) // 8].tobytes()
    md5 = hashlib.md5(raw).digest() if digest else bytes(16)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + md5
    note = b"\x84" + (5).to_bytes(3, "big") + b"hello"
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + note + w.bytes()


def sound(n=700, channels=1, bits=16, seed=0):
    r = np.random.default_rng(seed)
    x = np.sin(np.arange(n)[:, None] * (0.03 + 0.01 * np.arange(channels))) * 0.6 + r.normal(size=(n, channels)) * 0.01
    return np.clip(np.rint(x * (1 << (bits - 1))), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)


def check(x, bits, data, rate=44100):
    got, r, channels = flac.decode_flac(data)
    assert r == rate and channels == x.shape[1] and (np.rint(got.astype(float) * (1 << (bits - 1))).astype(np.int64) == x.ravel()).all()


@pytest.mark.parametrize("kind", [("verbatim", 0), *(("fixed", k) for k in range(5)), *(("linear", k) for k in (1, 2, 5, 8))])
@pytest.mark.parametrize("parts, escape", [(1, False), (4, False), (2, True)])
def test_kinds_of_subframes(kind, parts, escape):
    x = sound()
    check(x, 16, encode(x, kind=kind, parts=parts, escape=escape))


@pytest.mark.parametrize("code", [None, 8, 9, 10])
@pytest.mark.parametrize("bits", [8, 12, 16, 20])
def test_channels_and_widths(code, bits):
    x = sound(channels=2, bits=bits)
    check(x, bits, encode(x, bits=bits, code=code, kind=("linear", 3)))
    check(x[:, :1] * 0 + 5, bits, encode(x[:, :1] * 0 + 5, bits=bits, kind=("constant", 0)))
    even = x >> 2 << 2
    if code is None:
        check(even, bits, encode(even, bits=bits, kind=("fixed", 1), wasted=2))


def test_without_count_or_checksum_and_many_channels():
    x = sound(channels=5)
    check(x, 16, encode(x, total=False, digest=False))
    assert S.decode(encode(x))[2] == 5


def test_damaged_recordings_are_errors(spark):
    data = encode(sound(3000))
    for n in (3, 20, 60, len(data) // 2, len(data) - 3):
        with pytest.raises(ValueError):
            flac.decode_flac(data[:n])
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 4
    rows = spark.createDataFrame([(1, data), (2, bytes(bad)), (3, data[:-50])], "id int, bytes binary")
    got = rows.select("id", S.decode_audio("bytes").alias("d")).select("id", "d.ok", "d.error").orderBy("id").collect()
    assert [r["ok"] for r in got] == [True, False, False] and got[0]["error"] is None


def test_loader_reads_both_containers(spark):
    from tarnwick.operators.loader import load_clips

    rows = spark.createDataFrame([(0, 1, encode(sound(4000), rate=8000)), (1, 2, encode(sound(4000), rate=8000)[:300])], "index bigint, label bigint, bytes binary")
    got = load_clips(rows, rate=8000, seconds=0.4, n_mels=16).orderBy("index").collect()
    assert got[0]["ok"] and len(got[0]["features"]) == 512 * 16 and not got[1]["ok"]
