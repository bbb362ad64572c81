"""Signal transforms over arrays of samples, as higher-order functions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def power(x: Column) -> Column:
    """Mean square; 0 for no samples."""
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.coalesce(F.try_divide(total, F.size(x)), F.lit(0.0))


def _once(value: Column, then) -> Column:
    """then(value), with value worked out once per row rather than once per element."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def mix_at_snr(clean: Column, noise: Column, snr_db: float) -> Column:
    """clean plus noise, cut or repeated to its length and scaled to the ratio; peaks over 1 scale the whole down."""
    n = F.size(clean)
    tiled = F.slice(F.flatten(F.array_repeat(noise, F.ceil(n / F.greatest(F.size(noise), F.lit(1))).cast("int"))), F.lit(1), n)

    def mixed(t: Column) -> Column:
        gain = F.sqrt(power(clean) / F.greatest(power(t), F.lit(1e-12)) / 10 ** (snr_db / 10))
        return _once(gain, lambda g: F.zip_with(clean, t, lambda a, b: a.cast("double") + g * b.cast("double")))

    def limited(x: Column) -> Column:
        return _once(F.array_max(F.transform(x, F.abs)), lambda peak: F.transform(x, lambda v: F.when(peak > 1, v / peak).otherwise(v)))

    return _once(_once(tiled, mixed), limited)


def inject_silence(x: Column, at: Column, length: int) -> Column:
    """x with `length` zeros from place `at` (from 0) on."""
    return F.concat(F.slice(x, F.lit(1), at), F.array_repeat(F.lit(0.0), length), F.slice(x, at + 1, F.greatest(F.size(x) - at, F.lit(0))))


def mask_chunks(x: Column, starts: Column, length: int) -> Column:
    """Zero in [s, s + length) of every start."""
    return F.transform(x, lambda v, i: F.when(F.exists(starts, lambda s: (i >= s) & (i < s + length)), 0.0).otherwise(v.cast("double")))


def is_silent(x: Column, probe: int = 8) -> Column:
    """Only zeros at the beginning, in the middle and at the end."""
    n = F.size(x)
    parts = F.concat(F.slice(x, F.lit(1), F.lit(probe)), F.slice(x, F.greatest(F.floor(n / 2).cast("int"), F.lit(1)), F.lit(probe)), F.slice(x, F.greatest(n - probe + 1, F.lit(1)), F.lit(probe)))
    return F.forall(parts, lambda v: v == 0)


def pad_to(x: Column, length: Column) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(length - F.size(x), F.lit(0)).cast("int")))


def find_run(x: Column, wanted: Column) -> Column:
    """The first place (from 0) where `wanted` stands in x, else 80 % of x's length."""
    k = F.size(wanted)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(x) - k + 1, F.lit(1))), lambda i: F.slice(x, i, k) == wanted)
    return F.when(F.size(places) > 0, F.element_at(places, 1) - 1).otherwise(F.floor(F.size(x) * 0.8)).cast("int")


def drop_quiet_runs(x: Column, threshold: float, least: int) -> Column:
    """x without runs of at least `least` values whose size is under the threshold; one pass over the loud places and the gaps between them."""

    def kept(x: Column, loud: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), loud)
        after = F.concat(loud, F.array(F.size(x)))
        # what stands between two loud places, where it is short, and the later of the two
        part = lambda a, b: F.slice(x, F.when(b - a - 1 < least, a + 2).otherwise(b + 1), F.when(b - a - 1 < least, b - a).otherwise(1))
        return F.flatten(F.zip_with(ends, after, part))

    places = F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) < threshold, -1).otherwise(i)), lambda i: i >= 0)
    return _once(x, lambda own: _once(places, lambda loud: kept(own, loud)))


def decay_index(x: Column, drop_db: float) -> Column:
    """The first place where the energy that is left (backward sum) has fallen by drop_db; null if never."""
    energy = F.transform(x, lambda v: v.cast("double") * v.cast("double"))
    total = F.aggregate(energy, F.lit(0.0), lambda a, v: a + v)
    found = F.aggregate(energy, F.struct(total.alias("left"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at")),
                        lambda a, v: F.struct((a.left - v).alias("left"), (a.i + 1).alias("i"), F.coalesce(a["at"], F.when(a.left <= total * 10 ** (-drop_db / 10), a.i)).alias("at")), lambda a: a["at"])
    return found


def reverb(kernel: list[float]):
    """A column function: x convolved with the kernel by FFT, cut to x's length, with x's energy."""
    k = np.asarray(kernel, np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rows: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not len(x):
                return x
            x = np.asarray(x, np.float64)
            n = len(x) + len(k) - 1
            y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(k, n), n)[: len(x)]
            e = np.sqrt((y * y).sum())
            return y * (np.sqrt((x * x).sum()) / e) if e > 0 else y

        return rows.map(one)

    return run


def _seed(ident: str) -> int:
    """The generator's seed of an utterance: the md5 of its id modulo 2**31, and 42."""
    return int(hashlib.md5(ident.encode()).hexdigest(), 16) % (1 << 31) + 42


def silence_place(n: int, ident: str, share: float, rate: int) -> tuple[int, int]:
    """Where a gap of a share of n samples begins, at 30 to 70 % of them (drawn by the id), and its length."""
    return int(n * np.random.RandomState(_seed(ident)).uniform(0.3, 0.7)), int(n / rate * share * rate)


def silence_gain(at: np.ndarray, n: int, gap: int, rate: int) -> np.ndarray:
    """The gain of the samples at these places around a gap that begins at `gap`: 5 ms down before it, 5 ms up behind."""
    fade = int(0.005 * rate)
    if not 0 < fade < gap:
        return np.ones(len(at), np.float32)
    slope, away = max(1, fade - 1), np.where(at < gap, gap - 1 - at, at - gap if gap + fade < n else fade)
    return np.clip(away / slope, 0, 1).astype(np.float32)


def faded_silence(x: np.ndarray, ident: str, share: float, rate: int) -> np.ndarray:
    """x with zeros for a share of its length put in, with fades before and after."""
    at, gap = silence_place(len(x), ident, share, rate)
    return np.insert(x * silence_gain(np.arange(len(x)), len(x), at, rate), at, np.zeros(gap, np.float32))


def mask_gain(at: np.ndarray, n: int, ident: str, share: float, chunks: int, rate: int) -> np.ndarray:
    """The gain of the samples at these places of a recording of n, of which `chunks` pieces of a share in all are masked.

    The recording is cut into as many equal stretches, and each has its piece at a place drawn by the id, with 5 ms down before and
    up behind within the stretch, so that pieces lie apart.  Nothing is masked where a stretch is too short.
    """
    size, fade, stretch = int(n * share) // chunks, int(0.005 * rate), n // chunks
    room = stretch - size - 2 * fade
    gain = np.ones(len(at), np.float32)
    if size > 0 and room >= 0:
        starts = np.arange(chunks) * stretch + fade + (np.random.RandomState(_seed(ident)).uniform(0, 1, chunks) * (room + 1)).astype(int)
        for start in starts.tolist():
            away = np.maximum(start - at, at - (start + size - 1))  # 1 beside the piece, 0 and less in it
            gain = np.minimum(gain, np.clip((away - 1) / max(1, fade - 1), 0, 1).astype(np.float32))
    return gain


def masked_chunks(x: np.ndarray, ident: str, share: float, chunks: int, rate: int) -> np.ndarray:
    """x with its masked pieces."""
    return x.astype(np.float32) * mask_gain(np.arange(len(x)), len(x), ident, share, chunks, rate)


def loudness(power: np.ndarray) -> np.ndarray:
    """Decibels of a mean square."""
    return 20 * np.log10(np.sqrt(power + 1e-12) + 1e-12)


def voiced(x: np.ndarray, rate: int, floor_db: float = -35.0, least_ms: int = 200) -> np.ndarray:
    """x without runs of frames (20 ms, every 10) that are quieter than the floor for `least_ms` or more; a run goes up to its last frame's end."""
    size, hop = rate * 20 // 1000, rate * 10 // 1000
    if len(x) < size:
        return x
    squares = np.concatenate([[0.0], np.cumsum(x.astype(np.float64) ** 2)])
    heads = np.arange(0, len(x) - size + 1, hop)
    quiet = loudness((squares[heads + size] - squares[heads]) / size) < floor_db
    edges = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(np.int8), [0]]))).reshape(-1, 2)
    keep = np.ones(len(x), bool)
    for a, b in edges[edges[:, 1] - edges[:, 0] >= max(1, least_ms // 10)]:
        keep[a * hop : b * hop + size] = False
    return x[keep]


def reverberation_time(x: np.ndarray, rate: int) -> float:
    """Seconds until an impulse response has fallen by 60 dB: three times its way from -5 to -25 dB of the energy left, else straight."""
    left = np.cumsum((x.astype(np.float64) ** 2)[::-1])[::-1]
    if not len(x) or left[0] <= 0:
        return 0.0
    db = 10 * np.log10(left / left[0] + 1e-12)
    first = lambda level: int(np.argmax(db < level)) / rate  # noqa: E731  0 if it is never reached
    return 3 * (first(-25) - first(-5)) if first(-25) > first(-5) > 0 else first(-60)


def _over(function, kind: T.DataType):
    """A column function of (samples, more columns) from one over an array of samples; null samples stay null."""

    @F.pandas_udf(kind)
    def run(samples: pd.Series, ident: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(np.asarray(x, np.float32), str(i)) for x, i in zip(samples, ident, strict=True)])

    return run


def with_silence(share: float, rate: int = 16_000):
    """(samples, id) -> samples with a faded gap."""
    return _over(lambda x, i: faded_silence(x, i, share, rate), T.ArrayType(T.FloatType()))


def with_masks(share: float, chunks: int, rate: int = 16_000):
    """(samples, id) -> samples with faded masks."""
    return _over(lambda x, i: masked_chunks(x, i, share, chunks, rate), T.ArrayType(T.FloatType()))


def without_silence(rate: int = 16_000, floor_db: float = -35.0, least_ms: int = 200):
    """(samples, id) -> samples without quiet runs."""
    return _over(lambda x, _: voiced(x, rate, floor_db, least_ms), T.ArrayType(T.FloatType()))


def rt60(rate: int = 16_000):
    """(samples, id) -> reverberation time in seconds."""
    return _over(lambda x, _: reverberation_time(x, rate), T.DoubleType())
