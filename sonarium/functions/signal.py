"""Expressions on one waveform per row (``array<double>``). Only the Fourier steps need a Python worker, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def hashed_noise(seed: int, *place: Column) -> Column:
    """Standard normal noise from the MD5 digest of a sample's place, so that a retried task draws the same numbers."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in place], F.lit(str(seed))))

    def uniform(first: int) -> Column:
        return (F.conv(F.substring(digest, first, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(14))


def add_noise(wave: Column, clip: Column, level: float = 0.005, seed: int = 0) -> Column:
    return F.transform(wave, lambda x, i: x + level * hashed_noise(seed, clip, i))


def mask_time(
    wave: Column, clip: Column, start_percent: float = 20.0, end_percent: float = 40.0, floor: float = 1e-4, seed: int = 0
) -> Column:
    """Replace [int(L·a/100), int(L·b/100)) by faint noise (``floor`` 0 gives silence)."""
    size = F.size(wave)
    first, last = F.floor(size * start_percent / 100), F.floor(size * end_percent / 100)
    fill = (lambda i: floor * hashed_noise(seed, clip, i)) if floor else (lambda i: F.lit(0.0))
    return F.transform(wave, lambda x, i: F.when((i >= first) & (i < last), fill(i)).otherwise(x))


def mask_band(wave: Column, rate: Column, low: float = 1000.0, high: float = 2000.0, two_sided: bool = False) -> Column:
    """Zero the spectrum in [low, high] Hz. By default only positive frequencies, which halves the band; ``two_sided`` removes it."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def masked(waves: pd.Series, rates: pd.Series) -> pd.Series:
        out = []
        for x, r in zip(waves, rates):
            if x is None or len(x) == 0:
                out.append(x)
                continue
            x = np.asarray(x, dtype="float64")
            freqs = np.fft.fftfreq(len(x), 1.0 / r)
            spectrum = np.fft.fft(x)
            hit = (np.abs(freqs) if two_sided else freqs)
            spectrum[(hit >= low) & (hit <= high)] = 0
            out.append(np.fft.ifft(spectrum).real)
        return pd.Series(out)

    return masked(wave, rate)


SPECTRAL = ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff")
STATS = ("mean", "std", "min", "max")
SPECTRAL_TYPE = StructType([StructField(f"{n}_{s}", DoubleType()) for n in SPECTRAL for s in STATS])


def spectral_features(wave: Column, rate: Column, frame: int = 2048, hop: int = 512, rolloff: float = 0.85) -> Column:
    """Centroid, bandwidth and rolloff of Hann-windowed frames, each as mean, population std, min and max.

    Frames are not centred; a signal shorter than one frame is padded with zeros. Null for an empty signal.
    """

    @F.pandas_udf(SPECTRAL_TYPE)
    def features(waves: pd.Series, rates: pd.Series) -> pd.DataFrame:
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
        rows = []
        for x, r in zip(waves, rates):
            if x is None or len(x) == 0:
                rows.append([None] * (len(SPECTRAL) * len(STATS)))
                continue
            x = np.asarray(x, dtype="float64")
            x = np.pad(x, (0, max(0, frame - len(x))))
            cut = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
            mags = np.abs(np.fft.rfft(cut * window, axis=1))
            freqs = np.arange(mags.shape[1]) * r / frame
            total = mags.sum(axis=1)
            shares = np.divide(mags, total[:, None], out=np.zeros_like(mags), where=total[:, None] > 0)
            centroid = shares @ freqs
            width = np.sqrt((shares * (freqs[None, :] - centroid[:, None]) ** 2).sum(axis=1))
            edge = freqs[(np.cumsum(mags, axis=1) >= rolloff * total[:, None]).argmax(axis=1)]
            rows.append([f(v) for v in (centroid, width, edge) for f in (np.mean, np.std, np.min, np.max)])
        return pd.DataFrame(rows, columns=SPECTRAL_TYPE.names, dtype="float64")

    return features(wave, rate)


def finish_wave(wave: Column) -> Column:
    """Non-finite samples to 0, then divide by the peak if it exceeds 1."""
    clean = F.transform(
        wave, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    )

    def scaled(c: Column) -> Column:
        peak = F.array_max(F.transform(c, lambda x: F.abs(x)))
        return F.transform(F.array(peak), lambda p: F.transform(c, lambda x: F.when(p > 1.0, x / p).otherwise(x)))[0]

    # the one-element transforms compute the cleaned wave and its peak once per row
    return F.transform(F.array(clean), scaled)[0]
