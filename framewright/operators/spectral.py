"""Spectra of framed signals: magnitudes, mel bands, loudness. A frame is a bounded array, a batch of frames a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framewright.operators.blocks import with_group
from framewright.operators.frames import strided_frames
from framewright.operators.sequence import _ddl
from framewright.session import cut


def map_rows(df: DataFrame, keep: list[str], column: str, fn, out: str) -> DataFrame:
    """Apply `fn` (matrix of rows → matrix of rows) to an array column, batch by batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = fn(batch[column].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
            arrays = pa.ListArray.from_arrays(offsets, np.ascontiguousarray(rows, dtype=np.float64).ravel())
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], arrays], [*keep, out])

    return df.select(*keep, column).mapInArrow(run, f"{_ddl(df, keep)}, `{out}` array<double>")


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / size)


def magnitudes(frames: DataFrame, keys: list[str], f: str = "f", floor: float = 1e-6, out: str = "mag") -> DataFrame:
    """Hann-windowed magnitude of each frame array, `sqrt(re² + im² + floor)`."""

    def transform(rows: np.ndarray) -> np.ndarray:
        spectrum = np.fft.rfft(rows * hann(rows.shape[1]), axis=1)
        return np.sqrt(spectrum.real**2 + spectrum.imag**2 + floor)

    return map_rows(frames, keys, f, transform, out)


def spectrum(df: DataFrame, keys: list[str], idx: str, x: str, size: int, hop: int) -> DataFrame:
    """keys, frame, mag: reflect-padded by `(size - hop) / 2`, as for training spectra."""
    frames = strided_frames(df, keys, idx, x, size, hop, pad=(size - hop) // 2, mirror=True)
    return magnitudes(frames, [*keys, "frame"])


def mel_filters(rate: float, size: int, mels: int, low: float, high: float) -> np.ndarray:
    """Triangular filters, equal area, centres evenly spaced on a scale linear below 1 kHz and logarithmic above."""
    step = np.log(6.4) / 27.0
    to_mel = lambda hz: np.where(hz < 1000.0, 3.0 * hz / 200.0, 15.0 + np.log(np.maximum(hz, 1000.0) / 1000.0) / step)
    to_hz = lambda m: np.where(m < 15.0, 200.0 * m / 3.0, 1000.0 * np.exp(step * (np.maximum(m, 15.0) - 15.0)))
    edges = to_hz(np.linspace(to_mel(np.float64(low)), to_mel(np.float64(high)), mels + 2))
    bins = np.linspace(0.0, rate / 2.0, size // 2 + 1)
    rising = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    falling = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0.0, np.minimum(rising, falling)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def mel_project(spectra: DataFrame, keys: list[str], mag: str, filters: np.ndarray, out: str = "mel") -> DataFrame:
    """Filterbank energies of each magnitude array."""
    return map_rows(spectra, keys, mag, lambda rows: rows @ filters.T, out)


def a_weights(rate: float, size: int) -> np.ndarray:
    """A-weighting in dB of each bin, not below -80, less 20 dB reference level."""
    sq = np.linspace(0.0, rate / 2.0, size // 2 + 1) ** 2
    # The pole frequencies of the A-weighting curve in Hz.
    c = np.array([12194.217, 20.598997, 107.65265, 737.86223]) ** 2
    with np.errstate(divide="ignore"):
        curve = 2.0 + 20.0 * (
            np.log10(c[0]) + 2.0 * np.log10(sq) - np.log10(sq + c[0]) - np.log10(sq + c[1])
            - 0.5 * np.log10(sq + c[2]) - 0.5 * np.log10(sq + c[3])
        )
    return np.maximum(curve, -80.0) - 20.0


def loudness(df: DataFrame, keys: list[str], idx: str, x: str, size: int, hop: int, rate: float, top_db: float = 80.0) -> DataFrame:
    """A-weighted loudness of each frame: bins in dB not below `top_db` under the series' peak, weighted, averaged."""
    frames = strided_frames(df, keys, idx, x, size, hop, pad=size // 2)
    mags = magnitudes(frames, [*keys, "frame"], floor=0.0)
    db = mags.select(*keys, "frame", F.expr("transform(mag, m -> 20 * log10(greatest(m, 1e-5D)))").alias("db"))
    peaked = with_group(cut(db), keys, _top=F.max(F.array_max("db")))
    weights = F.array(*[F.lit(float(w)) for w in a_weights(rate, size)])
    level = F.zip_with(
        "db", weights, lambda v, w: F.greatest(F.greatest(v, F.col("_top") - top_db) + w, F.lit(-100.0))
    )
    return peaked.select(*keys, "frame", (F.aggregate(level, F.lit(0.0), lambda s, t: s + t) / (size // 2 + 1)).alias("loudness"))
