"""Level, scaling, coding and framing arithmetic, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def amp_to_db(x: Column, gain: float = 20.0, base: int | None = 10) -> Column:
    log = F.log10 if base == 10 else F.log
    return gain * log(F.greatest(x, F.lit(1e-5)))


def db_to_amp(db: Column, gain: float = 20.0, base: int | None = 10) -> Column:
    return F.pow(F.lit(10.0), db / gain) if base == 10 else F.exp(db / gain)


def level_below_peak(x: Column, peak: Column, floor_db: float = 80.0, amin: float = 1e-5) -> Column:
    """dB relative to the peak, not lower than `floor_db` below it."""
    ratio = F.greatest(x, F.lit(amin)) / F.greatest(peak, F.lit(amin))
    return F.greatest(20.0 * F.log10(ratio), F.lit(-floor_db))


def range_normalise(db, ref=20.0, low=-100.0, top=4.0, symmetric=True, clipped=True) -> Column:
    unit = (db - ref - low) / -low
    if symmetric:
        out = 2.0 * top * unit - top
        return clip(out, -top, top) if clipped else out
    return clip(top * unit, 0.0, top) if clipped else top * unit


def range_denormalise(y, ref=20.0, low=-100.0, top=4.0, symmetric=True, clipped=True) -> Column:
    floor = -top if symmetric else 0.0
    y = clip(y, floor, top) if clipped else y
    return (y - floor) * (-low / (top - floor)) + low + ref


def standard_scale(x: Column, mean: Column, scale: Column) -> Column:
    return F.try_divide(x - mean, scale)


def compress_range(x: Column, gain: float = 1.0, floor: float = 1e-5) -> Column:
    return F.log(F.greatest(x, F.lit(floor)) * gain)


def expand_range(y: Column, gain: float = 1.0) -> Column:
    return F.exp(y) / gain


def log_floor_scale(x: Column, peak: Column) -> Column:
    """log10 with a floor 8 decades below the utterance peak, shifted and scaled to about [-1, 1]."""
    level = F.log10(F.greatest(x, F.lit(1e-10)))
    return (F.greatest(level, F.log10(F.greatest(peak, F.lit(1e-10))) - 8.0) + 4.0) / 4.0


def mulaw_encode(x: Column, bits: int) -> Column:
    mu = 2.0**bits - 1.0
    curve = F.signum(x) * F.log(1.0 + mu * F.abs(x)) / math.log(1.0 + mu)
    return F.floor((curve + 1.0) / 2.0 * mu + 0.5).cast("bigint")


def mulaw_decode(y: Column, bits: int) -> Column:
    """Inverse companding of a value in [-1, 1]."""
    mu = 2.0**bits - 1.0
    return F.signum(y) / mu * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1.0)


def pcm16(x: Column) -> Column:
    return clip(x * 32768.0, -32768.0, 32767.0).cast("bigint")


def quantise(x: Column, bits: int) -> Column:
    return (x + 1.0) * (2.0**bits - 1.0) / 2.0


def dequantise(y: Column, bits: int) -> Column:
    return 2.0 * y / (2.0**bits - 1.0) - 1.0


def frame_seconds(frame: Column, hop: int, rate: int) -> Column:
    return frame * float(hop) / float(rate)


def coefficient_hz(index: Column, size: int, rate: int) -> Column:
    return index * float(rate) / float(size)


def clock_label(frame: str, value: Column, frame_ms: int = 10) -> Column:
    """`{m}m {s}s {ms},{value}` of a frame number, milliseconds right-aligned to three places."""
    t = f"({frame} * {frame_ms})"
    return F.format_string(
        "%dm %ds %3d,%d",
        F.expr(f"{t} div 60000"),
        F.expr(f"({t} div 1000) % 60"),
        F.expr(f"{t} % 1000"),
        value.cast("bigint"),
    )


def even_offsets(length: str, window: int, count: int) -> Column:
    """Starts of `count` evenly spaced windows, truncated to whole frames; a short row shrinks the window."""
    room = f"greatest({length} - {window}, 0)"
    return F.expr(f"transform(sequence(0, {count - 1}), i -> CAST(floor(i * ({room} / {count - 1}D)) AS BIGINT))")


def ivf_cells(n: str) -> Column:
    """Number of coarse cells for `n` vectors, at least one."""
    return F.expr(f"greatest(least(CAST(floor(16 * sqrt({n})) AS BIGINT), {n} div 39), 1)")


def timing_signal(position: Column, channel: int, channels: int, low: float = 1.0, high: float = 1.0e4) -> Column:
    """One channel of the sine/cosine position signal: sines first, then cosines, then a zero for odd counts."""
    half = channels // 2
    if channel >= 2 * half:
        return F.lit(0.0)
    step = math.log(high / low) / (half - 1)
    scaled = position * (low * math.exp(-(channel % half) * step))
    return F.sin(scaled) if channel < half else F.cos(scaled)


def hop_and_window(shift_ms: float, length_ms: float, rate: int) -> tuple[int, int]:
    factor = length_ms / shift_ms
    if factor != int(factor):
        raise ValueError("the frame shift must divide the frame length")
    hop = int(shift_ms / 1000.0 * rate)
    return hop, int(hop * factor)


def frame_padding(length: str, hop: int, sides: int) -> tuple[Column, Column]:
    pad = f"(({length} div {hop} + 1) * {hop} - {length})"
    if sides == 1:
        return F.lit(0).cast("bigint"), F.expr(f"CAST({pad} AS BIGINT)")
    return F.expr(f"CAST({pad} div 2 AS BIGINT)"), F.expr(f"CAST({pad} div 2 + {pad} % 2 AS BIGINT)")
