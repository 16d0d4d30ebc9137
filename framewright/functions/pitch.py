"""Pitch units and quantisation, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# The coarse pitch range in Hz and its number of codes.
COARSE_MIN_HZ, COARSE_MAX_HZ, COARSE_CODES = 50.0, 1100.0, 256
# Cents of the lowest pitch bin over 10 Hz, cents per bin, number of bins.
BIN_OFFSET_CENTS, BIN_WIDTH_CENTS, PITCH_BINS = 1997.3794084376191, 20.0, 360


def mel(f0: Column) -> Column:
    return 1127.0 * F.log(1.0 + f0 / 700.0)


def coarse(f0: Column) -> Column:
    """Pitch code 1..255 on a mel scale, rounding half up; unvoiced is 1."""
    low, high = (1127.0 * math.log(1.0 + hz / 700.0) for hz in (COARSE_MIN_HZ, COARSE_MAX_HZ))
    top = float(COARSE_CODES - 1)
    scaled = F.when(mel(f0) > 0, (mel(f0) - low) * (COARSE_CODES - 2) / (high - low) + 1.0).otherwise(mel(f0))
    return F.floor(F.least(F.greatest(scaled, F.lit(1.0)), F.lit(top)) + 0.5).cast("bigint")


def hz_to_cents(f0: Column, ref: float = 10.0) -> Column:
    """Cents above `ref`; unvoiced (0 Hz) is missing."""
    return 1200.0 * F.log2(F.nullif(f0, F.lit(0.0)) / ref)


def cents_to_hz(cents: Column, ref: float = 10.0) -> Column:
    return ref * F.pow(F.lit(2.0), cents / 1200.0)


def cents_to_bin(cents: Column, up: bool = False) -> Column:
    """Bin below (or above); a pitch exactly on a bin keeps it whatever the last digit of its logarithm."""
    position = (cents - BIN_OFFSET_CENTS) / BIN_WIDTH_CENTS
    return (F.ceil(position - 1e-9) if up else F.floor(position + 1e-9)).cast("bigint")


def bin_to_cents(index: Column) -> Column:
    return index * BIN_WIDTH_CENTS + BIN_OFFSET_CENTS


def semitones(f0: Column, shift: Column | float) -> Column:
    return f0 * F.pow(F.lit(2.0), F.lit(shift) / 12.0)


def hz_to_erb(f0: Column) -> Column:
    return 21.4 * F.log10(1.0 + f0 / 229.0)


def erb_to_hz(erb: Column) -> Column:
    return (F.pow(F.lit(10.0), erb / 21.4) - 1.0) * 229.0


def log_bin(f0: Column, resolution: float, ref: float) -> Column:
    """Bin of width `resolution` cents above `ref`, rounding half up."""
    return F.floor((1200.0 / resolution) * F.log2(F.nullif(f0, F.lit(0.0)) / ref) + 0.5).cast("bigint")


def nearest_bin(f0: Column, resolution: float, low: float, bins: int) -> Column:
    """Index of the geometrically nearest of `bins` axis values starting at `low` Hz."""
    position = F.rint(F.log2(F.nullif(f0, F.lit(0.0)) / low) * (1200.0 / resolution))
    return F.when(f0 > 0, F.least(F.greatest(position, F.lit(0.0)), F.lit(float(bins - 1))).cast("bigint"))
