"""Reproducible draws: a uniform number is a function of a text key, the same on every engine and every retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def digest(seed, *cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols]))


def uniform(seed, *cols) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the md5 of `seed|cols…`."""
    head = F.substring(digest(seed, *cols), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)


def triangular(seed, *cols, half_width: float) -> Column:
    return half_width * (uniform(f"{seed}a", *cols) + uniform(f"{seed}b", *cols) - 1.0)


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u * 0.99998 + 1e-5))


def gaussian(seed, *cols) -> Column:
    """Standard normal by the polar transform of two uniforms."""
    radius = F.sqrt(-2.0 * F.log(F.greatest(uniform(f"{seed}a", *cols), F.lit(2.0**-33))))
    return radius * F.cos(2.0 * math.pi * uniform(f"{seed}b", *cols))
