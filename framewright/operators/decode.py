"""Decoding scores per group: softmax, argmax, top-n, sampling, ranking. Rows are (group, candidate, score)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framewright.functions.noise import gumbel, uniform
from framewright.functions.pitch import bin_to_cents, cents_to_bin, cents_to_hz, hz_to_cents
from framewright.operators.blocks import with_group
from framewright.operators.sequence import band_matrix, viterbi


def _best(c: str, score: Column) -> Column:
    """The candidate with the highest score, the lowest one on ties."""
    return F.max_by(F.col(c), F.struct(score.alias("s"), (-F.col(c)).alias("c")))


def softmax(rows: DataFrame, group: list[str], z: str) -> DataFrame:
    """Adds `p` and `logp`."""
    top = with_group(rows, group, _m=F.max(z))
    shifted = F.col(z) - F.col("_m")
    summed = with_group(top, group, _t=F.sum(F.exp(shifted)))
    return summed.withColumn("p", F.exp(shifted) / F.col("_t")).withColumn("logp", shifted - F.log("_t")).drop("_m", "_t")


def argmax(rows: DataFrame, group: list[str], c: str, z: str) -> DataFrame:
    return rows.groupBy(*group).agg(_best(c, F.col(z)).alias("bin"), F.max(z).alias("periodicity"))


def weighted_argmax(rows: DataFrame, group: list[str], c: str, z: str, reach: int = 4) -> DataFrame:
    """Sigmoid-weighted mean of the cents around the best bin, in Hz."""
    near = with_group(rows, group, _b=_best(c, F.col(z))).where(F.abs(F.col(c) - F.col("_b")) <= reach)
    weight = 1.0 / (1.0 + F.exp(-F.col(z)))
    cents = F.sum(weight * bin_to_cents(F.col(c))) / F.sum(weight)
    return near.groupBy(*group).agg(F.max("_b").alias("bin"), cents_to_hz(cents).alias("hz"))


def in_range(rows: DataFrame, c: str, low_hz: float, high_hz: float) -> DataFrame:
    """Bins from the one at or below `low_hz` up to, not including, the one at or above `high_hz`."""
    edge = lambda hz, up: cents_to_bin(hz_to_cents(F.lit(hz)), up)
    return rows.where((F.col(c) >= edge(low_hz, False)) & (F.col(c) < edge(high_hz, True)))


def top_labels(rows: DataFrame, group: list[str], c: str, z: str, n: int, allowed: list | None = None) -> DataFrame:
    """The n likeliest labels among the allowed ones with their probability to two places."""
    pool = rows if allowed is None else rows.where(F.col(c).isin(allowed))
    probs = softmax(pool, group, z)
    order = W.partitionBy(*group).orderBy(F.desc(z), F.asc(c))
    ranked = probs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(*group, c, F.round("p", 2).alias("p"), F.col("rank").cast("bigint").alias("rank"))


def temperature_sample(rows: DataFrame, group: list[str], c: str, z: str, temperature: float, seed) -> DataFrame:
    """Argmax at temperature 0, else a draw from softmax(z / temperature) by adding Gumbel noise."""
    score = F.col(z) if temperature == 0 else F.col(z) / temperature + gumbel(uniform(seed, *group, c))
    return rows.groupBy(*group).agg(_best(c, score).alias(c))


def ranked_best(rows: DataFrame, group: list[str], row_id: str, logprob: str, length: str, alpha: float | None) -> DataFrame:
    """Best candidate by log probability over its length, or over `((5 + length) / 6) ** alpha`."""
    lp, n = F.col(logprob), F.col(length)
    score = lp / n if alpha is None else lp / F.pow((5.0 + n) / 6.0, F.lit(alpha))
    return rows.groupBy(*group).agg(
        _best(row_id, score).alias(row_id),
        F.max(score).alias("score"),
        F.max_by(lp / (n + 1), F.struct(score.alias("s"), (-F.col(row_id)).alias("c"))).alias("avg_logprob"),
    )


def best_path(rows: DataFrame, group: list[str], c: str, z: str, states: int = 360, width: int = 12) -> DataFrame:
    """Bin of every frame on the best path through the frames of a track, whose steps follow a triangular band.

    `group` is the track's keys and then the frame's position, counted from 0. A softmax shifts all scores of a frame
    alike and so changes no path: scores are taken as they are. A candidate that a frame does not have is impossible there; of
    two scores for one candidate the higher counts.
    """
    if len(group) < 2:
        raise ValueError("the group needs the keys of a track before the position")
    frames = rows.groupBy(*group).agg(F.collect_list(F.struct(F.col(c).cast("int"), F.col(z).cast("double"))).alias("_lp"))
    paths = viterbi(frames, group[:-1], group[-1], "_lp", band_matrix(states, width), np.log(np.full(states, 1 / states)))
    return paths.select(*group, F.col("state").alias("bin"))


DECODERS = {
    "viterbi": lambda rows, group, c, z, **o: best_path(rows, group, c, z, **o).select(
        *group, cents_to_hz(bin_to_cents(F.col("bin"))).alias("hz")
    ),
    "argmax": lambda rows, group, c, z: argmax(rows, group, c, z).select(
        *group, cents_to_hz(bin_to_cents(F.col("bin"))).alias("hz")
    ),
    "weighted_argmax": lambda rows, group, c, z: weighted_argmax(rows, group, c, z).select(*group, "hz"),
}


def decode(rows: DataFrame, group: list[str], c: str, z: str, decoder: str, **options) -> DataFrame:
    """Pitch in Hz by the decoder of that name; further ones can be added to `DECODERS`."""
    return DECODERS[decoder](rows, group, c, z, **options)


def triangular_transition(i: Column, j: Column, states: int, width: int) -> Column:
    """Row-normalised band: `max(width - |i - j|, 0)` over its row sum."""
    band = lambda a, b: F.greatest(width - F.abs(a - b), F.lit(0))
    row = F.aggregate(F.sequence(F.lit(0), F.lit(states - 1)), F.lit(0).cast("bigint"), lambda s, t: s + band(i, t).cast("bigint"))
    return band(i, j) / row


def voicing_transition(
    i: Column, vi: Column, j: Column, vj: Column, states: int, triangle: list[float], stay: float = 0.99
) -> Column:
    """Pitch steps within a voicing follow the triangle, renormalised near the edges; a voicing change keeps the pitch.

    Near the lower edge the last element of the triangle is left out.
    """
    reach = len(triangle) // 2
    shape = F.array(*[F.lit(float(t)) for t in triangle])
    offset = (j - i + reach).cast("int")
    low, high = i < reach, i >= states - reach
    first = F.when(low, reach - i).otherwise(0).cast("int")
    last = F.when(low, 2 * reach - 1).when(high, reach - 1 - (i - states)).otherwise(2 * reach).cast("int")
    part = F.slice(shape, first + 1, last - first + 1)
    norm = F.when(low | high, F.aggregate(part, F.lit(0.0), lambda s, t: s + t)).otherwise(1.0)
    inside = (offset >= first) & (offset <= last)
    step = F.when(inside, stay * F.get(shape, offset) / norm).otherwise(0.0)
    return F.when(vi == vj, step).otherwise(F.when(i == j, 1.0 - stay).otherwise(0.0))


def tolerance_transition(i: Column, j: Column, tol: int = 0, low: float = 0.01, high: float = 1.0) -> Column:
    return F.when(F.abs(i - j) <= tol, high).otherwise(low)
