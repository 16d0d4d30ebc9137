"""Evaluation metrics, logs and log-frequency energy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framewright.functions.pitch import log_bin
from framewright.operators.blocks import with_group


def voiced_stats(track: DataFrame, keys: list[str], f0: str) -> DataFrame:
    voiced = F.when(F.col(f0) > 0, F.col(f0))
    return track.groupBy(*keys).agg(F.avg(voiced).alias("mean"), F.min(voiced).alias("low"), F.max(voiced).alias("high"))


def l1_summary(pairs: DataFrame, item: list[str], real: str, fake: str) -> DataFrame:
    """Mean absolute error two ways: the mean of the items' means, and the mean over all values."""
    per_item = pairs.groupBy(*item).agg(F.sum(F.abs(F.col(real) - F.col(fake))).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per_item.agg(
        F.count(F.lit(1)).alias("items"),
        F.avg(F.col("_s") / F.col("_n")).alias("mean_of_means"),
        (F.sum("_s") / F.sum("_n")).alias("mean"),
    )


def spectral_convergence(real: Column, fake: Column) -> Column:
    """Frobenius norm of the difference over that of the real magnitudes (an aggregate)."""
    return F.try_divide(F.sqrt(F.sum((real - fake) * (real - fake))), F.sqrt(F.sum(real * real)))


# Fixed value: the power floor under magnitudes.
POWER_FLOOR = 1e-7


def log_magnitude_l1(real: Column, fake: Column) -> Column:
    floor = F.lit(math.sqrt(POWER_FLOOR))
    return F.avg(F.abs(F.log(F.greatest(real, floor)) - F.log(F.greatest(fake, floor))))


def multi_resolution(pairs: DataFrame, keys: list[str], idx: str, real: str, fake: str, sizes: list[int]) -> DataFrame:
    """Both spectral losses on window energies of several sizes, averaged over the sizes."""
    sized = pairs.withColumn("_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    energy = lambda x: F.sqrt(F.greatest(F.sum(F.col(x) * F.col(x)), F.lit(POWER_FLOOR)))
    windows = sized.groupBy(*keys, "_size", F.expr(f"`{idx}` div _size").alias("_w")).agg(
        energy(real).alias("_r"), energy(fake).alias("_f")
    )
    per_size = windows.groupBy(*keys, "_size").agg(
        spectral_convergence(F.col("_r"), F.col("_f")).alias("_sc"), log_magnitude_l1(F.col("_r"), F.col("_f")).alias("_mag")
    )
    return per_size.groupBy(*keys).agg(F.avg("_sc").alias("sc"), F.avg("_mag").alias("mag"))


def masked_kl(z: Column, logs_q: Column, m_p: Column, logs_p: Column, mask: Column, logdet: Column | None = None) -> Column:
    """KL of a sampled z against a Gaussian prior over the masked rows (an aggregate)."""
    point = logs_p - logs_q - 0.5 + 0.5 * F.pow(z - m_p, F.lit(2.0)) * F.exp(-2.0 * logs_p)
    total = F.sum(point * mask)
    return F.try_divide(total if logdet is None else total - F.sum(logdet), F.sum(mask))


def gaussian_kl(m_p: Column, logs_p: Column, m_q: Column, logs_q: Column) -> Column:
    gap = m_p - m_q
    return (logs_q - logs_p) - 0.5 + 0.5 * (F.exp(2.0 * logs_p) + gap * gap) * F.exp(-2.0 * logs_q)


def drift_from_all(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Gaussian KL of each key's values against all values.

    Only moments per key leave the first aggregate; the overall moments are their sum.
    """
    v = F.col(x)
    moments = rows.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    total = moments.agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "s", "q")])
    both = moments.select(key, "n", "s", "q", *[total.select(f"_{c}").scalar().alias(f"_{c}") for c in ("n", "s", "q")])
    mean = lambda p: F.col(f"{p}s") / F.col(f"{p}n")
    log_std = lambda p: 0.5 * F.log(F.col(f"{p}q") / F.col(f"{p}n") - mean(p) * mean(p))
    return both.select(key, gaussian_kl(mean(""), log_std(""), mean("_"), log_std("_")).alias("kl"))


def attentive_stats(rows: DataFrame, keys: list[str], x: str, score: Column) -> DataFrame:
    """Softmax-weighted mean and deviation of each key."""
    top = with_group(rows.withColumn("_z", score), keys, _m=F.max("_z"))
    e = F.exp(F.col("_z") - F.col("_m"))
    v = F.col(x)
    sums = top.groupBy(*keys).agg(F.sum(e).alias("_e"), F.sum(e * v).alias("_x"), F.sum(e * v * v).alias("_q"))
    mean = F.col("_x") / F.col("_e")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("_e") - mean * mean, F.lit(1e-5)))
    return sums.select(*keys, mean.alias("mean"), spread.alias("std"))


def multi_crop_mean(rows: DataFrame, keys: list[str], idx: str, pools: dict[str, Column], frames: int, crops: int) -> DataFrame:
    """Mean of the unit-length embeddings of evenly spaced windows; a short key shrinks the window.

    `pools` names the aggregates that form a window's embedding.
    """
    sized = with_group(rows, keys, _n=F.count(F.lit(1))).withColumn("_w", F.expr(f"least({frames}L, _n)"))
    start = f"floor(j * ((_n - _w) / {crops - 1}D))"
    inside = f"filter(sequence(0, {crops - 1}), j -> `{idx}` >= {start} AND `{idx}` < {start} + _w)"
    windows = sized.withColumn("_crop", F.explode(F.expr(inside)))
    pooled = windows.groupBy(*keys, "_crop").agg(*[c.alias(n) for n, c in pools.items()])
    length = F.greatest(F.sqrt(sum((F.col(n) * F.col(n) for n in pools), F.lit(0.0))), F.lit(1e-12))
    return pooled.groupBy(*keys).agg(*[F.avg(F.col(n) / length).alias(n) for n in pools])


def log_rows(wide: DataFrame, step: str, every: int) -> DataFrame:
    """(step, tag, val) of a wide metric table at every `every`-th step: every column but `step` is a tag."""
    picked = wide.where(F.col(step) % every == 0)
    return picked.unpivot([step], [c for c in wide.columns if c != step], "tag", "val").where("val IS NOT NULL")


def histogram(log: DataFrame, keys: list[str], val: str, bins: int) -> DataFrame:
    """Counts in equal bins between each key's extremes; the top value falls in the last bin."""
    spread = with_group(log, keys, _lo=F.min(val), _hi=F.max(val))
    place = F.floor(F.coalesce(F.try_divide((F.col(val) - F.col("_lo")) * float(bins), F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    return spread.groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_bin_power(rows: DataFrame, keys: list[str], hz: str, power: str, resolution: float, low: float, high: float) -> DataFrame:
    """Power added up in log-frequency bins; frequencies outside `[low, high)` are discarded."""
    inside = rows.where((F.col(hz) >= low) & (F.col(hz) < high))
    return inside.groupBy(*keys, log_bin(F.col(hz), resolution, low).alias("bin")).agg(F.sum(power).alias("power"))


def bin_count(resolution: float, low: float, high: float) -> int:
    return math.floor((1200.0 / resolution) * math.log2(high / low) + 0.5) + 1


def harmonic_weights(resolution: float, harmonics: int, alpha: float, width: int) -> dict[int, float]:
    """Weight of each bin offset: a squared-cosine window around every harmonic, falling by `alpha` per harmonic."""
    half = width // 2
    weights: dict[int, float] = {}
    for k in range(harmonics):
        centre = round(math.log2(k + 1) * 1200.0 / resolution)
        for o in range(-half, half + 1):
            w = alpha**k * math.cos(o / half * math.pi / 2.0) ** 2
            if w > 1e-15:
                weights[centre + o] = weights.get(centre + o, 0.0) + w
    return weights


def harmonic_sum(spectrum: DataFrame, keys: list[str], weights: dict[int, float], bins: int) -> DataFrame:
    """Salience of each bin that some power supports: weighted power at its harmonics.

    The bins of a frame, a bounded number, are gathered once; the frames of a batch make a matrix, and their saliences are its
    product with the weights. Several powers of a bin add up; missing ones do not count.
    """
    band = np.zeros((bins + max(weights), bins))
    for o, w in weights.items():
        at = np.arange(max(0, -o), bins)
        band[at + o, at] = w
    ddl = ", ".join(f"`{k}` {spectrum.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(keys))
            flat = held.flatten()
            frame = np.repeat(np.arange(batch.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False))
            place, power = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            good = (place >= 0) & (place < len(band)) & ~np.isnan(power)
            dense, there = np.zeros((batch.num_rows, len(band))), np.zeros((batch.num_rows, len(band)))
            np.add.at(dense, (frame[good], place[good].astype(np.int64)), power[good])
            there[frame[good], place[good].astype(np.int64)] = 1.0
            row, bin_ = np.nonzero(there @ (band != 0))
            found = (dense @ band)[row, bin_]
            same = [batch.column(k).take(pa.array(row)) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(bin_.astype(np.int64)), pa.array(found)], names=[*keys, "bin", "salience"])

    gathered = spectrum.where("power IS NOT NULL").groupBy(*keys).agg(F.collect_list(F.struct(F.col("bin").cast("bigint"), F.col("power").cast("double"))).alias("_b"))
    return gathered.mapInArrow(run, f"{ddl}, bin bigint, salience double")


# Fixed value: the guard inside the logarithm of relative levels (single precision epsilon).
LEVEL_EPS = 1.1920928955078125e-07


def compress_levels(rows: DataFrame, clip: list[str], x: str, beta: float, gamma: float) -> DataFrame:
    """`x` to the power `beta` where it lies below `gamma` dB relative to the clip's peak, 0 elsewhere and in silent clips."""
    peaked = with_group(rows, clip, _peak=F.max(x))
    level = 20.0 * F.log10(F.try_divide(F.col(x), F.col("_peak")) + LEVEL_EPS)
    return peaked.withColumn(x, F.when(level < gamma, F.pow(F.col(x), F.lit(beta))).otherwise(0.0)).drop("_peak")


def salience(
    spectrum: DataFrame, clip: list[str], frame: list[str], weights: dict[int, float], bins: int, beta: float, gamma: float
) -> DataFrame:
    """`harmonic_sum` of the compressed power, compressed once more: columns clip, frame, bin, salience."""
    summed = harmonic_sum(compress_levels(spectrum, clip, "power", beta, gamma), [*clip, *frame], weights, bins)
    return compress_levels(summed, clip, "salience", beta, gamma)


def retention(rows: DataFrame, name: list[str], row_id: str, newest: list, keep: int, protected: Column | None = None) -> DataFrame:
    """Rows to delete: all but the `keep` newest of each name; nothing if `keep` is 0. Protected rows do not count.

    The survivors are a top-k per name, cut before the shuffle; the rest follows by anti-join, so a name with very
    many rows is never ranked as a whole.
    """
    if keep == 0:
        return rows.limit(0)
    open_rows = rows if protected is None else rows.where(~protected)
    order = W.partitionBy(*name).orderBy(*newest)
    survivors = open_rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).select(*name, row_id)
    return open_rows.join(survivors, [*name, row_id], "left_anti")
