"""Aggregates and row functions over embedding vectors and keyed weight arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, t) -> s + t)")


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str) -> Column:
    """Cosine similarity; missing when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, (s, t) -> s + t)")


def l2_normalise(a: str) -> Column:
    return F.expr(f"transform({a}, t -> t / greatest(sqrt(aggregate({a}, 0D, (s, u) -> s + u * u)), 1e-12D))")


def blend(a: str, b: str, ratio: float) -> Column:
    """`(1 - ratio) * a + ratio * b`, element by element."""
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be within [0, 1]")
    return F.expr(f"zip_with({a}, {b}, (p, q) -> (1D - {ratio!r}D) * p + {ratio!r}D * q)")


def dimension_stats(long: DataFrame) -> DataFrame:
    """Mean and population deviation of each dimension of a `(d, c)` table."""
    return long.groupBy("d").agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"))


def mean_long(vectors: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Element-wise mean per key, one row per dimension; sums are combined before the shuffle."""
    return (
        vectors.select(*keys, F.posexplode(v).alias("d", "c")).groupBy(*keys, "d").agg(F.avg("c").alias("mean"))
    )


def gather(long: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rows `(keys, d, value)` back to one array per key. The array is as long as the vector, never longer."""
    packed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", value))).alias("_p"))
    return packed.select(*keys, F.expr(f"transform(_p, e -> e.{value})").alias(out))


def group_mean(vectors: DataFrame, keys: list[str], v: str, out: str = "mean") -> DataFrame:
    return gather(mean_long(vectors, keys, v), keys, "mean", out)
