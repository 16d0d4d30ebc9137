"""Whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framewright.session import cut

STEP, SHIFT, COMPONENTS = 1024, 100_000, 8


def fit_list(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x), written to the shared folder, and the dimension.

    x are the entries in steps of 1/1024, rounded down and shifted. Vectors that are null or empty or hold null or non-finite
    entries are left out, and so are those of another length than most have (the longer one among equally many).
    """
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(STEP * c.cast("double")) + SHIFT)
    rows = cut(vectors.where(fine).select("vec_id", x.alias("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("x") == dimension), dimension


def matrices(batches: Iterator[pa.RecordBatch], column: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def added(rows: DataFrame, column: str, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all vectors of what `of` makes of a batch: one matrix per task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, 0, shape[1]):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["place", "value"])

    sums = rows.select(column).mapInArrow(run, f"place bigint, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1], np.int64 if kind == "bigint" else np.float64)
    out[sums["place"].to_numpy(np.int64)] = sums["value"].to_numpy()
    return out.reshape(shape)


def scatter(rows: DataFrame, column: str, dimension: int, mean: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the vectors less their mean."""

    def of(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    return added(rows, column, (dimension, dimension), of)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L @ L.T equal to `a`, one column per pivot: the largest diagonal entry left, until nothing but rounding is left.

    In the order of the pivots its rows are lower triangular; they are left in the order of `a`.
    """
    a, columns = a.astype(np.float64).copy(), []
    least = max(a.diagonal().max(initial=0.0), 0.0) * len(a) * np.finfo(float).eps
    left = np.ones(len(a), bool)
    while left.any():
        pivot = int(np.argmax(np.where(left, a.diagonal(), -np.inf)))
        if not a[pivot, pivot] > least:
            break
        column = np.where(left, a[:, pivot], 0.0) / np.sqrt(a[pivot, pivot])
        columns.append(column)
        a -= np.outer(column, column)
        left[pivot] = False
    return np.array(columns).T if columns else np.zeros((len(a), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`factor` with its columns rotated in pairs until all are orthogonal.

    A round deals the columns into disjoint pairs, which are rotated at once; in a sweep every two columns meet.
    """
    g = factor.copy()
    n = g.shape[1] + g.shape[1] % 2
    g = np.concatenate([g, np.zeros((len(g), n - g.shape[1]))], axis=1)
    seats = np.arange(n)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(n - 1):
            p, q = seats[: n // 2], seats[n // 2 :][::-1]
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            scale = np.sqrt(aa * bb)
            turn = np.abs(ab) > 1e-15 * scale
            worst = max(worst, float(np.max(np.abs(ab[turn]) / scale[turn], initial=0.0)))
            tau = (bb - aa) / (2 * np.where(turn, ab, 1.0))
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            c, s = np.where(turn, c, 1.0), np.where(turn, t * c, 0.0)
            g[:, p], g[:, q] = c * a - s * b, s * a + c * b
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
        if worst < 1e-14:
            break
    return g[:, : factor.shape[1]]


def principal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a positive semi-definite matrix, by falling eigenvalue; zero ones are left out.

    The sign of a vector makes its entry of largest size positive.
    """
    turned = one_sided_jacobi(pivoted_cholesky(a))
    norms = np.sqrt((turned * turned).sum(0))
    order = np.argsort(-norms, kind="stable")
    norms, units = norms[order], turned[:, order] / norms[order]
    signs = np.sign(units[np.argmax(np.abs(units), axis=0), np.arange(len(norms))])
    return norms * norms, units * signs


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector of the fit list and component.

    Vectors are taken in steps of 1/1024 (`fit_list` says which take part). Components are unit eigenvectors of their
    covariance by falling eigenvalue; there are fewer than `components` where the covariance has a smaller rank, and none
    for a single vector or equal ones. `whitened` is the projection of the centred vector over the square root of the eigenvalue,
    `explained` that eigenvalue's share of the trace, `identity_error` how far the covariance of `whitened` is from the identity.
    `deviation` is the exact sum of squares of n * x - (sum of all x); where it does not fit in 64 bits, the job fails.
    Repeated vectors count each; null ids are kept; an empty table gives no rows; other columns are ignored.

    Three sums over the vectors are made by task and place: of the entries, of the centred outer products, and of these
    after whitening; the driver gets matrices of the dimension alone.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows, d = fit_list(vectors, vector)
    n = rows.count() if d else 0
    if not n:
        return spark.createDataFrame([], schema)
    sums = added(rows, "x", (1, d), lambda x: x.sum(0, keepdims=True), "bigint")[0]
    mean = sums / n
    spread = scatter(rows, "x", d, mean)
    values, units = principal(spread)
    keep = min(components, len(values))
    if not keep:
        return spark.createDataFrame([], schema)
    explained = (values / spread.trace())[:keep].tolist()
    axes = units[:, :keep] / np.sqrt(values[:keep] / n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, 1, d):
            off = n * x.astype(np.float64) - sums
            if max(float((off * off).sum(1).max()), float(np.abs(off).max())) > 9e18:
                raise OverflowError("a deviation does not fit in 64 bits")
            exact = n * x - sums
            z = (x - mean) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, keep, dtype=np.int32)), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((exact * exact).sum(1)), lists], names=["vec_id", "deviation", "z"])

    found = cut(rows.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, deviation bigint, z array<double>"))
    centre = added(found, "z", (1, keep), lambda z: z.sum(0, keepdims=True))[0] / n
    error = float(np.abs(scatter(found, "z", keep, centre) / n - np.eye(keep)).max())
    shares = F.array(*[F.lit(e) for e in explained])
    return found.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
