"""Recurrences over frame series: best paths, feedback filters, period estimates.

A path or a filter depends on everything before it. A filter is cut into blocks: one pass sums up every block as a decay, those are
chained, and a last pass fills in the rows of each block. A path goes forward in order and is walked back in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.operators.blocks import BLOCK_ROWS, FAN, block_id, chained, group_starts, in_spans, join_on
from framewright.operators.frames import EPS
from framewright.session import cut


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


class Steps:
    """Best predecessors under a transition matrix that has its lowest value everywhere but on some diagonals.

    Only the diagonals are looked at one by one; over all other states the best is the best of all at the lowest value. A
    matrix without such a value has all of its diagonals looked at. The result, ties to the lowest state and rounding
    included, is that of looking at every pair of states.
    """

    def __init__(self, step: np.ndarray) -> None:
        n = len(step)
        self.floor = step.min()
        ahead = np.subtract.outer(np.arange(n), np.arange(n)).T  # from state i to j: j - i
        kept = np.unique(ahead[step > self.floor])[::-1]  # the farthest step first, so predecessors ascend
        kept = kept if len(kept) else np.zeros(1, np.int64)
        before = np.arange(n)[:, None] - kept
        self.inside = (before >= 0) & (before < n)
        self.before = np.where(self.inside, before, 0)
        self.cost = np.where(self.inside, step[self.before, np.arange(n)[:, None]], -np.inf)
        self.rows = np.arange(n)

    def ahead(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every state the best score of reaching it from scores `now`, and the state it is reached from."""
        reach = now[self.before] + self.cost
        at = reach.argmax(1)
        best, origin = reach[self.rows, at], self.before[self.rows, at]
        far = now + self.floor
        top = int(far.argmax())
        other = (far[top] > best) | ((far[top] == best) & (top < origin))
        return np.where(other, far[top], best), np.where(other, top, origin)


#: Frames whose steps back make one row.
CHUNK = 512


def viterbi(
    frames: DataFrame, keys: list[str], idx: str, scores: str, transition: np.ndarray, initial: np.ndarray, block: int = CHUNK
) -> DataFrame:
    """Best state path by log score: keys, idx, state. Ties go to the lowest state.

    `scores` is an array column with one log score per state, or an array of (state, score) structs in which missing states
    are impossible. `transition[i, j]` is the log score of a step from i to j, `initial` the log score of starting in each state.

    A path depends on everything before it, to the last bit: each key streams through one task in order, a batch of frames at
    a time, which keeps the scores of one frame and the steps back of one chunk of `block` frames. The chunks are written as
    rows with the steps back and the map from the state after the chunk to that before it; the maps are chained from
    the end, and every chunk is walked back by itself. The result does not depend on `block`.
    """
    step, start = Steps(np.asarray(transition, float)), np.asarray(initial, float)
    states, names = len(start), [*keys, idx]
    small = np.dtype(np.uint8 if states <= 1 << 8 else np.uint16 if states <= 1 << 16 else np.int32)
    fields = frames.select(*names).schema
    ordered = frames.select(*names, F.col(scores).alias("_s")).repartition(*keys).sortWithinPartitions(*names)

    def dense(column: pa.Array) -> np.ndarray:
        if not pa.types.is_struct(column.type.value_type):
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, states)
        out = np.full((len(column), states), -np.inf)
        flat = column.flatten()
        rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
        state, value = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        np.maximum.at(out, (rows, state.astype(np.int64)), value.astype(np.float64))
        return out

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, number, places, back = None, None, 0, [], []

        def chunk() -> pa.RecordBatch:
            steps, origin = np.array(back, small), np.arange(states)
            for t in range(len(steps) - 1, -1, -1):
                origin = steps[t][origin]
            values = [*key, number, list(places), steps.tobytes(), origin.tolist(), int(now.argmax())]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in range(len(names))]
            for t, obs in enumerate(dense(batch.column(len(names)))):
                own = tuple(c[t] for c in lists[:-1])
                if now is None or own != key or len(back) == block:
                    if back:
                        yield chunk()
                    number = number + 1 if now is not None and own == key else 0
                    places, back = [], []
                if now is None or own != key:
                    key, now = own, start + obs
                    back.append(np.zeros(states, small))
                else:
                    best, origin = step.ahead(now)
                    now = best + obs
                    back.append(origin.astype(small))
                places.append(lists[-1][t])
        if back:
            yield chunk()

    key_ddl, place = _ddl(frames, keys), fields[idx].dataType.simpleString()
    schema = f"{key_ddl}, _blk bigint, at array<{place}>, back binary, m array<int>, last int"
    target = to_arrow_schema(frames.sparkSession.createDataFrame([], schema).schema)
    chunks = cut(ordered.mapInArrow(forward, schema))
    ends = chained(chunks.select(*keys, "_blk", "m", "last"), keys, "last", reverse=True, fan=FAN)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                at, end = row.column(len(keys)).flatten(), int(row.column(len(keys) + 2)[0].as_py())
                path = _walk_back(np.frombuffer(row.column(len(keys) + 1)[0].as_py(), small).reshape(-1, states), end)
                times = pa.array(np.zeros(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([*[row.column(k).take(times) for k in range(len(keys))], at, pa.array(path)], names=[*names, "state"])

    met = join_on(chunks.select(*keys, "_blk", "at", "back"), ends, [*keys, "_blk"])
    return met.select(*keys, "at", "back", "_entry").mapInArrow(walk, f"{_ddl(frames, names)}, state bigint")


def _walk_back(back: np.ndarray, end: int) -> np.ndarray:
    path = np.empty(len(back), dtype=np.int64)
    for t in range(len(back) - 1, -1, -1):
        path[t] = end
        end = back[t][end]
    return path


def band_matrix(states: int, width: int) -> np.ndarray:
    """Log of the row-normalised triangular band."""
    i = np.arange(states)
    band = np.maximum(width - np.abs(i[:, None] - i), 0).astype(float)
    return np.log(band / band.sum(1, keepdims=True) + np.finfo(float).tiny)


# Fixed value: the guard inside the logarithm of salience (single precision epsilon).
SALIENCE_EPS = 1.1920928955078125e-07


def c_library(lists: Column | str, fn: Callable[[pa.Array], pa.Array]) -> Column:
    """`fn` of all elements of an array of doubles, in Arrow.

    Arrow's powers, exponentials and logarithms are the C library's, as a database's are. Those of the JVM differ from them in the
    last bit, which is enough to choose another of two paths that score the same.
    """

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(column.offsets, fn(column.values))

    return run(lists)


def trajectory(
    grid: DataFrame, keys: list[str], idx: str, salience: str, states: int, tol: int = 5, regions: DataFrame | None = None,
    low: float = 0.01, high: float = 1.0, **opts
) -> DataFrame:
    """Best path through a salience grid (an array of `states` values per frame); -1 outside the regions if there are any.

    `regions` has keys, region, start, end: disjoint `[start, end)` spans tracked independently of each other.
    """
    i = np.arange(states)
    step = np.log(np.where(np.abs(i[:, None] - i) <= tol, high, low) + SALIENCE_EPS)
    scored = grid.select(*keys, idx, c_library(salience, lambda z: pc.ln(pc.add(z, SALIENCE_EPS))).alias("_lp"))
    if regions is None:
        return viterbi(scored, keys, idx, "_lp", step, np.zeros(states), **opts)
    regions = cut(regions.select(*keys, "region", "start", "end"))
    inside = in_spans(scored, regions.select(*keys, "region", "start", "end"), keys, idx, "start", "end")
    local = inside.select(*keys, "region", (F.col(idx) - F.col("start")).alias(idx), "_lp")
    paths = viterbi(local, [*keys, "region"], idx, "_lp", step, np.zeros(states), **opts)
    placed = paths.join(regions, [*keys, "region"]).select(*keys, (F.col(idx) + F.col("start")).alias(idx), "state")
    return grid.select(*keys, idx).join(placed, [*keys, idx], "left").withColumn("state", F.coalesce("state", F.lit(-1).cast("bigint")))


def _fed_back(values: np.ndarray, fresh: np.ndarray, coef: float) -> np.ndarray:
    """`y[t] = x[t] + coef · y[t-1]`, from rest where `fresh`: sums of 1, 2, 4, ... rows until they reach the longest stretch."""
    rows = np.arange(len(values))
    since = rows - np.maximum.accumulate(np.where(fresh, rows, 0))
    out, reach = values.copy(), 1
    while reach <= since.max():
        out[reach:] += np.where(since[reach:] >= reach, coef**reach * out[:-reach], 0.0)
        reach *= 2
    return out


def inverse_preemphasis(df: DataFrame, keys: list[str], idx: str, x: str, coef: float, block: int = BLOCK_ROWS) -> DataFrame:
    """`y[t] = x[t] + coef · y[t-1]`, added as `y`: each block from rest, plus the decayed end of the block before.

    The blocks of a task go through it one after the other, many short ones in a batch.
    """
    part = [*keys, "_blk"]

    def from_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0.0
        for batch in filter(len, batches):
            fresh, last = group_starts(batch, part, last)
            values = pc.cast(batch[x], pa.float64()).to_numpy(zero_copy_only=False).copy()
            if not fresh[0]:
                values[0] += coef * held
            fresh[0] = True
            out = _fed_back(values, fresh, coef)
            held = float(out[-1])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in [*keys, idx, "_blk"]], pa.array(out)], names=[*keys, idx, "_blk", "y"])

    rows = df.select(*keys, idx, x, block_id(idx, block).alias("_blk")).repartition(*part).sortWithinPartitions(*part, idx)
    local = cut(rows.mapInArrow(from_rest, f"{_ddl(df, [*keys, idx])}, _blk bigint, y double"))
    ends = local.groupBy(*part).agg(F.max_by("y", idx).alias("e"), F.count(F.lit(1)).alias("n"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0.0
        for batch in filter(len, batches):
            fresh, last = group_starts(batch, keys, last)
            out = np.empty(len(fresh))
            for t, (new, e, n) in enumerate(zip(fresh.tolist(), batch["e"].to_pylist(), batch["n"].to_pylist())):
                out[t] = held = 0.0 if new else held
                held = e + coef ** float(n) * held
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in part], pa.array(out), pa.array(fresh)], names=[*part, "h", "_first"])

    ordered = ends.repartition(*keys).sortWithinPartitions(*part)
    entered = ordered.mapInArrow(carry, f"{_ddl(df, keys)}, _blk bigint, h double, _first boolean")
    held = cut(entered.where("NOT _first").drop("_first"))  # the first block of a key is entered at rest, so short series have no row here
    decay = F.pow(F.lit(float(coef)), (F.col(idx) - F.col("_blk") * block + 1).cast("double"))
    return join_on(local, held, part, "left").select(*keys, idx, F.when(F.col("h").isNull(), F.col("y")).otherwise(F.col("y") + decay * F.col("h")).alias("y"))


def cmndf(f: str, lag_max: int) -> Column:
    """Cumulative mean normalised difference of a frame array at lags 0..lag_max."""
    diff = f"""aggregate(zip_with(slice({f}, 1, size({f}) - k), slice({f}, k + 1, size({f}) - k), (p, q) -> (p - q) * (p - q)),
        0D, (s, t) -> s + t)"""
    diffs = f"transform(sequence(1, {lag_max}), k -> {diff})"
    walk = f"""aggregate({diffs}, named_struct('m', 0D, 'k', 0, 'out', array(1D)), (a, v) -> named_struct(
        'm', a.m * a.k / (a.k + 1) + v / (a.k + 1), 'k', a.k + 1,
        'out', concat(a.out, array(v / (a.m * a.k / (a.k + 1) + v / (a.k + 1) + {EPS!r}D)))), a -> a.out)"""
    return F.expr(walk)


def _dip(cm: np.ndarray, threshold: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Refined lag of the first local minimum below `threshold` in `[low, high)`, else of the smallest value there.

    The refined depth is written back, as later searches look at it.
    """
    lags = np.arange(cm.shape[1])
    span = (lags >= low[:, None]) & (lags < high[:, None])
    dip = np.zeros(cm.shape, dtype=bool)
    dip[:, 1:-1] = (cm[:, 1:-1] < cm[:, :-2]) & (cm[:, 1:-1] < cm[:, 2:])
    dip &= span & (cm < threshold)
    found, at, rows = dip.any(1), dip.argmax(1), np.arange(len(cm))
    inner = np.clip(at, 1, cm.shape[1] - 2)
    y1, y2, y3 = cm[rows, inner - 1], cm[rows, inner], cm[rows, inner + 1]
    a, b = EPS + (y1 + y3 - 2.0 * y2) / 2.0, (y3 - y1) / 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        refined, depth = at - b / (2.0 * a), y2 - b**2 / (4.0 * a)
    lowest = np.where(span, cm, np.inf).argmin(1)
    use = found & (low != high)
    cm[rows[use], at[use]] = depth[use]
    return np.where(low == high, low, np.where(found, refined, lowest)).astype(float)


def period_estimate(frames: DataFrame, keys: list[str], f: str, rate: float, f_min: float, f_max: float, threshold: float = 0.15):
    """Frequency and aperiodicity of each frame array; the lag is refined once more within 25 cents of the first estimate."""
    if f_min > f_max:
        raise ValueError("f_min must not exceed f_max")
    lag_min, lag_max = max(int(np.ceil(rate / f_max)), 1), int(np.ceil(rate / f_min))

    def run(batches):
        for batch in batches:
            x = batch[f].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cm, mean = np.ones((len(x), lag_max + 1)), np.zeros(len(x))
            for k in range(1, lag_max + 1):
                diff = ((x[:, :-k] - x[:, k:]) ** 2).sum(1)
                mean = mean * (k - 1) / k + diff / k
                cm[:, k] = diff / (mean + EPS)
            whole = np.ones(len(x), dtype=int)
            lag = _dip(cm, threshold, whole * lag_min, whole * lag_max)
            near = lambda cents: np.rint(lag * 2.0 ** (-cents / 1200.0)).astype(int)
            lag = _dip(cm, np.inf, np.maximum(near(25), lag_min), np.minimum(near(-25), lag_max))
            whole_lag = np.floor(lag).astype(int)
            part = (lag - whole_lag)[:, None]
            mirrored = np.concatenate([x, x[:, ::-1]], 1)
            at = whole_lag[:, None] + np.arange(x.shape[1])
            moved = (1 - part) * np.take_along_axis(mirrored, at, 1) + part * np.take_along_axis(
                mirrored, np.minimum(at + 1, mirrored.shape[1] - 1), 1
            )
            power = ((x**2).mean(1) + (moved**2).mean(1)) / 2.0
            ap = ((x - moved) ** 2).mean(1) / 2.0 / (power + EPS)
            columns = [batch[k] for k in keys] + [pa.array(rate / lag), pa.array(ap)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "f0", "ap"])

    return frames.select(*keys, f).mapInArrow(run, f"{_ddl(frames, keys)}, f0 double, ap double")
