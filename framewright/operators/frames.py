"""Frame series: filters, framing, chunking, alignment and phase. Every series is (keys, idx, value) rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.operators.blocks import BLOCK_ROWS, framed, group_starts, halo, ordinal, running, stretched, with_group
from framewright.session import cut

# Fixed value: the guard against a zero denominator (double precision epsilon).
EPS = 2.220446049250313e-16
#: Rows of results that a task puts together before they leave it.
FLUSH_ROWS = 8192


def _around(w: WindowSpec, win: int) -> WindowSpec:
    return w.rowsBetween(-(win // 2), win // 2)


def moving_average(df: DataFrame, keys, idx: str, x: str, n: int, out: str = "y", **opts) -> DataFrame:
    """Box filter of length n with zeros beyond the ends: the divisor is always n."""
    before, after = n // 2, (n - 1) // 2
    return framed(df, keys, idx, before, after, lambda w: {out: F.sum(x).over(w.rowsBetween(-before, after)) / float(n)}, **opts)


def valid_mean(x: str) -> Callable[[WindowSpec], Column]:
    return lambda w: F.avg(x).over(w)


def lower_median(x: str) -> Callable[[WindowSpec], Column]:
    """Lower median of the values present in the frame, missing if there are none."""

    def column(w: WindowSpec) -> Column:
        seen = F.sort_array(F.collect_list(x).over(w))
        return F.get(seen, ((F.size(seen) - 1) / 2).cast("int"))

    return column


def window_filter(df: DataFrame, keys, idx: str, win: int, fn, out: str = "y", **opts) -> DataFrame:
    """Any function of a centred window of odd length; the window shrinks at the ends."""
    return framed(df, keys, idx, win // 2, win // 2, lambda w: {out: fn(_around(w, win))}, **opts)


def mean_filter(df: DataFrame, keys, idx: str, x: str, win: int, out: str = "y", **opts) -> DataFrame:
    """Mean of the values present; a mean of exactly zero counts as missing."""
    return window_filter(df, keys, idx, win, lambda w: F.nullif(F.avg(x).over(w), F.lit(0.0)), out, **opts)


#: Widest window whose values are sorted for every row; wider ones keep an order that each step changes by two values.
SORTED_WINDOW = 63


def median_filter(df: DataFrame, keys, idx: str, x: str, win: int, out: str = "y", rows: int = BLOCK_ROWS, sorted_up_to: int = SORTED_WINDOW) -> DataFrame:
    """Lower median of the values present in a centred window of odd length, missing if there are none."""
    if win <= sorted_up_to:
        return window_filter(df, keys, idx, win, lower_median(x), out, rows=rows)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{out}` double"
    return chunk_apply(df, keys, idx, rows, win // 2, lambda pdf: pdf.assign(**{out: sliding_median(pdf[x].to_numpy(np.float64), win)}), schema)


def sliding_median(values: np.ndarray, win: int) -> np.ndarray:
    """Lower medians of centred windows of odd length, which shrink at the ends; NaN is no value.

    The values of a window are counted in a tree over the ranks of all values, so a step costs the logarithm of their number.
    """
    n, half = len(values), win // 2
    distinct, rank = np.unique(values, return_inverse=True)
    present, rank = (~np.isnan(values)).tolist(), (rank + 1).tolist()
    size = 1 << len(distinct).bit_length()
    tree, held, out = [0] * (size + 1), 0, np.full(n, np.nan)

    def add(i: int, by: int) -> None:
        while i <= size:
            tree[i] += by
            i += i & -i

    for right in range(n + half):
        if right < n and present[right]:
            add(rank[right], 1)
            held += 1
        left = right - win
        if left >= 0 and present[left]:
            add(rank[left], -1)
            held -= 1
        if right >= half and held:
            place, wanted, step = 0, (held + 1) // 2, size
            while step:
                if place + step <= size and tree[place + step] < wanted:
                    place += step
                    wanted -= tree[place]
                step >>= 1
            out[right - half] = distinct[place]
    return out


def preemphasis(df: DataFrame, keys, idx: str, x: str, coef: float, out: str = "y", **opts) -> DataFrame:
    if coef == 0:
        raise ValueError("the coefficient must not be 0")
    return framed(df, keys, idx, 1, 0, lambda w: {out: F.col(x) - coef * F.coalesce(F.lag(x).over(w), F.lit(0.0))}, **opts)


def delay(df: DataFrame, keys, idx: str, x: str, out: str = "y", **opts) -> DataFrame:
    """Shift by one step with a zero in front."""
    return framed(df, keys, idx, 1, 0, lambda w: {out: F.coalesce(F.lag(x).over(w), F.lit(0.0))}, **opts)


def peaks(df: DataFrame, keys, idx: str, f0: str, out: str = "peak", **opts) -> DataFrame:
    """Voiced maxima between voiced neighbours, and the first voiced step after an unvoiced one."""

    def stage(w):
        voiced = lambda c: F.coalesce(c > 0, F.lit(False))
        here, prev, after = F.col(f0), F.lag(f0).over(w), F.lead(f0).over(w)
        top = voiced(here) & voiced(prev) & voiced(after) & (here > prev) & (here > after)
        return {out: F.coalesce(top, F.lit(False)) | (voiced(here) & ~voiced(prev))}

    return framed(df, keys, idx, 1, 1, stage, **opts)


def first_dip(df: DataFrame, keys, idx: str, x: str, threshold: float, low: int, high: int, **opts) -> DataFrame:
    """Per key the first strict local minimum below `threshold` within `[low, high)`, else the position of the minimum.

    Columns: keys, lag, dip (whether a local minimum was found), and the refined `vertex` and `depth` of the parabola
    through the dip and its neighbours.
    """
    near = framed(
        df, keys, idx, 1, 1, lambda w: {"_p": F.lag(x).over(w), "_n": F.lead(x).over(w)}, **opts
    ).where((F.col(idx) >= low) & (F.col(idx) < high))
    dip = (F.col(x) < F.col("_p")) & (F.col(x) < F.col("_n")) & (F.col(x) < threshold)
    found = F.struct(F.col(idx).alias("i"), F.col("_p").alias("p"), F.col(x).alias("x"), F.col("_n").alias("n"))
    best = near.groupBy(*keys).agg(
        F.min(F.when(dip, found)).alias("_d"), F.expr(f"min_by(`{idx}`, struct(`{x}`, `{idx}`))").alias("_m"),
        F.min(x).alias("_floor"),
    )
    shift, depth = vertex(F.col("_d.p"), F.col("_d.x"), F.col("_d.n"))
    return best.select(
        *keys,
        F.coalesce("_d.i", "_m").alias("lag"),
        F.col("_d").isNotNull().alias("dip"),
        F.coalesce(F.col("_d.i") + shift, F.col("_m").cast("double")).alias("vertex"),
        F.coalesce(depth, F.col("_floor")).alias("depth"),
    )


def vertex(y1: Column, y2: Column, y3: Column) -> tuple[Column, Column]:
    """Offset and value of the extremum of a parabola through three equally spaced points."""
    a = EPS + (y1 + y3 - 2.0 * y2) / 2.0
    b = (y3 - y1) / 2.0
    return F.try_divide(-b, 2.0 * a), y2 - F.try_divide(b * b, 4.0 * a)


def phases(df: DataFrame, keys, idx: str, f0: str, rate: float, harmonics: int, **opts) -> DataFrame:
    """Running phase of each harmonic in cycles, its sine, and the voiced flag.

    `f0` is rounded to 1e-12 Hz and added up as decimals, so a series of any length, in any blocks, gathers no further error and a
    whole number of cycles is phase 0. Values that this does not hold (NaN and from 1e5 Hz) are added up as doubles; `rate` is below 1e7.
    """
    fits = F.abs(f0) < 1e5
    sums = {"_c": ("sum", F.when(fits, F.col(f0).cast("decimal(17,12)"))), "_w": ("sum", F.when(~fits, F.col(f0).cast("double")))}
    cycle = F.lit(rate).cast("decimal(17,10)")
    out = running(df, keys, idx, sums, **opts).withColumn("k", F.explode(F.expr(f"sequence(1L, {harmonics}L)")))
    held = F.pmod(F.pmod("_c", cycle) * F.col("k").cast("int"), cycle).cast("double") / rate
    out = out.withColumn("phase", F.pmod(held + F.col("_w") / rate * F.col("k"), F.lit(1.0))).drop("_c", "_w")
    return out.withColumn("sine", F.sin(2.0 * math.pi * F.col("phase"))).withColumn("voiced", F.col(f0) > 0)


def restarted_phase(df: DataFrame, keys, idx: str, f0: str, rate: float, **opts) -> DataFrame:
    """Running phase that starts again from zero at every voiced stretch, and its cosine."""
    cum = cut(running(cut(df), keys, idx, {"_c": ("sum", F.col(f0) / rate)}, **opts))
    base = running(cum, keys, idx, {"_b": ("last", F.when(F.col(f0) <= 0, F.col("_c")))}, **opts)
    out = base.withColumn("phase", F.col("_c") - F.coalesce("_b", F.lit(0.0))).drop("_c", "_b")
    return out.withColumn("wave", F.cos(2.0 * math.pi * F.col("phase")))


def instantaneous_hz(df: DataFrame, keys, idx: str, phase: str, k: int, size: int, hop: int, rate: float, **opts):
    """Frequency from the wrapped phase step between frames; the first frame repeats the second."""
    omega, turn = 2.0 * math.pi * k / size, 2.0 * math.pi

    def stage(w):
        step = F.coalesce(F.col(phase) - F.lag(phase).over(w), F.lead(phase).over(w) - F.col(phase)) - omega * hop
        wrapped = step - turn * (F.rint(step / turn + 1.0) - 1.0)
        return {"hz": (omega + wrapped / hop) * rate / turn}

    return framed(df, keys, idx, 1, 1, stage, **opts)


def peak_normalise(df: DataFrame, keys, x: str, gain: float, floor: float | None = None, out: str = "y") -> DataFrame:
    """Scale each key to a peak of `gain`; a silent key is missing unless the peak has a floor."""
    peak = F.col("_peak") if floor is None else F.greatest("_peak", F.lit(floor))
    return with_group(df, keys, _peak=F.max(F.abs(x))).withColumn(out, F.try_divide(F.col(x), peak) * gain).drop("_peak")


def hop_frames(df: DataFrame, keys, idx: str, x: str, size: int, hop: int, pad: bool = True) -> DataFrame:
    """Overlapping frames as (keys, frame, offset, x) rows; a padded series gets `size / 2` zeros at both ends."""
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    half = size // 2 if pad else 0
    rows = df.select(*keys, F.col(idx).alias("_p"), F.col(x).alias("x"))
    if pad:
        edges = f"concat(sequence({-half}L, -1L), sequence(_n, _n + {half - 1}))"
        rows = rows.unionByName(lengths.select(*keys, F.explode(F.expr(edges)).alias("_p"), F.lit(0.0).alias("x")))
    total = f"(1 + floor(_n / {hop}))" if pad else f"(1 + floor((_n - {size}) / {hop}))"
    first = f"greatest(ceil((_p + {half} - {size - 1}) / {hop}), 0)"
    last = f"least(floor((_p + {half}) / {hop}), {total} - 1)"
    span = f"CASE WHEN {first} <= {last} THEN sequence(CAST({first} AS BIGINT), CAST({last} AS BIGINT)) END"
    placed = rows.join(lengths, keys).withColumn("frame", F.explode(F.expr(span)))
    return placed.select(*keys, "frame", F.expr(f"_p + {half} - frame * {hop}").alias("offset"), "x")


def strided_frames(
    df: DataFrame, keys, idx: str, x: str, size: int, hop: int, pad: int = 0, mirror: bool = False, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Overlapping frames as one array each: keys, frame, f. `pad` rows of zeros, or mirrored ones, stand at both ends.

    One shuffle brings the rows of a block together with the few that its last frames reach beyond it; the frames
    are views of that stretch, so no row is repeated before they are made. The end of a series shows in its last blocks, which need no
    count of it. Positions are dense from 0. A series with fewer than `pad` + 1 rows cannot be mirrored and has no frames, as one shorter than a frame.
    """
    spread = halo(df.select(*keys, idx, F.col(x).cast("double").alias("_x")), keys, idx, pad, size, rows)

    def views(table: pa.Table) -> pa.Table:
        table = table.sort_by(idx)
        at, own = table[idx].to_numpy(), table["_own"].to_numpy()
        block, first, top = int(table["_blk"][0].as_py()), int(at[0]), int(at[-1]) + 1
        low, high = block * rows, min((block + 1) * rows, top)
        ends = top < (block + 1) * rows + size
        start = 0 if block == 0 else -(-(low + pad) // hop)
        stop = (high - 1 + pad) // hop + 1
        if ends:
            stop = min(stop, 0 if mirror and top <= pad else (top + 2 * pad - size) // hop + 1)
        if not own.any() or stop <= start:
            return pa.table({})
        values = table["_x"].to_numpy()
        left = (values[pad:0:-1] if mirror else np.zeros(pad)) if first == 0 else values[:0]
        right = (values[-2 : -pad - 2 : -1] if mirror else np.zeros(pad)) if ends else values[:0]
        line = np.concatenate([left, values, right])
        frame = np.arange(start, stop)
        found = np.lib.stride_tricks.sliding_window_view(line, size)[frame * hop - pad - (first - len(left))]
        offsets = np.arange(0, found.size + 1, size, dtype=np.int32)
        same = {k: table[k].combine_chunks().take(pa.array(np.zeros(len(frame), np.int64))) for k in keys}
        return pa.table({**same, "frame": pa.array(frame), "f": pa.ListArray.from_arrays(offsets, found.reshape(-1))})

    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread.groupBy(*keys, "_blk").applyInArrow(views, f"{ddl}, frame bigint, f array<double>")


def frame_zscore(frames: DataFrame, keys) -> DataFrame:
    """Each frame minus its mean, over its sample deviation (at least 1e-10)."""
    return with_group(frames, [*keys, "frame"], _m=F.avg("x"), _s=F.stddev_samp("x")).select(
        *keys, "frame", "offset", ((F.col("x") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-10))).alias("z")
    )


def frame_arrays(frames: DataFrame, keys) -> DataFrame:
    """One array per frame, as long as the frame size."""
    packed = frames.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("offset", "x"))).alias("_f"))
    return packed.select(*keys, "frame", F.expr("transform(_f, e -> e.x)").alias("f"))


def aperiodicity(f: str, lag: int) -> Column:
    """Residual over mean power of a frame and its copy shifted by `lag`, mirrored at the end."""
    shifted = f"concat(slice({f}, {lag + 1}, size({f}) - {lag}), slice(reverse({f}), 1, {lag}))"
    mean_sq = lambda a: f"(aggregate({a}, 0D, (s, t) -> s + t * t) / size({f}))"
    power = f"(({mean_sq(f)} + {mean_sq(shifted)}) / 2)"
    residual = f"({mean_sq(f'zip_with({f}, {shifted}, (p, q) -> p - q)')} / 2)"
    return F.expr(f"{residual} / ({power} + {EPS!r}D)")


def fixed_segments(df: DataFrame, keys, idx: str, size: int, per_feature: int) -> DataFrame:
    """Consecutive pieces of `size` rows: start, length and number of whole features."""
    return df.groupBy(*keys, F.expr(f"`{idx}` div {size}").alias("chunk")).agg(
        F.min(idx).alias("start"),
        F.count(F.lit(1)).alias("len"),
        F.expr(f"count(1) div {per_feature}").alias("features"),
    )


def chunk_apply(df: DataFrame, keys, idx: str, chunk: int, context: int, fn, schema: str) -> DataFrame:
    """Run a pandas function over chunks with `context` rows of each neighbour, and keep the rows each chunk owns.

    `fn` gets one ordered chunk and returns a frame of the same length, described by `schema`. Chunks are cut in the task out of
    blocks of some `BLOCK_ROWS` rows, so only rows at the edges of these are sent twice.
    """
    rows = chunk * max(1, BLOCK_ROWS // chunk)
    part = [*keys, "_blk"]
    placed = halo(df, keys, idx, context, context, rows)
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    own_at, idx_at = placed.columns.index("_own"), placed.columns.index(idx)

    def chunks(table: pa.Table) -> Iterator[pd.DataFrame]:
        own = table.column(own_at).to_numpy()
        if not own.any():
            return
        block, places = table["_blk"][0].as_py(), table.column(idx_at)
        pdf = table.drop_columns(["_own", "_blk"]).to_pandas()
        if block is None:
            yield fn(pdf)
            return
        at = places.to_numpy()
        starts = np.unique(at[own] // chunk) * chunk
        edges = (np.searchsorted(at, starts + by) for by in (-context, 0, chunk, chunk + context))
        for low, first, stop, high in zip(*(e.tolist() for e in edges)):
            piece = fn(pdf.iloc[low:high].reset_index(drop=True))
            yield piece.iloc[first - low : stop - low]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, done, size = None, [], [], 0

        def flush() -> list[pa.RecordBatch]:
            out = pd.concat(done, ignore_index=True)[target.names]
            return pa.Table.from_pandas(out, schema=target, preserve_index=False).to_batches()

        for batch in chain(filter(len, batches), [None]):
            fresh, last = group_starts(batch, part, last) if batch is not None else (np.ones(1, bool), last)
            edges = [0, *np.flatnonzero(fresh).tolist(), len(batch) if batch is not None else 0]
            for k, (low, high) in enumerate(zip(edges, edges[1:])):
                if k and held:
                    for piece in chunks(pa.Table.from_batches(held)):
                        done.append(piece)
                        size += len(piece)
                    held = []
                    if size >= FLUSH_ROWS:
                        yield from flush()
                        done, size = [], 0
                if high > low:
                    held.append(batch.slice(low, high - low))
        if done:
            yield from flush()

    return placed.repartition(*part).sortWithinPartitions(*part, idx).mapInArrow(run, schema)


def pad_or_trim(df: DataFrame, keys, idx: str, x: str, longest: int, shortest: int) -> DataFrame:
    """Cut every key to `longest` rows and add zero rows up to `shortest`."""
    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < shortest)
    zeros = short.select(*keys, F.explode(F.expr(f"sequence(_n, {shortest - 1}L)")).alias(idx), F.lit(0.0).alias(x))
    return df.where(F.col(idx) < longest).select(*keys, idx, x).unionByName(zeros)


def repeat_upsample(df: DataFrame, idx: str, times: int) -> DataFrame:
    return df.withColumn("_j", F.explode(F.expr(f"sequence(0L, {times - 1}L)"))).withColumn(
        idx, F.col(idx) * times + F.col("_j")
    ).drop("_j")


def stride_downsample(df: DataFrame, idx: str, step: int) -> DataFrame:
    return df.where(F.col(idx) % step == 0).withColumn(idx, F.expr(f"`{idx}` div {step}"))


def find_endpoint(df: DataFrame, keys, idx: str, x: str, window: int, threshold: float, **opts) -> DataFrame:
    """First grid point followed by `window` quiet rows, plus one hop; the length if there is none.

    What counts is how far the next loud row is, so the cost does not depend on the window. Missing values are quiet.
    """
    hop = window // 4
    loud = F.when(F.col(x) >= threshold, F.col(idx))
    ahead = cut(running(cut(df), keys, idx, {"_next": ("last", loud)}, reverse=True, **opts))
    sized = with_group(ahead, keys, _n=F.count(F.lit(1)))
    quiet = F.coalesce(F.col("_next") - F.col(idx) >= window, F.lit(True))
    here = (F.col(idx) >= hop) & (F.col(idx) % hop == 0) & (F.col(idx) < F.col("_n") - window) & quiet
    return sized.groupBy(*keys).agg(F.coalesce(F.min(F.when(here, F.col(idx))) + hop, F.max("_n")).alias("endpoint"))


def silence_trim(df: DataFrame, keys, idx: str, x: str, margin: int, size: int, hop: int, top_db: float) -> DataFrame:
    """Drop `margin` rows at both ends, then the frames before the first and after the last loud one."""
    sized = with_group(cut(df.select(*keys, idx, x)), keys, _n=F.count(F.lit(1)))
    inner = sized.where((F.col(idx) >= margin) & (F.col(idx) < F.col("_n") - margin))
    inner = cut(inner.select(*keys, (F.col(idx) - margin).alias(idx), x))
    frames = strided_frames(inner, keys, idx, x, size, hop, pad=size // 2)
    squares = F.aggregate("f", F.lit(0.0), lambda s, v: s + F.coalesce(v * v, F.lit(0.0)))
    power = cut(frames.select(*keys, "frame", (squares / float(size)).alias("_p")))
    level = lambda c: 10.0 * F.log10(F.greatest(F.col(c), F.lit(1e-10)))
    loud = with_group(power, keys, _top=F.max("_p")).where(level("_p") - level("_top") > -top_db)
    bounds = loud.groupBy(*keys).agg((F.min("frame") * hop).alias("_a"), ((F.max("frame") + 1) * hop).alias("_z"))
    kept = inner.join(bounds, keys).where((F.col(idx) >= F.col("_a")) & (F.col(idx) < F.col("_z")))
    return kept.select(*keys, (F.col(idx) - F.col("_a")).alias(idx), x)


def split_on_silence(
    df: DataFrame, keys, idx: str, x: str, min_silence: int, threshold: float, keep: int, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Drop stretches of at least `min_silence` rows at or below the RMS `threshold`, keeping `keep` rows at their edges.

    Adds the new dense position `out_idx`. A fully silent key yields nothing. Missing values do not count in a mean. The cost
    of a row does not depend on `min_silence`.
    """
    reach = min_silence - 1 + keep

    def kept_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[x].to_numpy(np.float64)
        gone = ~np.isnan(values)
        n, whole = len(values), len(values) - min_silence + 1
        quiet = np.zeros(n, np.int64)
        if whole > 0:
            total = window_sums(np.where(gone, values, 0.0) ** 2, min_silence)
            seen = window_sums(gone.astype(np.float64), min_silence)
            with np.errstate(invalid="ignore", divide="ignore"):
                quiet[:whole] = np.sqrt(total / seen) <= threshold
        inside = spread(quiet, min_silence - 1, 0) > 0
        return pdf.assign(_k=spread((~inside).astype(np.int64), keep, keep) > 0)

    def spread(marks: np.ndarray, back: int, ahead: int) -> np.ndarray:
        """Marks in the rows from `back` before to `ahead` after each."""
        counts = np.r_[0, np.cumsum(marks)]
        places = np.arange(len(marks))
        return counts[np.minimum(places + ahead + 1, len(marks))] - counts[np.maximum(places - back, 0)]

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, _k boolean"
    kept = cut(chunk_apply(df, keys, idx, rows, reach, kept_rows, schema).where("_k").drop("_k"))
    return ordinal(kept, keys, [idx], F.expr(f"`{idx}` div {1 << 22}"), "out_idx")


def window_sums(values: np.ndarray, size: int) -> np.ndarray:
    """Sum of every `size` neighbours, without subtraction.

    The values are cut into runs of `size`: a window is the end of one run and the start of the next, both running sums.
    """
    padded = np.pad(values, (0, -len(values) % size)).reshape(-1, size)
    ahead = padded.cumsum(1).reshape(-1)
    behind = padded[:, ::-1].cumsum(1)[:, ::-1].reshape(-1)
    start = np.arange(len(values) - size + 1)
    return np.where(start % size == 0, behind[start], behind[start] + ahead[start + size - 1])


def best_so_far(log: DataFrame, keys, step: str, loss: str, **opts) -> DataFrame:
    """Rows whose loss is strictly below everything before; `replaces` is the best loss they take over from."""
    seen = running(log, keys, step, {"replaces": ("min", F.col(loss), "before")}, **opts)
    return seen.where(F.col("replaces").isNull() | (F.col(loss) < F.col("replaces")))


def label_timestamps(tokens: DataFrame, keys, idx: str, token: str, begin: int, **opts) -> DataFrame:
    """Number the text between time markers: tokens from `begin` on are markers in steps of 0.02 s.

    Text rows get `seg` (markers seen so far) and the `label` of the last marker.
    """
    marker = F.col(token) >= begin
    label = F.format_string("<|%.2f|>", (F.col(token) - begin) * 0.02)
    seen = running(
        tokens, keys, idx, {"seg": ("sum", marker.cast("bigint")), "label": ("last", F.when(marker, label))}, **opts
    )
    return seen.where(~marker)


def hourly_interpolation(points: DataFrame, keys, ts: str, x: str, step: int = 3600) -> DataFrame:
    """Linear interpolation of irregular points on a regular time grid of `step` seconds, within the points' span.

    Points are reduced to the first and last of each grid cell before any ordering, so what is sorted per key is one
    row per cell, however many points the key has.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    p = points.select(*keys, micros.alias("_t"), F.col(x).alias("_x")).withColumn("_g", F.expr(f"_t div {step * 10**6}"))
    point = F.struct("_t", "_x")
    cells = p.groupBy(*keys, "_g").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    reach = cells.groupBy(*keys).agg(F.min("_first._t").alias("_lo"), F.max("_last._t").alias("_hi"))
    cell_us = step * 10**6
    grid = stretched(reach, f"ceil(_lo / {cell_us})", f"_hi div {cell_us}", "_g").select(*keys, "_g", F.lit(True).alias("_on"))
    both = cut(cells.join(grid, [*keys, "_g"], "full"))
    both = running(both, keys, "_g", {"_before": ("last", F.col("_last"), "before")})
    both = running(both, keys, "_g", {"_after": ("last", F.col("_first"))}, reverse=True).where("_on")
    at = F.col("_g") * cell_us
    span = (F.col("_after._t") - F.col("_before._t")).cast("double")
    line = F.col("_before._x") + (F.col("_after._x") - F.col("_before._x")) * ((at - F.col("_before._t")) / span)
    return both.select(*keys, at.alias("at_us"), F.when(F.col("_after._t") == at, F.col("_after._x")).otherwise(line).alias("y"))
