"""Voiced and spoken segments of frame series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from framewright.operators.blocks import BLOCK_ROWS, block_id, chained, framed, halo, in_spans, join_on, ordinal, running, with_group
from framewright.session import cut


def hysteresis(
    df: DataFrame, keys, idx: str, f0: str, per: str, low=0.19, high=0.31, width=0.2, stds=1.7, out="y", **opts
) -> DataFrame:
    """Pitch kept where periodicity passes a threshold that rises away from the key's mean log pitch.

    A run above the threshold that starts right after a row below it and never exceeds `high` is dropped whole.
    """
    log = F.when(F.col(per) >= low, F.log2(F.nullif(F.col(f0), F.lit(0.0))))
    rows = with_group(cut(df.withColumn("_y", log)), keys, _m=F.avg("_y"), _s=F.stddev_pop("_y"))
    z = F.try_divide(F.col("_y") - F.col("_m"), F.col("_s"))
    parabola = width * z * z - width * stds * stds
    rows = rows.withColumn(
        "_thr", F.coalesce(low + F.when(parabola.isNotNull(), F.least(F.greatest(parabola, F.lit(0.0)), F.lit(1.0 - low))), F.lit(low))
    )
    rows = cut(rows.withColumn("_up", F.col(per) > F.col("_thr")))
    # a run is told from others by the rows above no threshold before it; the larger struct is that of the later run, or of the higher value in it
    before = running(
        rows, keys, idx,
        {
            "_isl": ("sum", (~F.col("_up")).cast("bigint")),
            "_below": ("last", F.when(~F.col("_up"), F.coalesce(F.col(per) < F.col("_thr"), F.lit(False)))),
        },
        **opts,
    )
    before = cut(before)
    high_of = lambda run: F.when(F.col("_up"), F.struct(run.alias("run"), F.col(per).alias("top")))
    so_far = running(before, keys, idx, {"_so": ("max", high_of(F.col("_isl")))}, **opts)
    joined = running(cut(so_far), keys, idx, {"_to": ("max", high_of(-F.col("_isl")))}, reverse=True, **opts)
    top = F.greatest(F.col("_so.top"), F.col("_to.top"))
    weak = F.coalesce(F.col("_below"), F.lit(False)) & (top <= high)
    kept = ~(F.col(per) < F.col("_thr")) & ~(F.col("_up") & F.coalesce(weak, F.lit(False)))
    return joined.withColumn(out, F.when(kept, F.pow(F.lit(2.0), F.col("_y")))).drop(
        "_isl", "_so", "_to", "_below", "_thr", "_up", "_y", "_m", "_s"
    )


def run_islands(df: DataFrame, keys, idx: str, flag: Column, unit: int = 1, **opts) -> DataFrame:
    """Runs of a flag as `[start, end)` in units; a run open at the end closes there."""
    rows = df.select(*keys, idx, flag.alias("_f"))
    marked = running(rows, keys, idx, {"_isl": ("sum", (~F.col("_f")).cast("bigint"))}, **opts).where("_f")
    runs = marked.groupBy(*keys, "_isl").agg((F.min(idx) * unit).alias("start"), ((F.max(idx) + 1) * unit).alias("end"))
    return runs.drop("_isl")


def speech_segments(
    df: DataFrame, keys, idx: str, p: str, threshold=0.5, min_speech=2, min_silence=2, **opts
) -> DataFrame:
    """Speech segments of per-frame probabilities: keys, seg_no, start, end, len (of the series), in frames.

    A stretch runs from one row at or above the threshold to the next. It closes the segment if its rows below
    `threshold - 0.15` span at least `min_silence`; the segment then ends at the first of them.
    """
    enter, leave = F.col(p) >= threshold, F.col(p) < threshold - 0.15
    df = cut(df.select(*keys, idx, p))
    counted = running(df, keys, idx, {"_k": ("sum", enter.cast("bigint"))}, **opts)
    stretches = (
        counted.where("_k > 0")
        .groupBy(*keys, "_k")
        .agg(F.min(idx).alias("_at"), F.min(F.when(leave, F.col(idx))).alias("_n0"), F.max(F.when(leave, F.col(idx))).alias("_n1"))
        .withColumn("_close", F.when(F.col("_n1") - F.col("_n0") >= min_silence, F.col("_n0")))
        .drop("_n0", "_n1")
    )
    stretches = cut(stretches)
    numbered = running(stretches, keys, "_at", {"_g": ("sum", F.col("_close").isNotNull().cast("bigint"), "before")}, **opts)
    found = numbered.groupBy(*keys, "_g").agg(F.min("_at").alias("start"), F.max("_close").alias("_end"))
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"))
    ended = found.join(lengths, keys).withColumn("end", F.coalesce("_end", "len"))
    segs = cut(ended.where(F.expr(f"end - start > {min_speech}")).drop("_g", "_end"))
    return ordinal(segs, keys, ["start"], F.expr(f"start div {1 << 22}"), "seg_no").select(*keys, "seg_no", "start", "end", "len")


class _Jumps:
    """Segments of at most `limit` frames in a stretch of rows, as jumps from one moment of decision to the next.

    There are two kinds of moments: nothing is open from row r on, or the segment that began at an earlier pause was just cut
    at row r. In both the machine remembers nothing that r does not tell, so every moment has one successor, at most
    `limit` + 1 rows on or at the next onset. `own` is the stretch of rows whose moments are asked for; the
    rows hold `limit` more on either side, as far as the series has them.
    """

    def __init__(self, at: np.ndarray, p: np.ndarray, threshold: float, limit: int, min_speech: float, min_silence: int, pause: int) -> None:
        self.first, n = int(at[0]), len(p)
        self.n, self.limit, self.min_speech = n, limit, min_speech
        onset, quiet = np.flatnonzero(p >= threshold), np.flatnonzero(p < threshold - 0.15)

        def following(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """The first of `places` at or after each row; far beyond the end where there is none."""
            return np.r_[places, 4 * n + 4 * limit][np.searchsorted(places, rows)]

        rows = np.arange(n)
        self.onset = following(onset, np.arange(n + 1))
        after = self.onset[1:]  # the onset that ends the pause a row lies in
        # a pause watched from row r on: where it begins, where it is long enough to close, and where long enough to cut at
        self.pause = following(quiet, rows)
        closes, cuts = following(quiet, self.pause + min_silence), following(quiet, self.pause + pause + 1)
        self.closes, self.cuts = np.where(closes < after, closes, -1), np.where(cuts < after, cuts, -1)
        self.after = after
        # the next onset whose pause closes, and the last watch (from an onset or the first row) whose pause allows a cut before a row
        closing = onset[self.closes[onset] >= 0]
        self.closing = np.r_[following(closing, rows + 1)]
        watch = np.unique(np.r_[0, onset])
        allowed = watch[self.cuts[watch] >= 0]
        self.allowed = np.r_[-1, allowed][np.searchsorted(self.cuts[allowed], np.arange(n + 1))]

    def begun(self, cut: np.ndarray) -> np.ndarray:
        """Where the segment began that is open after a cut at a row; -1 where no segment can be."""
        watch = self.allowed[cut]
        start = np.where(watch >= 0, self.after[np.maximum(watch, 0)], -1)
        return np.where((start <= cut) & (cut - start < self.limit), start, -1)

    def follow(self, start: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What becomes of segments begun at `start` and watched from row `seen` on: end, whether it is kept, next moment (its row, and whether that is a cut)."""
        n, cut = self.n, start + self.limit
        here = self.closes[seen] >= 0
        onset = np.minimum(self.closing[seen], n - 1)
        close = np.where(here, self.closes[seen], np.where(self.closing[seen] < n, self.closes[onset], 4 * n))
        end = np.where(here, self.pause[seen], self.pause[onset])
        closed = close < np.minimum(cut, n)
        is_cut = ~closed & (cut < n)
        row = np.minimum(cut, n - 1)
        watch = np.where(self.allowed[row] > seen, self.allowed[row], np.where((self.cuts[seen] >= 0) & (self.cuts[seen] < row), seen, -1))
        paused = is_cut & (watch >= 0)
        w = np.maximum(watch, 0)
        goes_on = paused & (self.after[w] <= row)
        ends = np.where(closed, end, np.where(paused, self.pause[w], np.where(is_cut, cut, n)))
        keep = is_cut | (ends - start > self.min_speech)
        after = np.where(closed, close + 1, np.where(is_cut, np.where(goes_on, cut, cut + 1), n))
        return ends, keep, after, goes_on

    def successors(self, low: int, high: int) -> np.ndarray:
        """Exit of every entry to the rows [low, high).

        Entry and exit number i of the first limit + 2 say that nothing is open from the i-th row after the border on, the
        others that a segment was cut at that row.
        """
        size, rows = self.limit + 2, np.arange(low, high)
        count = high - low
        # moments 0 .. count - 1: nothing open; count .. 2 * count - 1: cut; then the exits
        exits = 2 * count
        start = self.onset[rows]
        open_ = start < high
        safe = np.where(open_, start, 0)
        _, _, after, goes_on = self.follow(safe, safe)
        target = np.full(2 * count + 2 * size, -1)
        target[:count] = np.where(open_, self._moment(after, goes_on, low, high), exits)
        begun = self.begun(rows)
        known = begun >= 0
        _, _, after, goes_on = self.follow(np.where(known, begun, 0), np.where(known, rows, 0))
        target[count:exits] = np.where(known, self._moment(after, goes_on, low, high), exits)
        target[exits:] = np.arange(exits, exits + 2 * size)
        while (target[:exits] < exits).any():
            target = target[target]
        entry = np.arange(2 * size) % size
        inside = entry < count
        moment = np.where(np.arange(2 * size) < size, entry, count + entry)
        through = exits + np.arange(2 * size) - count  # a moment beyond these rows passes them
        return target[np.where(inside, moment, through)] - exits

    def _moment(self, row: np.ndarray, is_cut: np.ndarray, low: int, high: int) -> np.ndarray:
        count, size = high - low, self.limit + 2
        inside = np.where(is_cut, count, 0) + row - low
        beyond = 2 * count + np.where(is_cut, size, 0) + np.minimum(row - high, size - 1)
        return np.where(row < high, inside, beyond)

    def walk(self, entry: int, low: int, high: int) -> list[tuple[int, int]]:
        """The segments decided from an entry on within the rows [low, high)."""
        size, found = self.limit + 2, []
        row, is_cut = low + entry % size, entry >= size
        while row < high:
            start = int(self.begun(np.array([row]))[0]) if is_cut else int(self.onset[row])
            if start >= high:
                break
            end, keep, after, goes_on = (v[0] for v in self.follow(np.array([start]), np.array([row if is_cut else start])))
            if keep:
                found.append((self.first + start, self.first + int(end)))
            row, is_cut = int(after), bool(goes_on)
        return found


def limited_segments(
    df: DataFrame, keys, idx: str, p: str, max_speech: int, threshold=0.5, min_speech=2, min_silence=2, pause=1, rows: int = BLOCK_ROWS
) -> DataFrame:
    """`speech_segments` of at most `max_speech` frames: keys, seg_no, start, end, len (of the series), in frames.

    A segment that is longer at some row is cut there. If since it began, or since the last cut, there was a pause of more than `pause` frames,
    it ends where the last such pause begins, and the next one begins at the onset after that pause; if no onset came yet, the next onset
    begins one. Without such a pause it ends at the row itself. A cut also starts the count of silence anew. Cut segments are kept
    whatever their length. Positions are dense from 0; a NULL probability is neither speech nor silence.

    What a cut leaves depends on the row alone, so each block of `rows` rows is summed up by where it leads from
    every row at which a cut before it can fall; the blocks are chained, and a second pass gives the segments of each block.
    """
    if max_speech < 1 or min_silence < 1:
        raise ValueError("max_speech and min_silence must be at least 1")
    limit = int(max_speech) + 1
    df = cut(df.select(*keys, idx, p))
    sizes = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"), F.max(block_id(idx, rows)).alias("_last")))
    spread = halo(df.select(*keys, idx, F.col(p).cast("double").alias("_p")), keys, idx, limit, limit + 1, rows)
    spread = join_on(spread, sizes.select(*keys, "_last"), keys).where("_blk <= _last")
    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def jumps(pdf: pd.DataFrame) -> tuple[_Jumps, int, int]:
        at = pdf[idx].to_numpy(np.int64)
        own = np.flatnonzero(pdf["_own"].to_numpy(bool))
        made = _Jumps(at, pdf["_p"].to_numpy(np.float64), threshold, limit, min_speech, min_silence, pause)
        return made, int(own[0]), int(own[-1]) + 1

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        made, low, high = jumps(pdf)
        return pdf.iloc[:1][[*keys, "_blk"]].assign(m=[made.successors(low, high)])

    maps = cut(spread.where("_last > 0").groupBy(*keys, "_blk").applyInPandas(lead, f"{ddl}, _blk bigint, m array<int>"))
    entries = chained(maps, keys, 0)  # a key of one block is entered with nothing open

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        made, low, high = jumps(pdf)
        found = made.walk(int(pdf["_entry"].iloc[0]), low, high)
        out = pd.DataFrame(found, columns=["start", "end"], dtype="int64")
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    fed = join_on(spread, entries, [*keys, "_blk"], "left").fillna(0, ["_entry"])
    segs = cut(fed.groupBy(*keys, "_blk").applyInPandas(mark, f"{ddl}, start bigint, end bigint"))
    numbered = ordinal(segs, keys, ["start"], F.expr(f"start div {1 << 22}"), "seg_no")
    return numbered.join(sizes, keys).select(*keys, "seg_no", "start", "end", "len")


def pad_segments(segs: DataFrame, keys, pad: int, **opts) -> DataFrame:
    """Widen segments by `pad` on both sides; a gap too short for both pads is halved between its neighbours."""

    def stage(w):
        gap_after = F.lead("start").over(w) - F.col("end")
        gap_before = F.col("start") - F.lag("end").over(w)
        share = lambda gap: F.when(gap < 2 * pad, F.floor(gap / 2)).otherwise(F.lit(pad))
        return {
            "_s": F.greatest(F.col("start") - F.when(gap_before.isNull(), F.lit(pad)).otherwise(share(gap_before)), F.lit(0)),
            "_e": F.when(gap_after < 2 * pad, F.col("end") + F.floor(gap_after / 2)).otherwise(
                F.least(F.col("end") + pad, F.col("len"))
            ),
        }

    out = framed(segs, keys, "seg_no", 1, 1, stage, **opts)
    return out.select(*keys, "seg_no", F.col("_s").cast("bigint").alias("start"), F.col("_e").cast("bigint").alias("end"), "len")


def keep_segments(df: DataFrame, segs: DataFrame, keys, idx: str) -> DataFrame:
    """Rows inside segments, joined end to end: `out_idx` is the new dense position."""
    inside = in_spans(df, segs.select(*keys, "start", "end"), keys, idx, "start", "end", "left_semi")
    return ordinal(inside, keys, [idx], F.expr(f"`{idx}` div {1 << 22}"), "out_idx")


def drop_segments(df: DataFrame, segs: DataFrame, keys, idx: str, keep_tail: bool = False) -> DataFrame:
    """Rows in the gaps before segments, joined end to end. Rows after the last segment go too unless `keep_tail`."""
    segs = segs if keep_tail else cut(segs)
    outside = in_spans(df, segs.select(*keys, "start", "end"), keys, idx, "start", "end", "left_anti")
    if not keep_tail:
        last = segs.groupBy(*keys).agg(F.max("end").alias("_z"))
        outside = outside.join(last, keys).where(F.col(idx) < F.col("_z")).drop("_z")
    return ordinal(outside, keys, [idx], F.expr(f"`{idx}` div {1 << 22}"), "out_idx")


def mask_outside(df: DataFrame, segs: DataFrame, keys, idx: str, x: str, factor: int = 1) -> DataFrame:
    """Zero the rows outside segments; segments are in units of `factor` rows. Adds `inside`."""
    spans = segs.select(*keys, (F.col("start") * factor).alias("_a"), (F.col("end") * factor).alias("_z"))
    out = in_spans(df, spans, keys, idx, "_a", "_z", "left").withColumn("inside", F.col("_a").isNotNull())
    return out.withColumn(x, F.when(F.col("inside"), F.col(x)).otherwise(F.lit(0.0))).drop("_a", "_z")
