"""Queries over frame series and their segments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions import pitch as P
from framewright.operators import frames as FR, segments as SG
from framewright.operators.blocks import framed, ordinal, with_group
from framewright.operators.manifest import random_start
from framewright.plans import views as V
from framewright.plans.on_scalars import r6
from framewright.plans.registry import query

c = F.col
KEY = ["sid"]
OVER = "OVER (PARTITION BY sid ORDER BY idx"


def big(name, alias=None):
    return c(name).cast("bigint").alias(alias or name)


def rows_over(a, b):
    return f"{OVER} ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


@query("moving_average_same", V.sql("series", f"SELECT sid, idx, round(sum(x) {rows_over(1, 1)} / 3.0, 6) AS y FROM series"))
def moving_average_same(spark, d):
    return FR.moving_average(V.series(spark, d), KEY, "idx", "x", 3).select("sid", "idx", r6("y").alias("y"))


@query("masked_mean_filter", V.sql("gappy", f"SELECT sid, idx, round(nullif(avg(x) {rows_over(2, 2)}, 0), 6) AS y FROM gappy"))
def masked_mean_filter(spark, d):
    return FR.mean_filter(V.gappy(spark, d), KEY, "idx", "x", 5).select("sid", "idx", r6("y").alias("y"))


def median_sql(x, a):
    return f"quantile_disc({x}, 0.5) {rows_over(a, a)}"


@query("masked_median_filter", V.sql("gappy", f"SELECT sid, idx, {median_sql('x', 3)} AS y FROM gappy"))
def masked_median_filter(spark, d):
    return FR.median_filter(V.gappy(spark, d), KEY, "idx", "x", 7).select("sid", "idx", "y")


@query(
    "nan_filter",
    V.sql("gappy", f"SELECT sid, idx, round(avg(x) {rows_over(2, 2)}, 6) AS mean, {median_sql('x', 2)} AS median FROM gappy"),
)
def nan_filter(spark, d):
    both = framed(
        V.gappy(spark, d), KEY, "idx", 2, 2,
        lambda w: {"a": FR.valid_mean("x")(w.rowsBetween(-2, 2)), "b": FR.lower_median("x")(w.rowsBetween(-2, 2))},
    )
    return both.select("sid", "idx", r6("a").alias("mean"), c("b").alias("median"))


@query("filter_plugin", V.sql("gappy", f"SELECT sid, idx, max(x) {rows_over(4, 4)} AS y FROM gappy"))
def filter_plugin(spark, d):
    return FR.window_filter(V.gappy(spark, d), KEY, "idx", 9, lambda w: F.max("x").over(w)).select("sid", "idx", "y")


HYST = dict(
    a="SELECT sid, idx, f0, per, CASE WHEN per >= 0.19 THEN log2(nullif(f0, 0)) END AS y FROM pitch",
    b="""SELECT *, (y - avg(y) OVER (PARTITION BY sid)) / nullif(stddev_pop(y) OVER (PARTITION BY sid), 0) AS z FROM a""",
    t="""SELECT *, 0.19 + coalesce(least(greatest(0.2 * z * z - 0.2 * 1.7 * 1.7, 0), 1.0 - 0.19), 0) AS thr FROM b""",
    i=f"SELECT *, per > thr AS up, count(*) FILTER (WHERE NOT (per > thr)) {OVER}) AS isl FROM t",
    r="""SELECT *, max(per) FILTER (WHERE up) OVER (PARTITION BY sid, isl) AS top,
        coalesce(bool_or(NOT up AND per < thr) OVER (PARTITION BY sid, isl), false) AS below FROM i""",
)


@query(
    "hysteresis",
    V.sql(
        "pitch",
        """SELECT sid, idx, round(CASE WHEN NOT (per < thr) AND NOT (up AND below AND top <= 0.31) THEN pow(2.0, y) END, 6)
        AS f0 FROM r""",
        **HYST,
    ),
)
def hysteresis(spark, d):
    return SG.hysteresis(V.pitch(spark, d), KEY, "idx", "f0", "per").select("sid", "idx", r6("y").alias("f0"))


@query(
    "run_islands",
    V.sql(
        "series",
        f"""SELECT sid, min(idx) * 80 AS start, (max(idx) + 1) * 80 AS end FROM
        (SELECT sid, idx, x, count(*) FILTER (WHERE NOT x > 50) {OVER}) AS isl FROM series) WHERE x > 50 GROUP BY sid, isl""",
    ),
)
def run_islands(spark, d):
    return SG.run_islands(V.series(spark, d), KEY, "idx", c("x") > 50, 80)


SEG = dict(
    kk=f"SELECT sid, idx, p, count(*) FILTER (WHERE p >= 0.5) {OVER}) AS k FROM prob",
    st="""SELECT sid, k, min(idx) AS a, min(idx) FILTER (WHERE p < 0.35) AS n0, max(idx) FILTER (WHERE p < 0.35) AS n1
        FROM kk WHERE k > 0 GROUP BY sid, k""",
    cl="SELECT sid, a, CASE WHEN n1 - n0 >= 2 THEN n0 END AS cut FROM st",
    nu="""SELECT *, count(cut) OVER (PARTITION BY sid ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
        FROM cl""",
    sg="""SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY s) - 1 AS seg_no, s AS start, e AS end, n AS len FROM
        (SELECT sid, min(a) AS s, coalesce(max(cut), any_value(n)) AS e, any_value(n) AS n FROM nu JOIN
        (SELECT sid, count(*) AS n FROM prob GROUP BY sid) USING (sid) GROUP BY sid, g) WHERE e - s > 2""",
)


@query("speech_segments", V.sql("prob", "SELECT sid, seg_no, start, \"end\" FROM sg", **SEG))
def speech_segments(spark, d):
    return found_segments(spark, d).select("sid", "seg_no", "start", "end")


LIMITED = """st AS (SELECT sid, idx, p, false AS open, 0 AS a, 0 AS q, 0 AS e, 0 AS r, NULL::BIGINT AS s0, NULL::BIGINT AS s1 FROM prob
    WHERE false UNION ALL SELECT sid, -1, 0.0, false, 0, 0, 0, 0, NULL, NULL FROM (SELECT DISTINCT sid FROM prob)
  UNION ALL SELECT sid, idx, p,
    CASE WHEN fresh THEN true WHEN cut AND e > 0 THEN again >= e WHEN cut OR closed THEN false ELSE open END,
    CASE WHEN fresh THEN idx WHEN cut AND e > 0 AND again >= e THEN again WHEN cut OR closed THEN 0 ELSE a END,
    CASE WHEN cut AND e > 0 AND again >= e AND low THEN idx WHEN cut OR closed THEN 0 ELSE quiet END,
    CASE WHEN cut OR closed THEN 0 WHEN open AND low AND idx - quiet > 1 THEN quiet ELSE e END,
    CASE WHEN cut OR closed THEN 0 ELSE again END,
    CASE WHEN cut OR (closed AND quiet - a > 2) THEN a END, CASE WHEN cut THEN CASE WHEN e > 0 THEN e ELSE idx END WHEN closed AND quiet - a > 2 THEN quiet END
  FROM (SELECT *, open AND NOT cut AND low AND idx - quiet >= 3 AS closed FROM (SELECT *, loud AND NOT open AS fresh, open AND idx - a > 8 AS cut,
      CASE WHEN open AND low AND q = 0 THEN idx WHEN loud THEN 0 ELSE q END AS quiet, CASE WHEN loud AND q > 0 AND r < e THEN idx ELSE r END AS again
    FROM (SELECT x.sid, x.idx, x.p, x.p >= 0.5 AS loud, x.p < 0.35 AS low, s.open, s.a, s.q, s.e, s.r FROM st s JOIN prob x ON x.sid = s.sid AND x.idx = s.idx + 1))))"""


@query(
    "speech_segments_limited",
    V.sql("prob", "", last="SELECT sid, count(*) AS n FROM prob GROUP BY sid").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {LIMITED} SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY s0) - 1 AS seg_no, s0 AS start, s1 AS "end" FROM
    (SELECT sid, s0, s1 FROM st WHERE s0 IS NOT NULL UNION ALL SELECT sid, a, n FROM st JOIN last USING (sid) WHERE open AND idx = n - 1 AND n - a > 2)""",
)
def speech_segments_limited(spark, d):
    """No segment of more than 8 frames; cuts fall into pauses of more than one."""
    found = SG.limited_segments(V.prob(spark, d), KEY, "idx", "p", 8, min_silence=3, pause=1)
    return found.select("sid", "seg_no", "start", "end")


def found_segments(spark, d):
    return SG.speech_segments(V.prob(spark, d), KEY, "idx", "p")


@query(
    "segment_pad_merge",
    V.sql(
        "prob",
        """SELECT sid, seg_no, greatest(start - CASE WHEN gb < 4 THEN gb // 2 ELSE 2 END, 0) AS start,
        CASE WHEN ga < 4 THEN "end" + ga // 2 ELSE least("end" + 2, len) END AS end FROM (SELECT *,
        lead(start) OVER w - "end" AS ga, start - lag("end") OVER w AS gb FROM sg WINDOW w AS (PARTITION BY sid ORDER BY seg_no))""",
        **SEG,
    ),
)
def segment_pad_merge(spark, d):
    return SG.pad_segments(found_segments(spark, d), KEY, 2).select("sid", "seg_no", "start", "end")


IN_SEG = 'EXISTS (SELECT 1 FROM sg WHERE sg.sid = s.sid AND s.idx >= sg.start AND s.idx < sg."end")'


@query(
    "segment_keep",
    V.sql(
        "series prob",
        f"SELECT sid, idx, row_number() {OVER}) - 1 AS out_idx, x FROM (SELECT * FROM series s WHERE {IN_SEG})",
        **SEG,
    ),
)
def segment_keep(spark, d):
    kept = SG.keep_segments(V.series(spark, d).select("sid", "idx", "x"), found_segments(spark, d), KEY, "idx")
    return kept.select("sid", "idx", "out_idx", "x")


@query(
    "segment_drop",
    V.sql(
        "series prob",
        f"""SELECT sid, idx, row_number() {OVER}) - 1 AS out_idx, x FROM (SELECT * FROM series s WHERE NOT {IN_SEG}
        AND idx < (SELECT max("end") FROM sg WHERE sg.sid = s.sid))""",
        **SEG,
    ),
)
def segment_drop(spark, d):
    kept = SG.drop_segments(V.series(spark, d).select("sid", "idx", "x"), found_segments(spark, d), KEY, "idx")
    return kept.select("sid", "idx", "out_idx", "x")


@query(
    "interval_mask",
    V.sql(
        "series prob",
        f"""SELECT sid, idx * 2 + j AS idx, inside, CASE WHEN inside THEN x ELSE 0 END AS x FROM
        (SELECT *, {IN_SEG} AS inside FROM series s), (VALUES (0), (1)) AS t(j)""",
        **SEG,
    ),
)
def interval_mask(spark, d):
    masked = SG.mask_outside(V.series(spark, d).select("sid", "idx", "x"), found_segments(spark, d), KEY, "idx", "x")
    return FR.repeat_upsample(masked, "idx", 2).select("sid", "idx", "inside", "x")


@query("threshold_at", V.sql("pitch", "SELECT sid, idx, CASE WHEN NOT per < 0.3 THEN f0 END AS f0 FROM pitch"))
def threshold_at(spark, d):
    return V.pitch(spark, d).select("sid", "idx", F.when(c("per") >= 0.3, c("f0")).alias("f0"))


@query(
    "unvoiced_zero",
    V.sql(
        "pitch",
        f"""SELECT sid, idx, round(CASE WHEN m < 0.5 THEN 0 ELSE f END, 6) AS f0 FROM (SELECT sid, idx,
        {median_sql('per', 3)} AS m, nullif(avg(f0) {rows_over(2, 2)}, 0) AS f FROM pitch)""",
    ),
)
def unvoiced_zero(spark, d):
    def stage(w):
        return {
            "m": FR.lower_median("per")(w.rowsBetween(-3, 3)),
            "f": F.nullif(F.avg("f0").over(w.rowsBetween(-2, 2)), F.lit(0.0)),
        }

    both = framed(V.pitch(spark, d), KEY, "idx", 3, 3, stage)
    return both.select("sid", "idx", r6(F.when(c("m") < 0.5, F.lit(0.0)).otherwise(c("f"))).alias("f0"))


@query(
    "silence_gate",
    V.sql(
        "series pitch",
        """SELECT sid, idx, round(CASE WHEN 20 * log10(x / 100.0) < -20 THEN 0 ELSE per END, 6) AS per
        FROM pitch JOIN series USING (sid, idx)""",
    ),
)
def silence_gate(spark, d):
    loudness = V.series(spark, d).select("sid", "idx", (20.0 * F.log10(c("x") / 100.0)).alias("db"))
    gated = V.pitch(spark, d).join(loudness, ["sid", "idx"])
    return gated.select("sid", "idx", r6(F.when(c("db") < -20, F.lit(0.0)).otherwise(c("per"))).alias("per"))


BLOCKED = ["the", "of", "la", "der", "que"]
BLANK = ["", "and", "le"]


@query(
    "blocklist_filter",
    """SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS word FROM
    (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)) WHERE word NOT IN ('the', 'of', 'la', 'der', 'que')
    AND NOT (pos = 0 AND word IN ('', 'and', 'le'))""",
)
def blocklist_filter(spark, d):
    words = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word"))
    kept = words.where(~c("word").isin(BLOCKED) & ~((c("pos") == 0) & c("word").isin(BLANK)))
    return kept.select("doc_id", big("pos"), "word")


@query("stride_downsample", V.sql("series", "SELECT sid, idx // 3 AS idx, x FROM series WHERE idx % 3 = 0"))
def stride_downsample(spark, d):
    return FR.stride_downsample(V.series(spark, d).select("sid", "idx", "x"), "idx", 3)


PEAK = """SELECT sid, idx, (coalesce(f0 > 0 AND p > 0 AND n > 0 AND f0 > p AND f0 > n, false)
    OR (f0 > 0 AND NOT coalesce(p > 0, false))) AS peak FROM (SELECT sid, idx, f0, lag(f0) OVER w AS p, lead(f0) OVER w AS n
    FROM pitch WINDOW w AS (PARTITION BY sid ORDER BY idx))"""


@query("peak_locations", V.sql("pitch", PEAK))
def peak_locations(spark, d):
    return FR.peaks(V.pitch(spark, d), KEY, "idx", "f0").select("sid", "idx", "peak")


@query(
    "phase_accumulate",
    V.sql(
        "pitch",
        f"""SELECT sid, idx, k, f0 > 0 AS voiced, round((cum * k) - floor(cum * k), 8) AS phase,
        round(sin(2 * pi() * ((cum * k) - floor(cum * k))), 6) AS sine
        FROM (SELECT sid, idx, f0, sum(f0 / 16000.0) {OVER}) AS cum FROM pitch), generate_series(1, 3) AS t(k)""",
    ),
)
def phase_accumulate(spark, d):
    out = FR.phases(V.pitch(spark, d), KEY, "idx", "f0", 16000.0, 3)
    return out.select("sid", "idx", "k", "voiced", F.round("phase", 8).alias("phase"), r6("sine").alias("sine"))


@query(
    "segment_reset_cumsum",
    V.sql(
        "pitch",
        f"""SELECT sid, idx, round(p, 8) AS phase, round(cos(2 * pi() * p), 6) AS wave FROM (SELECT sid, idx,
        sum(f0 / 16000.0) OVER (PARTITION BY sid, isl ORDER BY idx) AS p FROM
        (SELECT *, count(*) FILTER (WHERE f0 <= 0) {OVER}) AS isl FROM pitch))""",
    ),
)
def segment_reset_cumsum(spark, d):
    out = FR.restarted_phase(V.pitch(spark, d), KEY, "idx", "f0", 16000.0)
    return out.select("sid", "idx", F.round("phase", 8).alias("phase"), r6("wave").alias("wave"))


OMEGA = 2.0 * math.pi * 3 / 64


@query(
    "phase_increment",
    V.sql(
        "series",
        f"""SELECT sid, idx, round(({OMEGA!r} + (h - 2 * pi() * (round_even(h / (2 * pi()) + 1, 0) - 1)) / 16.0) * 16000
        / (2 * pi()), 6) AS hz FROM (SELECT sid, idx, coalesce(x - lag(x) {OVER}), lead(x) {OVER}) - x) - {OMEGA!r} * 16 AS h
        FROM series)""",
    ),
)
def phase_increment(spark, d):
    out = FR.instantaneous_hz(V.series(spark, d), KEY, "idx", "x", 3, 64, 16, 16000.0)
    return out.select("sid", "idx", r6("hz").alias("hz"))


@query("preemphasis", V.sql("series", f"SELECT sid, idx, round(x - 0.97 * coalesce(lag(x) {OVER}), 0), 6) AS y FROM series"))
def preemphasis(spark, d):
    return FR.preemphasis(V.series(spark, d), KEY, "idx", "x", 0.97).select("sid", "idx", r6("y").alias("y"))


FRAMES_SQL = dict(
    len="SELECT sid, count(*) AS n FROM series GROUP BY sid",
    padded="""SELECT sid, idx AS p, x FROM series UNION ALL
        SELECT sid, unnest(generate_series(-4, -1)), 0.0 FROM len UNION ALL
        SELECT sid, unnest(generate_series(n, n + 3)), 0.0 FROM len""",
    fr="""SELECT sid, frame, p + 4 - frame * 4 AS offset, x FROM (SELECT p.sid, p.p, p.x, unnest(generate_series(
        greatest(CAST(ceil((p + 4 - 7) / 4.0) AS BIGINT), 0), least((p + 4) // 4, n // 4))) AS frame
        FROM padded p JOIN len USING (sid))""",
)


@query("hop_frames", V.sql("series", 'SELECT sid, frame, "offset", x FROM fr', **FRAMES_SQL))
def hop_frames(spark, d):
    return FR.hop_frames(V.series(spark, d), KEY, "idx", "x", 8, 4)


@query(
    "frame_zscore",
    V.sql(
        "series",
        """SELECT sid, frame, "offset", round((x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 1e-10), 6) AS z
        FROM fr WINDOW w AS (PARTITION BY sid, frame)""",
        **FRAMES_SQL,
    ),
)
def frame_zscore(spark, d):
    frames = FR.hop_frames(V.series(spark, d), KEY, "idx", "x", 8, 4)
    return FR.frame_zscore(frames, KEY).select("sid", "frame", "offset", r6("z").alias("z"))


@query("peak_normalise", V.sql("series", "SELECT sid, idx, round(x / max(abs(x)) OVER (PARTITION BY sid) * 0.6, 6) AS y FROM series"))
def peak_normalise(spark, d):
    return FR.peak_normalise(V.series(spark, d), KEY, "x", 0.6).select("sid", "idx", r6("y").alias("y"))


@query(
    "fixed_segments",
    V.sql(
        "series",
        """SELECT sid, idx // 16 AS chunk, min(idx) AS start, count(*) AS len, count(*) // 4 AS features FROM series
        GROUP BY sid, idx // 16""",
    ),
)
def fixed_segments(spark, d):
    return FR.fixed_segments(V.series(spark, d), KEY, "idx", 16, 4)


@query("context_chunks", V.sql("series", f"SELECT sid, idx, round(sum(x) {rows_over(1, 1)} / 3.0, 6) AS y FROM series"))
def context_chunks(spark, d):
    """A moving average computed chunk by chunk equals the one over the whole series."""

    def smooth(pdf):
        import numpy as np

        return pdf.assign(y=np.convolve(pdf["x"], np.ones(3) / 3.0)[1 : 1 + len(pdf)])[["sid", "idx", "y"]]

    s = V.series(spark, d).select("sid", "idx", "x")
    out = FR.chunk_apply(s, KEY, "idx", 16, 3, smooth, "sid bigint, idx bigint, y double")
    return out.select("sid", "idx", r6("y").alias("y"))


@query(
    "pad_or_trim",
    V.sql(
        "series",
        """SELECT sid, idx, x FROM series WHERE idx < 72 UNION ALL SELECT sid, unnest(generate_series(n, 65)), 0.0
        FROM (SELECT sid, count(*) AS n FROM series GROUP BY sid)""",
    ),
)
def pad_or_trim(spark, d):
    return FR.pad_or_trim(V.series(spark, d), KEY, "idx", "x", 72, 66)


@query("repeat_upsample", V.sql("series", "SELECT sid, idx * 2 + j AS idx, x FROM series, (VALUES (0), (1)) AS t(j)"))
def repeat_upsample(spark, d):
    return FR.repeat_upsample(V.series(spark, d).select("sid", "idx", "x"), "idx", 2)


@query(
    "find_endpoint",
    V.sql(
        "series",
        f"""SELECT sid, coalesce(min(idx) FILTER (WHERE idx >= 2 AND idx % 2 = 0 AND idx < n - 8 AND m < 60) + 2, max(n))
        AS endpoint FROM (SELECT sid, idx, max(x) {rows_over(0, 7)} AS m, count(*) OVER (PARTITION BY sid) AS n FROM series)
        GROUP BY sid""",
    ),
)
def find_endpoint(spark, d):
    return FR.find_endpoint(V.series(spark, d), KEY, "idx", "x", 8, 60.0)


@query(
    "silence_trim",
    V.sql(
        "series",
        """SELECT sid, i - lo AS idx, x FROM cut JOIN (SELECT sid, min(f) * 2 AS lo, (max(f) + 1) * 2 AS hi FROM
        (SELECT *, max(pw) OVER (PARTITION BY sid) AS top FROM pw)
        WHERE 10 * log10(greatest(pw, 1e-10)) - 10 * log10(greatest(top, 1e-10)) > -6 GROUP BY sid) USING (sid)
        WHERE i >= lo AND i < hi""",
        cut="""SELECT sid, idx - 2 AS i, x, n - 4 AS n FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM series)
            WHERE idx >= 2 AND idx < n - 2""",
        pw="""SELECT sid, f, sum(x * x) / 4.0 AS pw FROM (SELECT sid, x, unnest(generate_series(greatest(
            CAST(ceil((i + 2 - 3) / 2.0) AS BIGINT), 0), least((i + 2) // 2, n // 2))) AS f FROM cut) GROUP BY sid, f""",
    ),
)
def silence_trim(spark, d):
    return FR.silence_trim(V.series(spark, d).select("sid", "idx", "x"), KEY, "idx", "x", 2, 4, 2, 6.0)


@query(
    "split_on_silence",
    V.sql(
        "series",
        f"""SELECT sid, idx, row_number() {OVER}) - 1 AS out_idx, x FROM (SELECT *, min(s) {rows_over(1, 1)} AS k FROM
        (SELECT *, max(q) {rows_over(3, 0)} AS s FROM (SELECT sid, idx, x, CASE WHEN count(*) {rows_over(0, 3)} = 4
        AND sqrt(avg(x * x) {rows_over(0, 3)}) <= 30 THEN 1 ELSE 0 END AS q FROM series))) WHERE k = 0""",
    ),
)
def split_on_silence(spark, d):
    s = V.series(spark, d).select("sid", "idx", "x")
    return FR.split_on_silence(s, KEY, "idx", "x", 4, 30.0, 1).select("sid", "idx", "out_idx", "x")


@query(
    "aperiodicity",
    V.sql(
        "series",
        f"""SELECT sid, frame, round((avg(pow(x - s, 2)) / 2) / ((avg(x * x) + avg(s * s)) / 2 + {FR.EPS!r}), 6) AS ap FROM
        (SELECT a.sid, a.frame, a.x, b.x AS s FROM u a JOIN u b ON a.sid = b.sid AND a.frame = b.frame
        AND b.o = CASE WHEN a.o + 2 < 16 THEN a.o + 2 ELSE 31 - (a.o + 2) END) GROUP BY sid, frame""",
        u="""SELECT sid, frame, idx - frame * 8 AS o, x FROM (SELECT s.sid, s.idx, s.x, unnest(generate_series(greatest(
            CAST(ceil((idx - 15) / 8.0) AS BIGINT), 0), least(idx // 8, (n - 16) // 8))) AS frame FROM series s JOIN
            (SELECT sid, count(*) AS n FROM series GROUP BY sid) USING (sid))""",
    ),
)
def aperiodicity(spark, d):
    frames = FR.frame_arrays(FR.hop_frames(V.series(spark, d), KEY, "idx", "x", 16, 8, pad=False), KEY)
    return frames.select("sid", "frame", r6(FR.aperiodicity("f", 2)).alias("ap"))


@query(
    "best_so_far",
    V.sql(
        "log",
        """SELECT tag, step, val, best AS replaces FROM (SELECT *, min(val) OVER (PARTITION BY tag ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM log) WHERE best IS NULL OR val < best""",
    ),
)
def best_so_far(spark, d):
    return FR.best_so_far(V.log(spark, d), ["tag"], "step", "val").select("tag", "step", "val", "replaces")


TOKENS = dict(
    tk="""SELECT conv_id, turn, j, CASE WHEN j = 0 THEN 50364 + turn * 125 ELSE len(word) END AS token, word FROM
        (SELECT conv_id, turn, unnest(generate_series(0, len(w))) AS j, unnest(list_prepend('', w)) AS word FROM
        (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))""",
    ps="SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, j) - 1 AS pos FROM tk",
)


@query(
    "timestamp_token_segments",
    V.sql(
        "",
        """SELECT conv_id, pos, seg, printf('<|%.2f|>', turn * 125 * 0.02::DOUBLE) AS label, word FROM (SELECT *,
        count(*) FILTER (WHERE token >= 50364) OVER (PARTITION BY conv_id ORDER BY pos) AS seg FROM ps) WHERE token < 50364""",
        **TOKENS,
    ),
)
def timestamp_token_segments(spark, d):
    """Every turn becomes a time marker followed by its words."""
    words = V.table(spark, d, "conversations").select(
        "conv_id", "turn", F.posexplode(F.concat(F.array(F.lit("")), F.split("text", " "))).alias("j", "word")
    )
    tokens = words.withColumn(
        "token", F.when(c("j") == 0, 50364 + c("turn") * 125).otherwise(F.length("word")).cast("bigint")
    )
    placed = ordinal(tokens, ["conv_id"], ["turn", "j"], F.expr("turn div 4096"), "pos")
    return FR.label_timestamps(placed, ["conv_id"], "pos", "token", 50364).select("conv_id", "pos", "seg", "label", "word")


@query("lag_shift", V.sql("series", f"SELECT sid, idx, coalesce(lag(x) {OVER}), 0) AS y FROM series"))
def lag_shift(spark, d):
    return FR.delay(V.series(spark, d), KEY, "idx", "x").select("sid", "idx", "y")


@query(
    "interp_resample",
    """WITH g AS (SELECT event_type, unnest(generate_series(CAST(ceil(lo / 3.6e9) AS BIGINT), hi // 3600000000)) * 3600000000
    AS at_us FROM (SELECT event_type, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY event_type))
    SELECT g.event_type, at_us, round(CASE WHEN b.t = at_us THEN b.value ELSE a.value + (b.value - a.value)
    * ((at_us - a.t) / (b.t - a.t)::DOUBLE) END, 6) AS y FROM g
    ASOF LEFT JOIN (SELECT event_type, epoch_us(ts) AS t, value FROM events) a ON g.event_type = a.event_type AND g.at_us > a.t
    ASOF LEFT JOIN (SELECT event_type, epoch_us(ts) AS t, value FROM events) b ON g.event_type = b.event_type AND g.at_us <= b.t""",
)
def interp_resample(spark, d):
    e = V.table(spark, d, "events").select("event_type", "ts", "value")
    return FR.hourly_interpolation(e, ["event_type"], "ts", "value").select("event_type", "at_us", r6("y").alias("y"))


@query(
    "shift_crossjoin",
    V.sql("pitch", "SELECT sid, idx, s AS shift, round(f0 * pow(2.0, s / 12.0), 6) AS f0 FROM pitch, generate_series(-3, 3) AS t(s)"),
)
def shift_crossjoin(spark, d):
    shifted = V.pitch(spark, d).select("sid", "idx", "f0", F.explode(F.expr("sequence(-3L, 3L)")).alias("shift"))
    return shifted.select("sid", "idx", "shift", r6(P.semitones(c("f0"), c("shift"))).alias("f0"))


@query(
    "span_mask",
    V.sql(
        "series",
        f"""SELECT s.sid, s.idx, coalesce(max(CASE WHEN st.sid IS NOT NULL THEN 1 END), 0) = 1 AS masked FROM series s
        LEFT JOIN (SELECT r.sid, r.idx FROM (SELECT sid, idx, row_number() OVER (PARTITION BY sid ORDER BY
        md5('11|' || sid || '|' || idx), idx) - 1 AS place FROM series JOIN l USING (sid) WHERE idx <= n - 4) r JOIN l
        USING (sid) WHERE place < k) st ON s.sid = st.sid AND s.idx >= st.idx AND s.idx < st.idx + 4 GROUP BY s.sid, s.idx""",
        l=f"""SELECT sid, n, CASE WHEN m * 4 > n THEN n // 4 ELSE m END AS k FROM (SELECT sid, n,
            greatest(CAST(floor(0.3 * n / 4 + {V.uniform_sql("'11|' || sid")}) AS BIGINT), 1) AS m FROM
            (SELECT sid, count(*) AS n FROM series GROUP BY sid))""",
    ),
)
def span_mask(spark, d):
    from framewright.operators.sampling import span_mask as mask

    return mask(V.series(spark, d).select("sid", "idx"), KEY, "idx", 0.3, 4, seed=11, min_masks=1)


@query(
    "random_slices",
    V.sql(
        "series",
        f"""SELECT sid, idx - start AS out_idx, x, 50 + 2 * x AS f0 FROM (SELECT s.*,
        CASE WHEN n >= 16 THEN CAST(floor({V.uniform_sql("'13|' || sid")} * (n - 16 + 1)) AS BIGINT) ELSE 0 END AS start
        FROM series s JOIN (SELECT sid, count(*) AS n FROM series GROUP BY sid) USING (sid))
        WHERE idx >= start AND idx < start + 16""",
    ),
)
def random_slices(spark, d):
    sized = with_group(V.series(spark, d).select("sid", "idx", "x"), KEY, n=F.count(F.lit(1)))
    start = random_start(c("n"), F.lit(16), 13, "sid", inclusive=True)
    cut = sized.withColumn("start", start).where("idx >= start AND idx < start + 16")
    return cut.select("sid", (c("idx") - c("start")).alias("out_idx"), "x", (50.0 + 2.0 * c("x")).alias("f0"))


@query(
    "collate_pad",
    V.sql(
        "series",
        """SELECT batch, pos, sid, i AS idx, length, round(coalesce(x, 0), 6) AS x FROM (SELECT *, unnest(generate_series(0, top - 1))
        AS i FROM (SELECT sid, sid // 8 AS batch, n AS length, row_number() OVER (PARTITION BY sid // 8 ORDER BY n DESC, sid) - 1
        AS pos, max(n) OVER (PARTITION BY sid // 8) AS top FROM (SELECT sid, count(*) AS n FROM series GROUP BY sid)))
        LEFT JOIN series USING (sid) WHERE series.idx = i OR (series.idx = 0 AND i >= length)""".replace(
            "round(coalesce(x, 0), 6)", "CASE WHEN i < length THEN x ELSE 0 END"
        ),
    ),
)
def collate_pad(spark, d):
    from framewright.operators.sampling import collate_pad as collate

    items = V.series(spark, d).select("sid", "idx", "x", F.expr("sid div 8").alias("batch"))
    return collate(items, "batch", "sid", "idx", "x").select("batch", "pos", "sid", "idx", "length", "x")


@query(
    "sequence_mask",
    """WITH t AS (SELECT l_orderkey AS g, l_linenumber AS b, CAST(ceil(sum(l_quantity) / 10) AS BIGINT) AS dur FROM lineitem
    GROUP BY l_orderkey, l_linenumber), s AS (SELECT *, CAST(sum(dur) OVER (PARTITION BY g ORDER BY b) - dur AS BIGINT) AS a FROM t),
    n AS (SELECT g, n, max(n) OVER (PARTITION BY g // 16) AS top FROM (SELECT g, CAST(sum(dur) AS BIGINT) AS n FROM t GROUP BY g))
    SELECT g, unnest(generate_series(a, a + dur - 1)) AS frame, CAST(b AS BIGINT) AS token, true AS valid FROM s UNION ALL
    SELECT g, unnest(generate_series(n, top - 1)), NULL, false FROM n""",
)
def sequence_mask(spark, d):
    from framewright.operators.sampling import alignment_path

    items = V.table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("g"), c("l_linenumber").alias("b")).agg(
        F.ceil(F.sum("l_quantity") / 10).cast("bigint").alias("dur")
    )
    return alignment_path(items.withColumn("batch", F.expr("g div 16")), ["g"], "b", "dur", "batch")
