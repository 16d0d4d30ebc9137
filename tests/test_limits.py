"""Segments of limited length against the loop they stand for."""

import random

import numpy as np
import pytest

from framewright.operators import segments as SG

RNG = random.Random(21)


def by_loop(p, limit, threshold=0.5, min_speech=2, min_silence=2, pause=1):
    """Segments of one series, row by row."""
    out, start, quiet, end, again = [], None, None, None, None
    for i, v in enumerate(p):
        loud = v is not None and v >= threshold
        if loud and quiet is not None:
            quiet = None
            if end is not None and (again is None or again < end):
                again = i
        if loud and start is None:
            start = i
            continue
        if start is not None and i - start > limit:
            if end is None:
                out.append((start, i))
                start = quiet = end = again = None
                continue
            out.append((start, end))
            start = again if again is not None and again >= end else None
            quiet = end = again = None
        if start is not None and v is not None and v < threshold - 0.15:
            quiet = i if quiet is None else quiet
            if i - quiet > pause:
                end = quiet
            if i - quiet >= min_silence:
                if quiet - start > min_speech:
                    out.append((start, quiet))
                start = quiet = end = again = None
    if start is not None and len(p) - start > min_speech:
        out.append((start, len(p)))
    return out


def series(n, loud):
    out = []
    while len(out) < n:
        out += [RNG.choice([0.9, 0.6, 0.5])] * RNG.randint(1, 12) if RNG.random() < loud else [RNG.choice([0.1, 0.2, 0.4, None])] * RNG.randint(1, 5)
    return out[:n]


@pytest.mark.parametrize("limit, min_speech, min_silence, pause", [(8, 2, 3, 1), (5, 0, 2, 0), (30, 4, 8, 2), (1, 2, 1, 0), (70, 2, 9, 20)])
def test_jumps_give_the_segments_of_the_loop(limit, min_speech, min_silence, pause):
    for _ in range(200):
        p = series(RNG.randint(1, 400), RNG.choice([0.2, 0.5, 0.8, 1.0]))
        want = by_loop(p, limit, 0.5, min_speech, min_silence, pause)
        values = np.array([np.nan if v is None else v for v in p])
        for rows in (len(p), 64, 7):
            entry, got = 0, []
            for b in range(0, len(p), rows):
                low, high = max(0, b - limit - 1), min(len(p), b + rows)
                top = min(len(p), b + rows + limit + 2)
                made = SG._Jumps(np.arange(low, top), values[low:top], 0.5, limit + 1, min_speech, min_silence, pause)
                got += made.walk(entry, b - low, high - low)
                entry = int(made.successors(b - low, high - low)[entry])
            assert got == want, (p, rows)


@pytest.mark.parametrize("rows", [64, 7, 1 << 16])
def test_limited_segments_do_not_depend_on_blocks(spark, rows):
    data = {0: series(1500, 0.7), 1: [0.9] * 300, 2: [0.1] * 50, 3: [0.9], 4: series(90, 0.5), None: series(200, 0.6)}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "sid bigint, idx bigint, p double").repartition(4)
    got = SG.limited_segments(df.where("sid IS NOT NULL"), ["sid"], "idx", "p", 8, min_silence=3, rows=rows).collect()
    want = [(k, n, a, z, len(vs)) for k, vs in data.items() if k is not None for n, (a, z) in enumerate(by_loop(vs, 8, min_silence=3))]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert SG.limited_segments(df.where("false"), ["sid"], "idx", "p", 8, rows=rows).count() == 0


def test_without_a_cut_they_are_the_unlimited_segments(spark):
    df = spark.createDataFrame([(k, i, v or 0.0) for k in range(3) for i, v in enumerate(series(500, 0.4))], "sid bigint, idx bigint, p double")
    want = sorted(map(tuple, SG.speech_segments(df, ["sid"], "idx", "p").collect()))
    assert sorted(map(tuple, SG.limited_segments(df, ["sid"], "idx", "p", 600, rows=128).collect())) == want
