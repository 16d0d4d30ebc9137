"""Operators over long series: how often they plan their source, and results that do not depend on blocks or gaps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framewright.operators import frames as FR, segments as SG, spectral as SP
from framewright.sources import transcripts as TR

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.mark.parametrize(
    "name, column",
    [
        ("hysteresis", "event_id"), ("segment_reset_cumsum", "event_id"), ("silence_trim", "event_id"), ("framed_spectrum", "event_id"),
        ("mel_project", "event_id"), ("a_weighted_loudness", "event_id"), ("span_mask", "event_id"), ("transcript_all", "conv_id"),
        ("split_on_silence", "event_id"), ("find_endpoint", "event_id"), ("speech_segments_limited", "event_id"),
    ],
)
def test_source_is_planned_at_most_twice(spark, name, column):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"Relation [{column}#") <= 2, plan


def frames_of(x, size, hop, pad, mirror):
    if mirror and len(x) <= pad:
        return []
    line = np.pad(x, pad, mode="reflect" if mirror else "constant") if pad else np.asarray(x)
    return [line[i : i + size].tolist() for i in range(0, len(line) - size + 1, hop)]


@pytest.mark.parametrize("rows", [16, 50, 1 << 16])
@pytest.mark.parametrize("size, hop, pad, mirror", [(8, 4, 0, False), (8, 4, 4, False), (16, 4, 6, True), (5, 7, 0, False), (9, 1, 4, True)])
def test_strided_frames_do_not_depend_on_blocks(hot, hot_df, rows, size, hop, pad, mirror):
    got = {(r["sid"], r["frame"]): list(r["f"]) for r in FR.strided_frames(hot_df, ["sid"], "idx", "x", size, hop, pad, mirror, rows=rows).collect()}
    want = {(k, i): f for k, v in hot.items() for i, f in enumerate(frames_of(v, size, hop, pad, mirror))}
    assert got == want


def test_strided_frames_are_those_of_rows(hot_df):
    rows = FR.frame_arrays(FR.hop_frames(hot_df, ["sid"], "idx", "x", 8, 4), ["sid"])
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, FR.strided_frames(hot_df, ["sid"], "idx", "x", 8, 4, pad=4, rows=20).collect()))
    assert SP.spectrum(hot_df.where("false"), ["sid"], "idx", "x", 16, 4).count() == 0


@pytest.mark.parametrize("rows", [10, 33, 1 << 16])
@pytest.mark.parametrize("win", [3, 21, 101, 301])
def test_medians_by_rank_are_those_of_sorted_windows(spark, win, rows):
    rng = random.Random(6)
    data = {0: [rng.choice([None, rng.randint(0, 9) / 2, rng.gauss(0, 3)]) for _ in range(260)], 1: [None] * 5, 2: [1.5]}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "sid bigint, idx bigint, x double").repartition(3)
    got = {(r["sid"], r["idx"]): r["y"] for r in FR.median_filter(df, ["sid"], "idx", "x", win, rows=rows, sorted_up_to=0).collect()}
    half = win // 2
    for k, vs in data.items():
        for i in range(len(vs)):
            seen = sorted(v for v in vs[max(0, i - half) : i + half + 1] if v is not None)
            y = got[k, i]
            assert (y is None or math.isnan(y)) if not seen else y == seen[(len(seen) - 1) // 2]


def test_wide_medians_take_near_linear_time():
    values = np.random.default_rng(2).normal(size=60_000)
    got = FR.sliding_median(values, 10_001)
    for i in (0, 4_000, 30_000, 59_999):
        seen = np.sort(values[max(0, i - 5000) : i + 5001])
        assert got[i] == seen[(len(seen) - 1) // 2]


@pytest.mark.parametrize("rows", [16, 45, 1 << 16])
@pytest.mark.parametrize("least, keep", [(1, 0), (4, 1), (30, 5)])
def test_silence_split_does_not_depend_on_blocks(spark, rows, least, keep):
    rng = random.Random(9)
    data = {0: [rng.choice([0.0, 0.0, 0.0, 0.01, 5.0, None]) if (i // 40) % 2 else rng.uniform(1, 2) for i in range(200)], 1: [0.0] * 50, 2: [3.0], 3: [0.0] * 3}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "sid bigint, idx bigint, x double").repartition(3)
    got = sorted((r["sid"], r["idx"], r["out_idx"]) for r in FR.split_on_silence(df, ["sid"], "idx", "x", least, 0.5, keep, rows=rows).collect())
    want = []
    for k, vs in data.items():
        silent = set()
        for i in range(len(vs) - least + 1):
            seen = [v for v in vs[i : i + least] if v is not None]
            if seen and math.sqrt(sum(v * v for v in seen) / len(seen)) <= 0.5:
                silent |= set(range(i, i + least))
        kept = [i for i in range(len(vs)) if any(j not in silent for j in range(max(0, i - keep), min(len(vs), i + keep + 1)))]
        want += [(k, i, n) for n, i in enumerate(kept)]
    assert got == want


def test_window_sums_lose_nothing_beside_loud_parts():
    values = np.r_[np.full(5000, 1e8), np.full(5000, 1e-8)]
    assert FR.window_sums(values, 1000)[-1] == pytest.approx(1000 * 1e-8, rel=1e-12)


@pytest.mark.parametrize("rows", [7, 1 << 16])
def test_hysteresis_with_one_long_run(spark, rows):
    """A run over many blocks is judged by its highest value, wherever that stands."""
    for top, kept in ((0.9, True), (0.3, False)):
        per = [0.1] + [0.25] * 60 + [top] + [0.25] * 30
        df = spark.createDataFrame([(0, i, 100.0 + i % 3, p) for i, p in enumerate(per)], "sid bigint, idx bigint, f0 double, per double").repartition(3)
        got = SG.hysteresis(df, ["sid"], "idx", "f0", "per", width=0.0, rows=rows).orderBy("idx").collect()
        assert [r["y"] is not None for r in got] == [False] + [kept] * 91


def test_json_chunks_hold_every_column(spark):
    segments = spark.createDataFrame([("a", 2, 1.0, 2.0, "t,o", 0.5), ("a", 1, 0.0, 1.0, 'on"e', None), ("b", 1, 0.0, 9.0, "x", 1.0)], "audio string, seg_no bigint, start_s double, end_s double, text string, p double")
    chunks = sorted((r["audio"], r["part"], r["chunk"]) for r in TR.transcript(segments, "json").collect())
    assert [c for a, _, c in chunks if a == "a"] == ['{"audio":a,"segments":[', '{"start":0.0,"end":1.0,"text":"on\\"e"}', ',{"start":1.0,"end":2.0,"text":"t,o","p":0.5}', "]}"]
    counts = {r["format"]: r["n"] for r in TR.transcript(segments, "all").groupBy("format").agg(F.count("chunk").alias("n")).collect()}
    assert counts == {"txt": 3, "vtt": 5, "srt": 3, "tsv": 5, "json": 7}


@pytest.mark.parametrize("rows", [7, 50, 1 << 16])
def test_phases_gather_no_rounding_error(spark, rows):
    rng = random.Random(8)
    cents = {0: [160000] * 120, 1: [rng.choice([0, 5000 + 2 * rng.randint(1, 40000)]) for _ in range(150)]}
    cents[1].append(-sum(cents[1]) % 1600000)
    nan = [100.0, math.nan, 100.0]
    data = {k: [v / 100 for v in vs] for k, vs in cents.items()} | {2: nan, 3: [2e9, 4000.0], 4: [None, 4000.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "sid bigint, idx bigint, f0 double").repartition(3)
    got = {(r["sid"], r["idx"], r["k"]): r["phase"] for r in FR.phases(df, ["sid"], "idx", "f0", 16000.0, 3, rows=rows).collect()}
    for key, vs in cents.items():
        for i in range(len(vs)):
            for k in (1, 2, 3):
                assert got[key, i, k] == pytest.approx(sum(vs[: i + 1]) * k % 1600000 / 1600000, rel=0, abs=2e-16)
    assert got[0, 9, 1] == got[0, 119, 3] == got[1, 150, 2] == 0.0
    assert got[2, 0, 2] == 0.0125 and math.isnan(got[2, 1, 1]) and math.isnan(got[2, 2, 1])
    assert (got[3, 1, 1], got[3, 1, 3], got[4, 0, 1], got[4, 1, 2]) == (0.25, 0.75, 0.0, 0.5)
