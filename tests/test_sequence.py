"""Best paths, feedback filters, periods and spectra."""

import itertools
import math

import duckdb
import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import GroupedData, functions as F

from framewright.operators import decode as D, frames as FR, metrics as M, sequence as SQ, spectral as SP
from framewright.plans import on_sequences  # noqa: F401  (registers the queries)
from framewright.plans.registry import ORACLES, QUERIES


def score(path, lp, step, start):
    return start[path[0]] + sum(step[a, b] for a, b in zip(path, path[1:])) + sum(lp[t][s] for t, s in enumerate(path))


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_viterbi_against_all_paths(spark, monkeypatch, block):
    monkeypatch.setattr(SQ, "FAN", 2)
    rng = np.random.default_rng(7)
    step, start = np.log(rng.dirichlet(np.ones(3), 3)), np.log(rng.dirichlet(np.ones(3)))
    scores = {0: rng.normal(size=(9, 3)), 1: rng.normal(size=(1, 3)), 2: rng.normal(size=(5, 3))}
    rows = [(k, i, [float(x) for x in r]) for k, lp in scores.items() for i, r in enumerate(lp)]
    df = spark.createDataFrame(rows, "sid bigint, idx bigint, lp array<double>")
    got = SQ.viterbi(df, ["sid"], "idx", "lp", step, start, block=block).orderBy("sid", "idx").collect()
    for k, lp in scores.items():
        path = [r["state"] for r in got if r["sid"] == k]
        best = max(itertools.product(range(3), repeat=len(lp)), key=lambda p: score(p, lp, step, start))
        assert score(path, lp, step, start) == pytest.approx(score(best, lp, step, start))


def dense_path(lp, step, start):
    now, back = start + lp[0], []
    for obs in lp[1:]:
        reach = now[:, None] + step
        back.append(reach.argmax(0))
        now = reach.max(0) + obs
    path = [int(now.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("block", [1, 64, 512])
def test_long_paths_over_many_states_are_those_of_all_pairs(spark, block):
    """Ties, impossible states, bands, blocks of bands and full matrices; keys of any length, one of them NULL."""
    rng = np.random.default_rng(3)
    band = SQ.band_matrix(60, 5)
    i = np.arange(60)
    tolerant = np.log(np.where(np.abs(i[:, None] - i) <= 3, 1.0, 0.01))
    with np.errstate(divide="ignore"):
        voiced = np.log(np.kron([[0.99, 0.01], [0.01, 0.99]], np.exp(SQ.band_matrix(30, 4)) * (np.abs(i[:30, None] - i[:30]) < 4)))
    full = rng.integers(-3, 1, size=(60, 60)).astype(float)
    start = np.log(np.full(60, 1 / 60))
    for step in (band, tolerant, voiced, full):
        scores = {0: rng.integers(-4, 1, size=(700, 60)).astype(float), 1: np.zeros((130, 60)), 2: rng.normal(size=(1, 60)), None: rng.normal(size=(65, 60))}
        scores[0][rng.random((700, 60)) < 0.3] = -np.inf
        rows = [(k, t * 3, r.tolist()) for k, lp in scores.items() for t, r in enumerate(lp)]
        df = spark.createDataFrame(rows, "sid bigint, idx bigint, lp array<double>").repartition(4)
        got = SQ.viterbi(df, ["sid"], "idx", "lp", step, start, block=block).collect()
        assert len(got) == len(rows)
        for k, lp in scores.items():
            assert [r["state"] for r in sorted((r for r in got if r["sid"] == k), key=lambda r: r["idx"])] == dense_path(lp, step, start)


def test_steps_over_a_band_cost_the_band():
    steps = SQ.Steps(SQ.band_matrix(360, 12))
    assert steps.cost.shape == (360, 23)
    rng = np.random.default_rng(4)
    now = rng.normal(size=360)
    reach = now[:, None] + SQ.band_matrix(360, 12)
    best, origin = steps.ahead(now)
    assert (best == reach.max(0)).all() and (origin == reach.argmax(0)).all()


def test_trajectory_follows_the_ridge_inside_regions(spark):
    ridge = [2, 2, 3, 3, 4, 4, 3, 3]
    rows = [(0, t, [1.0 if s == ridge[t] else 0.01 for s in range(6)]) for t in range(8)]
    grid = spark.createDataFrame(rows, "sid bigint, idx bigint, z array<double>")
    regions = spark.createDataFrame([(0, 0, 1, 4), (0, 1, 5, 7)], "sid bigint, region bigint, start bigint, end bigint")
    whole = SQ.trajectory(grid, ["sid"], "idx", "z", 6, tol=1).orderBy("idx").collect()
    assert [r["state"] for r in whole] == ridge
    parts = SQ.trajectory(grid, ["sid"], "idx", "z", 6, tol=1, regions=regions).orderBy("idx").collect()
    assert [r["state"] for r in parts] == [-1, 2, 3, 3, -1, 4, 3, -1]
    assert SQ.trajectory(grid.limit(0), ["sid"], "idx", "z", 6, tol=1, regions=regions.limit(0)).collect() == []


def test_best_path_decoder_bridges_a_spike(spark):
    """One frame whose best bin is far off is overruled by the band; a frame without a candidate takes another."""
    rows = [(0, t, c, 5.0 if c == (7 if t == 3 else 2) else 0.0) for t in range(6) for c in range(8) if (t, c) != (4, 2)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, c int, z double")
    got = D.best_path(df, ["k", "t"], "c", "z", states=8, width=2).orderBy("t").collect()
    bins = [r["bin"] for r in got]
    assert bins[:3] == [2, 2, 2] and abs(bins[3] - 2) <= 1 and bins[4] in (1, 3) and bins[5] == 2
    with pytest.raises(ValueError):
        D.decode(df, ["t"], "c", "z", "viterbi")


@pytest.mark.parametrize("block", [3, 70, 1000])
def test_feedback_filter_undoes_preemphasis(hot, hot_df, block):
    flat = FR.preemphasis(hot_df, ["sid"], "idx", "x", 0.97, rows=5).select("sid", "idx", F.col("y").alias("e"))
    back = SQ.inverse_preemphasis(flat, ["sid"], "idx", "e", 0.97, block=block)
    got = {(r["sid"], r["idx"]): r["y"] for r in back.collect()}
    for k, v in hot.items():
        for i, x in enumerate(v):
            assert got[k, i] == pytest.approx(x, abs=1e-9)


def test_feedback_filter_streams_short_series(spark, monkeypatch):
    """Series go through a task together, none of them in a call of its own, and neither keys that are NULL nor infinite values touch others."""
    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rng = np.random.default_rng(3)
    series = {k: rng.uniform(-1, 1, size=1 + (7 * (k or 0)) % 40) for k in [None, *range(1, 900)]}
    series[5][0] = np.inf
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sid bigint, idx bigint, x double").repartition(3)
    for block in (16, 1000):
        got = {(r["sid"], r["idx"]): r["y"] for r in SQ.inverse_preemphasis(df, ["sid"], "idx", "x", 0.9, block=block).collect()}
        assert len(got) == len(rows)
        for k, x in series.items():
            y = 0.0
            for i, v in enumerate(x):
                y = v + 0.9 * y
                assert got[k, i] == pytest.approx(y, abs=1e-9)


@pytest.fixture(scope="module")
def sine(spark):
    x = np.sin(2 * np.pi * 220.0 * np.arange(2048) / 16000.0)
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "sid bigint, idx bigint, x double")


def test_period_of_a_sine(sine):
    frames = FR.frame_arrays(FR.hop_frames(sine, ["sid"], "idx", "x", 512, 256, pad=False), ["sid"])
    out = SQ.period_estimate(frames, ["sid", "frame"], "f", 16000.0, 100.0, 800.0).collect()
    assert len(out) == 7
    assert all(abs(r["f0"] - 220.0) < 1.0 for r in out)
    # the mirrored tail, one period of 512 rows, never matches; the rest does
    assert all(r["ap"] < 2.0 * 73 / 512 for r in out)


def test_cmndf_column_matches_the_estimator_definition(spark):
    f = [0.0, 1.0, 0.5, -1.0, 2.0, 0.25]
    got = spark.createDataFrame([(f,)], "f array<double>").select(SQ.cmndf("f", 3)).first()[0]
    diffs = [sum((a - b) ** 2 for a, b in zip(f, f[k:])) for k in (1, 2, 3)]
    assert got == pytest.approx([1.0] + [d / (sum(diffs[: k + 1]) / (k + 1)) for k, d in enumerate(diffs)])


def test_spectrum_peaks_at_the_sine(sine):
    out = SP.spectrum(sine, ["sid"], "idx", "x", 1024, 320).orderBy("frame").collect()
    assert len(out) == 1 + (2048 + 2 * 352 - 1024) // 320
    assert all(int(np.argmax(r["mag"])) in (14, 15) for r in out[1:-1])


def test_mel_filters_cover_the_range_once():
    bank = SP.mel_filters(16000.0, 1024, 80, 0.0, 8000.0)
    assert bank.shape == (80, 513) and (bank >= 0).all() and (bank.sum(1) > 0).all()
    assert (np.diff(bank.argmax(1)) >= 0).all()


def test_silence_is_at_the_floor(spark):
    quiet = spark.createDataFrame([(0, i, 0.0) for i in range(64)], "sid bigint, idx bigint, x double")
    assert all(-125.0 < r["loudness"] <= -100.0 for r in SP.loudness(quiet, ["sid"], "idx", "x", 16, 8, 16000.0).collect())


def test_endpoint_before_a_quiet_window_across_blocks(spark):
    """Missing values are quiet; without a quiet window the endpoint is the length."""
    x = [9.0] * 10 + [0.0, None] * 8 + [9.0] * 10
    rows = [(0, i, v) for i, v in enumerate(x)] + [(1, i, 9.0) for i in range(12)]
    df = spark.createDataFrame(rows, "sid bigint, idx bigint, x double")
    for rows_per_block in (3, 7, 1000):
        got = FR.find_endpoint(df, ["sid"], "idx", "x", 8, 1.0, rows=rows_per_block).collect()
        assert {r["sid"]: r["endpoint"] for r in got} == {0: 12, 1: 12}


def test_levels_are_relative_to_the_clip(spark):
    """Power above the threshold goes, what is left is compressed, and a silent clip stays silent."""
    df = spark.createDataFrame([(0, 100.0), (0, 4.0), (0, 0.0), (1, 0.0)], "clip bigint, power double")
    got = M.compress_levels(df, ["clip"], "power", 0.5, -3.0).orderBy("clip", "power").collect()
    assert [tuple(r) for r in got] == [(0, 0.0), (0, 0.0), (0, 2.0), (1, 0.0)]
    assert [r["power"] for r in M.compress_levels(df, ["clip"], "power", 0.5, 40.0).orderBy("clip", "power").collect()] == [0.0, 2.0, 10.0, 0.0]


@pytest.mark.parametrize("name", ["viterbi", "trajectory_dp"])
def test_paths_of_nearly_equal_score_are_those_of_the_sql(spark, tmp_path, name):
    """In the series of this user two paths of trajectory_dp score the same but for the last bit of a logarithm."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = 890) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).select("sid", "idx", "state").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT sid, idx, state FROM ({ORACLES[name]})").fetchall())


def test_powers_exponentials_and_logarithms_are_the_c_library_s(spark):
    values = np.random.default_rng(2).uniform(0.01, 8, size=(3000, 8))
    df = spark.createDataFrame([(v.tolist(),) for v in values], "v array<double>").repartition(3)
    for fn, plain in ((lambda v: pc.power(v, 2.0), lambda v: math.pow(v, 2.0)), (pc.exp, math.exp), (pc.ln, math.log)):
        rows = df.select("v", SQ.c_library("v", fn).alias("y")).collect()
        assert all(r["y"] == [plain(v) for v in r["v"]] for r in rows)
