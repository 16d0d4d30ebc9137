"""Segments against state machines written as loops, in batch and as a stream."""

import math
import random
import tempfile

import numpy as np
import pytest

from framewright.operators import segments as SG
from framewright.streaming import ingest, vad


def spoken(p, t, min_speech, min_silence):
    out, start, quiet = [], None, None
    for i, v in enumerate(p):
        if v >= t:
            quiet = None
            start = i if start is None else start
        elif v < t - 0.15 and start is not None:
            quiet = i if quiet is None else quiet
            if i - quiet >= min_silence:
                if quiet - start > min_speech:
                    out.append((start, quiet))
                start = quiet = None
    if start is not None and len(p) - start > min_speech:
        out.append((start, len(p)))
    return out


def padded(segs, n, pad):
    segs = [list(s) for s in segs]
    for i, s in enumerate(segs):
        if i == 0:
            s[0] = max(0, s[0] - pad)
        if i + 1 < len(segs):
            gap = segs[i + 1][0] - s[1]
            share = gap // 2 if gap < 2 * pad else pad
            s[1] = s[1] + share if gap < 2 * pad else min(n, s[1] + pad)
            segs[i + 1][0] = max(0, segs[i + 1][0] - share)
        else:
            s[1] = min(n, s[1] + pad)
    return [tuple(s) for s in segs]


@pytest.fixture(scope="module")
def probs():
    rng = random.Random(1)
    out = {}
    for k in range(40):
        level, p = 0.5, []
        for _ in range(rng.choice([1, 5, 30, 120])):
            level = min(1.0, max(0.0, level + rng.uniform(-0.3, 0.3)))
            p.append(round(level, 3))
        out[k] = p
    out[40], out[41] = [0.0] * 12, [0.9] * 12
    return out


@pytest.fixture(scope="module")
def prob_df(spark, probs):
    return spark.createDataFrame([(k, i, v) for k, p in probs.items() for i, v in enumerate(p)], "sid bigint, idx bigint, p double")


@pytest.mark.parametrize("rows", [3, 1000])
def test_speech_segments(probs, prob_df, rows):
    segs = SG.speech_segments(prob_df, ["sid"], "idx", "p", 0.5, 2, 3, rows=rows)
    got = sorted((r["sid"], r["seg_no"], r["start"], r["end"]) for r in segs.collect())
    want = [(k, i, a, z) for k, p in probs.items() for i, (a, z) in enumerate(spoken(p, 0.5, 2, 3))]
    assert got == sorted(want)
    wide = sorted((r["sid"], r["start"], r["end"]) for r in SG.pad_segments(segs, ["sid"], 2, rows=2).collect())
    assert wide == sorted((k, *s) for k, p in probs.items() for s in padded(spoken(p, 0.5, 2, 3), len(p), 2))


def gate(f0, per, low=0.19, high=0.31, width=0.2, stds=1.7):
    y = np.array([math.log2(f) if f > 0 and p >= low else np.nan for f, p in zip(f0, per)])
    mean, std = (np.nanmean(y), np.nanstd(y)) if not np.isnan(y).all() else (np.nan, np.nan)
    with np.errstate(all="ignore"):
        thr = low + np.clip(width * ((y - mean) / std) ** 2 - width * stds**2, 0, 1 - low)
    thr[np.isnan(thr)] = low
    i = 0
    while i < len(per) - 1:
        if per[i] < thr[i] and per[i + 1] > thr[i + 1]:
            end = i + 1
            while end < len(per) and per[end] > thr[end]:
                end += 1
            if max(per[i + 1 : end]) <= high:
                thr[i + 1 : end] = 1
            i = end
        else:
            i += 1
    y[np.asarray(per) < thr] = np.nan
    return 2**y


@pytest.mark.parametrize("rows", [4, 1000])
def test_hysteresis(spark, rows):
    rng = random.Random(2)
    data = {k: [(rng.choice([0.0, 100.0, 200.0, 211.0, 900.0]), round(rng.uniform(0.1, 0.4), 3)) for _ in range(n)] for k, n in enumerate([60, 9, 33])}
    df = spark.createDataFrame([(k, i, f, p) for k, v in data.items() for i, (f, p) in enumerate(v)], "sid bigint, idx bigint, f0 double, per double")
    got = {(r["sid"], r["idx"]): r["y"] for r in SG.hysteresis(df, ["sid"], "idx", "f0", "per", rows=rows).collect()}
    for k, v in data.items():
        for i, w in enumerate(gate(*zip(*v))):
            if math.isnan(w):
                assert got[k, i] is None
            else:
                assert got[k, i] == pytest.approx(w)


def stream_rows(p, t=0.5, min_silence=2, pad=1):
    on, quiet, events, states = False, 0, [], []
    for now, v in enumerate(p, 1):
        if v >= t:
            quiet = 0
            if not on:
                on = True
                events.append(("start", now - pad))
        elif v < t - 0.15 and on:
            quiet = quiet or now
            if now - quiet >= min_silence:
                events.append(("end", quiet + pad))
                on, quiet = False, 0
        states.append(on)
    return events, states


STREAM = "sid bigint, pos bigint, p double, x double"


def series(probs):
    keys = [k for k, p in probs.items() if len(p) >= 30]
    return keys, [(k, i, v, 1.0 + i) for k in keys for i, v in enumerate(probs[k])]


def streamed(spark, root, fn, out, **options):
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return ingest.drain(fn(stream, **options), f"{root}/{out}")


def put(spark, root, part):
    spark.createDataFrame(part, STREAM).coalesce(1).write.mode("append").parquet(f"{root}/in")


def all_events(probs, keys):
    return sorted((k, *e) for k in keys for e in stream_rows(probs[k])[0])


def all_samples(probs, keys):
    return sorted((k, i, 1.0 + i if on else 0.0) for k in keys for i, on in enumerate(stream_rows(probs[k])[1]))


def test_stream_across_batches_and_restart(spark, probs):
    """Without waiting rows: files in order and one again; the state carries over, repeats are marked, a restart adds nothing."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    keys, rows = series(probs)

    def run():
        return streamed(spark, root, vad.speech_events, "events", hold=0), streamed(spark, root, vad.masked_samples, "mask", hold=0)

    put(spark, root, [r for r in rows if r[1] < 10])
    run()
    put(spark, root, [r for r in rows if 10 <= r[1] < 25])
    put(spark, root, [r for r in rows if r[1] < 10])
    run()
    put(spark, root, [r for r in rows if r[1] >= 25])
    for _ in range(2):
        events, mask = run()
        assert sorted((r["sid"], r["kind"], r["at"]) for r in events.where("kind <> 'late'").collect()) == all_events(probs, keys)
        assert sorted((r["sid"], r["pos"], r["x"]) for r in mask.where("NOT late").collect()) == all_samples(probs, keys)
        again = sorted((k, i) for k in keys for i in range(10))
        assert sorted((r["sid"], r["at"]) for r in events.where("kind = 'late'").collect()) == again
        assert sorted((r["sid"], r["pos"]) for r in mask.where("late").collect()) == again


@pytest.mark.parametrize("hold", [30, 4096])
def test_stream_of_files_newest_first(spark, probs, hold):
    """Rows wait for earlier ones; none is lost, and those left in the state are put out at the end."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    keys, rows = series(probs)
    for low, high in ((20, 1 << 40), (10, 20), (0, 10)):
        part = [r for r in rows if low <= r[1] < high and r[1] < 30]
        put(spark, root, part + part[:1])
        events, mask = streamed(spark, root, vad.speech_events, "events", hold=hold), streamed(spark, root, vad.masked_samples, "mask", hold=hold)
    put(spark, root, [r for r in rows if r[1] >= 30] or rows[:1])
    events, mask = streamed(spark, root, vad.speech_events, "events", hold=hold), streamed(spark, root, vad.masked_samples, "mask", hold=hold)
    events, mask = events.unionByName(vad.events_left(spark, f"{root}/events")), mask.unionByName(vad.samples_left(spark, f"{root}/mask"))
    assert sorted((r["sid"], r["kind"], r["at"]) for r in events.collect()) == all_events(probs, keys)
    assert sorted((r["sid"], r["pos"], r["x"]) for r in mask.collect()) == all_samples(probs, keys)
    assert mask.where("late").isEmpty()


def test_ingest_keeps_late_first_arrivals(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for hour in (9, 5, 1, 9):
        rows = spark.range(hour * 10, hour * 10 + 10).selectExpr("id AS event_id", f"TIMESTAMP_NTZ'2024-01-0{hour} 00:00:00' AS ts")
        rows = rows.selectExpr("*", "event_id % 3 AS user_id", "'a' AS event_type", "1D AS value", "'' AS props")
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        out = ingest.drain(ingest.once(ingest.watch(spark, f"{root}/in", files_per_batch=1)), f"{root}/out")
    assert sorted(r["event_id"] for r in out.collect()) == sorted(i for h in (1, 5, 9) for i in range(h * 10, h * 10 + 10))
