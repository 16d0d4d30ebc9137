"""Finished streams hold every window; batches are counted as they are made; frames come in bounded batches."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from framewright.operators import manifest as M, plugins as PL
from framewright.streaming import ingest


def test_windows_of_a_finished_input_are_whole_whatever_the_order_of_files(spark):
    folder, out = tempfile.mkdtemp(prefix="run-", dir="/tmp"), tempfile.mkdtemp(prefix="run-", dir="/tmp")
    begin = dt.datetime(2024, 1, 1)
    rows = [(i, begin + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2] if i % 11 else None, float(i), None) for i in range(120)]
    for n, part in enumerate((rows[80:], rows[40:80], rows[:40])):  # newest first
        spark.createDataFrame(part, ingest.EVENTS).coalesce(1).write.parquet(f"{folder}/{n}")
    events = spark.read.schema(ingest.EVENTS).option("recursiveFileLookup", True).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(map(repr, ingest.chunk_features(events, ["event_type"]).collect()))
    got = []
    for n in range(3):  # a file at a time, so that earlier windows are closed when the later files come
        stream = ingest.chunk_features(ingest.watch(spark, f"{folder}/*", files_per_batch=1), ["event_type"])
        if n == 0:
            assert ingest.finished_features(spark, out, spark.createDataFrame([], stream.schema), events, ["event_type"]).count() == len(want)
        got = ingest.finished_features(spark, out, ingest.drain(stream, out), events, ["event_type"]).collect()
    assert sorted(map(repr, got)) == want


def test_audit_counts_what_batches_hold(spark):
    items = spark.createDataFrame([(i, n) for i, n in enumerate([50, 101, 152, 160, 299, 301, 302, 500, 900, 201, 202])], "k bigint, n bigint")
    batches, audit = M.audited_batches(items, "k", "n", [150, 300, 450], 2, 2)
    row = audit.first().asDict()
    rows = batches.collect()
    assert (row["items"], row["too_short"], row["capped"], row["unbucketed"]) == (11, 1, 2, 1)
    assert row["slots"] == len(rows) and row["repeats"] == len(rows) - 9 and row["frames"] == sum(r["use"] for r in rows)
    assert row["batches"] == len({(r["bucket"], r["replica"], r["batch"]) for r in rows}) and len(rows) == 2 * row["batches"]
    assert row["padding"] == sum(r["length"] - r["use"] for r in rows)
    assert M.audited_batches(items.where("false"), "k", "n", [150, 300], 2, 2)[1].first()["slots"] == 0


def test_frames_of_arrays_of_any_length(spark):
    spark.udtf.register("frames", PL.Frames)
    rows = [(1, [float(i) for i in range(50_000)]), (2, [1.0] * 15), (3, None), (4, [float(i) for i in range(16)])]
    spark.createDataFrame(rows, "id bigint, v array<double>").createOrReplaceTempView("arrays")
    got = spark.sql("SELECT id, count(*) AS n, sum(x - frame * 8 - offset) AS off, max(frame) AS last FROM frames(TABLE(SELECT id, v, 16 AS size, 8 AS hop FROM arrays)) GROUP BY id")
    assert sorted(map(tuple, got.collect())) == [(1, 6249 * 16, 0.0, 6248), (4, 16, 0.0, 0)]


def test_salience_is_the_sum_over_sent_powers(spark):
    import random

    from framewright.operators import metrics as MT

    rng = random.Random(3)
    rows = [(k, b, rng.choice([None, rng.random()])) for k in range(30) for b in range(-2, 70) if rng.random() < 0.2]
    rows += [(None, 5, 1.0), (None, 5, 2.0)]
    weights = MT.harmonic_weights(100.0, 3, 0.8, 4)
    got = {(r["t"], r["bin"]): r["salience"] for r in MT.harmonic_sum(spark.createDataFrame(rows, "t bigint, bin bigint, power double"), ["t"], weights, 61).collect()}
    want = {}
    for t, b, p in rows:
        if p is not None and b >= 0:
            for o, w in weights.items():
                if 0 <= b - o < 61:
                    want[t, b - o] = want.get((t, b - o), 0.0) + p * w
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_held_out_keys_are_those_of_the_ranked_split(spark):
    items = spark.createDataFrame([(i,) for i in range(200)] + [(3,), (None,)], "k bigint").repartition(5)
    ranked = {r["k"] for r in M.holdout_split(items.where("k IS NOT NULL").distinct(), "k", 12, 5).where("split = 'valid'").collect()}
    got = M.held_out(items.where("k IS NOT NULL").distinct(), "k", 12, 5).where("split = 'valid'")
    assert {r["k"] for r in got.collect()} == ranked and got.count() == 12
    assert M.held_out(items, "k", 12, 5).count() == 202
