"""Files on disk: audio, manifests, pitch tables, transcripts."""

import math
import os
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import manifest as M
from framewright.sources import catalog, filelists as FL, pcm, transcripts as TR


@pytest.fixture(scope="module")
def corpus():
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    levels = {
        ("ann", "sine"): [int(20000 * math.sin(2 * math.pi * 220 * i / 16000)) for i in range(1600)],
        ("ann", "silence"): [0] * 800,
        ("bob", "short"): [1, -1, 32767, -32768],
        ("bob", "square"): [32767 if i // 10 % 2 else -32768 for i in range(400)],
    }
    for (speaker, utt), samples in levels.items():
        os.makedirs(f"{root}/{speaker}", exist_ok=True)
        with wave.open(f"{root}/{speaker}/{utt}.wav", "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes(np.asarray(samples, "<i2").tobytes())
    np.save(f"{root}/ann/sine.vec.npy", np.arange(12, dtype=np.float32).reshape(3, 4))
    open(f"{root}/ann/notes.txt", "w").close()
    return root, levels


def test_scan_and_decode(spark, corpus):
    root, levels = corpus
    assert {(r["speaker"], r["utt"]) for r in catalog.scan_corpus(spark, root).collect()} == set(levels)
    for use, scale in pcm.SCALES.items():
        got = {(r["speaker"], r["utt"]): r for r in pcm.read_corpus(spark, root, use).collect()}
        for k, v in levels.items():
            assert got[k]["rate"] == 16000
            assert got[k]["samples"] == pytest.approx([s / scale for s in v], abs=1e-6)


def test_features_and_pending(spark, corpus):
    root, _ = corpus
    rows = pcm.read_npy(spark, root, ".vec.npy").orderBy("frame").collect()
    assert [(r["speaker"], r["utt"], r["frame"]) for r in rows] == [("ann", "sine", i) for i in range(3)]
    assert rows[1]["v"] == [4.0, 5.0, 6.0, 7.0]
    todo = catalog.pending(catalog.scan_corpus(spark, root), pcm.read_npy(spark, root, ".vec.npy"), ["speaker", "utt"])
    assert todo.count() == 3


def test_filelists_round_trip(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/lists"
    rows = spark.range(25).select("id", *[F.concat(F.lit(f"{f}/"), F.col("id").cast("string")).alias(f) for f in FL.FIELDS])
    FL.write_filelists(M.holdout_split(rows, "id", 10), path)
    valid, train = FL.read_filelist(spark, f"{path}/valid"), FL.read_filelist(spark, f"{path}/train")
    assert (valid.count(), train.count()) == (10, 15)
    both = sorted(tuple(r) for r in valid.unionByName(train).collect())
    assert both == sorted(tuple(r)[1:] for r in rows.collect())
    lines = [open(f"{path}/valid/{p}").read().split() for p in sorted(os.listdir(f"{path}/valid")) if p.startswith("part")]
    flat = [x for part in lines for x in part]
    assert flat == sorted(flat)


def test_pitch_lines(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 99.9), (6123, 440.5)], "idx bigint, f0 double")
    lines = df.select(FL.pitch_line().alias("l"), FL.pitch_of_line(FL.pitch_line()).alias("v")).collect()
    assert [r["l"] for r in lines] == ["0m 0s   0,0", "0m 0s  10,99", "1m 1s 230,440"]
    assert [r["v"] for r in lines] == [0, 99, 440]


def test_json_with_comments(spark):
    texts = ['{"k": 1}', '{"k": 2 // two\n}', '{"k": \\\n 3}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(FL.parse_json(F.col("t"), "k BIGINT")["k"]).collect()] == [1, 2, 3]


def test_transcript_files(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/subs"
    segs = spark.createDataFrame([("a", 0, 0.0, 1.5, " hi --> you "), ("a", 1, 2.0, 3.0, "x\ty")], "audio string, seg_no bigint, start_s double, end_s double, text string")
    TR.write_transcripts(segs, "all", path, files=1)
    read = lambda f: "".join(open(f"{path}/format={f}/audio=a/{p}").read() for p in os.listdir(f"{path}/format={f}/audio=a") if p.startswith("part"))
    assert read("vtt") == "WEBVTT\n\n00:00.000 --> 00:01.500\nhi -> you\n\n00:02.000 --> 00:03.000\nx\ty\n\n"
    assert read("srt").startswith("1\n00:00:00,000 --> 00:00:01,500\nhi -> you\n\n2\n")
    assert read("tsv") == "start\tend\ttext\n0\t1500\thi --> you\n2000\t3000\tx y\n"
    assert read("txt") == "hi --> you\nx\ty\n"
    import json

    assert [s["text"] for s in json.loads(read("json").replace('"audio":a', '"audio":"a"'))["segments"]] == [" hi --> you ", "x\ty"]
