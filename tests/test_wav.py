"""WAV files written, listed and read in pieces."""

import os
import struct
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import catalog, wav


@pytest.fixture(scope="module")
def corpus(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/voices"
    rng = np.random.default_rng(1)
    levels = {("anna", "a b"): rng.integers(-32768, 32768, 5000), ("anna", "c"): rng.integers(-9, 9, 1), ("", "top"): rng.integers(-9, 9, 777), ("ben", "é"): rng.integers(-9, 9, 64)}
    rows = [(s, u, i, int(v)) for (s, u), vs in levels.items() for i, v in enumerate(vs)]
    wav.write_wavs(spark.createDataFrame(rows, "speaker string, utt string, idx bigint, level int").repartition(7), root, 16000)
    return root, levels


def test_written_files_are_plain_wav(corpus):
    root, levels = corpus
    for (speaker, utt), want in levels.items():
        with wave.open(os.path.join(root, speaker, f"{utt}.wav")) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, 16000)
            assert np.frombuffer(w.readframes(w.getnframes()), "<i2").tolist() == want.tolist()
    assert not [f for _, _, fs in os.walk(root) for f in fs if f.startswith(".") and not f.endswith(".crc")]


@pytest.mark.parametrize("size", [1, 7, 101, 4000, 1 << 20])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_every_sample_is_read_once_whatever_the_pieces(spark, corpus, size, scheme):
    root, levels = corpus
    if size == 1:
        levels, root = {k: v for k, v in levels.items() if k[0] == "ben"}, root + "/ben"
    df = wav.read_wavs(spark, scheme + root, "pitch", size)
    got = {}
    for r in df.collect():
        assert r["rate"] == 16000
        got.setdefault((r["speaker"], r["utt"]), {})[r["idx"]] = r["x"]
    assert sum(map(len, got.values())) == df.count() == sum(map(len, levels.values()))
    for (speaker, utt), want in levels.items():
        x = got[speaker or "voices", utt]
        assert np.allclose([x[i] for i in range(len(want))], want / 32767.0)


def test_long_recordings_are_many_tasks_and_short_ones_share_one(spark, corpus):
    assert wav.read_wavs(spark, corpus[0], partition_bytes=2000).rdd.getNumPartitions() >= 6
    assert wav.read_wavs(spark, corpus[0]).rdd.getNumPartitions() == 1
    assert wav.read_wavs(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp")).count() == 0


def test_files_under_the_root_are_listed(spark, corpus):
    got = sorted((r["speaker"], r["utt"]) for r in catalog.scan_corpus(spark, corpus[0]).collect())
    assert got == [("anna", "a b"), ("anna", "c"), ("ben", "é"), ("voices", "top")]


def test_other_chunks_are_passed_over_and_other_formats_refused(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    samples = np.arange(-5, 5, dtype="<i2").tobytes()
    fmt = lambda channels: struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, 8000, 16000, 2, 16)
    extra = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    data = struct.pack("<4sI", b"data", 0xFFFFFFFF) + samples
    with open(f"{root}/odd.wav", "wb") as f:
        f.write(b"RIFF\xff\xff\xff\xffWAVE" + extra + fmt(1) + extra + data)
    rows = wav.read_wavs(spark, root, partition_bytes=11).orderBy("idx").collect()
    assert [round(r["x"] * 32768) for r in rows] == list(range(-5, 5)) and rows[0]["rate"] == 8000
    with open(f"{root}/stereo.wav", "wb") as f:
        f.write(b"RIFF\xff\xff\xff\xffWAVE" + fmt(2) + data)
    with pytest.raises(Exception, match="mono"):
        wav.read_wavs(spark, root).agg(F.count("x")).collect()
