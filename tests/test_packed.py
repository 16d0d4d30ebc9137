"""Many texts in few files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from framewright.sources import filelists as FL, transcripts as TR
from framewright.sources.packed import Packed, read_packed, write_packed


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["folder"], r["item"], r["part"])):
        out[r["folder"], r["item"]] = out.get((r["folder"], r["item"]), "") + r["text"]
    return out


def test_ten_thousand_audios_make_few_files(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/subs"
    audios = spark.range(10_000).select(F.format_string("a%05d", "id").alias("audio"), F.explode(F.expr("sequence(0L, id % 3)")).alias("seg_no"))
    segments = audios.select("*", F.col("seg_no").cast("double").alias("start_s"), (F.col("seg_no") + 1.0).alias("end_s"), F.concat(F.lit("é "), "audio").alias("text"))
    TR.pack_transcripts(segments, "all", path, files=6)
    found = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs]
    assert len([f for f in found if f.endswith(".txt")]) <= 6 * 5 and len(found) <= 2 * 6 * 5
    assert not [f for f in found if os.path.basename(f).startswith(".") and not f.endswith(".crc")]
    texts = whole(read_packed(spark, path))
    assert len(texts) == 50_000
    assert texts["txt", "a00002"] == "é a00002\n" * 3 and texts["vtt", "a00003"] == "WEBVTT\n\n00:00.000 --> 00:01.000\né a00003\n\n"
    assert whole(read_packed(spark, path, "srt", "a09999")) == {("srt", "a09999"): texts["srt", "a09999"]}
    assert {f for f, _ in whole(read_packed(spark, path, "tsv"))} == {"tsv"}


def test_a_long_item_goes_on_in_other_entries_and_files(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/long"
    spark.dataSource.register(Packed)
    chunks = spark.range(3000).select(F.lit("x").alias("folder"), F.lit("one").alias("item"), F.col("id").alias("part"), F.format_string("line %05d\n…", "id").alias("chunk"))
    chunks.repartitionByRange(3, "part").sortWithinPartitions("part").write.format("packed_text").option("entry", 5000).mode("append").save(path)
    pieces = read_packed(spark, path)
    assert pieces.agg(F.max(F.octet_length("text"))).first()[0] < 5100 and pieces.count() > 6
    assert whole(pieces)["x", "one"] == "".join(f"line {i:05d}\n…\n" for i in range(3000))
    assert read_packed(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp")).count() == 0


def test_a_failing_task_leaves_no_files(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/bad"
    rows = spark.range(100).select(F.lit("x").alias("folder"), F.col("id").cast("string").alias("item"), "id", F.lit("t").alias("chunk"))
    bad = rows.select("folder", "item", F.col("id").alias("part"), F.expr("IF(id = 77, raise_error('stop'), chunk)").alias("chunk"))
    with pytest.raises(Exception, match="stop"):
        write_packed(bad, path, 4)
    assert not [f for _, _, fs in os.walk(path) for f in fs if f.endswith((".txt", ".idx"))]


def test_pitch_tables_in_few_files(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/pitch"
    track = spark.range(60).select((F.col("id") % 7).alias("sid"), F.expr("id div 7").alias("idx"), (F.col("id") * 1.5).alias("f0"))
    FL.pack_pitch(track, path, "sid", files=2)
    assert len(os.listdir(f"{path}/pitch")) <= 8
    lines = whole(read_packed(spark, path))["pitch", "3"].split("\n")[:-1]
    assert len(lines) == 9 and lines[1] == "0m 0s  10,15"
