"""Transcript writers. A file is a table of (audio, part, chunk): its chunks in `part` order, one per line group.

No audio is gathered into one string, so a transcript of any length is written by as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions.text import format_timestamp, sanitise, strip
from framewright.operators.blocks import ORDINAL_SPAN, ordinal
from framewright.session import cut
from framewright.sources.packed import write_packed


def numbered(segments: DataFrame) -> DataFrame:
    """Adds `part`, counting an audio's segments from 1."""
    placed = ordinal(segments, ["audio"], ["seg_no"], F.expr(f"seg_no div {ORDINAL_SPAN}"), "_i")
    return placed.withColumn("part", F.col("_i") + 1).drop("_i")


def _span(always_hours: bool, mark: str):
    return F.concat_ws(" --> ", format_timestamp("start_s", always_hours, mark), format_timestamp("end_s", always_hours, mark))


def _item(columns: list[str]) -> Column:
    """One segment as JSON: start, end, text and whatever else it has."""
    known = ("audio", "part", "seg_no", "start_s", "end_s", "text")
    return F.to_json(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", *[F.col(f"`{n}`") for n in columns if n not in known]))


def _ms(seconds: str) -> Column:
    return F.expr(f"CAST(CAST(bround(1000D * {seconds}, 0) AS BIGINT) AS STRING)")


#: Per format the opening chunk of an audio, if it has one, and the chunk of a segment among such columns.
FORMATS = {
    "txt": (None, lambda columns: strip(F.col("text"))),
    "vtt": ("WEBVTT\n", lambda columns: F.concat(_span(False, "."), F.lit("\n"), sanitise(F.col("text"), arrow=True), F.lit("\n"))),
    "srt": (None, lambda columns: F.concat(
        F.col("part").cast("string"), F.lit("\n"), _span(True, ","), F.lit("\n"), sanitise(F.col("text"), arrow=True), F.lit("\n")
    )),
    "tsv": ("start\tend\ttext", lambda columns: F.concat_ws("\t", _ms("start_s"), _ms("end_s"), sanitise(F.col("text"), tab=True))),
    "json": ('{"audio":%,"segments":[', lambda columns: F.concat(F.when(F.col("part") > 1, ",").otherwise(""), _item(columns))),
}


def transcript(segments: DataFrame, output_format: str) -> DataFrame:
    """Chunks (audio, part, chunk) of one format, or of every format with a `format` column for "all".

    Segments are numbered once; an audio's first segment also gives its opening chunk (part 0), and JSON documents, of which every
    segment is an object with all of its columns, are closed by one more chunk per audio.
    """
    names = list(FORMATS) if output_format == "all" else [output_format]
    placed = numbered(segments)
    if "json" in names:
        placed = cut(placed)
    chunks = []
    for name in names:
        head, chunk = FORMATS[name]
        if head:
            opening = F.concat(*[F.lit(p) if p != "%" else F.col("audio").cast("string") for p in head.replace("%", "|%|").split("|")])
            chunks.append(F.when(F.col("part") == 1, _chunk(name, F.lit(0).cast("bigint"), opening)))
        chunks.append(_chunk(name, F.col("part"), chunk(segments.columns)))
    columns = ["audio", "e.part", "e.chunk", *(["e.format"] if output_format == "all" else [])]
    out = placed.select("audio", F.explode(F.array_compact(F.array(*chunks))).alias("e")).select(*columns)
    if "json" in names:
        ends = placed.groupBy("audio").agg((F.max("part") + 1).alias("part"))
        out = out.unionByName(ends.select("audio", "part", F.lit("]}").alias("chunk"), F.lit("json").alias("format")).select(*out.columns))
    return out


def _chunk(name: str, part: Column, chunk: Column) -> Column:
    return F.struct(F.lit(name).alias("format"), part.alias("part"), chunk.alias("chunk"))


def write_transcripts(segments: DataFrame, output_format: str, path: str, files: int = 200) -> None:
    """Text files under one folder per format; an audio's chunks lie in order, split over files if it is long."""
    chunks = transcript(segments, output_format)
    if "format" not in chunks.columns:
        chunks = chunks.withColumn("format", F.lit(output_format))
    placed = chunks.repartitionByRange(files, "format", "audio", "part").sortWithinPartitions("format", "audio", "part")
    placed.select("format", "audio", "chunk").write.partitionBy("format", "audio").text(path)


def pack_transcripts(segments: DataFrame, output_format: str, path: str, files: int = 200) -> None:
    """Few files per format, each with a table of where its audios lie; `read_packed(spark, path, format, audio)` reads one."""
    chunks = transcript(segments, output_format)
    if "format" not in chunks.columns:
        chunks = chunks.withColumn("format", F.lit(output_format))
    write_packed(chunks.select(F.col("format").alias("folder"), F.col("audio").alias("item"), "part", "chunk"), path, files)
