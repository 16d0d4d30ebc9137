"""Manifest lines, pitch tables as text, and JSON with comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framewright.functions.scalars import clock_label
from framewright.sources.packed import write_packed

# The fields of a manifest line, in order.
FIELDS = ["wave", "spec", "pitch", "hubert", "whisper", "spk"]


def manifest_line(fields: list[str] = FIELDS) -> Column:
    return F.concat_ws("|", *fields)


def split_line(line: Column, fields: list[str] = FIELDS) -> list[Column]:
    parts = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\|")
    return [F.get(parts, i).alias(name) for i, name in enumerate(fields)]


def read_filelist(spark: SparkSession, path: str, fields: list[str] = FIELDS) -> DataFrame:
    return spark.read.text(path).select(*split_line(F.col("value"), fields))


def write_filelists(manifest: DataFrame, path: str, fields: list[str] = FIELDS) -> None:
    """`manifest` has the fields, `split` and `position`: valid lines sorted by content, train lines in shuffled order."""
    line = manifest_line(fields).alias("value")
    manifest.where("split = 'valid'").select(line).orderBy("value").write.text(f"{path}/valid")
    manifest.where("split = 'train'").orderBy("position").select(line).write.text(f"{path}/train")


def pitch_line(frame: str = "idx", f0: str = "f0") -> Column:
    """A row of the pitch table for 10 ms frames; the pitch is truncated."""
    return clock_label(frame, F.col(f0))


def pitch_of_line(line: Column) -> Column:
    """Pitch in the last comma field, whatever the columns before it."""
    return F.trim(F.element_at(F.split(line, ","), -1)).cast("bigint")


def write_pitch(track: DataFrame, path: str, keys: list[str], frame: str = "idx", f0: str = "f0") -> None:
    lines = track.select(*keys, frame, pitch_line(frame, f0).alias("line"))
    lines.repartitionByRange(*keys, frame).sortWithinPartitions(*keys, frame).select(*keys, "line").write.partitionBy(
        *keys
    ).text(path)


def pack_pitch(track: DataFrame, path: str, key: str, frame: str = "idx", f0: str = "f0", files: int = 200) -> None:
    """The pitch tables of all series in few files, each with a table of where a series lies."""
    write_packed(track.select(F.lit("pitch").alias("folder"), F.col(key).alias("item"), F.col(frame).alias("part"), pitch_line(frame, f0).alias("chunk")), path, files)


def parse_json(text: Column, schema: str) -> Column:
    """Strict parse, then once more without line continuations and `//` comments."""
    relaxed = F.regexp_replace(F.regexp_replace(text, r"\\\n", ""), r"//.*\n", "\n")
    strict = F.try_parse_json(text)
    return F.from_json(F.when(strict.isNotNull(), text).otherwise(relaxed), schema)
