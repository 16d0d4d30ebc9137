"""Spark data source for folders of 16-bit mono WAV files: a long recording is read by many tasks, many short ones by one.

`spark.read.format("pcm16").load(root)` gives speaker, utt, rate, idx and x of every `root/<speaker>/<utt>.wav` and of every
`root/<utt>.wav`, whose speaker is the root's own name. Rows with a header's worth of facts are written back with
`df.write.format("pcm16").mode("append").save(root)`.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from framewright.operators.blocks import with_group
from framewright.sources.pcm import SCALES

#: Bytes of WAV files that make a partition unless the reader's `bytes` option says otherwise; samples of an output batch.
PARTITION_BYTES, BATCH_SAMPLES = 32 << 20, 1 << 18
WRITTEN = ["speaker", "utt", "rate", "n", "idx", "level"]


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a URI, or of a local path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def header(file: pa.NativeFile, size: int) -> tuple[int, int, int]:
    """(rate, first byte of the samples, bytes of samples) of an open WAV file; anything but mono 16-bit PCM is an error."""
    if file.read_at(12, 0)[:4] != b"RIFF":
        raise ValueError("not a RIFF file")
    at, rate = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
            if (channels, bits) != (1, 16) or kind not in (1, 0xFFFE):
                raise ValueError("only mono 16-bit PCM is supported")
        if name == b"data":
            if rate is None:
                raise ValueError("the samples come before their format")
            return rate, at + 8, min(length, size - at - 8) // 2 * 2
        at += 8 + length + length % 2
    raise ValueError("the file has no samples")


@dataclass
class Ranges(InputPartition):
    """(path, file size, first byte, end) of the stretches that one task reads."""

    parts: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.scale = options["path"], SCALES[options.get("use", "train")]
        self.bytes = int(options.get("bytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Stretches of at most `bytes`, by the sizes in the listing alone; no file is opened here."""
        files, root = located(self.path)
        root = root.rstrip("/")
        found, held, room = [], [], self.bytes
        for info in sorted(files.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            inside = info.path[len(root) :].strip("/").split("/")
            if info.type != pafs.FileType.File or not inside[-1].endswith(".wav") or inside[-1].startswith(".") or len(inside) > 2:
                continue
            for start in range(0, info.size, self.bytes):
                end = min(info.size, start + self.bytes)
                if held and end - start > room:
                    found.append(Ranges(held))
                    held, room = [], self.bytes
                held.append((info.path, info.size, start, end))
                room -= end - start
        return [*found, Ranges(held)] if held else found or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.path)
        for path, size, low, high in partition.parts:
            with files.open_input_file(path) as file:
                rate, begin, length = header(file, size)
                first, end = (min(max(0, at - begin + 1), length) // 2 for at in (low, high))
                speaker, utt = posixpath.basename(posixpath.dirname(path)), posixpath.basename(path)[:-4]
                for at in range(first, end, BATCH_SAMPLES):
                    n = min(BATCH_SAMPLES, end - at)
                    levels = np.frombuffer(file.read_at(2 * n, begin + 2 * at), "<i2")
                    same = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [same(speaker, pa.string()), same(utt, pa.string()), same(rate, pa.int32()), pa.array(np.arange(at, at + n)), pa.array((levels / self.scale).astype(np.float32))],
                        names=["speaker", "utt", "rate", "idx", "x"],
                    )


class WavWriter(DataSourceArrowWriter):
    """Writes the rows of a task, which come in order and with whole utterances, one file each. A file gets its name when it is whole."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = located(self.path)
        state = {"key": None, "out": None, "part": "", "left": 0}

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                if state["left"]:
                    files.delete_file(state["part"])
                    raise ValueError(f"{state['key']}: {state['left']} samples are missing")
                folder = posixpath.join(root, state["key"][0])
                files.move(state["part"], posixpath.join(folder, state["key"][1] + ".wav"))
                state["out"] = None

        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                speakers, utts = table["speaker"].to_pylist(), table["utt"].to_pylist()
                rates, totals = table["rate"].to_pylist(), table["n"].to_pylist()
                levels = table["level"].to_numpy().astype("<i2")
                at = 0
                while at < len(levels):
                    key, end = (speakers[at], utts[at]), at
                    while end < len(levels) and (speakers[end], utts[end]) == key:
                        end += 1
                    if key != state["key"] or state["out"] is None:
                        close()
                        folder, size = posixpath.join(root, key[0]), 2 * totals[at]
                        files.create_dir(folder, recursive=True)
                        part = posixpath.join(folder, f".{key[1]}.{uuid.uuid4().hex}")
                        state.update(key=key, out=files.open_output_stream(part), part=part, left=totals[at])
                        state["out"].write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, rates[at], 2 * rates[at], 2, 16, b"data", size))
                    state["out"].write(levels[at:end].tobytes())
                    state["left"] -= end - at
                    at = end
            close()
        except Exception:
            if state["out"] is not None:
                state["out"].close()
                files.delete_file(state["part"])
            raise
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        """Every file is in its place already."""

    def abort(self, messages) -> None:
        """Files that are whole stay, as they would be written alike again."""


class Wav(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm16"

    def schema(self) -> str:
        return "speaker string, utt string, rate int, idx bigint, x float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or schema.names != WRITTEN:
            raise ValueError(f"give the columns {', '.join(WRITTEN)}, and append")
        return WavWriter(dict(self.options))


def read_wavs(spark: SparkSession, root: str, use: str = "train", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """speaker, utt, rate, idx, x of the WAV files of a corpus, scaled by 1/32768 for training or 1/32767 for pitch."""
    spark.dataSource.register(Wav)
    return spark.read.format("pcm16").option("use", use).option("bytes", partition_bytes).load(root)


def write_wavs(rows: DataFrame, root: str, rate: int) -> None:
    """Write speaker, utt, idx, level (16 bits) as one file per utterance. An empty speaker names files directly under the root."""
    rows.sparkSession.dataSource.register(Wav)
    sized = with_group(rows.select("speaker", "utt", "idx", F.col("level").cast("int").alias("level")), ["speaker", "utt"], n=F.count(F.lit(1)))
    whole = sized.withColumn("rate", F.lit(rate)).repartition("speaker", "utt").sortWithinPartitions("speaker", "utt", "idx")
    whole.select(*WRITTEN).write.format("pcm16").mode("append").save(root)
