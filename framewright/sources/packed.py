"""Spark data source for many small texts in few files: each file has a table of where its items lie.

`write_packed` puts chunks (folder, item, part, chunk) into at most one file per task and folder, a line end after every chunk,
and beside it the offsets. `read_packed` gives the texts back; one item is read by its offsets alone.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from framewright.sources.wav import located

#: Bytes from which an item goes on in another entry of the table, so that an entry is one row of bounded size.
ENTRY_BYTES = 4 << 20
WRITTEN = ["folder", "item", "part", "chunk"]


@dataclass
class Moves(WriterCommitMessage):
    """What a task wrote under temporary names, and the names it is to have."""

    files: list[tuple[str, str]] = field(default_factory=list)


class PackedWriter(DataSourceArrowWriter):
    """Rows of a task come in the order of folder, item and part. Files get their names when all tasks are done, or go."""

    def __init__(self, options: dict) -> None:
        self.path, self.entry = options["path"], int(options.get("entry", ENTRY_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = located(self.path)
        moves, out, table, at = Moves(), None, None, 0
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        folder = entry = None

        def end_entry() -> None:
            if entry is not None:
                table.write((json.dumps([entry["item"], entry["part"], entry["start"], at]) + "\n").encode())

        try:
            for batch in iterator:
                for where, item, part, chunk in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                    if where != folder:
                        end_entry()
                        if out is not None:
                            out.close(), table.close()
                        folder, entry, at = where, None, 0
                        files.create_dir(posixpath.join(root, where), recursive=True)
                        places = [(posixpath.join(root, where, f".{name}{kind}"), posixpath.join(root, where, f"{name}{kind}")) for kind in (".txt", ".idx")]
                        moves.files += places
                        out, table = (files.open_output_stream(p) for p, _ in places)
                    if entry is None or item != entry["item"] or at - entry["start"] >= self.entry:
                        end_entry()
                        entry = {"item": item, "part": part, "start": at}
                    line = f"{chunk}\n".encode()
                    out.write(line)
                    at += len(line)
            end_entry()
        except Exception:
            self.remove(files, out, table, moves)
            raise
        if out is not None:
            out.close(), table.close()
        return moves

    @staticmethod
    def remove(files: pafs.FileSystem, out, table, moves: Moves) -> None:
        for stream in (out, table):
            if stream is not None and not stream.closed:
                stream.close()
        for part, _ in moves.files:
            if files.get_file_info(part).type == pafs.FileType.File:
                files.delete_file(part)

    def commit(self, messages) -> None:
        files, _ = located(self.path)
        for message in messages:
            for part, whole in message.files if message else ():
                files.move(part, whole)

    def abort(self, messages) -> None:
        files, _ = located(self.path)
        for message in messages:
            if message:
                self.remove(files, None, None, message)


@dataclass
class PackedFile(InputPartition):
    folder: str
    path: str


class PackedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.folder, self.item = options["path"], options.get("folder"), options.get("item")

    def partitions(self) -> list[InputPartition]:
        files, root = located(self.path)
        root = root.rstrip("/")
        found = []
        for info in sorted(files.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            inside = info.path[len(root) :].strip("/").split("/")
            if len(inside) == 2 and inside[1].endswith(".idx") and not inside[1].startswith(".") and self.folder in (None, inside[0]):
                found.append(PackedFile(inside[0], info.path[: -len(".idx")]))
        return found or [PackedFile("", "")]

    def read(self, partition: PackedFile) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = located(self.path)
        with files.open_input_stream(f"{partition.path}.idx") as table, files.open_input_file(f"{partition.path}.txt") as texts:
            for line in table.read().decode().split("\n"):
                if line:
                    item, part, start, end = json.loads(line)
                    if self.item in (None, item):
                        yield partition.folder, item, part, texts.read_at(end - start, start).decode()


class Packed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_text"

    def schema(self) -> str:
        return "folder string, item string, part bigint, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or schema.names != WRITTEN:
            raise ValueError(f"give the columns {', '.join(WRITTEN)}, and append")
        return PackedWriter(dict(self.options))


def write_packed(chunks: DataFrame, path: str, files: int = 200) -> None:
    """Write (folder, item, part, chunk) to at most `files` files per folder, chunks of an item in the order of part."""
    chunks.sparkSession.dataSource.register(Packed)
    order = ["folder", "item", "part"]
    placed = chunks.select("folder", F.col("item").cast("string").alias("item"), F.col("part").cast("bigint").alias("part"), "chunk")
    placed = placed.repartitionByRange(files, *order).sortWithinPartitions(*order)
    placed.write.format("packed_text").mode("append").save(path)


def read_packed(spark: SparkSession, path: str, folder: str | None = None, item: str | None = None) -> DataFrame:
    """(folder, item, part, text): the texts of all items, of a folder's, or of one; `part` orders the pieces of a long one."""
    spark.dataSource.register(Packed)
    reader = spark.read.format("packed_text")
    for name, value in (("folder", folder), ("item", item)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(path)
