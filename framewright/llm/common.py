"""What the operators of this folder share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Rows that a Python worker gets at a time. Texts are long, and a worker holds a batch and what it makes of it.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; from then on the session sends rows to Python workers in batches of at most BATCH_ROWS."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """Reproducible fold of a row: the CRC-32 of its id as text. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))


def scan(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[dict]]]) -> DataFrame:
    """Run a Python function over the Arrow batches of `df`.

    `make()` is called once per task. What it returns gets the columns of a batch as lists and yields dictionaries of
    output columns; if it also has a `flush` attribute, that yields what is left at the end of the task.
    """
    spark = df.sparkSession
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        flush = getattr(work, "flush", None)

        def packed(columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

        for batch in batches:
            if batch.num_rows:
                for columns in work(*[c.to_pylist() for c in batch.columns]):
                    yield packed(columns)
        if flush:
            for columns in flush():
                yield packed(columns)

    return df.mapInArrow(run, schema)


def chunks(texts: list, size: int = 1 << 19) -> Iterator[list]:
    """Consecutive texts of about `size` characters together."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def process_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator; what it kept for another one goes.

    Functions are shipped by value, so a module of theirs would be new for each task.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if kept.get("owner") != owner:
        kept.update(owner=owner, things={})
    return kept["things"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name
