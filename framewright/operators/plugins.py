"""Extension points: user models over batches, vector transforms by name, frames as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udtf

from framewright.operators.retrieval import compress


def apply_model(df: DataFrame, make_model: Callable, schema: str) -> DataFrame:
    """Run a model over Arrow batches. `make_model` is called once per task; it returns a pandas → pandas function."""

    def run(batches):
        model = make_model()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


TRANSFORMS = {
    "identity": lambda v, keys, **o: v.select(*keys, "vec_id", "v"),
    "compress": lambda v, keys, **o: compress(v, keys, **{**o, "threshold": 0}),
    "conditional": lambda v, keys, **o: compress(v, keys, **o),
}


def transform_vectors(vectors: DataFrame, keys: list[str], name: str, **options) -> DataFrame:
    """Vectors of each group as they are, compressed, or compressed only above a size."""
    return TRANSFORMS[name](vectors, keys, **options)


#: Rows that one output batch of `frames` holds at most.
FRAME_ROWS = 1 << 16


@arrow_udtf(returnType="id bigint, frame bigint, offset bigint, x double")
class Frames:
    """`frames(TABLE(SELECT id, v, size, hop ...))`: every whole frame of the array of each row. Batches of frames are views of the arrays."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for name, row, length, step in zip(*[batch.column(c) for c in ("id", "v", "size", "hop")]):
            length, step = length.as_py(), step.as_py()
            if not row.is_valid or len(row.values) < length:
                continue
            line = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            views = np.lib.stride_tricks.sliding_window_view(line, length)[::step]
            some = max(1, FRAME_ROWS // length)
            for at in range(0, len(views), some):
                part = views[at : at + some]
                frame = np.repeat(np.arange(at, at + len(part)), length)
                offset = np.tile(np.arange(length), len(part))
                same = pa.array([name.as_py()], pa.int64()).take(pa.array(np.zeros(part.size, np.int64)))
                yield pa.table({"id": same, "frame": frame, "offset": offset, "x": part.reshape(-1)})
