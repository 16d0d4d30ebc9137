"""Masking and padded batches of frame series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from framewright.functions.noise import digest, uniform
from framewright.operators.blocks import hashed_ordinal, running, stretched, with_group
from framewright.session import cut


def span_mask(rows: DataFrame, keys: list[str], idx: str, share: float, length: int, seed, min_masks: int = 0) -> DataFrame:
    """Mark random spans of `length` rows: about `share` of each key, starts distinct and never past the end.

    The number of spans is `share · n / length` rounded up or down at random, at least `min_masks`, and falls back to
    the whole spans that fit if they would not fit.
    """
    rows = cut(rows)
    sized = with_group(rows, keys, _n=F.count(F.lit(1)))
    wanted = F.greatest(F.floor(share * F.col("_n") / length + uniform(seed, *keys)), F.lit(min_masks))
    spans = F.when(wanted * length > F.col("_n"), F.expr(f"_n div {length}")).otherwise(wanted)
    starts = sized.where(F.col(idx) <= F.col("_n") - length).select(*keys, idx, spans.alias("_k"), digest(seed, *keys, idx).alias("_h"))
    picked = hashed_ordinal(cut(starts), keys, "_h", idx, "_place").where(F.col("_place") < F.col("_k"))
    masked = picked.select(*keys, F.explode(F.expr(f"sequence(`{idx}`, `{idx}` + {length - 1})")).alias(idx)).distinct()
    return rows.join(masked.withColumn("masked", F.lit(True)), [*keys, idx], "left").withColumn(
        "masked", F.coalesce("masked", F.lit(False))
    )


def collate_pad(rows: DataFrame, batch: str, item: str, idx: str, x: str) -> DataFrame:
    """Zero-pad every item of a batch to the longest one, items ordered by falling length.

    `rows` has batch, item, idx, x, with idx dense from 0. Items keep all of their rows; limit lengths before, if need be. Padding is
    made block by block, so that no row holds more than 65,536 positions.
    """
    items = rows.groupBy(batch, item).agg(F.count(F.lit(1)).alias("length"))
    order = W.partitionBy(batch).orderBy(F.desc("length"), item)
    placed = with_group(items, [batch], _top=F.max("length")).withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
    short = placed.where(F.col("length") < F.col("_top"))
    zeros = stretched(short, "length", "_top - 1", idx).select(batch, item, "pos", "length", idx, F.lit(0.0).alias(x))
    data = rows.join(placed.drop("_top"), [batch, item]).select(batch, item, "pos", "length", idx, x)
    return data.unionByName(zeros)


def alignment_path(rows: DataFrame, keys: list[str], token: str, duration: str, batch: str) -> DataFrame:
    """Frames of each token laid end to end by duration, padded to the longest item of the batch.

    Columns: keys, frame, token (missing on padding), valid. `token` is an integer that orders the tokens of a key.
    """
    started = running(rows, keys, token, {"_start": ("sum", F.col(duration), "before")})
    frames = stretched(started, "_start", f"_start + `{duration}` - 1", "frame").select(*keys, "frame", F.col(token).cast("bigint").alias("token"))
    lengths = rows.groupBy(*keys, batch).agg(F.sum(duration).alias("_n"))
    short = with_group(lengths, [batch], _top=F.max("_n")).where(F.col("_n") < F.col("_top"))
    padding = stretched(short, "_n", "_top - 1", "frame").select(*keys, "frame", F.lit(None).cast("bigint").alias("token"))
    return frames.unionByName(padding).withColumn("valid", F.col("token").isNotNull())
