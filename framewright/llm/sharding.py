"""Shards by vector bin packing: bytes, tokens and rows are balanced together."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from framewright.session import cut

#: A group that takes more than 1/HEAVY of a shard in any dimension is placed first, one of more than 1/SPLIT is cut; cells hold about CELL groups.
HEAVY, SPLIT, CELL, MAX_CELLS, BLOCK_ROWS = 20, 4, 16_384, 4096, 50_000
SIZES = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, room: np.ndarray, first: int = 0) -> np.ndarray:
    """Shard of every item (rows of sizes), largest first, each where its dot product with the residual room is highest.

    Sizes count relative to their total; ties go to the next shard from `first` on. `room` is
    changed to what is left.
    """
    scale = 1 / np.maximum(items.sum(axis=0), 1e-300)
    order = np.lexsort((np.arange(len(items)), -(items * scale).max(axis=1)))
    place = np.empty(len(items), np.int32)
    left = np.roll(room * scale, -first, axis=0)
    for i in order:
        item = items[i] * scale
        place[i] = s = int(np.argmax(left @ item))
        left[s] -= item
    room[:] = np.roll(left, first, axis=0) / scale
    return (place + first) % len(room)


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of `docs` (doc_id, text).

    Rows of equal text are one group and stay together, unless they would take more than a quarter of a shard; such a group is
    cut by the hash of its doc_ids into parts of about that size. At most 3 * 20 * `shards` groups can be larger than a twentieth of a shard, so
    their list is small whatever the table. They are placed first; all others are dealt to cells by hash, and every cell packs its own groups
    into its share of the room that is left in each shard, in parallel. Slots number the rows of a shard from 0, by
    cell and block, with one running total over the counts of blocks.

    Bytes are the size (UTF-8 length plus 16), tokens the spaces plus one. A null text has size 16, no tokens and CRC 0, and is a
    group of its own; repeated rows get a slot each; no rows give none; other columns are ignored.
    """
    key = F.when(F.col("text").isNotNull(), F.md5("text"))
    rows = cut(
        docs.select(
            "doc_id",
            F.coalesce(key, F.lit("")).alias("key"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
            F.coalesce(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1, F.lit(0)).cast("bigint").alias("tokens"),
        )
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES], F.count(F.lit(1)).alias("n")).first()
    limit = {c: max(1.0, total[c] / (shards * HEAVY)) for c in SIZES}
    share = F.greatest(*[F.col(c) / F.lit(limit[c]) for c in SIZES])
    spark = docs.sparkSession
    heavy = groups.where(share > 1).where("rows > 1 OR bytes > 0").select("key", F.least(F.ceil(share * SPLIT / HEAVY), F.col("rows")).cast("int").alias("parts"))
    heavy = F.broadcast(cut(heavy))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")).cast("int")
    big = (
        rows.join(heavy, "key")
        .groupBy("key", part.alias("part"))
        .agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
        .toPandas()
        .sort_values(["key", "part"])
    )
    whole = np.array([[total[c] for c in SIZES]], float)
    room = np.repeat(whole / shards, shards, axis=0)
    big["shard"] = pack(big[list(SIZES)].to_numpy(float), room) if len(big) else pd.Series(dtype="int32")
    rest = np.maximum(room, 0)
    rest = rest / np.maximum(rest.sum(axis=0), 1e-300)
    cells = int(min(MAX_CELLS, max(1, total["n"] // CELL)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        items = pdf[list(SIZES)].to_numpy(float)
        return pd.DataFrame({"key": pdf["key"], "part": 0, "shard": pack(items, rest * items.sum(axis=0), int(pdf["cell"].iloc[0]) * 7 % shards), "cell": pdf["cell"], "blocks": -(-pdf["rows"] // BLOCK_ROWS)})

    place = "key string, part int, shard int, cell int, blocks bigint"
    light = groups.join(heavy, "key", "left_anti").withColumn("cell", F.pmod(F.xxhash64("key", F.lit(6)), F.lit(cells)).cast("int"))
    placed = light.groupBy("cell").applyInPandas(fill, place)
    big = big.assign(cell=cells, blocks=-(-big["rows"] // BLOCK_ROWS))[["key", "part", "shard", "cell", "blocks"]]
    if len(big):
        placed = placed.unionByName(spark.createDataFrame(big, place))
    parted = rows.join(heavy, "key", "left").withColumn("part", F.coalesce(part, F.lit(0)))
    block = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks"))
    blocked = ["shard", "cell", "salt", "block"]
    salt = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key", "part"), F.lit(64))).otherwise(0)
    found = cut(parted.join(placed, ["key", "part"]).withColumn("block", block).withColumn("salt", salt).select("doc_id", "size", "text_crc32", *blocked))
    earlier = W.partitionBy("shard").orderBy("cell", "salt", "block").rowsBetween(W.unboundedPreceding, -1)
    counts = found.groupBy(*blocked).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*blocked, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = W.partitionBy(*blocked).orderBy("doc_id", "text_crc32")
    numbered = found.withColumn("r", F.row_number().over(within) - 1)
    return numbered.join(starts, blocked).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("r")).cast("bigint").alias("slot"))
