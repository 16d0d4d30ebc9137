"""Token ids in compressed blocks: every document is compressed alone, with a dictionary that all of them share.

A store is two Parquet tables: `dictionary` (one row: hash, bytes) and `blocks`. A block holds the documents of a stretch
of the id order: their ids, token counts, the byte offsets of their compressed arrays in the payload, the hash of the
dictionary and the tokens before the block in its part. One document is read from its block's row by its offset alone.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from framewright.llm.common import chunks, scan
from framewright.llm.word_ids import WordIds

BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Orders rows of one doc_id: the head of the text, then a hash of it, then the scan; a repeated id does not keep rows in one task.
HEAD = 64
BLOCK = "part int, block int, first_id bigint, last_id bigint, dict_hash string, before bigint, doc_ids array<bigint>, counts array<bigint>, offsets array<bigint>, payload binary"


def train_dictionary(docs: DataFrame, path: str, rows: int, size: int) -> bytes:
    """A dictionary of at most `size` bytes from the id arrays of about `rows` documents, picked by the hash of their text.

    Where the sample is too small to train on, its last bytes serve as the dictionary.
    """
    total = docs.count()
    step = max(1, total // max(rows, 1))
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").limit(4 * rows)

    def make():
        tokens = WordIds.kept(path, joined=True)

        def work(texts):
            for part in chunks(texts):
                yield {"ids": [i[: 1 << 14] for i in tokens.encode(part)]}

        return work

    samples = [bytes(r["ids"]) for r in scan(picked, "ids binary", make).collect() if r["ids"]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_token_files(docs: DataFrame, target: str, path: str, end_id: int, sample_rows: int = 1000, dictionary_bytes: int = 1 << 16) -> None:
    """Encode every text of `docs` (doc_id, text; a null text is empty) and write the store to `target`.

    Documents are in ascending doc_id order, null ids first, equal ids by the head of their text (null first) and a hash of it; each gets `end_id` at its end. The order is
    made by ranges, so every task encodes, compresses and writes its own stretch. `sample_rows` and `dictionary_bytes`
    bound what the dictionary is trained on and its size. No rows make an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    shared = train_dictionary(rows, path, sample_rows, dictionary_bytes)
    name = hashlib.sha256(shared).hexdigest()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        tokens = WordIds.kept(path, joined=True)
        known = zstandard.ZstdCompressionDict(shared) if shared else None
        press = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
        held = {"doc_ids": [], "counts": [], "payload": []}
        state = {"block": 0, "before": 0, "bytes": 0}

        def flush() -> Iterator[dict]:
            if held["doc_ids"]:
                sizes = [len(p) for p in held["payload"]]
                yield {
                    "part": [TaskContext.get().partitionId()], "block": [state["block"]],
                    "first_id": [next((i for i in held["doc_ids"] if i is not None), None)], "last_id": [held["doc_ids"][-1]], "dict_hash": [name], "before": [state["before"]],
                    "doc_ids": [list(held["doc_ids"])], "counts": [list(held["counts"])], "offsets": [[0, *np.cumsum(sizes).tolist()]], "payload": [b"".join(held["payload"])],
                }
                state["block"] += 1
                state["before"] += sum(held["counts"])
                state["bytes"] = 0
                for v in held.values():
                    v.clear()

        def work(ids, texts):
            at = 0
            for part in chunks(texts):
                for raw in tokens.encode(part):
                    held["doc_ids"].append(ids[at])
                    held["counts"].append(len(raw) // 4 + 1)
                    held["payload"].append(press.compress(raw + end))
                    state["bytes"] += len(held["payload"][-1])
                    at += 1
                    if len(held["counts"]) >= BLOCK_DOCS or state["bytes"] > BLOCK_BYTES:
                        yield from flush()

        work.flush = flush
        return work

    order = ["doc_id", "head", "hash", "row"]
    marked = rows.select("*", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    scan(ordered.select("doc_id", "text"), BLOCK, make).write.parquet(f"{target}/blocks")
    spark.createDataFrame([(name, bytearray(shared))], "hash string, bytes binary").write.parquet(f"{target}/dictionary")


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a store; start counts the tokens of all documents before it.

    One total per part is broadcast: as many rows as there were writing tasks.
    """
    blocks = spark.read.parquet(f"{target}/blocks")
    name, shared = spark.read.parquet(f"{target}/dictionary").first()
    totals = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(counts, 0L, (a, c) -> a + c)")).alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return scan(
        blocks.join(F.broadcast(starts), "part").select("dict_hash", (F.col("offset") + F.col("before")).alias("start"), "doc_ids", "counts", "offsets", "payload"),
        "doc_id bigint, start bigint, n_tokens bigint, ids binary",
        lambda: _unpacker(name, bytes(shared)),
    )


def _unpacker(name: str, shared: bytes):
    known = zstandard.ZstdCompressionDict(shared) if shared else None
    unpress = zstandard.ZstdDecompressor(dict_data=known)

    def work(hashes, starts, doc_ids, counts, offsets, payloads):
        for own, start, ids, ns, cuts, data in zip(hashes, starts, doc_ids, counts, offsets, payloads):
            if own != name:
                raise ValueError(f"the block was written with dictionary {own}, the store has {name}")
            arrays = [unpress.decompress(data[a:b]) for a, b in zip(cuts, cuts[1:])]
            if [len(a) // 4 for a in arrays] != list(ns):
                raise ValueError("a block does not hold the tokens it lists")
            yield {"doc_id": ids, "start": (np.cumsum([0, *ns[:-1]]) + start).tolist(), "n_tokens": ns, "ids": arrays}

    return work


def read_document(spark: SparkSession, target: str, doc_id: int) -> list[np.ndarray]:
    """The arrays of the documents with this id, each decompressed alone from its slice of its block; only blocks whose ids reach round it are read."""
    name, shared = spark.read.parquet(f"{target}/dictionary").first()
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(shared)) if shared else None)
    blocks = spark.read.parquet(f"{target}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    found = blocks.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("doc_ids"))))
    piece = F.expr("substring(payload, CAST(offsets[at - 1] AS INT) + 1, CAST(offsets[at] - offsets[at - 1] AS INT))")
    rows = found.where(F.expr("doc_ids[at - 1]") == doc_id).select(piece.alias("data")).collect()
    return [np.frombuffer(unpress.decompress(bytes(r["data"])), "<u4") for r in rows]
