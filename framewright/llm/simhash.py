"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from collections.abc import Iterator
from pyspark.sql import DataFrame, functions as F, Window as W
from pyspark.sql.functions import arrow_udf

from framewright.llm.common import process_cache
from framewright.llm.graph import components
from framewright.session import cut


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the `words`-word shingles of `text`, repeats included, as a signed integer.

    Words are split at ASCII white space and A-Z are lower-cased. Fewer words make one shingle; no word (or null) gives 0.
    A bit is set if it is set in over half of the XXH64 values (seed 42, as Spark's own function has).
    """
    parts = text.encode().lower().split() if text else []
    n = len(parts)
    if not n:
        return 0
    flat = b" ".join(parts)
    if n <= words:
        values = [xxhash.xxh64_intdigest(flat, 42)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        values = [digest(flat[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist())]
    raw = np.array(values, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(words: int):
    @arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        process_cache("fingerprints")
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), words) for t in batch], pa.int64())

    return run


def ball_links(prints: DataFrame, fp: str, radius: int = 2) -> DataFrame:
    """Edges (fp, to) that connect every pair of distinct fingerprints at most `radius` (even) bits apart.

    Every fingerprint is sent to each variant within half the radius; two within the radius share one. All members of a
    variant's group are within half the radius of it, so within the radius of one another: the group is complete, it can
    hold no more members than the ball has variants (65 for radius 2), and links to its smallest member connect it.
    Links are made distinct and verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even")
    masks = [sum(1 << i for i in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    signed = ",".join(f"{m - (1 << 64) if m >> 63 else m}L" if m != 1 << 63 else "shiftleft(1L, 63)" for m in masks)
    balls = prints.select(F.col(fp).alias("fp"), F.explode(F.expr(f"transform(array({signed}), m -> `{fp}` ^ m)")).alias("variant"))
    return (
        balls.select("fp", F.min("fp").over(W.partitionBy("variant")).alias("to"))
        .where("fp <> to")
        .where(F.expr(f"bit_count(fp ^ to) <= {radius}"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every row of `docs` (doc_id, text).

    Rows link when their fingerprints differ in at most `radius` bits; component_id is the smallest non-null doc_id reachable.
    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows stay and share their component.
    Other columns of `docs` are ignored. No rows give no rows. text_key is the hash of the text.
    """
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprints(words)("text").alias("fp")))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = components(ball_links(firsts, "fp", radius), "fp", "to")
    known = firsts.join(groups, firsts["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.where("root <> fp").select("fp", "root").join(lowest, "root").select("fp", "component_id")
    own = lowest.select(F.col("root").alias("fp"), "component_id")
    return rows.join(named.unionByName(own), "fp").select("doc_id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """`docs` with one row per near-duplicate group: the one with the smallest doc_id (a null id counts as the largest).

    Of repeated rows with that id one stays, the smallest text first. All columns are kept.
    """
    groups = near_duplicates(docs, words, radius)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), F.col("fp").cast("string")))
    best = groups.groupBy(group.alias("g")).agg(F.min(rank).alias("best"))
    same = groups.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    keep = best.select(F.col("best.doc_id").alias("k_id"), F.col("best.text_key").alias("k_key"))
    keep = cut(keep.join(same, F.col("k_id").eqNullSafe(same["doc_id"]) & (F.col("k_key") == same["text_key"])).select("k_id", "k_key", "times"))
    d, k = docs.alias("d"), keep.alias("k")
    on = F.col("d.doc_id").eqNullSafe(F.col("k.k_id")) & (F.xxhash64("d.text") == F.col("k.k_key"))
    single = d.join(k.where("times = 1"), on, "left_semi")
    if keep.where("times > 1").isEmpty():
        return single
    many = d.join(k.where("times > 1"), on, "left_semi")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = many.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(columns, F.to_json(columns)).alias("row")).select("row.*")
    return single.unionByName(one)
