"""Resampling towards a target text: hashed word features, a gain per bucket, and the best noisy scores by distributed quickselect."""

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.common import scan
from framewright.operators.blocks import ordinal
from framewright.session import cut

BUCKETS, LEAST_WORDS, PERCENT, SEED, PIVOTS = 10_000, 20, 25, 7, 16
#: Bytes as they count in a word: A-Z as a-z; digits, a-z and everything beyond ASCII as they are; the rest separates words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str | None, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every word and every pair of neighbours joined by a space), repeats included."""
    words = text.encode().translate(LETTERS).split() if text else []
    single = list(map(crc32, words))
    pairs = list(map(crc32, [b" " + w for w in words[1:]], single))  # the checksum goes on where that of the first word ends
    return len(words), np.array(single + pairs, np.int64) % buckets


def totals(docs: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: one array per task, added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found += np.bincount(features(text.as_py(), buckets)[1], minlength=buckets) if text.is_valid else 0
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of the smoothed shares of every bucket in target and source, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every document: the mean gain of its features, rounded down."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(rows, ids, texts):
            out = {"row": rows, "doc_id": ids, "n_words": [], "n_features": [], "weight": []}
            for text in texts:
                n, found = features(text, len(gain))
                out["n_words"].append(n)
                out["n_features"].append(len(found))
                out["weight"].append(int(gain[found].sum()) // len(found) if len(found) else 0)
            yield out

        return work

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return scan(rows, f"row bigint, doc_id {kind}, n_words bigint, n_features bigint, weight bigint", make)


def noise(doc_id: str, seed: int) -> Column:
    """Thousandfold Gumbel noise of a document, rounded down, from the digest of the seed and its id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def quickselect(rows: DataFrame, columns: list[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (from 1) distinct key of `columns`, in which null comes before everything else; None without such a row.

    Every round picks some random keys among those still possible and counts, in one aggregation over these, how many are
    below each and how many equal it; that leaves the stretch between two pivots, or finds the key. `columns` must tell rows apart.
    """
    key = F.struct(*columns)
    schema = rows.select(*columns).schema
    low = high = None
    below = 0  # rows at or under `low`

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, schema.fields)])

    for turn in range(10_000):
        left = rows.select(*columns)
        if low is not None:
            left = left.where((F.col(columns[0]) >= low[0]) & (key > literal(low)))
        if high is not None:
            left = left.where((F.col(columns[0]) <= high[0]) & (key < literal(high)))
        picked = [tuple(r) for r in left.orderBy(F.xxhash64(*columns, F.lit(turn))).limit(pivots).collect()]
        if not picked:
            return None
        order = lambda t: tuple((v is not None, v) for v in t)
        picked.sort(key=order)
        parts = [c for i, p in enumerate(picked) for c in (F.count_if(key < literal(p)).alias(f"l{i}"), F.count_if(key == literal(p)).alias(f"e{i}"))]
        found = left.agg(*parts).first()
        before = below
        for i, p in enumerate(picked):
            less, same = before + found[f"l{i}"], found[f"e{i}"]
            if less < k <= less + same:
                return p
            if less + same < k:
                low, below = p, less + same
            else:
                high = p
                break
    raise RuntimeError("the keys do not tell rows apart")


def draw(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of `docs` (doc_id, text): the draw towards the texts of `target`.

    Words are runs of digits, letters and what lies beyond ASCII, A-Z as a-z; features are single words and pairs of neighbours,
    hashed into `buckets`. The weight is the mean gain of a document's features, the score that plus Gumbel noise. Of the
    documents with at least `least_words` words, `percent` in a hundred with the highest scores are drawn, ties to the smaller id, null ids
    last, then in order of the scan; they are ranked from 1, the rest has no rank. Null and wordless texts have no features
    and weight 0; repeated rows are drawn each for itself; an empty target has equal counts in all buckets; no rows give none; other columns are ignored.
    """
    gain = gains(totals(docs, buckets), totals(target, buckets))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = cut(scored.select("*", (-F.col("score")).alias("place"), F.col("doc_id").isNull().alias("no_id")))
    fit = scored.where(F.col("n_words") >= least_words)
    wanted = percent * fit.count() // 100
    key = ["place", "no_id", "doc_id", "row"]
    last = quickselect(fit, key, wanted) if wanted else None
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    bound = F.struct(*[F.lit(v).cast(scored.schema[c].dataType).alias(c) for v, c in zip(last, key)])
    drawn = (F.col("n_words") >= least_words) & (F.struct(*key) <= bound)
    # ranges of the key are numbered one by one: only the drawn rows are sorted
    ranges = cut(scored.where(drawn & (F.col("place") <= last[0])).repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    ranked = ordinal(ranges, [], key, F.col("part"), "rank").select(*out, (F.col("rank") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")))
