"""Benchmark decontamination: exact containment of item windows, by a prefix-filtered join on rare shingles."""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window as W

from framewright.llm.common import chunks, scan
from framewright.llm.words import letters_table, mix, word_hashes
from framewright.session import cut

#: Words of a window; words of a shingle; bits of the shared filter at most (2**27 bits are 16 MB).
WINDOW, SHINGLE, FILTER_BITS = 10, 3, 27
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SALTS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_hashes(h: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of all `words`-word shingles that lie in one text."""
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = sum((h[i : n + i] * SALTS[i] for i in range(words)), np.zeros(n, np.uint64))
    at = np.flatnonzero(owner[:n] == owner[words - 1 :])
    return mix(total + np.uint64(words))[at], at


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, window, n, k, shingles) of every window; k is the shingle length, shingles its hashes by place."""

    def make():
        table = letters_table("ascii")

        def work(ids, texts):
            out = {k: [] for k in ("item_id", "window", "n", "k", "shingles")}
            for item, text in zip(ids, texts):
                words = WORD.findall(text.translate(LOWER)) if text else []
                if not words:
                    continue
                n = min(window, len(words))
                k = min(SHINGLE, n)
                h, owner, *_ = word_hashes([text], table)
                hashes = shingle_hashes(h, owner, k)[0].view(np.int64).tolist()
                for i in range(len(words) - n + 1):
                    for c, v in zip(out, (item, " ".join(words[i : i + n]), n, k, hashes[i : i + n - k + 1])):
                        out[c].append(v)
            yield out

        return work

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return scan(items, "item_id string, window string, n int, k int, shingles array<bigint>", make)


def bit_filter(shingles: DataFrame, column: str) -> np.ndarray:
    """Bits set at the leading bits of the hashes, as bytes: at least 64 per hash, as long as that is at most 2**27 in all."""
    n = shingles.count()
    bits = int(min(FILTER_BITS, max(16, np.ceil(np.log2(64 * max(n, 1))))))
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = shingles.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS INT)))").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if bits <= 22 else out.view(np.uint8)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: `bits` is one flag or eight flags per byte."""
    if bits.dtype == bool:
        return bits[(h >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)]
    slot = (h >> np.uint64(65 - (8 * len(bits)).bit_length())).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)


def shingle_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(shingle, n): occurrences in all texts of the shingles that pass the filter, added up per task before the shuffle."""

    def make():
        table, counts = letters_table("ascii"), Counter()

        def flush() -> Iterator[dict]:
            if counts:
                yield {"shingle": list(counts), "n": list(counts.values())}
                counts.clear()

        def work(texts):
            for part in chunks(texts):
                h, owner, *_ = word_hashes(part, table)
                for k in sizes:
                    hashes, _ = shingle_hashes(h, owner, k)
                    values, times = np.unique(hashes[passes(bits.value, hashes)].view(np.int64), return_counts=True)
                    for v, n in zip(values.tolist(), times.tolist()):
                        counts[v] += n
                if len(counts) > 500_000:
                    yield from flush()

        work.flush = flush
        return work

    return scan(docs.select("text"), "shingle bigint, n bigint", make).groupBy("shingle").agg(F.sum("n").alias("n"))


HITS = "array<struct<shingle:bigint,at:bigint,start:bigint,words:string>>"


def prefix_hits(docs: DataFrame, bits, sizes: list[int], window: int) -> DataFrame:
    """(row, doc_id, n_words, hits): the places in each text whose shingle passes the filter, with the words round them."""

    def make():
        table = letters_table("ascii")

        def work(rows, ids, texts):
            at = 0
            for part in chunks(texts):
                h, owner, starts, ends = word_hashes(part, table)
                n_words = np.bincount(owner, minlength=len(part))
                firsts = np.cumsum(n_words) - n_words
                hits: list[list[dict]] = [[] for _ in part]
                for k in sizes:
                    hashes, places = shingle_hashes(h, owner, k)
                    good = np.flatnonzero(passes(bits.value, hashes))
                    for v, p in zip(hashes[good].view(np.int64).tolist(), places[good].tolist()):
                        i = int(owner[p])
                        low, high = max(firsts[i], p - window + k), min(firsts[i] + n_words[i], p + window) - 1
                        words = WORD.findall(part[i][starts[low] : ends[high]].translate(LOWER))
                        hits[i].append({"shingle": v, "at": p - int(firsts[i]), "start": int(low - firsts[i]), "words": " ".join(words)})
                yield {"row": rows[at : at + len(part)], "doc_id": ids[at : at + len(part)], "n_words": n_words.tolist(), "hits": hits}
                at += len(part)

        return work

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return scan(rows, f"row bigint, doc_id bigint, n_words bigint, hits {HITS}", make)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) for every row of `docs` (doc_id, text), against `benchmark` (item_id, text).

    Windows are `window` consecutive words of an item, or all words of a shorter one. Every window is represented by its one
    rarest shingle, by occurrences in all documents; windows with a shingle that never occurs drop out. Only shingles that
    pass a filter of bounded size leave the scan of the documents. They meet windows by that shingle, places where the window
    would begin before or end after the text are dropped, and the rest is compared word by word.

    n_hit counts the words inside any occurrence, item_ids are the distinct items (as sorted strings; items without an id
    count for n_hit alone). Null and wordless texts have no words; wordless items no windows; repeated rows are
    repeated; an empty benchmark hits nothing; no documents give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    found = cut(item_windows(benchmark, window))
    windows = found.select("window", "n", "shingles").dropDuplicates(["window"])
    sizes = sorted(r["k"] for r in found.select("k").distinct().collect())  # of 1, 2 and 3
    each = cut(windows.select("window", "n", F.posexplode("shingles").alias("offset", "shingle")))
    shingles = each.select("shingle").distinct()
    send = spark.sparkContext.broadcast
    counts = shingle_counts(docs, send(bit_filter(shingles, "shingle")), sizes)
    rarest = F.min(F.struct("n_seen", "offset", "shingle")).alias("r")
    ranked = each.join(counts.withColumnRenamed("n", "n_seen"), "shingle", "left").fillna(0, ["n_seen"])
    prefixes = cut(ranked.groupBy("window", "n").agg(rarest).where("r.n_seen > 0").select("window", "n", "r.offset", "r.shingle"))
    scanned = cut(prefix_hits(docs, send(bit_filter(prefixes.select("shingle").distinct(), "shingle")), sizes, window))
    hits = scanned.where("size(hits) > 0").select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.*")
    met = hits.join(prefixes, "shingle").withColumn("first", F.col("at") - F.col("offset"))
    met = met.where("first >= 0 AND first + n <= n_words AND first >= start")
    same = F.expr("array_join(slice(split(words, ' '), CAST(first - start AS INT) + 1, n), ' ') = window")
    places = cut(met.where(same).select("row", "first", (F.col("first") + F.col("n")).alias("last"), "window").distinct())
    before = W.partitionBy("row").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    spans = places.select("row", "first", "last").distinct().withColumn("done", F.coalesce(F.max("last").over(before), F.lit(0)))
    covered = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", "done"))).alias("n_hit"))
    owners = found.where("item_id IS NOT NULL").select("window", "item_id").distinct()
    items = places.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return (
        scanned.select("row", "doc_id", "n_words")
        .join(covered, "row", "left")
        .join(items, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the rows that hold a benchmark window; all columns are kept."""
    bad = contamination(docs, benchmark, window).where("n_hit > 0")
    # equal ids may name different texts, so the text is looked at again for those ids that are hit
    ids = bad.select("doc_id").distinct().alias("b")
    d = docs.alias("d")
    doubtful = bad.where("doc_id IS NULL").limit(1).count() or docs.groupBy("doc_id").count().where("count > 1").join(ids, "doc_id", "left_semi").limit(1).count()
    if doubtful:
        keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
        ids = contamination(keyed, benchmark, window).where("n_hit > 0").select("doc_id").distinct().alias("b")
        return d.join(ids, F.xxhash64("d.text") == F.col("b.doc_id"), "left_anti")
    return d.join(ids, F.col("d.doc_id") == F.col("b.doc_id"), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
