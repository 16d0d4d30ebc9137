"""Katz back-off language model: Good-Turing discounted n-gram counts and exactly normalised back-off weights.

The texts are cut into blocks of about a million tokens. Level by level, every block asks the n-gram table, which is
partitioned by context, for its distinct n-grams: it sends them with its training counts, and each partition adds the counts
of all blocks up, stores them and answers with the totals. Both ways a row holds the packed n-grams of one block and one
partition. A context of more than HOT occurrences is dealt to several partitions by the next word; what they know of it
(HOT is at least a 2**20th of all tokens, so these are at most 2**20 contexts) is added up and broadcast.
Last, every block evaluates the recursion for each of its tokens.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framewright.llm.common import chunks, scan
from framewright.llm.packets import narrow, pack, unpack
from framewright.llm.words import mix, word_hashes
from framewright.session import cut, scratch

#: Tokens of a block, and of a partition of the n-gram table; largest count that is discounted.
BLOCK_TOKENS, DISCOUNTED = 1 << 20, 5
#: Occurrences from which a context is dealt to several partitions; contexts that may be dealt so.
HOT, HOT_CONTEXTS = 1 << 20, 1 << 20
#: What stands for the end and the start of a text among the word hashes; ids of the start and of all unknown words.
END_HASH, START_HASH, START, UNKNOWN = np.uint64(1), np.uint64(0), 0, 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROW = "block bigint, bucket bigint, data binary"
TALLY = "grams array<bigint>, seen bigint, total bigint, hot array<struct<context:bigint,freed:array<bigint>,lower:double>>, model binary"


def token_table() -> np.ndarray:
    """Code point to the number that stands for it in a word, 0 for white space; A-Z count as a-z."""
    table = np.arange(1, 0x110001, dtype=np.uint64)
    table[65:91] = table[97:123]
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def blocks(docs: DataFrame, train: Column, order: int, block_tokens: int) -> DataFrame:
    """(block, rows, ids, data): packed token streams. A text longer than the rest of a block goes on in the next one.

    data holds the distinct word hashes in ascending order, the stream as places in them, and the segments of texts: tokens
    that are only context for the first ones, tokens that count, and whether the text is learned from.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        table = token_table()
        held, state = {"tokens": [], "rows": [], "ids": [], "lead": [], "n": [], "train": []}, {"tokens": 0, "block": 0}

        def flush() -> Iterator[dict]:
            if held["rows"]:
                from pyspark import TaskContext

                words, places = np.unique(np.concatenate(held["tokens"]), return_inverse=True)
                data = pack(words, narrow(places.astype(np.int64)), np.array(held["lead"], np.int32), np.array(held["n"], np.int32), np.array(held["train"], np.uint8))
                name = TaskContext.get().partitionId() << 32 | state["block"]
                yield {"block": [name], "rows": [list(held["rows"])], "ids": [list(held["ids"])], "data": [data]}
                state.update(tokens=0, block=state["block"] + 1)
                for v in held.values():
                    v.clear()

        def work(rows, ids, texts, flags):
            at = 0
            for part in chunks(texts):
                h, owner, *_ = word_hashes(part, table)
                h = np.where(h <= END_HASH, END_HASH + np.uint64(1), h)  # 0 and 1 are taken
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                for i in range(len(part)):
                    line = np.concatenate([[START_HASH], h[edges[i] : edges[i + 1]], [END_HASH]])
                    start = 1
                    while start < len(line):
                        stop = min(len(line), start + block_tokens - state["tokens"])
                        lead = min(start, order - 1)
                        for k, v in zip(held, (line[start - lead : stop], rows[at + i], ids[at + i], lead, stop - start, flags[at + i])):
                            held[k].append(v)
                        state["tokens"] += stop - start
                        start = stop
                        if state["tokens"] >= block_tokens:
                            yield from flush()
                at += len(part)

        work.flush = flush
        return work

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.coalesce(train, F.lit(False)))
    return scan(rows, f"block bigint, rows array<bigint>, ids array<{kind}>, data binary", make)


class Block:
    """The tokens of a block, and what it has learned of them level by level.

    `models[m]` is what `model_of` gives for level m + 1, `answers[m]` the answers of that level by bucket.
    """

    def __init__(self, data: bytes, buckets: int, models: list[dict], answers: list[list[bytes]], texts_learned: int) -> None:
        self.words, self.places, self.lead, self.n, train = unpack(data)
        self.buckets = buckets
        sizes = self.lead + self.n
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        offset = np.arange(len(self.owner), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        self.first, self.counted = offset == 0, offset >= self.lead[self.owner]
        self.learned = self.counted & (train[self.owner] > 0)
        self.order = np.argsort(self.words % np.uint64(buckets), kind="stable")
        if models:
            self.total = models[0]["total"]
            self.lowest(models[0], answers[0], texts_learned)
            for model, answer in zip(models[1:], answers[1:]):
                self.climb(model, answer)

    def word_requests(self) -> Iterator[tuple[int, bytes]]:
        """Per bucket the hashes and training counts of its words."""
        real = self.words[self.order] != START_HASH
        times = np.bincount(self.places[self.learned], minlength=len(self.words))[self.order][real]
        words = self.words[self.order][real]
        for bucket, a, b in runs((words % np.uint64(self.buckets)).astype(np.int64)):
            yield bucket, pack(words[a:b], narrow(times[a:b]))

    def lowest(self, model: dict, answers: list[bytes], texts_learned: int) -> None:
        ids, counts = [np.concatenate([np.zeros(0, np.int64), *column]) for column in zip(*map(unpack, answers))]
        where = self.order[self.words[self.order] != START_HASH]
        of_word, times = np.full(len(self.words), START), np.zeros(len(self.words), np.int64)
        of_word[where], times[where] = ids, counts
        times[self.words == START_HASH] = texts_learned
        self.word, self.times = of_word[self.places], times[self.places]
        # at this level the only context is the empty one, and what is freed goes to the unknown word
        discounts = model["discounts"]
        left = left_mass(model["grams"][:DISCOUNTED], discounts)[0]
        room = model["total"] + (left == 0)
        self.p = np.where(self.times > 0, discounted(self.times, discounts) / room, (left or 1) / room)
        self.gram, self.known = self.word, self.times

    def prepare(self) -> None:
        """Distinct (context, word) of the next level, in order of their bucket."""
        self.asked = (np.flatnonzero((self.known[:-1] > 0) & ~self.first[1:]) + 1).astype(np.int32)
        context, seen, word = self.gram[self.asked - 1], self.known[self.asked - 1], self.word[self.asked]
        hot = max(HOT, self.total // HOT_CONTEXTS)
        dealt = np.flatnonzero(seen > hot)
        mixed = context.view(np.uint64) << np.uint64(1)
        parts = -(-seen[dealt] // hot)
        mixed[dealt] += mix(word[dealt].view(np.uint64)) % parts.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (mix(mixed) % np.uint64(self.buckets)).astype(np.int32)
        del mixed
        order = np.lexsort((word, context, bucket))
        bucket, context, word = bucket[order], context[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        heads = np.flatnonzero(new)
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - 1
        self.bucket, self.context, self.follower = bucket[heads], context[heads], word[heads]
        at = order[heads]
        self.seen, self.dealt, self.lower = seen[at], seen[at] > hot, self.p[self.asked[at]]

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """Per bucket its contexts with their numbers of followers, then the followers, their training counts and lower probabilities."""
        self.prepare()
        times = np.bincount(self.pair[self.learned[self.asked]], minlength=len(self.bucket))
        for bucket, a, b in runs(self.bucket):
            heads = np.flatnonzero(np.r_[True, np.diff(self.context[a:b]) != 0])
            yield bucket, pack(
                narrow(np.diff(self.context[a:b][heads], prepend=0)), narrow(np.diff(np.r_[heads, b - a])), self.dealt[a:b][heads].view(np.uint8),
                narrow(self.follower[a:b]), narrow(times[a:b]), *indexed(self.lower[a:b]),
            )

    def climb(self, model: dict, answers: list[bytes]) -> None:
        """Probabilities, ids and counts of the next level from its answers; the highest level has no ids."""
        self.prepare()
        discounts = model["discounts"]
        columns = list(zip(*map(unpack, answers))) or [[np.zeros(0, np.int64)]] * 4
        counts, ids, freed, lower = [np.concatenate(c) for c in columns]
        heads = np.r_[True, (np.diff(self.bucket) != 0) | (np.diff(self.context) != 0)][: len(self.bucket)]
        which = np.cumsum(heads) - 1
        freed, lower = freed.reshape(-1, DISCOUNTED).astype(np.float64), lower.copy()
        mine = self.context[heads]
        dealt = np.flatnonzero(self.dealt[heads])
        at = np.searchsorted(model["hot"], mine[dealt])
        freed[dealt], lower[dealt] = model["freed"][at], model["lower"][at]
        left = left_mass(freed, discounts)
        room = self.seen + (left == 0)[which]
        weight = np.where(left == 0, 1.0, left)[which] / room / np.maximum(1 - lower[which], 1e-300)
        p = np.where(counts > 0, discounted(counts, discounts) / room, weight * self.lower)
        self.p = self.p.copy()
        self.p[self.asked] = p[self.pair]
        if len(ids):  # contexts of the next level
            gram, known = np.full(len(self.owner), -1), np.zeros(len(self.owner), np.int64)
            gram[self.asked], known[self.asked] = ids[self.pair], counts[self.pair]
            self.gram, self.known = gram, known

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of the counted tokens by segment."""
        return np.bincount(self.owner[self.counted], values[self.counted], minlength=len(self.n))


def indexed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the place of each among them."""
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, narrow(place)


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of runs of equal neighbours."""
    cuts = np.r_[0, np.flatnonzero(np.diff(values)) + 1, len(values)] if len(values) else np.zeros(1, np.int64)
    return [(int(values[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def discounts_of(grams: list[int]) -> np.ndarray:
    """Factors of the counts 1 to DISCOUNTED from the numbers of n-grams seen once, twice ... DISCOUNTED + 1 times.

    Katz's form of Good-Turing. Where these numbers give a factor outside (0, 1), all counts are discounted by one half instead.
    """
    r = np.arange(1, DISCOUNTED + 1)
    n = np.array(grams[: DISCOUNTED + 1], np.float64)
    if len(n) == DISCOUNTED + 1 and (n > 0).all():
        common = (DISCOUNTED + 1) * n[-1] / n[0]
        if common != 1:
            factors = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
            if ((factors > 0) & (factors < 1)).all():
                return factors
    return (r - 0.5) / r


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.r_[1.0, factors, 1.0][np.minimum(counts, DISCOUNTED + 1).astype(np.int64)]


def left_mass(freed: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """What discounting frees of each context's count: `freed` holds how many followers it has by count 1 to DISCOUNTED.

    Where that is nothing, the context is counted once more and that count is what is left.
    """
    return np.atleast_2d(freed) @ (np.arange(1, DISCOUNTED + 1) * (1 - factors))


def tally(counts: np.ndarray) -> dict:
    return {"grams": np.bincount(np.minimum(counts[counts > 0], DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist(), "seen": int((counts > 0).sum()), "total": int(counts.sum())}


def answer_words(pdf: pd.DataFrame, buckets: int, last: bool, keep: bool) -> pd.DataFrame:
    """One partition of the word table: ids by falling count, and every block's answer."""
    bucket, asked = int(pdf["bucket"].iloc[0]), [unpack(d) for d in pdf["data"]]
    words, place = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([n for _, n in asked]).astype(np.float64), minlength=len(words)).astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    ids = np.where(counts > 0, rank * buckets + bucket + 2, UNKNOWN)
    ends = np.cumsum([len(w) for w, _ in asked])
    data = [pack(narrow(ids[i]), narrow(counts[i])) for i in np.split(place, ends[:-1])]
    seen = counts > 0
    model = pack(words[seen], narrow(ids[seen]), narrow(counts[seen])) if keep else None
    return answers(pdf["block"], bucket, data, tally(counts) | {"hot": [], "model": model})


def answers(names: pd.Series, bucket: int, data: list[bytes], found: dict) -> pd.DataFrame:
    """The answers to the blocks, and a row without a block that holds the tally of the partition."""
    n = len(data)
    block = pd.array([*names, pd.NA], dtype="Int64")
    return pd.DataFrame({"block": block, "bucket": bucket, "data": [*data, None], **{k: [*[None] * n, v] for k, v in found.items()}}).astype({"seen": "Int64", "total": "Int64"})


def answer_grams(pdf: pd.DataFrame, buckets: int, last: bool, keep: bool) -> pd.DataFrame:
    """One partition of the table of a higher level; n-grams get ids where they are the contexts of another level."""
    bucket, contexts, words, times, lowers, dealt = int(pdf["bucket"].iloc[0]), [], [], [], [], []
    for d in pdf["data"]:
        steps, sizes, hot, follower, n, lower, place = unpack(d)
        contexts.append(np.repeat(np.cumsum(steps.astype(np.int64)), sizes))
        dealt.append(np.repeat(hot, sizes))
        words.append(follower.astype(np.int64))
        times.append(n.astype(np.float64))
        lowers.append(lower[place])
    ends = np.cumsum([len(w) for w in words])[:-1]
    context, word, n, lower, dealt = map(np.concatenate, (contexts, words, times, lowers, dealt))
    order = np.lexsort((word, context))
    a, b = context[order], word[order]
    new = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)]
    gram = np.empty(len(order), np.int64)
    gram[order] = np.cumsum(new) - 1
    heads = order[new]
    counts = np.bincount(gram, n, minlength=len(heads)).astype(np.int64)
    starts = np.r_[True, np.diff(context[heads]) != 0]
    of_context = np.cumsum(starts) - 1
    seen = counts > 0
    low = np.bincount(of_context[seen], lower[heads][seen], minlength=int(starts.sum()))
    small = seen & (counts <= DISCOUNTED)
    freed = np.bincount(of_context[small] * DISCOUNTED + counts[small] - 1, minlength=DISCOUNTED * len(low)).reshape(-1, DISCOUNTED)
    ids = np.where(seen, (np.cumsum(seen) - 1) * buckets + bucket, 0)
    data = []
    for g in np.split(gram, ends):
        c = of_context[g]
        firsts = np.flatnonzero(np.r_[True, np.diff(c) != 0])
        unseen = np.bitwise_or.reduceat(counts[g] == 0, firsts)
        data.append(pack(narrow(counts[g]), narrow(ids[g][: 0 if last else None]), narrow(freed[c[firsts]].reshape(-1)), np.where(unseen, low[c[firsts]], 0.0)))
    hot = np.flatnonzero(dealt[heads][starts])
    rows = [{"context": int(context[heads][starts][i]), "freed": freed[i].tolist(), "lower": float(low[i])} for i in hot]
    model = pack(narrow(context[heads][seen]), narrow(word[heads][seen]), narrow(ids[seen]), narrow(counts[seen])) if keep else None
    return answers(pdf["block"], bucket, data, tally(counts) | {"hot": rows, "model": model})


def model_of(stored: DataFrame) -> dict:
    """What every block is told of a level: the discounts, how many n-grams there are in all and by count, and the hot contexts."""
    told = stored.where("block IS NULL")
    rows = told.select(F.posexplode("grams").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect()
    grams = np.array([r["n"] for r in rows] or [0] * (DISCOUNTED + 1))
    seen, total = told.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    parts = told.select(F.explode("hot").alias("h")).select("h.*")
    sums = [F.sum(F.col("freed")[r]).alias(f"f{r}") for r in range(DISCOUNTED)]
    hot = parts.groupBy("context").agg(*sums, F.sum("lower").alias("lower")).orderBy("context").toPandas()
    return {
        "discounts": discounts_of(grams), "grams": grams, "seen": int(seen), "total": int(total), "hot": hot["context"].to_numpy(np.int64),
        "freed": hot[[f"f{r}" for r in range(DISCOUNTED)]].to_numpy(np.float64), "lower": hot["lower"].to_numpy(np.float64),
    }


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """(level, bucket, context, word, id, n) of every n-gram of a model that `score` has stored at `path`.

    At level 1, word is the hash of the word's characters and context is null; above, word is the id of the last word and
    context that of the words before it, START for the start of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, bucket, data in zip(*[c.to_pylist() for c in batch.columns]):
                columns = [a.astype(np.int64) if a.dtype != np.uint64 else a.view(np.int64) for a in unpack(data)]
                for at in range(0, len(columns[0]), 1 << 16):
                    part = [pa.array(c[at : at + (1 << 16)]) for c in columns]
                    n = len(part[0])
                    context = [pa.nulls(n, pa.int64())] if level == 1 else []
                    same = [pa.array(np.full(n, level, np.int32)), pa.array(np.full(n, bucket, np.int64))]
                    yield pa.RecordBatch.from_arrays([*same, *context, *part], names=["level", "bucket", "context", "word", "id", "n"])

    rows = spark.read.schema("bucket bigint, model binary, level int").parquet(path)
    return rows.select("level", "bucket", "model").mapInArrow(run, "level int, bucket bigint, context bigint, word bigint, id bigint, n bigint")


def score(docs: DataFrame, train: Column, order: int = 2, block_tokens: int = BLOCK_TOKENS, model_path: str | None = None) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs` (doc_id, text).

    The model of `order` n-grams is learned from the rows for which `train` is true. Tokens are the words between white space,
    A-Z as a-z, and one end per text; the first words have the start as their context. At level 1, discounting
    frees mass for the unknown word, which stands for every word not learned; an n-gram not learned has the probability of its
    shorter form times the weight of its context, which is what discounting left there over what the shorter forms of its
    unlearned followers hold together. A context in which nothing is discounted counts once more, and that count is left; one that was never
    learned gives way to the shorter one. The probabilities of all words and the unknown one in a context add up to one.

    n_known counts tokens learned, train_tokens all learned tokens, score is the log10 probability of the text, and base_score the sum of
    log10((c + 0.5) / (N + 0.5 * (V + 1))) over counts c of single tokens. A null text is empty, that is one end; repeated
    rows are repeated; null ids are kept; no rows give none; with `model_path`, the n-grams and their counts are also stored there, partitioned by level,
    a row per partition of the table (`stored_counts` reads them); with nothing to learn from, every token is unknown and has
    probability 1. A null `train` is false. Other columns are ignored.
    """
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the exchanges of a written table are not needed again
    try:
        return _score(docs, train, order, block_tokens, model_path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def _score(docs: DataFrame, train: Column, order: int, block_tokens: int, model_path: str | None) -> DataFrame:
    spark = docs.sparkSession
    texts = cut(blocks(docs, train, order, block_tokens))

    # a segment begins a text exactly if its first token is the start, which has place 0 among the words
    def starts(names, ids, rows, data):
        for d in data:
            words, places, lead, n, learned = unpack(d)
            heads = np.cumsum(np.r_[0, (lead.astype(np.int64) + n)[:-1]])
            begins = (places[heads] == 0) & (words[0] == START_HASH)
            yield {"tokens": [int(n.sum())], "texts": [int((begins & (learned > 0)).sum())]}

    size = scan(texts, "tokens bigint, texts bigint", lambda: starts).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    buckets, learned = max(1, -(-size[0] // block_tokens)), size[1]
    folder = scratch(spark, "katz")

    def store(asked: DataFrame, answer, level: int) -> DataFrame:
        """The table of a level: the answers of its partitions, written to the shared folder and read from there."""
        schema = f"{ROW}, {TALLY}"
        told = asked.groupBy("bucket").applyInPandas(lambda pdf: answer(pdf, buckets, level == order, model_path is not None), schema)
        told.write.parquet(f"{folder}/level={level}")
        stored = spark.read.schema(schema).parquet(f"{folder}/level={level}").withColumn("level", F.lit(level))
        if model_path is not None:
            stored.where("model IS NOT NULL").select("level", "bucket", "model").write.mode("append").partitionBy("level").parquet(model_path)
        return stored

    def ask_words(names, rows, ids, data):
        for name, d in zip(names, data):
            for bucket, packet in Block(d, buckets, [], [], learned).word_requests():
                yield {"block": [name], "bucket": [bucket], "data": [packet]}

    levels = [store(scan(texts, ROW, lambda: ask_words), answer_words, 1)]
    models = [model_of(levels[0])]

    def met(fn, schema: str) -> DataFrame:
        """Run fn(block, its rows) for every block with the answers it got so far."""
        known = spark.sparkContext.broadcast(list(models))
        told = levels[0]
        for t in levels[1:]:
            told = told.unionByName(t)
        told = told.where("block IS NOT NULL").select("block", "level", "bucket", "data")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values(["level", "bucket"])
            answers = [right.loc[right["level"] == m, "data"].tolist() for m in range(1, len(known.value) + 1)]
            return fn(left, Block(left["data"].iloc[0], buckets, known.value, answers, learned))

        return texts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, schema)

    def ask(left: pd.DataFrame, block: Block) -> pd.DataFrame:
        found = list(block.requests())
        return pd.DataFrame({"block": left["block"].iloc[0], "bucket": [b for b, _ in found], "data": [d for _, d in found]})

    for level in range(2, order + 1):
        levels.append(store(met(ask, ROW), answer_grams, level))
        models.append(model_of(levels[-1]))
    total = models[0]["total"]
    floor = np.log10(total + 0.5 * (models[0]["seen"] + 1))

    def evaluate(left: pd.DataFrame, block: Block) -> pd.DataFrame:
        base = block.sums(np.log10(block.times + 0.5) - floor)
        return pd.DataFrame({
            "row": left["rows"].iloc[0], "doc_id": pd.Series(list(left["ids"].iloc[0]), dtype=object), "n_tokens": block.n.astype(np.int64),
            "n_known": block.sums((block.times > 0).astype(np.float64)).astype(np.int64), "base_score": base, "score": block.sums(np.log10(block.p)),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = met(evaluate, f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("row", "doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
