"""Utterance tables: modality joins, overlays, splits, buckets and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from framewright.functions.noise import digest, uniform
from framewright.operators.blocks import hashed_ordinal, ordinal, with_group
from framewright.operators.vectors import blend, cosine
from framewright.session import cut


def manifest_join(modalities: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keep an utterance only if every modality has it; columns of each side other than the keys come along."""
    return reduce(lambda a, b: a.join(b, keys), modalities.values())


def missing_report(utterances: DataFrame, modalities: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per utterance and modality that lacks it.

    Presence flags of all modalities are combined in one aggregate, so the utterance table is shuffled once.
    """
    names = list(modalities)
    flag = lambda df, which: df.select(*keys, *[F.lit(1 if n == which else 0).alias(f"_{n}") for n in ["", *names]])
    rows = reduce(DataFrame.unionByName, [flag(utterances, ""), *[flag(df, n) for n, df in modalities.items()]])
    seen = rows.groupBy(*keys).agg(*[F.max(f"_{n}").alias(f"_{n}") for n in ["", *names]]).where("`_` = 1")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_{n}") == 0, F.lit(n)) for n in names]))
    return seen.select(*keys, F.explode(lacks).alias("modality"))


def with_timbre(utterances: DataFrame, vectors: DataFrame, by_singer: bool, spk="spk", utt="vec_id", v="v") -> DataFrame:
    """Attach the utterance's own embedding, or the one embedding of its singer."""
    keys = [spk] if by_singer else [spk, utt]
    return utterances.join(vectors.select(*keys, v), keys)


def rewrite_by_mean(vectors: DataFrame, means: DataFrame, threshold: float = 0.85, spk="spk", v="v") -> DataFrame:
    """Replace an embedding by its speaker mean when their cosine is above `threshold`."""
    joined = vectors.join(means, spk).withColumn("rewritten", cosine(v, "mean") > threshold)
    return joined.withColumn(v, F.when(F.col("rewritten"), F.col("mean")).otherwise(F.col(v))).drop("mean")


def mix_singers(means: DataFrame, weights: dict, spk: str = "spk") -> DataFrame:
    """Weighted sum of named singers, per dimension; the weights need not add up to 1."""
    weight = F.coalesce(*[F.when(F.col(spk) == k, F.lit(float(w))) for k, w in weights.items()])
    named = means.where(F.col(spk).isin(list(weights)))
    return named.groupBy("d").agg(F.sum(weight * F.col("mean")).alias("c"))


def average_checkpoints(ckpt: DataFrame, first, models: int) -> DataFrame:
    """Element-wise mean over `models` checkpoints for the keys of the first one."""
    long = ckpt.select("model", "key", F.posexplode("w").alias("pos", "w"))
    summed = long.groupBy("key", "pos").agg(
        (F.sum("w") / float(models)).alias("w"), F.max((F.col("model") == first).cast("int")).alias("_first")
    )
    return summed.where("_first = 1").drop("_first")


def merge_checkpoints(a: DataFrame, b: DataFrame, rate: float) -> DataFrame:
    if not 0.0 < rate < 1.0:
        raise ValueError("rate must be between 0 and 1")
    pair = a.select("key", F.col("w").alias("_a")).join(b.select("key", F.col("w").alias("_b")), "key")
    return pair.select("key", blend("_b", "_a", rate).alias("w"))


def overlay_checkpoint(model: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved weights where present, else the model's own; `absent` marks the keys the checkpoint lacks."""
    joined = model.join(saved.select("key", F.col("w").alias("_s")), "key", "left")
    return joined.select("key", F.coalesce("_s", "w").alias("w"), F.col("_s").isNull().alias("absent"))


def align_lengths(lengths: dict[str, str], context: dict[str, int] | None = None) -> Column:
    """Common length of several streams; `context` frames are taken off a stream before comparing."""
    context = context or {}
    return F.least(*[F.expr(col) - context.get(name, 0) for name, col in lengths.items()])


def length_filter(items: DataFrame, n: str, shortest: int = 100, longest: int = 400) -> DataFrame:
    """Usable length is one less than the frames; short items are dropped, long ones capped."""
    usable = F.col(n) - 1
    return items.where(usable >= shortest).withColumn("use", F.least(usable, F.lit(longest)).cast("bigint"))


def bucket_of(n: Column, bounds: list[int]) -> Column:
    """Bucket i holds lengths in `(bounds[i], bounds[i+1]]`; missing outside all of them."""
    spans = list(zip(bounds, bounds[1:]))
    return F.coalesce(*[F.when((n > lo) & (n <= hi), F.lit(i)) for i, (lo, hi) in enumerate(spans)]).cast("bigint")


def holdout_split(items: DataFrame, key: str, held: int, seed=0) -> DataFrame:
    """Adds `position` in a seeded random order and `split`: the first `held` items are valid, the rest train."""
    placed = shuffled(items, [], key, seed, "position")
    return placed.withColumn("split", F.when(F.col("position") < held, "valid").otherwise("train"))


def held_out(items: DataFrame, key: str, held: int, seed=0) -> DataFrame:
    """Adds `split` alone: the keys that `holdout_split` holds out, without an order of the others.

    A top-k by digest of at most `held` keys is broadcast; nothing else is ranked or shuffled. Rows that share a held key are all valid.
    """
    keys = items.select(F.col(key).alias("_held")).orderBy(digest(seed, F.col("_held")), "_held").limit(held).distinct()
    joined = items.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col("_held")) & F.col("_held").isNotNull(), "left")
    return joined.withColumn("split", F.when(F.col("_held").isNotNull(), "valid").otherwise("train")).drop("_held")


def shuffled(items: DataFrame, keys: list[str], key: str, seed, out: str = "position") -> DataFrame:
    """Adds the dense position of each row in a seeded random order within `keys`."""
    return hashed_ordinal(items.withColumn("_h", digest(seed, key)), keys, "_h", key, out).drop("_h")


def random_start(length: Column, size: Column, seed, *key, inclusive: bool = False) -> Column:
    """Uniform start of a slice: below `length - size`, or up to and including it."""
    room = length - size + (1 if inclusive else 0)
    return F.when(room > 0, F.floor(uniform(seed, *key) * room)).otherwise(F.lit(0)).cast("bigint")


def wrap_pad(items: DataFrame, bucket: str, key: str, multiple: int, seed=None) -> DataFrame:
    """Pad each bucket to a multiple by repeating its items from the start: `pos` runs over the padded bucket."""
    if seed is None:
        placed = ordinal(items, [bucket], [key], F.expr(f"{key} div {1 << 22}"), "_p")
    else:
        placed = shuffled(items, [bucket], key, seed, "_p")
    sized = with_group(placed, [bucket], _n=F.count(F.lit(1)))
    padded = f"CAST(ceil(_n / {multiple}) * {multiple} AS BIGINT)"
    return sized.withColumn("pos", F.explode(F.expr(f"sequence(_p, {padded} - 1, _n)"))).drop("_p", "_n")


def rank_batches(padded: DataFrame, replicas: int, size: int) -> DataFrame:
    """Every replica takes every `replicas`-th position; `size` consecutive ones form a batch."""
    return (
        padded.withColumn("replica", F.expr(f"pos % {replicas}"))
        .withColumn("batch", F.expr(f"(pos div {replicas}) div {size}"))
        .withColumn("slot", F.expr(f"(pos div {replicas}) % {size}"))
    )


def even_batches(rows: DataFrame, keys: list[str], key: str, size: int) -> DataFrame:
    """Split each group into `ceil(n / size)` contiguous batches whose sizes differ by at most one."""
    placed = ordinal(rows, keys, [key], F.expr(f"{key} div {1 << 22}"), "_p")
    sized = with_group(placed, keys, _n=F.count(F.lit(1))).withColumn("_k", F.expr(f"CAST(ceil(_n / {size}) AS BIGINT)"))
    small, extra = "(_n div _k)", "(_n % _k)"
    batch = f"""CASE WHEN _p < {extra} * ({small} + 1) THEN _p div ({small} + 1)
        ELSE {extra} + (_p - {extra} * ({small} + 1)) div {small} END"""
    return sized.withColumn("batch", F.expr(batch)).drop("_p", "_n", "_k")


def shuffle_batches(rows: DataFrame, batch: list[str], seed) -> DataFrame:
    """Adds `place`, the position of each row's batch in a seeded random order of all batches."""
    batches = rows.select(*batch).distinct().withColumn("_h", digest(seed, *batch))
    placed = ordinal(batches, [], ["_h", *batch], F.substring("_h", 1, 3), "place").drop("_h")
    return rows.join(placed, batch)


def audited_batches(
    items: DataFrame, key: str, n: str, bounds: list[int], replicas: int, size: int, shortest: int = 100, longest: int = 400, seed=None
) -> tuple[DataFrame, DataFrame]:
    """(batches, audit): the items in padded batches, written to the shared folder, and one row that counts what happened to them.

    Items are filtered and capped by length, put into buckets, padded to whole batches of all replicas and dealt to
    these. The counts are observed in the pass that does so: items, too_short, capped and unbucketed ones, repeats that fill
    buckets up, and frames of items and of padding, each batch being as long as its longest item.
    """
    spark = items.sparkSession
    seen, dealt = Observation(), Observation()
    usable = F.col(n) - 1
    sized = items.withColumn("_bucket", bucket_of(F.least(usable, F.lit(longest)), bounds))
    counted = sized.observe(
        seen,
        F.count(F.lit(1)).alias("items"),
        F.count_if(usable < shortest).alias("too_short"),
        F.count_if(usable > longest).alias("capped"),
        F.count_if((usable >= shortest) & F.col("_bucket").isNull()).alias("unbucketed"),
    )
    kept = cut(length_filter(counted, n, shortest, longest).where("_bucket IS NOT NULL").select(key, "use", F.col("_bucket").alias("bucket")))
    padded = rank_batches(wrap_pad(kept, "bucket", key, replicas * size, seed), replicas, size)
    tops = padded.groupBy("bucket", "replica", "batch").agg(F.max("use").alias("length"))
    placed = padded.join(tops, ["bucket", "replica", "batch"]).observe(
        dealt,
        F.count(F.lit(1)).alias("slots"),
        F.count_if(F.col("slot") == 0).alias("batches"),
        F.coalesce(F.sum("use"), F.lit(0)).alias("frames"),
        F.coalesce(F.sum(F.col("length") - F.col("use")), F.lit(0)).alias("padding"),
    )
    batches = cut(placed)
    found = seen.get | dealt.get
    repeats = found["slots"] - (found["items"] - found["too_short"] - found["unbucketed"])
    names = ["items", "too_short", "capped", "unbucketed", "slots", "batches", "frames", "padding"]
    row = [int(found[c]) for c in names] + [int(repeats)]
    return batches, spark.createDataFrame([tuple(row)], ", ".join(f"{c} bigint" for c in [*names, "repeats"]))
