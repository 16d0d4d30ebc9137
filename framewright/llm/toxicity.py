"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from framewright.llm.common import chunks, scan
from framewright.llm.words import letters_table, mix, word_hashes

#: Bits of the feature space; rows of the fitting sample; passes over them.
BITS, SAMPLE_ROWS, PASSES = 20, 16_384, 3
#: Step size, its offset, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 3.0, 1.0
#: Features of fewer rows are not taken into a learner.
SUPPORT = 3
BIAS = 0


def features(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of every word, pair of neighbours, and pair with one word between; repeats included."""
    h, owner, *_ = word_hashes([t.lower() if t else t for t in texts], table)
    found, owners = [h], [owner]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = owner[gap:] == owner[:-gap]
        found.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
        owners.append(owner[gap:][same])
    slots = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.maximum(slots, BIAS + 1), np.concatenate(owners)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, passes: int) -> np.ndarray:
    """Weights after some passes over rows of present features, each coordinate with its own learning rate."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(z[i]) <= L1] = 0
        w[i == BIAS] = (-z[i] / ((BETA + np.sqrt(n[i])) / ALPHA))[i == BIAS]
        return w

    for _ in range(passes):
        for i, y in zip(rows, labels):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(1 << BITS))


def learn(labelled: DataFrame, texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) fitted to labels (doc_id, label 0/1) of documents (doc_id, text); both may have other columns.

    Up to half of the sample of about `sample_rows` labels are positive; the intercept is then set back to their share in all
    labels. Which rows are picked depends on their ids alone. The sampled texts become features where they are read, and one learner
    gets these, at most 2**20 distinct ones per text, in the order of a hash; the few weights that L1 leaves are collected. An id with several labels has the
    highest, an id with several texts the smallest. Null labels and texts are left out. Without both labels, all scores are the share of the positive one.
    """
    labels = labelled.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    count = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = count.get(1, 0), count.get(0, 0)
    if not ones or not zeros:
        return np.array([BIAS]), np.array([0.0 if ones == zeros else 35.0 if ones else -35.0])
    take_one = min(1.0, sample_rows / 2 / ones)
    take_zero = min(1.0, (sample_rows - take_one * ones) / zeros)
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(1 << 30)
    picked = labels.where(uniform < F.when(F.col("label") == 1, take_one).otherwise(take_zero))
    rows = texts.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    single = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def slots() -> Callable[..., Iterator[dict]]:
        table = letters_table("alnum")

        def work(ids, labels, texts):
            at = 0
            for part in chunks(texts):
                found, owner = features(part, table)
                key = np.unique(owner << BITS | found)
                split = np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, len(part))))
                yield {"doc_id": ids[at : at + len(part)], "label": labels[at : at + len(part)], "slots": [np.r_[BIAS, s].astype("<i4").tobytes() for s in split]}
                at += len(part)

        return work

    kind = texts.schema["doc_id"].dataType.simpleString()
    made = scan(single.select("doc_id", "label", "text"), f"doc_id {kind}, label int, slots binary", slots)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        present = [np.frombuffer(s, "<i4") for s in pdf["slots"]]
        times = np.bincount(np.concatenate(present), minlength=1 << BITS)
        present = [i[times[i] >= SUPPORT] for i in present]
        w = ftrl(present, pdf["label"].to_numpy(), PASSES)
        used = np.flatnonzero(w)
        return pd.DataFrame({"slot": used, "weight": w[used]})

    dealt = made.select(F.lit(0).alias("learner"), F.xxhash64("doc_id", F.lit(19)).alias("order"), "slots", "label")
    fitted = dealt.groupBy("learner").applyInPandas(fit, "slot bigint, weight double").toPandas().sort_values("slot")
    slots_of, weights = fitted["slot"].to_numpy(), fitted["weight"].to_numpy().copy()
    back = np.log(ones / zeros) - np.log(take_one * ones / (take_zero * zeros))
    if BIAS not in slots_of:
        return np.r_[BIAS, slots_of], np.r_[back, weights]
    weights[slots_of == BIAS] += back
    return slots_of, weights


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """UDF: text to its score. Every feature counts once per text."""

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = np.zeros(1 << BITS)
        weight[model[0]] = model[1]
        bias, weight[BIAS] = weight[BIAS], 0
        table = letters_table("alnum")
        for batch in batches:
            out = []
            for part in chunks(batch.to_pylist()):
                slots, owner = features(part, table)
                heavy = weight[slots] != 0
                key = np.unique(owner[heavy] << BITS | slots[heavy])
                total = bias + np.bincount(key >> BITS, weight[key & ((1 << BITS) - 1)], minlength=len(part))
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) for every row of `docs` (doc_id, text), from its whole text; null and empty texts get the intercept's score.

    Repeated rows are repeated, null ids kept; no rows give none; other columns are ignored.
    """
    return docs.select("doc_id", scorer(model)("text").alias("score"))
