"""The fit against a plain loop over coordinates, and labels and texts that repeat."""

import math
import random

import numpy as np

from framewright.llm import toxicity as T
from framewright.llm.words import letters_table

RNG = random.Random(51)
WORDS = "the of and river stone light carries über niño 漢字 vile grim 12".split()


def plain_ftrl(rows, labels, passes):
    """FTRL-proximal, one coordinate after the other, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i == T.BIAS:
            return -zi / ((T.BETA + math.sqrt(ni)) / T.ALPHA)
        return 0.0 if abs(zi) <= T.L1 else -(zi - math.copysign(T.L1, zi)) / ((T.BETA + math.sqrt(ni)) / T.ALPHA + T.L2)

    for _ in range(passes):
        for row, y in zip(rows, labels):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in row:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / T.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_weights_are_those_of_a_plain_loop():
    rng = np.random.default_rng(5)
    rows = [np.r_[T.BIAS, np.unique(rng.integers(1, 40, rng.integers(0, 12)))] for _ in range(200)]
    labels = np.array([int(5 in r or rng.random() < 0.1) for r in rows])
    got, want = T.ftrl(rows, labels, 3), plain_ftrl([r.tolist() for r in rows], labels.tolist(), 3)
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values())
    assert all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-12) for i, w in want.items())


def test_features_are_words_pairs_and_skips():
    texts = ["One two, three four", None, "", "two ONE"]
    slots, owner = T.features(texts, letters_table("alnum"))
    assert np.bincount(owner, minlength=4).tolist() == [4 + 3 + 2, 0, 0, 2 + 1] and slots.min() > T.BIAS
    assert set(slots[owner == 3][:2]) <= set(slots[owner == 0])  # the words alone, whatever their case and place


def test_repeated_labels_and_texts_count_once(spark):
    texts = [(i, " ".join(RNG.choice(WORDS[:9]) for _ in range(20)) + (" vile" if i % 4 == 0 else ""), "x") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, label int")
    once = T.learn(labels, docs)
    more = T.learn(labels.unionByName(labels).unionByName(labels.where("label = 1").selectExpr("doc_id", "0 AS label")), docs.unionByName(docs).repartition(7))
    assert once[0].tolist() == more[0].tolist() and np.allclose(once[1], more[1])
    long = docs.unionByName(spark.createDataFrame([(5, "vile " * 400_000, "x")], "doc_id bigint, text string, label string"))
    assert len(T.learn(labels, long)[0]) < 5000
