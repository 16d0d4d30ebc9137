"""The language model against plain dictionaries, and the sum of its probabilities."""

import math
import random
import re
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framewright.llm import katz

RNG = random.Random(11)
COMMON = [f"w{i}" for i in range(12)]


def prose(n):
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.8 else f"rare{RNG.randint(0, 300)}" for _ in range(n))


TEXTS = [None, "", " \n\t", "One", "x\x00y \x1f", prose(3000)] + [prose(RNG.randint(1, 60)) for _ in range(120)]
ROWS = [(i, t, i % 5 != 1, "k") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], False, "k"), (None, TEXTS[8], True, "k"), (None, None, None, "k")]
ROWS += [(900 + i, "w1 w2 w3", True, "k") for i in range(40)]


def tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [*words, None]


class Plain:
    """Katz's model in plain dictionaries; the start is 0, the end None, unknown words are ''."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            line = [0, *tokens(t)]
            for m in range(1, order + 1):
                for i in range(1, len(line)):
                    if i - m + 1 >= 0:
                        self.counts[m][tuple(line[i - m + 1 : i + 1])] += 1
        self.vocabulary = {g[0] for g in self.counts[1]}
        self.factors = [None] + [katz.discounts_of([sum(c == r for c in self.counts[m].values()) for r in range(1, 7)]) for m in range(1, order + 1)]
        self.followers = [defaultdict(dict) for _ in range(order + 1)]
        for m in range(1, order + 1):
            for g, c in self.counts[m].items():
                self.followers[m][g[:-1]][g[-1]] = c
        self.weights = {}

    def cut(self, m, c):
        return c * (self.factors[m][c - 1] if c <= 5 else 1.0)

    def p(self, context, word):
        context = context[len(context) - self.order + 1 :] if self.order > 1 else ()
        m = len(context) + 1
        seen = self.followers[m].get(context, {})
        if m > 1 and not seen:
            return self.p(context[1:], word)
        total = sum(seen.values())
        left = sum(c - self.cut(m, c) for c in seen.values())
        room, left = (total, left) if left else (total + 1, 1)
        if word in seen:
            return self.cut(m, seen[word]) / room
        if m == 1:
            return left / room
        if context not in self.weights:
            self.weights[context] = left / room / (1 - sum(self.p(context[1:], w) for w in seen))
        return self.weights[context] * self.p(context[1:], word)

    def score(self, text):
        line = [0, *[w if w in self.vocabulary else "" for w in tokens(text)]]
        return sum(math.log10(self.p(tuple(line[max(0, i - self.order + 1) : i]), line[i])) for i in range(1, len(line)))


def expected(rows, order):
    model = Plain([t for _, t, learn, _ in rows if learn], order)
    n, v = sum(model.counts[1].values()), len(model.counts[1])
    out = []
    for doc, text, _, _ in rows:
        line = tokens(text)
        counts = [model.counts[1][(w,)] for w in line]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts)
        out.append((doc, len(line), sum(c > 0 for c in counts), n, base, model.score(text)))
    return sorted(out, key=lambda r: (repr(r[0]), r[5]))


def agrees(spark, rows, order, block_tokens):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean, row string").repartition(5)
    found = katz.score(docs, F.col("train"), order, block_tokens).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found), key=lambda r: (repr(r[0]), r[5]))
    want = expected(rows, order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9), (g, w)


@pytest.mark.parametrize("order, block_tokens", [(1, 1 << 20), (2, 1 << 20), (2, 700), (3, 90)])
def test_scores_are_those_of_plain_dictionaries(spark, order, block_tokens):
    agrees(spark, ROWS, order, block_tokens)


def test_hot_contexts_are_dealt_to_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(katz, "HOT", 60)
    agrees(spark, ROWS, 2, 300)


def test_no_rows_and_nothing_to_learn_from(spark):
    assert katz.score(spark.createDataFrame([], "doc_id bigint, text string"), F.lit(True)).count() == 0
    rows = katz.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_probabilities_add_up_to_one():
    model = Plain([t for _, t, learn, _ in ROWS if learn], 2)
    for context in [(), (0,), ("w1",), ("w5",), ("rare7",), ("one",)]:
        assert sum(model.p(context, w) for w in [*model.vocabulary, ""]) == pytest.approx(1)


def test_discounts_fall_back_where_the_counts_of_counts_do_not_serve():
    assert katz.discounts_of([]).tolist() == katz.discounts_of([5, 0, 1, 1, 1, 1]).tolist() == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]
    assert (katz.discounts_of([1000, 400, 220, 150, 110, 85]) < 1).all()


def test_stored_counts_are_those_of_the_corpus(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/model"
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, train boolean, row string").repartition(3)
    scores = sorted(r["score"] for r in katz.score(docs, F.col("train"), 3, 500, path).collect())
    assert scores == pytest.approx(sorted(w[5] for w in expected(ROWS, 3)))
    model = Plain([t for _, t, learn, _ in ROWS if learn], 3)
    rows = katz.stored_counts(spark, path).collect()
    for level in (1, 2, 3):
        got = [r for r in rows if r["level"] == level]
        assert Counter(r["n"] for r in got) == Counter(model.counts[level].values())
    ids = {r["id"]: r["n"] for r in rows if r["level"] == 1}
    totals = Counter()
    for r in rows:
        if r["level"] == 2:
            totals[r["context"]] += r["n"]
            assert r["word"] in ids
    assert totals.pop(katz.START) == sum(1 for r in ROWS if r[2]) and all(ids[c] == n for c, n in totals.items())
