"""The language of a text does not depend on the texts it shares a batch with."""

import random

import numpy as np

from framewright.llm import langid

RNG = random.Random(23)
TONGUES = {"aa": "the of and river stone light with that when".split(), "bb": "el la de que piedra luz cuando rio con".split(), "cc": "der die und stein licht mit wenn das".split()}


def prose(name, n):
    return " ".join(RNG.choice(TONGUES[name]) for _ in range(n))


def test_every_text_is_judged_alone(spark):
    rows = [(i, prose(n, 60), n) for i in range(40) for n in TONGUES]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    tables, (codes, alpha) = model.tables(), model.codes()
    edges = ["", " ", "\n \n", "12 ", "... ", "  (", ",", "\u3000"]
    texts = [RNG.choice(edges) + prose(RNG.choice(list(TONGUES)), RNG.randint(0, 30)) + RNG.choice(edges) for _ in range(400)] + [None, "", prose("aa", 3000)]
    alone = [langid.parse(model, tables, codes, alpha, [t])[0] for t in texts]
    assert langid.parse(model, tables, codes, alpha, texts) == alone
    order = np.random.default_rng(1).permutation(len(texts))
    mixed = langid.parse(model, tables, codes, alpha, [texts[i] for i in order])
    assert [mixed[i] for i in np.argsort(order)] == alone
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for parts in (1, 7):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs.repartition(parts), model).collect()}
        assert [got[i] for i in range(len(texts))] == alone
