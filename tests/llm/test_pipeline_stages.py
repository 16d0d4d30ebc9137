"""What the stages of the pipeline decide."""

import random

import corpus_pipeline

RNG = random.Random(31)
TONGUES = {"aa": "the of and river stone light with that when".split(), "bb": "el la de que piedra luz cuando rio con".split()}


def prose(name, n):
    return " ".join(RNG.choice(TONGUES[name]) for _ in range(n))


def test_language_stage_drops_what_is_in_another_language(spark):
    rows = [(i, prose(n, 120), n, "s") for i in range(500) for n in TONGUES]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    odd = [
        (5000, prose("bb", 120), "aa", "s"), (5001, prose("bb", 4), "aa", "s"), (5002, prose("bb", 120), None, "s"), (5003, "1234 " * 100, "aa", "s"),
        (5004, None, "aa", "s"), (5005, "x" * 2000, "aa", "s"), (5006, "", None, "s"), (5006, prose("aa", 120), "aa", "s"),
    ]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, language_found string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"], r["lang"]) for r in kept.collect())
    assert got == sorted([(i, r[2]) for i, r in enumerate(rows)] + [(5001, "aa"), (5002, "bb"), (5006, "aa")])
