"""The draw towards a target against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm import resample

RNG = random.Random(12)
WORDS = "the of and river Stone light carries über été niño 漢字 don't 12 token=abc".split()


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice([" ", "", "-x", "\n"]) for _ in range(n))


TEXTS = [None, "", " \n\t ", "...", "one", "É", prose(9000), "Kİ x"] + [prose(RNG.randint(1, 60)) for _ in range(150)]
ROWS = [(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "k", 1), (None, TEXTS[6], "k", 1), (None, TEXTS[6], "k", 1), (None, None, "k", 1)]
ROWS += [(500 + i, TEXTS[6], "hot", 1) for i in range(60)]
TARGET = [("a", prose(50)), ("b", None), ("c", "river Stone"), ("d", "")]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]]


def expected(rows, target, least=20, percent=25):
    source, wanted = Counter(b for _, t, *_ in rows for b in buckets_of(t)), Counter(b for _, t in target for b in buckets_of(t))
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000))))
    out = []
    for doc, text, *_ in rows:
        found = buckets_of(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r, (_, text, *_) in zip(out, rows) if len(words_of(text)) >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = i
    return sorted(map(tuple, out), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, row int").repartition(6)


def found(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("percent", [25, 90, 100, 1])
def test_draw_is_that_of_plain_python(spark, percent):
    target = spark.createDataFrame(TARGET, "item_id string, text string")
    assert found(resample.draw(table(spark, ROWS), target, percent=percent)) == expected(ROWS, TARGET, percent=percent)


def test_empty_tables(spark):
    none, target = table(spark, []), spark.createDataFrame(TARGET, "item_id string, text string")
    assert resample.draw(none, target).count() == 0
    assert found(resample.draw(table(spark, ROWS[:30]), target.where("false"))) == expected(ROWS[:30], [])
    assert all(r[4] is None for r in found(resample.draw(table(spark, ROWS[:5]), target)))


@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_quickselect_finds_every_place(spark, pivots):
    rows = [(RNG.randint(0, 4), RNG.choice([None, 1, 2, 3]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(4)
    ordered = sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))
    for k in (1, 2, 30, 59, 60):
        assert resample.quickselect(df, ["a", "b", "c"], k, pivots) == ordered[k - 1]
    assert resample.quickselect(df, ["a", "b", "c"], 61, pivots) is None
    assert resample.quickselect(df.where(F.lit(False)), ["a", "b", "c"], 1, pivots) is None
