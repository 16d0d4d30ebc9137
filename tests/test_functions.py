"""Scalar functions: inverses, edges and formats."""

import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.functions import languages as L, pitch as P, scalars as S, text as X
from framewright.operators import manifest as M, metrics, rules as RU


def one(spark, *cols, **values):
    items = ", ".join(f"{v} AS {k}" for k, v in values.items()) or "1 AS one"
    return spark.sql(f"SELECT {items}").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("hz", [50.0, 126.8, 440.0, 1100.0])
def test_pitch_inverses(spark, hz):
    f = F.col("f")
    r = one(spark, P.cents_to_hz(P.hz_to_cents(f)), P.erb_to_hz(P.hz_to_erb(f)), P.semitones(P.semitones(f, 7), -7), f=f"{hz}D")
    assert list(r) == pytest.approx([hz] * 3)


def test_coarse_pitch_range(spark):
    r = one(spark, P.coarse(F.lit(0.0)), P.coarse(F.lit(50.0)), P.coarse(F.lit(1100.0)), P.coarse(F.lit(9000.0)))
    assert list(r) == [1, 1, 255, 255]


def test_pitch_on_a_bin_edge_keeps_its_bin(spark):
    cents = P.hz_to_cents(F.lit(126.8))
    assert list(one(spark, P.cents_to_bin(cents), P.cents_to_bin(cents, up=True))) == [120, 120]


def test_level_inverses(spark):
    x = F.col("x")
    db = S.amp_to_db(x)
    r = one(
        spark, S.db_to_amp(db), S.expand_range(S.compress_range(x, 3.0), 3.0), S.dequantise(S.quantise(x, 8), 8),
        S.db_to_amp(S.range_denormalise(S.range_normalise(db))), S.mulaw_decode((S.mulaw_encode(x, 16) * 2.0) / 65535.0 - 1.0, 16), x="0.25D",
    )
    assert list(r) == pytest.approx([0.25] * 5, rel=1e-3)


def test_pcm_is_clipped_and_truncated(spark):
    assert list(one(spark, *[S.pcm16(F.lit(v)) for v in (1.0, -2.0, 0.00005, -0.00005)])) == [32767, -32768, 1, -1]


def test_timestamps(spark):
    r = one(spark, X.format_timestamp("a"), X.format_timestamp("a", True, ","), X.format_timestamp("b"), X.format_timestamp("h"), a="61.0005D", b="0.0015D", h="3600D")
    assert list(r) == ["01:01.000", "00:01:01,000", "00:00.002", "01:00:00.000"]
    with pytest.raises(Exception, match="negative"):
        one(spark, X.format_timestamp("a"), a="-1D")


def test_paths(spark):
    p = F.col("p")
    assert list(one(spark, X.speaker_from_path(p), X.speaker_from_path(p, True), p="'a/b/jonny.spk.npy'")) == ["jonny", "jo"]


def test_casts(spark):
    r = one(spark, X.optional_number("n"), X.optional_number("i", "bigint"), X.exact_bool(F.col("t")), X.exact_bool(F.col("l")), n="'None'", i="'12'", t="'True'", l="'true'")
    assert list(r) == [None, 12, True, None]


def test_compression_ratio_is_zlib(spark):
    text = "na " * 400
    assert one(spark, X.compression_ratio(F.lit(text)))[0] == pytest.approx(len(text) / len(zlib.compress(text.encode())))


def test_compression_ratio_keeps_no_copy_of_a_text():
    """Texts are read where Arrow has them and what is deflated is only counted, by pieces and as a whole alike."""
    rng = random.Random(6)
    texts = ["", None, "é" * 100_000, "".join(chr(rng.randrange(33, 0x3000)) for _ in range(700_000))]
    column = pa.array(texts)
    tracemalloc.start()
    got = X.compression_ratio.func(column).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000
    assert got == [None if t is None else len(t.encode()) / len(zlib.compress(t.encode())) for t in texts]


def test_languages(spark):
    assert len(L.NAME_OF) == 99 and len(L.CODE_OF) == 110
    r = one(spark, *[L.language_code(F.lit(t)) for t in ("EN", "Haitian Creole", "flemish", "klingon")], L.language_name(F.lit("ht")))
    assert list(r) == ["en", "ht", "nl", None, "haitian creole"]


@pytest.mark.parametrize("n,cells", [(10, 1), (100, 2), (10**6, 16000), (10**9, 505964)])
def test_cells(spark, n, cells):
    assert one(spark, S.ivf_cells("n"), n=f"{n}L")[0] == cells


def test_rules_and_overlays(spark):
    df = spark.createDataFrame([(1, 5.0, "A", None), (2, None, "b", 1), (3, 50.0, "z", 1)], "id int, x double, s string, alt int")
    rules = [RU.Rule("x", required=True, low=6, high=40, instead_of="alt"), RU.Rule("s", allowed=("a", "b"), needs=("alt",))]
    got = sorted((r["id"], r["field"], r["problem"]) for r in RU.violations(df, ["id"], rules).collect())
    assert got == [(1, "s", "needs alt"), (1, "x", "below minimum"), (2, "x", "required"), (3, "s", "not allowed")]


@pytest.mark.parametrize("n,size", [(1, 8), (8, 8), (17, 8), (59, 7)])
def test_even_batches(spark, n, size):
    out = M.even_batches(spark.range(n).selectExpr("id", "0 AS k"), ["k"], "id", size).orderBy("id").collect()
    k = -(-n // size)
    sizes = [n // k + (1 if b < n % k else 0) for b in range(k)]
    assert [r["batch"] for r in out] == [b for b, s in enumerate(sizes) for _ in range(s)]


@pytest.mark.parametrize("n", [1, 5, 16, 17])
def test_every_replica_gets_whole_batches(spark, n):
    items = spark.range(n).selectExpr("id AS doc_id", "0L AS bucket")
    out = M.rank_batches(M.wrap_pad(items, "bucket", "doc_id", 16), 2, 8)
    assert {r["count"] for r in out.groupBy("replica", "batch").count().collect()} == {8}
    assert out.select("doc_id").distinct().count() == n
    assert [r["doc_id"] for r in out.orderBy("pos").collect()] == [p % n for p in range(-(-n // 16) * 16)]


def test_retention_keeps_the_newest(spark):
    df = spark.range(20).selectExpr("id % 2 AS name", "id")
    gone = metrics.retention(df, ["name"], "id", [F.desc("id")], 3)
    assert sorted(r["id"] for r in gone.collect()) == list(range(14))
    assert metrics.retention(df, ["name"], "id", [F.desc("id")], 0).count() == 0
