"""Blocked ordering, frames and running aggregates against plain loops, with blocks far smaller than a key."""

import pytest
from pyspark.sql import GroupedData, functions as F

from framewright.operators import blocks as B, frames as FR


def collect(df, *cols):
    return {(r["sid"], r["idx"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_ordinal_is_dense_per_key(spark):
    rows = [(i % 3 % 2, 7 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, at bigint")
    out = B.ordinal(df, ["k"], ["at"], F.expr("at div 20")).collect()
    for key in (0, 1):
        mine = sorted((r["at"], r["idx"]) for r in out if r["k"] == key)
        assert [i for _, i in mine] == list(range(len(mine)))


def test_ordinal_without_keys_is_global(spark):
    df = spark.range(50).withColumn("h", F.md5(F.col("id").cast("string")))
    out = B.hashed_ordinal(df, [], "h", "id", "place", digits=1).orderBy("place").collect()
    assert [r["place"] for r in out] == list(range(50))
    assert [r["h"] for r in out] == sorted(r["h"] for r in out)


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_framed_equals_whole_series(hot, hot_df, rows):
    got = collect(FR.window_filter(hot_df, ["sid"], "idx", 5, FR.valid_mean("x"), rows=rows), "y")
    for k, v in hot.items():
        for i in range(len(v)):
            near = v[max(0, i - 2) : i + 3]
            assert got[k, i][0] == pytest.approx(sum(near) / len(near))
    assert len(got) == sum(map(len, hot.values()))


@pytest.mark.parametrize("rows", [1, 4, 1000])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_aggregates(hot, hot_df, rows, reverse):
    gap = F.when(F.col("x") > 0.5, F.col("x"))
    specs = {"s": ("sum", F.col("x")), "m": ("min", F.col("x"), "before"), "t": ("max", F.col("x")), "l": ("last", gap)}
    got = collect(B.running(hot_df, ["sid"], "idx", specs, rows=rows, reverse=reverse), "s", "m", "t", "l")
    for k, v in hot.items():
        order = range(len(v) - 1, -1, -1) if reverse else range(len(v))
        seen = []
        for i in order:
            before, seen = list(seen), seen + [v[i]]
            s, m, t, last = got[k, i]
            assert s == pytest.approx(sum(seen))
            assert m == (min(before) if before else None)
            assert t == max(seen)
            big = [x for x in seen if x > 0.5]
            assert last == (big[-1] if big else None)


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_spans_find_their_rows(spark, hot, hot_df, block):
    spans = spark.createDataFrame([(0, 3, 9), (0, 9, 10), (0, 40, 77), (2, 0, 8), (1, 5, 5)], "sid bigint, a bigint, z bigint")
    want = {(s, i) for s, a, z in [(0, 3, 9), (0, 9, 10), (0, 40, 77), (2, 0, 8)] for i in range(a, z)}
    got = B.in_spans(hot_df, spans, ["sid"], "idx", "a", "z", block=block)
    assert {(r["sid"], r["idx"]) for r in got.collect()} == want
    assert got.count() == len(want)
    left = B.in_spans(hot_df, spans, ["sid"], "idx", "a", "z", "left", block=block)
    assert left.count() == hot_df.count()


def test_median_takes_the_lower_middle(spark):
    df = spark.createDataFrame([(0, 0, 4.0), (0, 1, None), (0, 2, 1.0), (0, 3, None), (0, 4, None)], "sid bigint, idx bigint, x double")
    got = collect(FR.median_filter(df, ["sid"], "idx", "x", 3), "y")
    assert [got[0, i][0] for i in range(5)] == [4.0, 1.0, 1.0, 1.0, None]


def test_mean_of_zero_is_missing(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (0, 2, 5.0)], "sid bigint, idx bigint, x double")
    got = collect(FR.mean_filter(df, ["sid"], "idx", "x", 3), "y")
    assert got[0, 0][0] is None and got[0, 1][0] == pytest.approx(5 / 3)


def test_chunks_with_context_equal_the_whole(hot, hot_df):
    def double(pdf):
        return pdf.assign(y=pdf["x"].rolling(3, center=True, min_periods=1).sum())[["sid", "idx", "y"]]

    got = collect(FR.chunk_apply(hot_df, ["sid"], "idx", 4, 1, double, "sid bigint, idx bigint, y double"), "y")
    for k, v in hot.items():
        for i in range(len(v)):
            assert got[k, i][0] == pytest.approx(sum(v[max(0, i - 1) : i + 2]))


def test_split_on_silence_drops_a_silent_key(spark):
    rows = [(0, i, 0.0) for i in range(10)] + [(1, i, 9.0 if i in (0, 9) else 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "sid bigint, idx bigint, x double")
    out = FR.split_on_silence(df, ["sid"], "idx", "x", 4, 1.0, 1, rows=3).orderBy("idx").collect()
    assert [(r["sid"], r["idx"], r["out_idx"]) for r in out] == [(1, 0, 0), (1, 1, 1), (1, 8, 2), (1, 9, 3)]


def test_null_keys_are_kept_or_refused(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (None, 0, 2.0), (None, 1, 4.0)], "sid bigint, idx bigint, x double")
    grouped = B.with_group(rows, ["sid"], top=F.max("x"))
    assert sorted((r["top"] for r in grouped.collect())) == [1.0, 4.0, 4.0]
    lost = spark.createDataFrame([(1, 0, 1.0), (1, None, 2.0)], "sid bigint, idx bigint, x double")
    assert B.framed(lost, ["sid"], "idx", 1, 1, lambda w: {"n": F.count("x").over(w)}).count() == 2
    for bad in (rows, lost):
        with pytest.raises(Exception, match="a row of a series needs"):
            B.running(bad, ["sid"], "idx", {"s": ("sum", F.col("x"))}).collect()
    with pytest.raises(Exception, match="a row of a series needs"):
        B.ordinal(rows, ["sid"], ["idx"], F.lit(0)).collect()


def test_items_longer_than_the_others_are_padded_whole(spark):
    from framewright.operators.sampling import collate_pad

    rows = spark.range(1000).selectExpr("0 AS b", "1 AS i", "id AS idx", "1.0D AS x").union(spark.range(3).selectExpr("0", "2", "id", "1.0D"))
    out = collate_pad(rows, "b", "i", "idx", "x")
    assert {(r["i"], r["n"], r["s"]) for r in out.groupBy("i").agg(F.count("x").alias("n"), F.sum("x").alias("s")).collect()} == {(1, 1000, 1000.0), (2, 1000, 3.0)}


def test_stretches_come_in_blocks_and_whole(spark):
    from framewright.operators.blocks import stretched

    rows = [(0, 3, 20), (1, 5, 5), (2, 5, 4), (3, -3, 2), (4, None, 3)]
    df = spark.createDataFrame(rows, "k int, a bigint, b bigint")
    for size in (1, 4, 1000):
        got = sorted((r["k"], r["i"]) for r in stretched(df, "a", "b", "i", size).collect())
        assert got == [(k, i) for k, a, b in rows if a is not None for i in range(a, b + 1)]


@pytest.mark.parametrize("block", [4, 12, 1 << 16])
def test_chunks_are_cut_in_the_task(spark, monkeypatch, block):
    """Only rows at the edges of blocks are sent twice, and no chunk or short series takes a call from Spark; keys and positions that are NULL stay."""
    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    monkeypatch.setattr(FR, "BLOCK_ROWS", block)
    monkeypatch.setattr(FR, "FLUSH_ROWS", 100)
    rows = [(k, i, float(i * (k or 7) % 11)) for k in [None, *range(1, 300)] for i in range(k % 23 if k else 9)] + [(5, None, 3.0)]
    df = spark.createDataFrame(rows, "sid bigint, idx bigint, x double").repartition(3)
    seen = lambda pdf: pdf.assign(n=len(pdf), total=pdf["x"].sum())[["sid", "idx", "n", "total"]]
    got = FR.chunk_apply(df, ["sid"], "idx", 4, 2, seen, "sid bigint, idx bigint, n bigint, total double").collect()
    series = {}
    for k, i, x in rows:
        series.setdefault(k, {})[i] = x
    near = lambda k, i: [x for j, x in series[k].items() if i is j or None not in (i, j) and i // 4 * 4 - 2 <= j < i // 4 * 4 + 6]
    key = lambda r: tuple((v is None, v or 0) for v in r[:2])
    assert sorted(map(tuple, got), key=key) == sorted([(k, i, len(near(k, i)), sum(near(k, i))) for k, i, _ in rows], key=key)
