"""Tiled search, weights and k-means against numpy."""

import tempfile

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from framewright.operators import retrieval as R


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)).round(3)
    v[20:40] = v[20]
    v[41] = 0
    return v


@pytest.fixture(scope="module")
def base(spark, data):
    return spark.createDataFrame([(i, i % 2, [float(t) for t in r]) for i, r in enumerate(data)], "vec_id bigint, spk int, v array<double>")


def brute(q, rows, ids, k):
    d2 = ((rows - q) ** 2).sum(1)
    return [ids[i] for i in np.lexsort((ids, d2))[:k]]


@pytest.mark.parametrize("tile", [4, 7, 2048])
@pytest.mark.parametrize("keys", [[], ["spk"]])
def test_nearest_is_exact_with_copies_and_ties(data, base, tile, keys):
    queries = base.select("spk", F.col("vec_id").alias("q"), "v")
    got = {}
    for r in R.nearest(queries, base, 5, keys, tile=tile).orderBy("rank").collect():
        got.setdefault(r["q"], []).append(r["vec_id"])
    ids = np.arange(len(data))
    for q in range(len(data)):
        mine = ids[ids % 2 == q % 2] if keys else ids
        assert got[q] == brute(data[q], data[mine], mine, 5)


def test_weights_sum_to_one_and_exact_match_wins(base):
    queries = base.select(F.col("vec_id").alias("q"), "v")
    w = R.inverse_square_weights(R.nearest(queries, base, 3, carry="base"))
    sums = w.groupBy("q").agg(F.sum("w").alias("s"), F.max(F.when(F.col("d2") > 0, F.col("w"))).alias("far")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    assert all(r["far"] in (None, 0.0) for r in sums)


def test_blend_passes_through_when_off_or_at_zero_ratio(base):
    cents = base.where("vec_id < 4").select(F.col("vec_id").alias("cell"), "v")
    postings = R.assign_cells(base, cents)
    queries = base.select(F.col("vec_id").alias("q"), F.reverse("v").alias("v"))
    own = sorted((r["q"], r["v"]) for r in R.retrieval_blend(queries, postings, cents, enabled=False).collect())
    zero = sorted((r["q"], r["v"]) for r in R.retrieval_blend(queries, postings, cents, ratio=0.0).collect())
    assert [q for q, _ in own] == [q for q, _ in zero]
    assert np.allclose([v for _, v in own], [v for _, v in zero])
    with pytest.raises(ValueError):
        R.retrieval_blend(queries, postings, cents, ratio=1.5)


def test_kmeans_does_not_get_worse_and_keeps_every_cell(spark, data, base):
    counts = spark.createDataFrame([(0, 5), (1, 3)], "spk int, k int")
    loss = []
    for rounds in (0, 4):
        cents = R.kmeans(base, counts, ["spk"], iterations=rounds)
        assert {r["spk"]: r["count"] for r in cents.groupBy("spk").count().collect()} == {0: 5, 1: 3}
        loss.append(R.assign_cells(base, cents, ["spk"]).agg(F.sum("d2")).first()[0])
    assert loss[1] <= loss[0]


def test_compress_only_above_threshold(base):
    out = R.compress(base.where("spk = 0 OR vec_id < 20"), ["spk"], threshold=15, clusters=4, iterations=1)
    assert {r["spk"]: r["count"] for r in out.groupBy("spk").count().collect()} == {0: 4, 1: 10}


def test_index_is_not_overwritten_by_accident(base):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/index"
    cents = base.where("vec_id < 2").select("spk", F.lit(0).cast("bigint").alias("cell"), "v")
    postings = R.assign_cells(base, cents, ["spk"])
    R.save_index(cents, postings, path, ["spk"])
    with pytest.raises(AnalysisException):
        R.save_index(cents, postings, path, ["spk"])
    R.save_index(cents, postings, path, ["spk"], rewrite=True)
    assert base.sparkSession.read.parquet(f"{path}/postings").count() == base.count()


def test_saved_index_is_read_by_group(spark, base):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/index"
    named = base.withColumn("speaker", F.concat(F.lit("0"), "spk")).drop("spk")
    cents = named.where("vec_id < 2").select("speaker", F.lit(0).cast("bigint").alias("cell"), "v")
    R.save_index(cents, R.assign_cells(named, cents, ["speaker"]), path, ["speaker"])
    _, everything = R.load_index(spark, path, {"speaker": "string"})
    assert {r["speaker"]: r["count"] for r in everything.groupBy("speaker").count().collect()} == {"00": 30, "01": 30}
    cents, postings = R.load_index(spark, path, {"speaker": "string"}, F.col("speaker").startswith("01"))
    assert cents.count() == 1 and {r["speaker"] for r in postings.collect()} == {"01"}
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(speaker" in plan
    queries = named.where("speaker = '01'").select("speaker", F.col("vec_id").alias("q"), "v")
    assert R.knn_ivf(queries, postings, cents, 1, ["speaker"]).where("d2 = 0").count() == 30


@pytest.mark.parametrize("tile", [2, 1000])
def test_code_probabilities_at_a_very_low_temperature(spark, tile):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001])]
    codes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "code bigint, v array<double>")
    got = R.soft_codes(spark.createDataFrame(rows, "q bigint, v array<double>"), codes, 1e-5, tile).orderBy("q").collect()
    assert [(r["q"], r["code"]) for r in got] == [(0, 0), (1, 1), (2, 0)]
    assert [r["prob"] for r in got] == pytest.approx([0.5, 1.0, 0.5])


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("seeding", ["spread", "sample"])
def test_rounds_are_lloyds_with_broadcast_centroids_or_tiles(spark, data, base, monkeypatch, seeding, limit):
    monkeypatch.setattr(R, "BROADCAST_BYTES", limit)
    counts = spark.createDataFrame([(0, 4), (1, 3)], "spk int, k int")
    as_dict = lambda df: {(r["spk"], r["cell"]): np.array(r["v"]) for r in df.collect()}
    start = as_dict(R.kmeans(base, counts, ["spk"], iterations=0, seeding=seeding))
    assert sorted(start) == [(0, c) for c in range(4)] + [(1, c) for c in range(3)]
    got = as_dict(R.kmeans(base, counts, ["spk"], iterations=3, seeding=seeding))
    for spk in (0, 1):
        rows, cents = data[np.arange(len(data)) % 2 == spk], np.array([start[k] for k in sorted(start) if k[0] == spk])
        for _ in range(3):
            at = ((rows[:, None] - cents) ** 2).sum(2).argmin(1)
            cents = np.array([rows[at == c].mean(0) if (at == c).any() else cents[c] for c in range(len(cents))])
        assert np.allclose(cents, [got[k] for k in sorted(got) if k[0] == spk])


def test_rounds_end_when_nothing_moves(spark, monkeypatch):
    df = spark.createDataFrame([(0, i, [float(i // 10 * 100), float(i % 2)]) for i in range(30)], "g int, vec_id bigint, v array<double>")
    made = []
    means = R.cell_means
    monkeypatch.setattr(R, "cell_means", lambda *a: made.append(1) or means(*a))
    cents = R.kmeans(df, spark.createDataFrame([(0, 3)], "g int, k int"), ["g"], iterations=50)
    assert sorted(r["v"] for r in cents.collect()) == [[0.0, 0.5], [100.0, 0.5], [200.0, 0.5]] and len(made) <= 3


def test_spread_seeds_find_far_groups_and_stop_at_copies(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 5)) * 50
    rows = [(0, i, (middles[0 if i < 300 else i % 12] + rng.normal(size=5) * 0.01).tolist()) for i in range(420)]
    rows += [(1, i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)] + [(1, 50, [0.0] * 5)]
    df = spark.createDataFrame(rows, "g int, vec_id bigint, v array<double>").repartition(4)
    seeds = R.spread_seeds(df, spark.createDataFrame([(0, 12), (1, 5)], "g int, k int"), ["g"], 0).collect()
    found = [r["v"] for r in seeds if r["g"] == 0]
    assert {int(((middles - np.array(v)) ** 2).sum(1).argmin()) for v in found} == set(range(12))
    assert sorted(r["v"] for r in seeds if r["g"] == 1) == [[0.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0]]


def test_search_reads_only_probed_cells(spark, base):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/index"
    cents = base.where("vec_id IN (0, 7, 20, 41)").select(F.col("vec_id").alias("cell"), "v")
    R.save_index(cents, R.assign_cells(base, cents), path, [])
    cents, postings = R.load_index(spark, path, {})
    queries = base.where("vec_id = 25").select(F.col("vec_id").alias("q"), "v")
    near = R.knn_ivf(queries, postings, cents, 2, carry="base")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(cell" in plan.replace("[isnotnull(cell#", "[(cell#")
    assert [(r["vec_id"], r["d2"]) for r in near.orderBy("rank").collect()] == [(20, 0.0), (21, 0.0)]


def test_rows_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """With ten times the vectors a row is sent no more often, until blocks are full; a few base vectors still meet many query blocks."""
    rng = np.random.default_rng(8)
    sent = {}
    for n in (400, 4000):
        rows = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id bigint, g bigint, v array<double>")
        left, right = R._tiles(df.select(F.col("vec_id").alias("q"), "v"), df.select("vec_id", "v"), [], "q", "vec_id", 10)
        assert left.count() == right.count()
        sent[n] = left.count() / n
        by = ["g"]
        left, right = R._tiles(df.select("g", F.col("vec_id").alias("q"), "v"), df.select("g", "vec_id", "v"), by, "q", "vec_id", 10)
        assert max(left.count(), right.count()) <= R.SPREAD * n
    assert sent == {400: R.SPREAD, 4000: R.SPREAD}
    left, right = R._tiles(df.select(F.col("vec_id").alias("q"), "v"), df.where("vec_id < 20").select("vec_id", "v"), [], "q", "vec_id", 10)
    assert left.select("_qb").distinct().count() == 400 and left.count() <= R.SPREAD * 4000
    monkeypatch.setattr(R, "BLOCK_BYTES", 4000 * 32 // 20)
    left, right = R._tiles(df.select(F.col("vec_id").alias("q"), "v"), df.select("vec_id", "v"), [], "q", "vec_id", 10)
    assert left.count() == right.count() == 20 * 4000


@pytest.mark.parametrize("scores", [1, 700])
def test_scores_held_at_a_time_do_not_change_results(spark, scores):
    """Near and coded alike however few scores a tile holds at a time."""
    rng = np.random.default_rng(9)
    m, codes = rng.normal(size=(300, 5)), rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "q bigint, v array<double>")
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(codes)], "code bigint, v array<double>")
    held, R.SCORES = R.SCORES, scores
    try:
        near = {(r["q"], r["rank"]): r["vec_id"] for r in R.nearest(df, base.withColumnRenamed("code", "vec_id"), 2, tile=64).collect()}
        coded = {r["q"]: (r["code"], r["prob"]) for r in R.soft_codes(df, base, 0.5, tile=64).collect()}
    finally:
        R.SCORES = held
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    logits = unit(m) @ unit(codes).T / 0.5
    for i in range(300):
        order = np.argsort(((m[i] - codes) ** 2).sum(1))
        assert [near[i, 1], near[i, 2]] == order[:2].tolist()
        assert coded[i][0] == logits[i].argmax() and coded[i][1] == pytest.approx(np.exp(logits[i].max()) / np.exp(logits[i]).sum())
