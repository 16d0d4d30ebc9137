"""Whitening against numpy's eigenvectors, and the exact integers against Python's."""

import math

import numpy as np
import pytest

from framewright.llm import whiten as wh

RNG = np.random.default_rng(13)
BASE = RNG.normal(size=(300, 9)) @ RNG.normal(size=(9, 9)) * 0.1
BAD = [(1000, None), (1001, [None] * 9), (1002, [math.nan] + [0.0] * 8), (1003, [math.inf] + [0.0] * 8), (1004, []), (1005, [1.0] * 4)]
ROWS = [(i, v.tolist(), 1, 2) for i, v in enumerate(BASE)] + [(*b, 1, 2) for b in BAD] + [(5, BASE[5].tolist(), 1, 2), (None, BASE[6].tolist(), 1, 2)]
ROWS += [(2000 + i, BASE[0].tolist(), 1, 2) for i in range(100)]


def run(spark, rows, kind="double", **opts):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, n int, z int").repartition(5)
    return wh.whiten(df, **opts)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_components_are_those_of_numpy(spark, kind):
    got = run(spark, ROWS, kind).collect()
    fine = [(i, np.array(v, np.float32 if kind == "float" else np.float64)) for i, v, *_ in ROWS if v and len(v) == 9 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in fine])
    n, sums = len(x), x.sum(0)
    values, units = np.linalg.eigh((x - sums / n).T @ (x - sums / n) / n)
    values, units = values[::-1], units[:, ::-1]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 9))
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    deviations = sorted((repr(i), sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))) for (i, _), v in zip(fine, x))
    assert sorted((repr(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == deviations
    for k in range(8):
        mine = sorted((repr(r["vec_id"]), r["whitened"]) for r in got if r["component"] == k + 1)
        want = sorted((repr(i), z) for (i, _), z in zip(fine, (x - sums / n) @ units[:, k] / np.sqrt(values[k])))
        a, b = np.array([v for _, v in mine]), np.array([v for _, v in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        shares = {r["explained"] for r in got if r["component"] == k + 1}
        assert len(shares) == 1 and shares.pop() == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_small_ranks_and_empty_tables(spark):
    line = [(i, [float(i), 2.0 * i, 0.5], 1, 2) for i in range(20)]
    assert {r["component"] for r in run(spark, line).collect()} == {1}
    assert run(spark, line[:1]).count() == 0 and run(spark, []).count() == 0 and run(spark, [(1, None, 1, 2)]).count() == 0
    assert run(spark, line, components=0).count() == 0


def test_decomposition_of_hard_matrices():
    for a in (np.diag([1e12, 1.0, 1e-6]), np.ones((5, 5)), np.eye(7), np.zeros((3, 3)), (lambda m: m @ m.T)(RNG.normal(size=(40, 40)) * np.logspace(0, -5, 40))):
        values, units = wh.principal(a)
        assert np.allclose(units.T @ units, np.eye(len(values)), atol=1e-12)
        assert np.allclose(units * values @ units.T, a, atol=1e-12 * max(1, np.abs(a).max()))
        assert (np.diff(values) <= 1e-12 * values[:1].max(initial=0)).all()


def test_overflow_is_an_error(spark):
    rows = [(i, [1e9 * (i % 2)] * 4, 1, 2) for i in range(5000)]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, rows).count()
