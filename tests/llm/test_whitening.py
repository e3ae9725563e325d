import math

import numpy as np
import pytest

from codelode.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, x string, component int, n double"


def rows_of(seed, n=300, d=7):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3
    data[::3] = data[0]  # a third of all rows alike
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(5, data[5].tolist()), (5, data[5].tolist()), (None, data[7].tolist())]
    return rows + [(900, None), (901, [math.nan] * d), (902, [math.inf] + [0.0] * (d - 1)), (903, [None] + [0.0] * (d - 1)), (904, []), (905, [1.0])]


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "c", 0, 0.0) for i, v in rows], SCHEMA).repartition(4)
    return wh.whiten(df).collect()


def expected(rows):
    held = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    size = max({len(v) for _, v in held}, key=lambda s: (sum(len(v) == s for _, v in held), s))
    held = [(i, v) for i, v in held if len(v) == size]
    listed = sorted({tuple(v) for _, v in held})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    x = np.array(listed, float)
    values, axes = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)) / n)
    out = []
    for i, v in held:
        far = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for k in range(1, min(4, size) + 1):
            out.append((i, k, n, far, abs((np.array(v) - x.mean(0)) @ axes[:, -k]) / values[-k] ** 0.5, values[-k] / values.sum()))
    return out


def test_against_plain_numpy(spark):
    rows = rows_of(1)
    got, want = run(spark, rows), expected(rows)
    assert len(got) == len(want)
    order = lambda r: (str(r[0]), r[1], r[3], round(abs(r[4]), 6))
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert tuple(g[:4]) == w[:4] and abs(g.whitened) == pytest.approx(w[4], abs=1e-9) and g.explained == pytest.approx(w[5], rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("low,high,rows", [(0, 1, 5), (-130, 120, 200), (-2 ** 40, 2 ** 40, 70), (-2 ** 63, 2 ** 63 - 1, 65)])
def test_scatter_is_exact(low, high, rows):
    x = np.random.default_rng(3).integers(low, high, (rows, 5), endpoint=True)
    sums, cross = wh.scatter(x)
    whole = x.astype(object)
    assert list(sums) == list(whole.sum(0)) and (cross == np.triu(whole.T @ whole)).all()
    assert wh.deviations(x // 2) == [int((r * r).sum()) for r in (x // 2).astype(object)]


def test_large_values(spark):
    rows = [(i, [c * 1e12 for c in v]) if v and v[0] is not None else (i, v) for i, v in rows_of(2)]
    far = {(r.vec_id, int(r.deviation)) for r in run(spark, rows)}
    assert far == {(w[0], w[3]) for w in expected(rows)}


def test_without_variance(spark):
    one = run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    flat = run(spark, [(i, [i * 1.0, 3.0, 0.0]) for i in range(4)])
    assert {r.component for r in flat if r.whitened is None} == {2, 3} and flat[0].identity_error < 1e-12


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
