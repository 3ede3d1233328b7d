"""Whitening against an eigendecomposition in numpy, and on odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, dim string, component string, n string"


def given(spark, vectors, kind="float"):
    rows = [(i, v, 1, "a", "b", "c", "d") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA.replace("array<float>", f"array<{kind}>"))


def brute(vectors, most=4):
    """By row: x; and n, sums, eigenvalues, vectors and trace of the distinct ones."""
    good = [(i, tuple(math.floor(256 * np.float64(np.float32(c))) for c in v)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((n, d) for d, n in Counter(len(x) for _, x in good).items())[1]
    good = [(i, x) for i, x in good if len(x) == dim]
    fit = np.array(sorted({x for _, x in good}), float)
    centred = fit - fit.mean(0)
    _, sizes, u = np.linalg.svd(centred, full_matrices=False)
    e = sizes**2 / len(fit)
    return good, len(fit), [sum(int(c) for c in col) for col in fit.T], e[:most], u[:most].T, e.sum()


def check(rows, vectors, most=4, near=1e-9):
    good, n, sums, e, u, trace = brute(vectors, most)
    assert Counter(r["vec_id"] for r in rows) == Counter(i for i, _ in good for _ in range(len(e)))
    by = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=near)
    assert sorted(by) == list(range(1, len(e) + 1))
    mean, far = np.array(sums) / n, lambda x: sum((n * a - s) ** 2 for a, s in zip(x, sums))
    for c, part in by.items():
        want = sorted((i is None, i or 0, far(x) if far(x) < 2**63 else None, float((np.array(x) - mean) @ u[:, c - 1] / math.sqrt(e[c - 1]))) for i, x in good)
        got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in part)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        a, b = np.array([g[3] for g in got]), np.array([w[3] for w in want])
        sign = np.sign((a * b).sum())
        np.testing.assert_allclose(np.sort(a * sign), np.sort(b), atol=near)


def spread(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) * np.geomspace(3, 0.1, dim)) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0] + 2


def test_whitening(spark):
    data = [(i, v.tolist()) for i, v in enumerate(spread(300, 12))]
    data += data[:40] + [(1000 + i, data[0][1]) for i in range(200)] + [(None, data[5][1]), (None, data[6][1])]
    check(whitening.whiten(given(spark, data)).collect(), data)


def test_odd_vectors(spark):
    data = [(i, v.tolist()) for i, v in enumerate(spread(60, 5))]
    data += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]), (105, [0.0] * 5), (106, [-0.0] * 5), (107, [1.0] * 3)]
    rows = whitening.whiten(given(spark, data)).collect()
    check(rows, data)
    assert {105, 106} <= {r["vec_id"] for r in rows} and not {100, 101, 102, 103, 104, 107} & {r["vec_id"] for r in rows}


def test_dependent_dimensions_give_fewer_components(spark):
    base = spread(80, 2)
    data = [(i, [*(np.floor(v * 256) / 256).tolist(), 3.0, float(np.floor(v[0] * 256) / 256)]) for i, v in enumerate(base)]
    rows = whitening.whiten(given(spark, data)).collect()
    assert {r["component"] for r in rows} == {1, 2}
    check(rows, data, most=2)


def test_wide_range_of_spreads(spark):
    rng = np.random.default_rng(2)
    data = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 3)) * [4e5, 40, 0.05])]
    rows = whitening.whiten(given(spark, data)).collect()
    check(rows, data, most=3, near=1e-7)


def test_exact_deviations_of_large_entries(spark):
    data = [(i, [float(2.0 ** (40 + i)), float(i)]) for i in range(5)]
    rows = whitening.whiten(given(spark, data, "double")).collect()
    x = [[2 ** (48 + i), 256 * i] for i in range(5)]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((5 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    got = {r["vec_id"]: r["deviation"] for r in rows}
    assert got == {i: (d if d < 2**63 else None) for i, d in enumerate(want)}


@pytest.mark.parametrize("data", [[], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])], [(1, None)]])
def test_no_spread_no_rows(spark, data):
    out = whitening.whiten(given(spark, data))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
