"""Thresholds in lists of any length: arrays, halving and the range count agree."""

import bisect
import random

import pytest

from bitloom.operators import thresholds


def given(spark, n, steps, seed=4):
    rng = random.Random(seed)
    cells = [(i, rng.choice([0, 1, 2, 7, None]), rng.choice([None, 5, rng.randint(-60, 60)])) for i in range(n)]
    lists = [(c, k, t) for c in (0, 1, 2) for k, t in enumerate(sorted(float(rng.choice([5, rng.randint(-70, 70)])) for _ in range(steps)))]
    return cells, lists, spark.createDataFrame(cells, "row_id long, c int, val long"), spark.createDataFrame(lists, "c int, step int, t double")


def brute(cells, lists, shared=False):
    by = {}
    for c, _, t in lists:
        by.setdefault(0 if shared else c, []).append(t)
    reached = lambda c, v: bisect.bisect_right(sorted(by.get(0 if shared else c, [])), v)
    return sorted([(i, c, None if v is None else reached(c, v)) for i, c, v in cells], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("steps", [3, 31, 400])
@pytest.mark.parametrize("most", [100_000, 2])
def test_lists_of_any_length(spark, monkeypatch, steps, most):
    monkeypatch.setattr(thresholds, "MAX_STEPS", most)
    cells, lists, c, t = given(spark, 600, steps)
    assert got(thresholds.multi_threshold(c, t)) == brute(cells, lists)
    assert got(thresholds.multi_threshold(c, t, channel=None)) == brute(cells, lists, True)
    assert got(thresholds.multi_threshold_wide(c, t, chunk=8)) == brute(cells, lists)


def test_range_count_of_a_long_shared_list(spark):
    cells = spark.range(5000).selectExpr("id AS row_id", "CAST(0 AS INT) AS c", "CASE WHEN id % 3 = 0 THEN 1000 ELSE id * 400 END AS val")
    steps = spark.range(2_000_000).selectExpr("CAST(id AS DOUBLE) AS t")
    out = thresholds.range_count(cells, steps, channel=None)
    assert out.where("reached <> least(2000000, val + 1)").count() == 0 and out.count() == 5000


def test_range_count_of_nothing(spark):
    cells, _, c, t = given(spark, 20, 3)
    assert [r["reached"] for r in thresholds.range_count(c, t.where("false")).where("val IS NOT NULL").collect()] == [0] * sum(v is not None for _, _, v in cells)
    assert thresholds.range_count(c.where("false"), t).collect() == []
