"""Longest paths against a plain topological pass, on graphs of many shapes."""

import random

import pytest

from bitloom.operators import paths


def brute(nodes, edges):
    own, before, done = dict(nodes), {}, {}
    for s, d in edges:
        before.setdefault(d, []).append(s)
    for n in sorted(own):  # ids rise along the edges
        done[n] = own[n] + max((done[s] for s in before.get(n, ())), default=0)
    return done


def solve(spark, graphs, width):
    nodes = [(m, n, c) for m, (own, _) in graphs.items() for n, c in own]
    edges = [(m, s, d) for m, (_, links) in graphs.items() for s, d in links]
    n = spark.createDataFrame(nodes, "model_id string, layer_id int, cycles long")
    e = spark.createDataFrame(edges, "model_id string, src int, dst int")
    return {(r["model_id"], r["layer_id"]): r["path"] for r in paths.critical_path(n, e, width).collect()}


def shapes():
    rng = random.Random(6)
    cost = lambda n: [(i, rng.randint(0, 50)) for i in range(n)]
    return {
        "alone": (cost(3), []),
        "chain": (cost(40), [(i, i + 1) for i in range(39)]),
        "skips": (cost(41), [(i, i + 1) for i in range(40)] + [(i, i + 4) for i in range(0, 37, 4)]),
        "layers": (cost(36), [(i, j) for k in range(11) for i in range(3 * k, 3 * k + 3) for j in range(3 * k + 3, 3 * k + 6)]),
        "into a hub": (cost(81), [(i, 80) for i in range(80)] + [(i, i + 1) for i in range(0, 70, 2)]),
        "out of a hub": (cost(61), [(0, i) for i in range(1, 60)] + [(i, 60) for i in range(1, 60)]),
        "random": (cost(60), [(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.1] + [(0, 1), (0, 1)]),
        "dense": (cost(24), [(i, j) for i in range(24) for j in range(i + 1, 24)]),
    }


@pytest.mark.parametrize("width", [4, 16])
def test_shapes(spark, width):
    want = {(m, n): p for m, (own, links) in shapes().items() for n, p in brute(own, links).items()}
    assert solve(spark, shapes(), width) == want


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = paths._round
    monkeypatch.setattr(paths, "_round", lambda *a: rounds.append(1) or plain(*a))
    n = 100_000
    nodes = spark.range(n).selectExpr("'m' AS model_id", "CAST(id AS INT) AS layer_id", "id % 7 + 1 AS cycles")
    edges = spark.range(n - 1).selectExpr("'m' AS model_id", "CAST(id AS INT) AS src", "CAST(id + 1 AS INT) AS dst")
    out = paths.critical_path(nodes, edges)
    assert out.selectExpr("max(path)", "count(*)").first() == (sum(i % 7 + 1 for i in range(n)), n)
    assert len(rounds) < 40


@pytest.mark.parametrize("length", [1, 2, 3, 5])
def test_cycles(spark, length):
    links = [(i, (i + 1) % length) for i in range(length)] + [(0, 10), (10, 11)]
    with pytest.raises(Exception, match="cycle"):
        solve(spark, {"good": ([(0, 1), (1, 1)], [(0, 1)]), "bad": ([(i, 1) for i in range(12)], links)}, 16)


def test_no_nodes(spark):
    n = spark.createDataFrame([], "model_id string, layer_id int, cycles long")
    assert paths.critical_path(n, spark.createDataFrame([], "model_id string, src int, dst int")).collect() == []
