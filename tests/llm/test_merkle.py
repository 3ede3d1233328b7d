"""The manifest against a tree built in plain Python, and on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bitloom.llm import merkle

FIELDS = ["doc_id", "source", "text"]
SCHEMA = "doc_id long, source string, text string, `key` string, `run` string, digests string, path string, idx string"


def h(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def leaf(row):
    parts = [b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in row]
    return h(b"".join(parts))


def tree(leaves, arity):
    paths, groups, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        parents, merged = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for s in range(len(run)):
                for i in groups[at + s]:
                    paths[i].append(("".join(run[:s]), "".join(run[s + 1 :])))
            parents.append(h("".join(run)))
            merged.append([i for g in groups[at : at + arity] for i in g])
        nodes, groups = parents, merged
    return nodes[0], paths


def brute(rows, arity):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    made = {}
    for k in keys:
        own = sorted(by[k], key=lambda x: x[:3])
        made[k] = (own, *tree([x[2] for x in own], arity))
    root, above = tree([made[k][1] for k in keys], arity)
    out = []
    for k, top in zip(keys, above):
        own, sub, paths = made[k]
        out += [(x[3], x[2], sub, root, tuple(p + top)) for x, p in zip(own, paths)]
    return sorted(out, key=repr)


def given(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def built(docs, arity):
    out = merkle.manifest(docs, FIELDS, arity=arity).collect()
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["before"], p["after"]) for p in r["path"])) for r in out], key=repr)


def odd_rows():
    rng = random.Random(3)
    rows = [(i, "hot", f"Text {i}") for i in range(70)] + [(i, rng.choice(["a", "b", "é", "", None]), None if i % 7 == 0 else "x" * i) for i in range(70, 110)]
    rows += [(i, f"s{i}", "one of one") for i in range(200, 220)]
    rows += [(None, "hot", "no id"), (None, "hot", "no id"), (5, "hot", "another row of id 5"), (6, "hot", "Text 6"), (300, "long", "word " * 60_000), (301, "long", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest(spark, arity):
    assert built(given(spark, odd_rows()), arity) == brute(odd_rows(), arity)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_of_one_group(spark, n):
    rows = [(i, "s", str(i)) for i in range(n)]
    assert built(given(spark, rows), 16) == brute(rows, 16)


def test_folding_finds_changed_leaves(spark):
    docs = given(spark, odd_rows())
    out = merkle.manifest(docs, FIELDS, carry={"changed": F.when(docs["doc_id"] == 9, merkle.leaf(docs["doc_id"], docs["source"], F.lit("other")))})
    out = out.withColumn("good", merkle.folded(F.col("path"), F.coalesce("changed", "leaf")) == F.col("root"))
    assert {r["doc_id"] for r in out.filter("not good").collect()} == {9}
    want = {r[0]: h("".join(b + a for b, a in r[4])) for r in brute(odd_rows(), 16)}
    got = {r["doc_id"]: r["p"] for r in out.select("doc_id", merkle.proof_digest(F.col("path")).alias("p")).collect()}
    assert {k: v for k, v in got.items() if k not in (None, 5, 6)} == {k: v for k, v in want.items() if k not in (None, 5, 6)}


def test_no_rows(spark):
    assert merkle.manifest(given(spark, []), FIELDS).collect() == []


def test_arity(spark):
    with pytest.raises(ValueError):
        merkle.manifest(given(spark, []), FIELDS, arity=1)
    assert spark.range(1).select(merkle.siblings(F.lit(37).cast("long"), 2).alias("s")).first()["s"] == [36]
    assert spark.range(1).select(merkle.siblings(F.lit(37).cast("long"), 4).alias("s")).first()["s"] == [38, 39, 36]
