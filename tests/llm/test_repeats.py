"""Long repeats against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), len(repeats.runs_of(gone[:-1])), hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [None, "", "short", "x" * 199, "y" * 200, "y" * 201, "ab" * 400, passage[:150], passage[:150]]
    texts += [prose(rng.randint(0, 80)) + passage[rng.randint(0, 30) :] + prose(rng.randint(0, 40)) for _ in range(30)]
    for _ in range(15):
        copy = list(texts[12])
        copy[rng.randrange(len(copy))] = "Z"
        texts.append("".join(copy))
    long = prose(2000)
    texts += [long, long[500:3000], long[:4000] + "!" + long[4000:]] * 2
    return texts


def check(spark, texts, length=200):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, uid string, anchor string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_repeats(spark):
    check(spark, planted())


@pytest.mark.parametrize("how", [{"HOT_BYTES": 0}, {"HOT_BYTES": 3000}, {"INDEX_BYTES": 1}])
def test_repeats_in_small_indexes_and_hot_anchors(spark, monkeypatch, how):
    for name, value in how.items():
        monkeypatch.setattr(repeats, name, value)
    check(spark, planted(), 64)


def test_long_documents_are_cut(monkeypatch):
    rng = random.Random(4)
    data = bytes(rng.choices(b"abc", k=9000)) + b"z" * 500 + bytes(rng.choices(b"abc", k=3000))
    monkeypatch.setattr(repeats, "CHUNK", 1024)
    covered = Counter()
    for docs, offsets, part, starts in repeats._chunks([data[:300], data, b"", data[:100]], 200):
        assert len(part) <= 1024
        for k, at, b, e in zip(docs, offsets, starts, starts[1:]):
            assert part[b:e] == (data[:300], data)[k][at : at + e - b]
            covered.update((k, at + i) for i in range(e - b - 199))
    assert covered == Counter([(0, i) for i in range(101)] + [(1, i) for i in range(len(data) - 199)])


def test_ranges_hold_each_window_once_and_equal_windows_share_an_anchor():
    texts = [(t or "").encode() for t in planted()]
    data, starts = b"".join(texts), np.cumsum([0, *map(len, texts)])
    doc, at, count, anchor, body = repeats.window_ranges(data, starts, 200)
    windows, bodies = {}, {}
    for d, a, n, h, b in zip(doc, at, count, anchor, body):
        assert bodies.setdefault(b, texts[d][a : a + n + 199]) == texts[d][a : a + n + 199]
        for i in range(a, a + n):
            assert windows.setdefault(texts[d][i : i + 200], h) == h
    assert sum(count) == sum(max(0, len(t) - 199) for t in texts)


def test_matching_statistics():
    rng = random.Random(2)
    pieces = [bytes(rng.choices(b"ab\0\xff", weights=[9, 9, 1, 1], k=rng.randint(1, 60))) for _ in range(40)]
    pieces += [pieces[0], pieces[1][5:], b"a" * 60, b"a" * 50]
    stats, starts, runs = repeats.matching_statistics(pieces, 60)
    assert runs < len(stats)
    for k, p in enumerate(pieces):
        for i in range(len(p)):
            best = 0
            for m, q in enumerate(pieces):
                for j in range(len(q)):
                    if (k, i) != (m, j):
                        n = 0
                        while i + n < len(p) and j + n < len(q) and p[i + n] == q[j + n]:
                            n += 1
                        best = max(best, n)
            assert stats[starts[k] + i] == best


def test_repeats_of_the_documents(spark):
    check(spark, [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_no_documents(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
