"""Repeated passages against a brute-force version, and on odd rows."""

import random
import re

import numpy as np
import pytest

from bitloom.llm import passages

SCHEMA = "doc_id long, text string, id string, th string, marks string, anchor string, `rows` string"


def brute(docs, length):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    order = [(i is None, i or 0) for i, _ in docs]
    first = {}
    for w, o in zip(words, order):
        for s in range(len(w) - length + 1):
            g = tuple(w[s : s + length])
            first[g] = min(first.get(g, o), o)
    out = []
    for (i, _), w, o in zip(docs, words, order):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < o:
                gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        out.append((i, len(w), int(gone.sum()), list(zip(edges[::2], edges[1::2])), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def given(spark, docs):
    return spark.createDataFrame([(*d, "a", "b", "c", "d", "e") for d in docs], SCHEMA)


def removed(docs, **options):
    rows = passages.remove_passages(docs, **options).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], [(s["lo"], s["hi"]) for s in r["spans"]], r["kept"]) for r in rows], key=repr)


def patchwork(n, seed):
    rng = random.Random(seed)
    base = [rng.choice("abcd") for _ in range(60)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, 50)
            w += base[s : s + rng.randint(1, 20)] if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(1, 8))]
        docs.append((rng.choice([None, rng.randint(0, 40)]) if rng.random() < 0.2 else i, None if rng.random() < 0.05 else rng.choice([" ", "\n", " \t "]).join(w)))
    return docs + docs[:15]


@pytest.mark.parametrize("length, gram", [(6, 3), (6, 6), (6, 1), (9, 4)])
@pytest.mark.parametrize("most_pairs", [1, 256])
def test_passages(spark, length, gram, most_pairs):
    docs = patchwork(120, length * gram)
    want = brute(docs, length)
    assert sum(r[2] for r in want) > 500
    assert removed(given(spark, docs), length=length, gram=gram, most_pairs=most_pairs, hot_rows=16) == want


def test_whole_texts_and_odd_ones(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijé", k=4))
    passage = [word() for _ in range(60)]
    long = [word() for _ in range(80_000)]
    long[70_000:70_060] = passage
    docs = [(1, " ".join(long)), (2, " ".join([*passage, *[word() for _ in range(30)]])), (3, None), (4, ""), (5, " \n\t"), (None, " ".join(passage)), (6, "a" * 400_000)]
    docs += [(7, "one word " + " ".join(passage[:50])), (8, " ".join(passage[:49])), (2, " ".join(passage))]
    got = removed(given(spark, docs))
    assert got == brute(docs, 50)
    assert {(r[0], r[2]) for r in got} == {(1, 0), (2, 60), (3, 0), (4, 0), (5, 0), (None, 60), (6, 0), (7, 50), (8, 0)}


def test_many_different_classes_of_an_anchor(spark):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join([*[rng.choice("xyz") for _ in range(12)], *common, *[rng.choice("xyz") for _ in range(12)]])) for i in range(400)]
    want = brute(docs, 50)
    assert 0 < sum(r[2] > 0 for r in want) < 400
    assert removed(given(spark, docs), most_pairs=64, hot_rows=50) == want


def test_repeats_within_a_document_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    assert [r[2] for r in removed(given(spark, [(1, f"{text} {text}"), (1, text), (2, text)]))] == [0, 0, 60]


def test_no_rows(spark):
    assert removed(given(spark, [])) == []
    with pytest.raises(ValueError):
        passages.remove_passages(given(spark, []), length=10, gram=11)


def test_leftmost_least():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 8, 31):
        v = rng.integers(0, 5, 200)
        assert passages.leftmost_least(v, width).tolist() == [s + int(np.argmin(v[s : s + width])) for s in range(200 - width + 1)]
