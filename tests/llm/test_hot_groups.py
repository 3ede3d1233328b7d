"""Groups of copies of any size, by rows and by bytes, with short and long lists of hot groups."""

import pytest

from bitloom.llm import exact_dedup


@pytest.mark.parametrize("listed", [100_000, 0])
@pytest.mark.parametrize("rows,held", [(7, 1 << 24), (512, 300), (512, 1 << 24)])
def test_hot_groups(spark, monkeypatch, listed, rows, held):
    monkeypatch.setattr(exact_dedup, "HOT_LIST", listed)
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", held)
    docs = [(i, "Same long text " * (1 + i % 3)) for i in range(90)] + [(i, None if i % 2 else "") for i in range(90, 130)] + [(200, "one"), (201, "ONE"), (202, "two"), (None, "two"), (202, "two")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").lower(), []).append(i)
    best = {t: max(i for i in ids if i is not None) for t, ids in groups.items()}
    got = exact_dedup.exact_groups(df, keep="max", hot_rows=rows).collect()
    assert len(got) == len(docs) and sum(r.kept for r in got) == len(groups)
    want = sorted(((i, best[(t or "").lower()], len(groups[(t or "").lower()])) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    left = exact_dedup.exact_dedup(df, keep="max", hot_rows=rows).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in left) == sorted((i, t) for t, i in best.items())
