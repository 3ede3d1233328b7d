"""Paths taken only at size give the same rows as the small ones."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bitloom import sizing
from bitloom.operators import elementwise, features, inventory, matmul, scans, spatial, thresholds
from bitloom.operators.scans import block_scan, row_numbers
from bitloom.sizing import param_join


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(tuple, a.select(cols).collect()), key=repr) == sorted(map(tuple, b.select(cols).collect()), key=repr)


def hot(spark, n=3000):
    """A table where one key holds a third of the rows."""
    return spark.range(n).selectExpr("id AS row_id", "CAST(if(id % 3 = 0, 0, id % 17) AS INT) AS c", "(id * 37) % 251 - 100 AS val")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, how):
    params = spark.range(0, 17, 2).selectExpr("CAST(id AS INT) AS c", "id * 5 AS p")
    small = param_join(hot(spark), params, ["c"], how)
    assert same(small, param_join(hot(spark), params, ["c"], how, max_rows=1))
    assert same(small, param_join(hot(spark), params, ["c"], how, max_rows=1, hot_rows=500))
    assert same(small, param_join(hot(spark), params, ["c"], how, max_rows=1, hot_rows=1))


def test_salted_join_spreads_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        params = spark.range(17).selectExpr("CAST(id AS INT) AS c", "id AS p")
        joined = param_join(hot(spark, 30000), params.hint("merge"), ["c"], max_rows=1, hot_rows=5000)
        sizes = [r["count"] for r in joined.where("c = 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) >= 10000 and max(sizes) < 0.6 * sum(sizes)


def test_salted_join_keeps_rows_without_key(spark):
    df = hot(spark).withColumn("c", F.when(F.col("row_id") % 3 > 0, F.col("c")))
    params = spark.range(0, 17, 2).selectExpr("CAST(id AS INT) AS c", "id * 5 AS p")
    small = param_join(df, params, ["c"], "left")
    assert small.count() == 3000 and same(small, param_join(df, params, ["c"], "left", max_rows=1, hot_rows=100))


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    params = spark.range(20).selectExpr("CAST(id AS INT) AS c", "sequence(1, 1000) AS ts")
    assert sizing.fits_broadcast(params, 100)
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 100_000)
    assert not sizing.fits_broadcast(params, 100)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("bits", [3, 7, 20])
def test_block_scan_equals_window(spark, inclusive, bits):
    df = hot(spark).withColumn("x", F.when(F.col("val") > 50, F.col("val")))
    got = block_scan(df, ["c"], ["row_id"], {"total": F.col("val")}, {"seen": F.col("x")}, inclusive, bits)
    w = Window.partitionBy("c").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumn("total", F.coalesce(F.sum("val").over(w), F.lit(0))).withColumn("seen", F.last("x", True).over(w))
    assert same(got, want)


def test_row_numbers_without_keys(spark):
    df = hot(spark).where("val > 0").select("row_id")
    got = row_numbers(df, [], ["row_id"], block_bits=5)
    want = df.withColumn("seq", F.row_number().over(Window.orderBy("row_id")) - 1)
    assert same(got, want.withColumn("seq", F.col("seq").cast("long")))


@pytest.mark.parametrize("group", [2, 22])
def test_scan_of_sparse_orders_and_null_keys(spark, monkeypatch, group):
    monkeypatch.setattr(scans, "GROUP_BITS", group)
    monkeypatch.setattr(scans, "ORDER_BITS", 12 if group == 2 else 64)
    gap = 3 if group == 2 else 1 << 52
    df = spark.range(600).selectExpr(f"(id - 300) * {gap} AS at", "if(id % 3 = 0, NULL, id % 5) AS k", "if(id % 7 < 5, NULL, id) AS x", "id % 11 - 5 AS val")
    got = block_scan(df, ["k"], ["at"], {"total": F.col("val")}, {"seen": F.col("x")}, block_bits=4 if group == 2 else 20)
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    assert same(got, df.withColumn("total", F.sum("val").over(w)).withColumn("seen", F.last("x", True).over(w)))
    numbered = row_numbers(df.select("at"), [], ["at"])
    assert {r["at"]: r["seq"] for r in numbered.collect()} == {(i - 300) * gap: i for i in range(600)}


def test_range_ranked_vocabulary(spark):
    words = spark.range(500).selectExpr("'w' AS column", "concat(chr(CAST(97 + id % 7 AS INT)), id) AS value").unionByName(
        spark.createDataFrame([("w", ""), ("w", "a"), ("w", "zz")], "column string, value string")
    )
    got = {r.value: r.code for r in features._ranked_by_range(words.repartition(5)).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_large_vocabulary_path(spark, monkeypatch):
    df = hot(spark).withColumn("s", F.concat(F.lit("k"), F.col("c").cast("string")))
    small = features.label_encode(df, ["s"])
    monkeypatch.setattr(features, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 2)
    assert same(small, features.label_encode(df, ["s"]))


def test_threshold_paths_agree(spark):
    cells = hot(spark).where("c < 4")
    t = spark.range(4 * 90).selectExpr("CAST(id DIV 90 AS INT) c", "CAST(id % 90 AS INT) step", "CAST(-100 + 3 * (id % 90) + id DIV 90 AS DOUBLE) t")
    plain = thresholds.multi_threshold(cells, t)
    assert same(plain, thresholds.multi_threshold_wide(cells, t, chunk=8))
    assert same(plain, thresholds.multi_threshold_wide(cells, t, chunk=1000))


def test_lookup_paths_agree(spark, monkeypatch):
    emb = spark.range(17).selectExpr("id AS idx", "array(id, id * 2) AS vec")
    df = hot(spark).withColumn("idx", F.col("c") + F.when(F.col("val") > 140, 100).otherwise(0))
    small = elementwise.lookup(df, "idx", emb, "row0")
    monkeypatch.setattr(elementwise, "BROADCAST_ROWS", 10)
    assert same(small, elementwise.lookup(df, "idx", emb, "row0"))
    with pytest.raises(Exception, match="outside the table"):
        elementwise.lookup(df, "idx", emb).collect()


def test_large_weights_go_by_blocks(spark, monkeypatch):
    # input 9 and output 3 have zero weights only, and two rows are equal
    w = spark.range(40).selectExpr("CAST(id DIV 4 AS INT) in_idx", "CAST(id % 4 AS INT) out_idx").selectExpr("*", "if(in_idx = 9 OR out_idx = 3, 0, (in_idx + 2 * out_idx) % 3 - 1) AS w")
    t = spark.range(12).selectExpr("CAST(id DIV 3 AS INT) c", "CAST(id % 3 AS INT) step", "CAST(3 * (id % 3) - 4 AS DOUBLE) t")
    rows = spark.range(40).selectExpr("if(id = 39, 38, id) AS row_id", "transform(sequence(0, 9), i -> (if(id = 39, 38, id) * 7 + i * i) % 11 - 5) AS vec")
    dense = matmul.matmul(rows, w, (10, 4)).collect(), matmul.mvau(rows, w, t, (10, 4), 3, 2, -1).collect()
    monkeypatch.setattr(matmul, "MATRIX_ELEMENTS", 30)
    monkeypatch.setattr(matmul, "BLOCK_SIDE", 3)
    monkeypatch.setattr(matmul, "BLOCK_ROWS", 9)
    strips = matmul.matmul(rows, w, (10, 4)).collect(), matmul.mvau(rows, w, t, (10, 4), 3, 2, -1).collect()
    assert [sorted(map(tuple, d)) for d in dense] == [sorted(map(tuple, s)) for s in strips]
    assert len(strips[0]) == 40
    with pytest.raises(Exception, match="10 elements"):
        matmul.matmul(rows.withColumn("vec", F.slice("vec", 1, 9)), w, (10, 4)).collect()


def test_sparse_weights_of_any_size(spark, monkeypatch):
    w = spark.range(40).selectExpr("CAST(id DIV 4 AS INT) in_idx", "CAST(id % 4 AS INT) out_idx", "CAST(id % 3 - 1 AS INT) w")
    cells = spark.range(200).selectExpr("id DIV 10 AS row_id", "CAST(id % 10 AS INT) i", "id % 7 AS val")
    small = matmul.matmul_cells(cells, w)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3)
    assert same(small, matmul.matmul_cells(cells, w))


def graph(spark):
    nodes = spark.range(60).selectExpr("concat('m', id DIV 20) AS model_id", "CAST(id % 20 AS INT) AS layer_id", "(id * 7) % 11 + 1 AS cycles")
    edges = spark.range(57).selectExpr("concat('m', id DIV 19) AS model_id", "CAST(id % 19 AS INT) AS src", "CAST(id % 19 + 1 AS INT) AS dst")
    skips = edges.where("src % 5 = 0 AND src < 15").selectExpr("model_id", "src", "src + 4 AS dst")
    return nodes, edges.unionByName(skips)


def test_longest_path_at_any_width(spark):
    nodes, edges = graph(spark)
    whole = inventory.critical_path(nodes, edges)
    assert whole.count() == 60
    assert same(whole, inventory.critical_path(nodes, edges, width=1))
    only_m1 = edges.unionByName(edges.where("model_id = 'm1'").selectExpr("model_id", "src", "dst"))
    assert same(whole, inventory.critical_path(nodes, only_m1, width=2))


def test_cycle_is_reported(spark):
    nodes, edges = graph(spark)
    back = spark.createDataFrame([("m0", 19, 0)], "model_id string, src int, dst int")
    with pytest.raises(Exception, match="cycle"):
        inventory.critical_path(nodes, edges.unionByName(back)).collect()


@pytest.mark.parametrize("width", [1, 16])
def test_bad_graphs_are_reported_at_any_width(spark, width):
    nodes, edges = graph(spark)
    for src, dst in ((99, 3), (3, 99)):
        lost = spark.createDataFrame([("m0", src, dst)], "model_id string, src int, dst int")
        with pytest.raises(Exception, match="edge without its"):
            inventory.critical_path(nodes, edges.unionByName(lost), width=width).collect()
    back = spark.createDataFrame([("m0", 19, 0)], "model_id string, src int, dst int")
    with pytest.raises(Exception, match="cycle"):
        inventory.critical_path(nodes, edges.unionByName(back), width=width).collect()


def holed(spark):
    """Images of 3x3 and two channels that lack cells, also the first."""
    cells = spark.range(3 * 18).selectExpr("id DIV 18 AS row_id", "CAST(id % 18 DIV 6 AS INT) h", "CAST(id % 6 DIV 2 AS INT) w", "CAST(id % 2 AS INT) c", "id % 13 - 6 AS val")
    return cells.where("NOT (row_id = 1 AND h < 2 AND w < 2) AND NOT (row_id = 2 AND (h = 0 OR c = 0 AND w = 1))")


def test_padding_gives_the_full_grid(spark):
    cells = holed(spark)
    known = {(r.row_id, r.h, r.w, r.c): r.val for r in cells.collect()}
    padded = {(r.row_id, r.h, r.w, r.c): r.val for r in spatial.pad2d(cells, (1, 0, 2, 1), (3, 3)).collect()}
    assert padded == {(r, h, w, c): known.get((r, h - 1, w, c), 0) for r in range(3) for h in range(6) for w in range(4) for c in range(2)}
    wide = {(r.row_id, r.h, r.w, r.c): r.val for r in spatial.pixel_pad(cells, (2, 3), (3, 3)).collect()}
    assert wide == {
        (r, h, w, c): known.get((r, h // 2, w // 3, c), 0) if h % 2 == 0 and w % 3 == 0 else 0 for r in range(3) for h in range(5) for w in range(7) for c in range(2)
    }


@pytest.mark.parametrize("held", [True, False])
def test_convolution_gives_every_output(spark, monkeypatch, held):
    cells = holed(spark)
    known = {(r.row_id, r.h, r.w, r.c): r.val for r in cells.collect()}
    w = spark.range(24).selectExpr("CAST(id DIV 12 AS INT) kh", "CAST(id % 12 DIV 6 AS INT) kw", "CAST(id % 6 DIV 3 AS INT) c", "CAST(id % 3 AS INT) out_idx", "CAST(id * 5 % 7 - 3 AS INT) w")
    taps = [tuple(r) for r in w.collect()]
    if not held:
        monkeypatch.setattr(spatial, "MATRIX_ELEMENTS", 3)
    got = {(r.row_id, r.oh, r.ow, r.out_idx): r.val for r in spatial.conv2d(cells, w, (3, 3), (2, 2), stride=(2, 1), pads=(1, 0, 0, 1)).collect()}
    assert got == {
        (r, oh, ow, o): sum(known.get((r, oh * 2 + kh - 1, ow + kw, c), 0) * x for kh, kw, c, out, x in taps if out == o)
        for r in range(3) for oh in range(2) for ow in range(3) for o in range(3)
    }


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_same_result_for_any_partition_count(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = block_scan(hot(spark).repartition(partitions), ["c"], ["row_id"], {"total": F.col("val")}, block_bits=6)
        total = got.agg(F.sum(F.xxhash64(*sorted(got.columns)).cast("decimal(38,0)"))).first()[0]
        assert total == RESULT.setdefault("sum", total)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


RESULT: dict = {}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_executors_need_no_installed_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from __spark_entry__ import entry\nfrom bitloom.session import local_session\n"
        "s = local_session(2)\nassert entry(s).count() == 10\nprint('done')\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "done" in out.stdout, out.stderr[-2000:]
