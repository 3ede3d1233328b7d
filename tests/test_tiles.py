"""Blocks of weights, tiles of images and shapes by batch against loops and the dense forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import matmul, spatial


def image_cells(spark, images, holes=0.3, seed=1):
    """Images as cells, some of them absent or null, and the arrays they stand for."""
    rng = np.random.default_rng(seed)
    rows, images = [], images.copy()
    for at in np.ndindex(*images.shape):
        if rng.random() < holes and at[1:] != (0, 0, 0):
            images[at] = 0
            if rng.random() < 0.5:
                rows.append((*map(int, at), None))
            continue
        rows.append((*map(int, at), int(images[at])))
    return spark.createDataFrame(rows, "row_id int, h int, w int, c int, val int"), images


def convolved(images, taps, stride, dilation, pads):
    x = np.pad(images, ((0, 0), (pads[0], pads[2]), (pads[1], pads[3]), (0, 0)))
    size = [(x.shape[1 + a] - dilation[a] * (taps.shape[a] - 1) - 1) // stride[a] + 1 for a in (0, 1)]
    out = np.zeros((len(x), *size, taps.shape[3]), int)
    for r, i, j in np.ndindex(len(x), *size):
        for a, b in np.ndindex(*taps.shape[:2]):
            out[r, i, j] += x[r, i * stride[0] + a * dilation[0], j * stride[1] + b * dilation[1]] @ taps[a, b]
    return out


def found(df, name):
    return {(r.row_id, r.oh, r.ow, r[name]): r.val for r in df.collect()}


def cells_of(x):
    return {tuple(map(int, at)): int(v) for at, v in np.ndenumerate(x)}


CASES = [((9, 14), (3, 2), (1, 1), (1, 1), (0, 0, 0, 0)), ((13, 11), (2, 3), (2, 3), (2, 1), (1, 2, 0, 1)), ((1, 40), (1, 5), (1, 2), (1, 3), (0, 0, 0, 0)), ((7, 7), (2, 2), (3, 3), (1, 1), (0, 0, 0, 0))]


@pytest.mark.parametrize("shape,kernel,stride,dilation,pads", CASES)
@pytest.mark.parametrize("tile", [1, 40, 1 << 21])
def test_convolution_in_tiles(spark, monkeypatch, tile, shape, kernel, stride, dilation, pads):
    monkeypatch.setattr(spatial, "TILE_CELLS", tile)
    rng = np.random.default_rng(5)
    cells, images = image_cells(spark, rng.integers(-9, 9, (3, *shape, 2)))
    taps = rng.integers(-4, 4, (*kernel, 2, 3))
    w = spark.createDataFrame([(*map(int, at), int(v)) for at, v in np.ndenumerate(taps)], "kh int, kw int, c int, out_idx int, w int")
    got = found(spatial.conv2d(cells, w, shape, kernel, stride, dilation, pads), "out_idx")
    assert got == cells_of(convolved(images, taps, stride, dilation, pads))


@pytest.mark.parametrize("tile", [1, 60, 1 << 21])
def test_depthwise_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(spatial, "TILE_CELLS", tile)
    rng = np.random.default_rng(6)
    cells, images = image_cells(spark, rng.integers(-9, 9, (2, 8, 9, 3)))
    taps = rng.integers(-4, 4, (3, 2, 3))
    w = spark.createDataFrame([(int(c), int(a), int(b), int(taps[a, b, c])) for a, b, c in np.ndindex(3, 2, 3)], "c int, kh int, kw int, w int")
    whole = taps[:, :, :, None] * np.eye(3, dtype=int)
    want = cells_of(convolved(images, whole, (2, 1), (1, 2), (0, 1, 1, 0)))
    assert found(spatial.depthwise2d(cells, w, (8, 9), (3, 2), (2, 1), (1, 2), (0, 1, 1, 0)), "c") == want
    monkeypatch.setattr(spatial, "MATRIX_ELEMENTS", 2)
    joined = found(spatial.depthwise2d(cells, w, (8, 9), (3, 2), (2, 1), (1, 2), (0, 1, 1, 0)), "c")
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in joined.items() if v}


def test_tiles_hold_few_cells(spark, monkeypatch):
    """An image far larger than a tile: no row of cells is larger than a tile and its halo."""
    monkeypatch.setattr(spatial, "TILE_CELLS", 1 << 10)
    cells = spark.range(300 * 200).selectExpr("0 AS row_id", "CAST(id DIV 200 AS INT) h", "CAST(id % 200 AS INT) w", "0 AS c", "CAST(id * 7 % 11 - 5 AS INT) val")
    w = spark.range(9).selectExpr("CAST(id DIV 3 AS INT) kh", "CAST(id % 3 AS INT) kw", "0 AS c", "0 AS out_idx", "1 AS w")
    out = spatial.conv2d(cells, w, (300, 200), (3, 3))
    assert out.count() == 298 * 198
    x = (np.arange(60000) * 7 % 11 - 5).reshape(300, 200)
    want = sum(x[a : a + 298, b : b + 198] for a in range(3) for b in range(3))
    assert out.agg(F.sum(F.col("val") * (F.col("oh") * 7 + F.col("ow")))).first()[0] == int((want * (np.arange(298)[:, None] * 7 + np.arange(198))).sum())


def test_block_product(spark):
    rng = np.random.default_rng(7)
    x, w = rng.integers(-9, 9, (50, 23)), rng.integers(-3, 4, (23, 17))
    w[8:16, :6] = 0
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "_row int, vec array<bigint>")
    weights = spark.createDataFrame([(int(i), int(o), int(v)) for (i, o), v in np.ndenumerate(w)], "in_idx int, out_idx int, w int")
    for side, together in ((8, 7), (6, 1000), (64, 64)):
        got = {(r._row, r.ob): r.val for r in matmul.block_sums(rows, weights, (23, 17), side, together).collect()}
        blocks = -(-17 // side)
        assert len(got) == 50 * blocks
        assert [sum((got[i, b] for b in range(blocks)), []) for i in range(50)] == (x @ w).astype(float).tolist()
    none = weights.where("false")
    assert all(set(r.val) == {0.0} for r in matmul.block_sums(rows, none, (23, 17), 8, 16).collect())
    assert matmul.block_sums(rows.where("false"), weights, (23, 17), 8, 16).count() == 0


def test_shapes_by_batch(spark):
    sizes = [(1, 5, 7, 2, 3, 1, 2, 2, 1), (2, 4, 4, 4, 4, 1, 1, 1, 1), (3, 1, 9, 1, 3, 1, 3, 1, 2)]
    shapes = spark.createDataFrame(sizes, "batch_id int, " + ", ".join(f"{c} int" for c in spatial.SHAPE))
    cells = spark.range(4 * 7 * 9).selectExpr("CAST(id DIV 63 + 1 AS INT) batch_id", "id DIV 63 AS row_id", "CAST(id % 63 DIV 9 AS INT) h", "CAST(id % 9 AS INT) w", "0 AS c", "id AS val")
    got = spatial.im2col_by_batch(cells, shapes)
    for b, height, width, kh, kw, sh, sw, dh, dw in sizes:
        own = cells.where(F.col("batch_id") == b)
        want = spatial.im2col(own, (height, width), (kh, kw), (sh, sw), (dh, dw))
        assert sorted(map(tuple, got.where(F.col("batch_id") == b).collect())) == sorted(map(tuple, want.collect()))
        assert want.count()
    assert got.where("batch_id = 4").count() == 0
    for column, value in (("kh", 9), ("sw", 0), ("dw", None)):
        with pytest.raises(Exception, match="no window fits"):
            spatial.im2col_by_batch(cells, shapes.withColumn(column, F.lit(value).cast("int"))).collect()


def test_small_tiles_are_multiplied_in_steps(spark, monkeypatch):
    """However many images an Arrow batch has, a step works on ``STEP_CELLS`` cells."""
    cells = spark.range(3000 * 256).selectExpr("id DIV 256 AS row_id", "CAST(id % 256 DIV 32 AS INT) h", "CAST(id % 32 DIV 4 AS INT) w", "CAST(id % 4 AS INT) c", "id % 13 AS val")
    w = spark.range(32).selectExpr("CAST(id DIV 16 AS INT) kh", "CAST(id DIV 8 % 2 AS INT) kw", "CAST(id DIV 2 % 4 AS INT) c", "CAST(id % 2 AS INT) out_idx", "id % 5 AS w")
    whole, run, steps = type(cells).mapInArrow, [], []

    def kept(df, step, schema):
        run.append((df, step))
        return whole(df, step, schema)

    monkeypatch.setattr(type(cells), "mapInArrow", kept)
    got = spatial.conv2d(cells, w, (8, 8), (2, 2)).agg(F.count("*"), F.sum("val")).first()
    for df, step in run:
        table = df.toArrow().combine_chunks()
        steps += step(iter(table.to_batches()))
    assert len(steps) > 1 and max(s.num_rows for s in steps) <= spatial.STEP_CELLS
    assert tuple(got) == (sum(s.num_rows for s in steps), sum(int(s["val"].to_numpy().sum()) for s in steps))
    assert got[0] == 3000 * 49 * 2
