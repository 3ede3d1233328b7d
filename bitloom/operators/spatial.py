"""Sliding windows, padding, resampling and pooling on cells ``(row_id, h, w, c, val)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import whole_div
from ..sizing import MATRIX_ELEMENTS, param_join, rows_at_most
from .matmul import agreement, depthwise
from .thresholds import multi_threshold

#: cells a tile of an image reads, or results it gives, at most about
TILE_CELLS = 1 << 21
#: cells that tiles smaller than this read, or give, together in one step of a worker
STEP_CELLS = 1 << 18
OUT_CLASSES = 64


def window_count(size: int, k: int, stride: int, dilation: int = 1) -> int:
    return (size - (dilation * (k - 1) + 1)) // stride + 1


def _feeds(pos: Column, k: int | Column, stride: int | Column, dilation: int | Column, n_out: int | Column) -> Column:
    """Outputs (and kernel taps) an input position feeds along one axis; sizes are numbers or columns."""
    taps = F.sequence(F.lit(0), F.lit(k - 1))
    pairs = F.transform(taps, lambda t: F.struct((pos - t * dilation).alias("at"), t.alias("tap")))
    usable = F.filter(pairs, lambda p: (p["at"] >= 0) & (p["at"] % stride == 0) & (p["at"] < n_out * stride))
    return F.transform(usable, lambda p: F.struct((p["at"] / stride).cast("int").alias("o"), p["tap"].alias("k")))


def im2col(
    cells: DataFrame, shape: tuple[int, int], kernel: tuple[int, int], stride: tuple[int, int] = (1, 1), dilation: tuple[int, int] = (1, 1)
) -> DataFrame:
    """Windows as ``(row_id, oh, ow, kh, kw, c, val)``.

    Each cell is sent to the windows it belongs to, at most ``kh*kw`` of them; no join.
    """
    oh, ow = (window_count(shape[a], kernel[a], stride[a], dilation[a]) for a in (0, 1))
    keep = [c for c in cells.columns if c not in ("h", "w", "c", "val")]
    high = cells.withColumn("_y", F.explode(_feeds(F.col("h"), kernel[0], stride[0], dilation[0], oh)))
    both = high.withColumn("_x", F.explode(_feeds(F.col("w"), kernel[1], stride[1], dilation[1], ow)))
    return both.select(
        *keep, F.col("_y.o").alias("oh"), F.col("_x.o").alias("ow"), F.col("_y.k").alias("kh"), F.col("_x.k").alias("kw"), "c", "val"
    )


SHAPE = ("height", "width", "kh", "kw", "sh", "sw", "dh", "dw")


def im2col_by_batch(cells: DataFrame, shapes: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Windows of batches whose image size, kernel, stride and dilation differ: ``shapes`` has one row per batch with the columns of ``SHAPE``.

    A cell meets the shape of its batch and is sent to its windows, as in ``im2col``. Cells of a batch without a
    shape give no windows; a size, kernel, stride or dilation that is null or below 1, and a kernel wider than its image, are errors.
    """
    wrong = F.lit(False)
    for c in SHAPE:
        wrong = wrong | F.coalesce(F.col(c) < 1, F.lit(True))
    for n, k, d in (("height", "kh", "dh"), ("width", "kw", "dw")):
        wrong = wrong | (F.col(d) * (F.col(k) - 1) + 1 > F.col(n))
    stop = F.raise_error(F.concat(F.lit("no window fits the shape of batch "), F.col(batch).cast("string"))).cast("int")
    checked = shapes.select(batch, F.when(wrong, stop).otherwise(F.col("height").cast("int")).alias("height"), *[F.col(c).cast("int").alias(c) for c in SHAPE[1:]])
    named = checked.select(F.col(batch), F.struct(*SHAPE).alias("_s"))
    keep = [c for c in cells.columns if c not in ("h", "w", "c", "val")]
    met = param_join(cells, named, [batch], "inner", spread=keep)

    def feeds(pos: str, n: str, k: str, s: str, d: str) -> Column:
        size, taps, step, apart = (F.col(f"_s.{c}") for c in (n, k, s, d))
        outs = whole_div(size - (apart * (taps - 1) + 1), step) + 1
        return _feeds(F.col(pos), taps, step, apart, outs)

    both = met.withColumn("_y", F.explode(feeds("h", "height", "kh", "sh", "dh"))).withColumn("_x", F.explode(feeds("w", "width", "kw", "sw", "dw")))
    return both.select(*keep, F.col("_y.o").alias("oh"), F.col("_x.o").alias("ow"), F.col("_y.k").alias("kh"), F.col("_x.k").alias("kw"), "c", "val")


def window_order(kernel: tuple[int, int], channels: int, depthwise: bool = False) -> Column:
    """Position inside a window: ``(kh, kw, c)``, or channel first for depthwise use."""
    tap = F.col("kh") * kernel[1] + F.col("kw")
    return F.col("c") * (kernel[0] * kernel[1]) + tap if depthwise else tap * channels + F.col("c")


def _convolve_cells(cells: DataFrame, weights: DataFrame, size, kernel, stride, dilation) -> DataFrame:
    """Weights of any size: windows meet their taps in a join, and a zero stands for every output."""
    windows = im2col(cells, size, kernel, stride, dilation)
    taps = weights.select("kh", "kw", "c", "out_idx", "w")
    joined = param_join(windows, taps, ["kh", "kw", "c"], "inner", spread=("row_id", "oh", "ow"))
    terms = joined.select("row_id", "oh", "ow", "out_idx", (F.col("val").cast("long") * F.col("w")).alias("val"))
    n = [window_count(size[a], kernel[a], stride[a], dilation[a]) for a in (0, 1)]
    grid = cells.select("row_id").distinct()
    for name, count in (("oh", n[0]), ("ow", n[1])):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    # each position meets every output once; the outputs lie in classes, so they are not held in one value
    outs = weights.select("out_idx", F.pmod("out_idx", F.lit(OUT_CLASSES)).alias("_class")).distinct()
    classed = grid.withColumn("_class", F.explode(F.sequence(F.lit(0), F.lit(OUT_CLASSES - 1))))
    zeros = param_join(classed, outs, ["_class"], "inner", spread=("row_id", "oh", "ow"))
    zeros = zeros.select("row_id", "oh", "ow", "out_idx", F.lit(0).cast(terms.schema["val"].dataType).alias("val"))
    return terms.unionByName(zeros).groupBy("row_id", "oh", "ow", "out_idx").agg(F.sum("val").alias("val"))


def _tile(n_out: int, side: int, k: int, stride: int, dilation: int) -> tuple[int, int]:
    """Outputs of a tile along an axis, such that it reads about ``side`` inputs, and the number of tiles."""
    size = min(n_out, max(1, (side - dilation * (k - 1) - 1) // stride + 1))
    return size, -(-n_out // size)


def _tiles_of(pos: Column, size: int, n_tiles: int, k: int, stride: int, dilation: int) -> Column:
    """The tiles an input position is read by: its own and, within the halo, those before."""
    span = size * stride
    reach = (size - 1) * stride + (k - 1) * dilation
    first = F.greatest(F.ceil((pos - reach) / span), F.lit(0))
    last = F.least(F.floor(pos / span), F.lit(n_tiles - 1))
    return F.when(first <= last, F.sequence(first, last))


def _convolve(cells: DataFrame, weights: DataFrame, size, kernel, stride, dilation, depthwise: bool = False) -> DataFrame:
    """Sum of products over shifted cells; positions without a cell, or with a null, count as zero.

    Outputs are cut into tiles. A cell goes to the tiles that read it, more than one only in the halo where tiles overlap, and a
    tile is one row of at most about ``TILE_CELLS`` cells, multiplied in Arrow batches with weights of proven size.
    An image of up to that size is one tile; small tiles are multiplied together, ``STEP_CELLS`` at a time. ``depthwise`` weights have no ``out_idx``: each channel is its own output.
    """
    n = [window_count(size[a], kernel[a], stride[a], dilation[a]) for a in (0, 1)]
    table = weights.select("kh", "kw", "c", *([F.col("c").alias("out_idx")] if depthwise else ["out_idx"]), "w").toArrow()
    at = {name: table[name].to_numpy() for name in table.column_names}
    outs, column = np.unique(at["out_idx"], return_inverse=True)
    depth = int(at["c"].max()) + 1 if len(table) else 1
    taps = np.zeros((*kernel, depth) if depthwise else (*kernel, depth, len(outs)))
    np.add.at(taps, (at["kh"], at["kw"], at["c"]) if depthwise else (at["kh"], at["kw"], at["c"], column), at["w"])
    deep = max(depth, len(outs), 1)
    side = max(1, int((TILE_CELLS // deep) ** 0.5))
    (high, rows), (wide, columns) = (_tile(n[a], side, kernel[a], stride[a], dilation[a]) for a in (0, 1))
    read = [(t - 1) * stride[a] + (kernel[a] - 1) * dilation[a] + 1 for a, t in ((0, high), (1, wide))]
    out_schema = f"row_id {cells.schema['row_id'].dataType.simpleString()}, oh int, ow int, out_idx int, val double"

    def products(x: np.ndarray) -> np.ndarray:
        acc = np.zeros((len(x), high, wide, len(outs)))
        for kh, kw in np.ndindex(*kernel):
            top, left = kh * dilation[0], kw * dilation[1]
            met = x[:, top : top + (high - 1) * stride[0] + 1 : stride[0], left : left + (wide - 1) * stride[1] + 1 : stride[1]]
            acc += (met * taps[kh, kw])[..., outs] if depthwise else met @ taps[kh, kw]
        return acc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = max(1, STEP_CELLS // (max(read[0] * read[1], high * wide) * deep))
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                part = batch.slice(start, together)
                tile = np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().to_numpy())
                h, w, c, val = (part.column(3).flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
                ty, tx = (part.column(k).to_numpy() for k in (1, 2))
                h, w = h - ty[tile] * (high * stride[0]), w - tx[tile] * (wide * stride[1])
                used = (h >= 0) & (h < read[0]) & (w >= 0) & (w < read[1]) & (c >= 0) & (c < depth)
                place = ((tile * read[0] + h) * read[1] + w) * depth + c
                x = np.bincount(place[used], val[used], part.num_rows * read[0] * read[1] * depth)
                acc = products(x.reshape(part.num_rows, read[0], read[1], depth))
                row, oh, ow, out = (i.ravel() for i in np.indices(acc.shape, np.int32))
                oh, ow = oh + (ty[row] * high).astype(np.int32), ow + (tx[row] * wide).astype(np.int32)
                inside = (oh < n[0]) & (ow < n[1])
                got = [part.column(0).take(pa.array(row[inside])), pa.array(oh[inside]), pa.array(ow[inside]), pa.array(outs[out[inside]].astype(np.int32)), pa.array(acc.ravel()[inside])]
                yield pa.RecordBatch.from_arrays(got, ["row_id", "oh", "ow", "out_idx", "val"])

    value = F.coalesce(F.col("val").cast("long"), F.lit(0)).cast("double").alias("val")
    cell = F.struct(*[F.col(p).cast("long").alias(p) for p in ("h", "w", "c")], value).alias("cell")
    if rows * columns == 1:
        zero = F.lit(0).cast("long")
        tiles = cells.groupBy("row_id").agg(F.collect_list(cell).alias("cells")).select("row_id", zero.alias("ty"), zero.alias("tx"), "cells")
    else:
        ty = F.explode(_tiles_of(F.col("h"), high, rows, kernel[0], stride[0], dilation[0])).alias("ty")
        tx = F.explode(_tiles_of(F.col("w"), wide, columns, kernel[1], stride[1], dilation[1])).alias("tx")
        sent = cells.select("row_id", cell, ty).select("row_id", "cell", "ty", F.col("cell.w").alias("w")).select("row_id", "ty", tx, "cell")
        # every tile of an image is there, also one without cells; the null it brings is not collected
        every = cells.select("row_id").distinct().select("row_id", F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1).cast("long"))).alias("t"))
        every = every.select("row_id", whole_div(F.col("t"), columns).cast("long").alias("ty"), (F.col("t") % columns).cast("long").alias("tx"), F.lit(None).cast(sent.schema["cell"].dataType).alias("cell"))
        tiles = sent.unionByName(every).groupBy("row_id", "ty", "tx").agg(F.collect_list("cell").alias("cells"))
    done = tiles.mapInArrow(run, out_schema)
    whole = not isinstance(weights.schema["w"].dataType, (T.FractionalType, T.DecimalType))
    return done.withColumn("val", F.col("val").cast("long")) if whole else done


def depthwise2d(
    cells: DataFrame, weights: DataFrame, shape, kernel, stride=(1, 1), dilation=(1, 1), pads=(0, 0, 0, 0), bipolar_width: int | None = None, thresholds: DataFrame | None = None, out_scale: float = 1, out_bias: float = 0
) -> DataFrame:
    """Per-channel convolution of images with ``(c, kh, kw, w)`` in tiles, as ``(row_id, oh, ow, c, val)``; an absent cell is zero.

    Agreements and thresholds as in ``matmul.depthwise``, which takes windows and weights of any size.
    """
    moved, size = _padded(cells, shape, pads)
    if not rows_at_most(weights, MATRIX_ELEMENTS):
        return depthwise(im2col(moved, size, kernel, stride, dilation), weights, bipolar_width, thresholds, out_scale, out_bias)
    out = _convolve(moved, weights, size, kernel, stride, dilation, depthwise=True).withColumnRenamed("out_idx", "c")
    out = out.withColumn("val", agreement(F.col("val"), bipolar_width)) if bipolar_width else out
    return out if thresholds is None else multi_threshold(out, thresholds, out_scale, out_bias, spread=("row_id", "oh", "ow"))


def _padded(cells: DataFrame, shape, pads) -> tuple[DataFrame, tuple[int, int]]:
    """Padding only shifts positions, since zeros add nothing to a sum."""
    top, left, bottom, right = pads
    return cells.withColumn("h", F.col("h") + top).withColumn("w", F.col("w") + left), (shape[0] + top + bottom, shape[1] + left + right)


def _convolution(cells: DataFrame, weights: DataFrame, size, kernel, stride, dilation) -> DataFrame:
    """In tiles with weights that every task can hold, else by a join of cells and weights."""
    fits = rows_at_most(weights, MATRIX_ELEMENTS)
    return (_convolve if fits else _convolve_cells)(cells, weights, size, kernel, stride, dilation)


def conv2d(cells: DataFrame, weights: DataFrame, shape, kernel, stride=(1, 1), dilation=(1, 1), pads=(0, 0, 0, 0)) -> DataFrame:
    """Convolution of images with ``(kh, kw, c, out_idx, w)``; an absent cell is zero."""
    moved, size = _padded(cells, shape, pads)
    return _convolution(moved, weights, size, kernel, stride, dilation)


def downsample(cells: DataFrame, s: int, axes: tuple[str, ...] = ("h", "w")) -> DataFrame:
    """Keep every s-th position of the given axes."""
    out = cells
    for a in axes:
        out = out.where(F.col(a) % s == 0).withColumn(a, (F.col(a) / s).cast("int"))
    return out


def _with_zeros(moved: DataFrame, height: int, width: int) -> DataFrame:
    """The full grid of each image and channel that has a cell: its cells, and zeros at all other positions."""
    keys = [c for c in moved.columns if c not in ("h", "w", "val")]
    every = F.sequence(F.lit(0), F.lit(height * width - 1))
    grid = moved.select(*keys).distinct().withColumn("_p", F.explode(every))
    place = whole_div(F.col("_p"), width).cast("int").alias("h"), (F.col("_p") % width).cast("int").alias("w")
    zeros = grid.select(*keys, *place, F.lit(0).cast(moved.schema["val"].dataType).alias("val"), F.lit(0).alias("_cell"))
    both = moved.withColumn("_cell", F.lit(1)).unionByName(zeros)
    return both.groupBy(*keys, "h", "w").agg(F.max_by("val", "_cell").alias("val")).select(*moved.columns)


def pad2d(cells: DataFrame, pads: tuple[int, int, int, int], shape: tuple[int, int]) -> DataFrame:
    """Zero padding ``(top, left, bottom, right)``; an absent cell of an image is zero too."""
    top, left, bottom, right = pads
    moved = cells.withColumn("h", (F.col("h") + top).cast("int")).withColumn("w", (F.col("w") + left).cast("int"))
    return _with_zeros(moved, shape[0] + top + bottom, shape[1] + left + right)


def _spread_size(shape, stride) -> tuple[int, int]:
    return tuple(shape[a] + (shape[a] - 1) * (stride[a] - 1) for a in (0, 1))


def _spread(cells: DataFrame, stride) -> DataFrame:
    return cells.withColumn("h", (F.col("h") * stride[0]).cast("int")).withColumn("w", (F.col("w") * stride[1]).cast("int"))


def pixel_pad(cells: DataFrame, stride: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Zeros between the pixels, and for absent ones: size ``I + (I-1)(s-1)``."""
    return _with_zeros(_spread(cells, stride), *_spread_size(shape, stride))


def deconv2d(cells: DataFrame, weights: DataFrame, shape, kernel, stride, pad: int, groups: int = 1) -> DataFrame:
    """Transposed convolution: pixel padding, padding by ``k - 1 - pad``, then a convolution.

    ``weights`` are those of the equivalent convolution, with taps already mirrored.
    """
    if groups != 1:
        raise ValueError("grouped transposed convolution is not supported")
    size = _spread_size(shape, stride)
    edge = [kernel[a] - 1 - pad for a in (0, 1)]
    moved = _spread(cells, stride).withColumn("h", F.col("h") + edge[0]).withColumn("w", F.col("w") + edge[1])
    return _convolution(moved, weights, (size[0] + 2 * edge[0], size[1] + 2 * edge[1]), kernel, (1, 1), (1, 1))


def mirrored(weights: DataFrame, kernel: tuple[int, int]) -> DataFrame:
    """Kernel taps turned by half a turn."""
    return weights.withColumn("kh", F.lit(kernel[0] - 1) - F.col("kh")).withColumn("kw", F.lit(kernel[1] - 1) - F.col("kw"))


def upsample(cells: DataFrame, scale: int, axes: tuple[str, ...] = ("h", "w")) -> DataFrame:
    """Nearest-neighbour repetition along the given axes."""
    out = cells
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(F.col(a) * scale, F.col(a) * scale + (scale - 1))))
    return out


def center_crop(cells: DataFrame, height: int, width: int, s: int) -> DataFrame:
    """The middle ``s x s`` part."""
    top, left = (height - s) // 2, (width - s) // 2
    inside = F.col("h").between(top, top + s - 1) & F.col("w").between(left, left + s - 1)
    return cells.where(inside).withColumn("h", F.col("h") - top).withColumn("w", F.col("w") - left)


def rechunk(words: DataFrame, m: int, stream: str = "stream_id", seq: str = "seq", vec: str = "vec", n: int | None = None) -> DataFrame:
    """Words of n elements to words of m elements; order and values stay. The last word may be shorter.

    ``n`` is the input width when all words share it; positions then need no scan. A word goes in
    slices to the words it falls into, one row a slice.
    """
    width = F.lit(n) if n is not None else F.size(vec)
    based = words.where(F.size(vec) > 0).select(stream, (F.col(seq) * width).cast("long").alias("_base"), F.col(vec).alias("_v"))
    end = F.col("_base") + F.size("_v")
    met = based.withColumn("_k", F.explode(F.sequence(whole_div(F.col("_base"), m), whole_div(end - 1, m))))
    first = F.greatest(F.col("_base"), F.col("_k") * m)
    size = F.least(end, (F.col("_k") + 1) * m) - first
    pieces = met.select(stream, F.col("_k").alias(seq), first.alias("_p"), F.slice("_v", (first - F.col("_base") + 1).cast("int"), size.cast("int")).alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_v")))
    return pieces.groupBy(stream, seq).agg(F.flatten(F.transform(ordered, lambda s: s["_v"])).alias(vec))


def global_acc_pool(cells: DataFrame) -> DataFrame:
    """Sum (not mean) of each channel of a row."""
    return cells.groupBy("row_id", "c").agg(F.sum(F.col("val").cast("long")).alias("val"))


def max_pool(cells: DataFrame, k: tuple[int, int], shape: tuple[int, int], ceil_mode: bool = False) -> DataFrame:
    """Maximum of non-overlapping windows. 2-D sizes must divide; 1-D may keep a partial last window."""
    one_d = shape[0] == 1 and k[0] == 1
    if not one_d and (shape[0] % k[0] or shape[1] % k[1]):
        raise ValueError("2-D sizes must divide by the kernel")
    used = cells if ceil_mode or not one_d else cells.where(F.col("w") < shape[1] // k[1] * k[1])
    return used.groupBy(
        "row_id", whole_div(F.col("h"), k[0]).cast("int").alias("h"), whole_div(F.col("w"), k[1]).cast("int").alias("w"), "c"
    ).agg(F.max("val").alias("val"))


def quant_avg_shift(k: int, ibits: int, obits: int) -> int:
    return max(0, int((2**ibits - 1) * k * k).bit_length() - obits)


def pool(windows: DataFrame, func: str, k: int, ibits: int | None = None, obits: int | None = None) -> DataFrame:
    """Reduce im2col windows: ``max``, or ``quantavg`` = sum shifted right."""
    groups = windows.groupBy("row_id", "oh", "ow", "c")
    if func == "max":
        return groups.agg(F.max("val").alias("val"))
    if func == "quantavg":
        total = F.sum(F.col("val").cast("long"))
        return groups.agg(F.shiftright(total, quant_avg_shift(k, ibits, obits)).alias("val"))
    raise ValueError(func)
