"""Matrix products: dense vectors as Arrow batches, sparse cells as joins, bits as popcounts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.packing import lanes
from ..functions.scalars import whole_div
from ..session import saved
from ..sizing import MATRIX_ELEMENTS, param_join, rows_at_most
from .thresholds import multi_threshold

#: inputs and outputs of a block of weights, and rows that meet it in one task: 8 MB and about 64 MB of doubles
BLOCK_SIDE = 1024
BLOCK_ROWS = 8192


def weight_matrix(weights: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """``(in_idx, out_idx, w)`` as a dense matrix; refuses more than ``MATRIX_ELEMENTS`` entries."""
    if shape[0] * shape[1] > MATRIX_ELEMENTS or not rows_at_most(weights, MATRIX_ELEMENTS):
        raise ValueError("weights too large to hold in every task; use matmul_cells")
    table = weights.select("in_idx", "out_idx", "w").toArrow()
    out = np.zeros(shape)
    out[table["in_idx"].to_numpy(), table["out_idx"].to_numpy()] = table["w"].to_numpy()
    return out


def threshold_matrix(thresholds: DataFrame, channels: int, steps: int) -> np.ndarray:
    """``(c, step, t)`` as ``channels x steps``, each row ascending."""
    if channels * steps > MATRIX_ELEMENTS or not rows_at_most(thresholds, channels * steps):
        raise ValueError("unexpected number of thresholds")
    table = thresholds.select("c", "step", "t").toArrow()
    out = np.full((channels, steps), np.inf)
    out[table["c"].to_numpy(), table["step"].to_numpy()] = table["t"].to_numpy()
    return np.sort(out, axis=1)


def _dense(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths()
    if column.null_count or len(column) and set(lengths.unique().to_pylist()) != {width}:
        raise ValueError(f"every vector must have {width} elements")
    values = column.flatten()
    if values.null_count:
        raise ValueError("null element in a vector")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _bits(column: pa.Array, width: int, bipolar: bool) -> np.ndarray:
    """Texts of 0 and 1 of one length, padded with zeros to ``width``; 0 becomes -1 when bipolar."""
    texts = column.cast(pa.large_binary())
    if texts.null_count:
        raise ValueError("null vector")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    if len(lengths) and (lengths.min() != lengths.max() or lengths[0] > width):
        raise ValueError("bit texts of different length, or longer than the first layer")
    chars = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(texts), -1)
    out = np.zeros((len(texts), width))
    out[:, : chars.shape[1]] = chars - 48
    return out * 2 - 1 if bipolar else out


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Matrix product, in single precision where every partial sum is exact in it."""
    peak = max(abs(float(x.min())), abs(float(x.max())))
    whole = np.array_equal(w, np.rint(w)) and np.array_equal(x, np.rint(x))
    if whole and peak * np.abs(w).sum(axis=0).max() < 1 << 24:
        return x.astype(np.float32) @ w.astype(np.float32)
    return x @ w


def _steps_reached(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Number of thresholds at or below each value; ``t`` is ``channels x steps``."""
    if t.shape[1] <= 32:
        count = np.zeros(x.shape, dtype=np.int32)
        for step in t.T:
            count += x >= step
        return count
    return np.stack([np.searchsorted(t[c], x[:, c], side="right") for c in range(x.shape[1])], axis=1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel().astype(np.int64)).cast(kind))


def dense_layers(df: DataFrame, layers: Sequence[tuple[np.ndarray, np.ndarray | None, float, float]], vec: str = "vec", bipolar_bits: bool = False) -> DataFrame:
    """Run vectors through layers of ``(weights, thresholds or None, out_scale, out_bias)``.

    All layers run on one Arrow batch, so a chain of layers costs one transfer. Integer results
    are exact up to 2^53. ``vec`` is an array, or a text of bits that is padded with zeros to the
    width of the first layer and, with ``bipolar_bits``, mapped to -1 and +1.
    """
    as_text = isinstance(df.schema[vec].dataType, T.StringType)
    keep = [c for c in df.columns if c != vec]
    payload = df.sparkSession.sparkContext.broadcast(list(layers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            column, width = table[vec].combine_chunks(), payload.value[0][0].shape[0]
            x = _bits(column, width, bipolar_bits) if as_text else _dense(column, width)
            for w, t, scale, bias in payload.value:
                x = _product(x, w)
                if t is not None:
                    x = _steps_reached(x, t) * scale + bias
            columns = [table[c].combine_chunks() for c in keep] + [_lists(x, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, vec])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vec]
    return df.select(*keep, vec).mapInArrow(run, ", ".join([*fields, f"`{vec}` array<bigint>"]))


def _fits(weights: DataFrame, shape: tuple[int, int]) -> bool:
    return shape[0] * shape[1] <= MATRIX_ELEMENTS and rows_at_most(weights, MATRIX_ELEMENTS)


def matmul(df: DataFrame, weights: DataFrame, shape: tuple[int, int], vec: str = "vec") -> DataFrame:
    """``x[rows, MW] . W[MW, MH]`` on vectors; no shuffle for weights of proven size, blocks of them beyond it."""
    if not _fits(weights, shape):
        return _by_blocks(df, weights, shape, vec)
    return dense_layers(df, [(weight_matrix(weights, shape), None, 1, 0)], vec)


def mvau(
    df: DataFrame, weights: DataFrame, thresholds: DataFrame, shape: tuple[int, int], steps: int, out_scale: float = 1, out_bias: float = 0
) -> DataFrame:
    """Product, then per-output thresholds; tables of any size, as ``matmul``."""
    if not _fits(weights, shape) or shape[1] * steps > MATRIX_ELEMENTS:
        return _by_blocks(df, weights, shape, "vec", lambda cells: multi_threshold(cells, thresholds, out_scale, out_bias, spread=("_row",)))
    layer = (weight_matrix(weights, shape), threshold_matrix(thresholds, shape[1], steps), out_scale, out_bias)
    return dense_layers(df, [layer])


def _packed_blocks(weights: DataFrame, side: int) -> DataFrame:
    """``(in_idx, out_idx, w)`` as ``(ib, ob, m)``: blocks of ``side x side`` doubles, one row a block; blocks of zeros are absent."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        m = np.zeros((side, side))
        np.add.at(m, (table["i"].to_numpy(), table["o"].to_numpy()), table["w"].to_numpy())
        return pa.table({"ib": [key[0].as_py()], "ob": [key[1].as_py()], "m": pa.array([m.tobytes()], pa.binary())}, schema=schema)

    schema = pa.schema([("ib", pa.int32()), ("ob", pa.int32()), ("m", pa.binary())])
    place = [whole_div(F.col(c), side).cast("int").alias(n) for c, n in (("in_idx", "ib"), ("out_idx", "ob"))]
    within = [(F.col(c) % side).cast("int").alias(n) for c, n in (("in_idx", "i"), ("out_idx", "o"))]
    entries = weights.where("w <> 0").select(*place, *within, F.col("w").cast("double").alias("w"))
    return entries.groupBy("ib", "ob").applyInArrow(pack, "ib int, ob int, m binary")


def block_sums(rows: DataFrame, weights: DataFrame, shape: tuple[int, int], side: int | None = None, together: int | None = None) -> DataFrame:
    """``(_row, vec)`` times weights of any size as ``(_row, ob, val)``: output block ``ob`` of each row, ``side`` outputs.

    Vectors are cut into slices of ``side`` inputs, weights into blocks of ``side x side``. A task multiplies one block with
    the slices of about ``together`` rows; each slice is sent once per output block and each weight block once per
    ``together`` rows. Partial products are added in the order of the input blocks, so results do not depend on timing.
    """
    side, together = side or BLOCK_SIDE, together or BLOCK_ROWS
    n_in, n_out = (-(-n // side) for n in shape)
    shares = -(-max(1, rows.count()) // together)
    share = F.pmod(F.xxhash64("_row"), F.lit(shares)).cast("int").alias("share")
    at = F.sequence(F.lit(0), F.lit(n_in - 1))
    slices = F.transform(at, lambda b: F.struct(b.cast("int").alias("ib"), F.slice(F.col("vec").cast("array<double>"), b * side + 1, F.lit(side)).alias("x")))
    left = rows.select("_row", share, F.explode(slices).alias("s")).select("_row", "share", "s.ib", "s.x", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))).alias("ob"))
    right = _packed_blocks(weights, side).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    kind = rows.schema["_row"].dataType.simpleString()

    def product(key: tuple, xs: pa.Table, ws: pa.Table) -> pa.Table:
        ib, ob = key[0].as_py(), key[1].as_py()
        # the first block stands for every output, also one whose weights are all zero
        if not xs.num_rows or not ws.num_rows and ib:
            return pa.table({"_row": xs["_row"].slice(0, 0), "ob": pa.array([], pa.int32()), "ib": pa.array([], pa.int32()), "val": pa.array([], pa.list_(pa.float64()))})
        width = min(side, shape[1] - ob * side)
        x = xs["x"].combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        w = np.frombuffer(ws["m"][0].as_py()).reshape(side, side)[: x.shape[1], :width] if ws.num_rows else np.zeros((x.shape[1], width))
        offsets = pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32))
        n = pa.array(np.full(len(x), ob, np.int32)), pa.array(np.full(len(x), ib, np.int32))
        return pa.table({"_row": xs["_row"], "ob": n[0], "ib": n[1], "val": pa.ListArray.from_arrays(offsets, pa.array((x @ w).ravel()))})

    keys = ["ib", "ob", "share"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, f"_row {kind}, ob int, ib int, val array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("ib", "val")))
    sums = parts.groupBy("_row", "ob").agg(ordered.alias("p"))
    return sums.select("_row", "ob", F.reduce(F.slice("p", F.lit(2), F.size("p")), F.col("p")[0]["val"], lambda acc, q: F.zip_with(acc, q["val"], lambda a, b: a + b)).alias("val"))


def _by_blocks(df: DataFrame, weights: DataFrame, shape: tuple[int, int], vec: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``matmul`` for weights no task should hold. Rows are known by a hash of all their columns, equal rows are multiplied once.

    ``then`` maps the sums ``(_row, c, val)`` before they are put into vectors again.
    """
    named = df.withColumn("_row", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    wrong = F.col(vec).isNull() | (F.size(vec) != shape[0]) | F.exists(vec, lambda x: x.isNull())
    stop = F.raise_error(F.lit(f"every vector must have {shape[0]} elements and no null")).cast(df.schema[vec].dataType)
    once = named.select("_row", F.when(wrong, stop).otherwise(F.col(vec)).alias("vec")).dropDuplicates(["_row"])
    sums = block_sums(saved(once, "product-rows"), weights, shape)
    if then is None:
        ordered = F.array_sort(F.collect_list(F.struct("ob", "val")))
        vectors = sums.groupBy("_row").agg(F.flatten(F.transform(ordered, lambda s: s["val"])).cast("array<bigint>").alias("_out"))
    else:
        cells = sums.select("_row", "ob", F.posexplode("val").alias("_o", "val"))
        cells = then(cells.select("_row", (F.col("ob") * BLOCK_SIDE + F.col("_o")).alias("c"), "val"))
        ordered = F.array_sort(F.collect_list(F.struct("c", F.col("val").cast("long").alias("val"))))
        vectors = cells.groupBy("_row").agg(F.transform(ordered, lambda s: s["val"]).alias("_out"))
    joined = named.join(vectors, "_row")
    return joined.select(*[c for c in df.columns if c != vec], F.col("_out").alias(vec))


def matmul_cells(cells: DataFrame, weights: DataFrame, keys: Sequence[str] = ("row_id",), val: str = "val") -> DataFrame:
    """Sparse product on ``(…, i, val)``: join on the input index, sum per output.

    Zero weights are skipped. Weights are broadcast when small, else joined by salted shuffle.
    """
    w = weights.where("w <> 0").select(F.col("in_idx").alias("i"), "out_idx", F.col("w").cast("long").alias("w"))
    joined = param_join(cells, w, ["i"], "inner", spread=keys)
    return joined.groupBy(*keys, "out_idx").agg(F.sum(F.col(val).cast("long") * F.col("w")).alias("acc"))


def matmul_blocks(df: DataFrame, weights: DataFrame, n_out: int, keys: Sequence[str] = ("row_id",), block: int = 32, kind: str = "long") -> DataFrame:
    """Product on vectors inside the JVM: each input cell meets a strip of ``block`` weights.

    Rows grow by the number of strips and not by the number of outputs, and one vector's cells
    are summed before the shuffle. Every output is there, also one whose weights are all zero.
    """
    strips = weights.where("w <> 0").groupBy(F.col("in_idx").alias("i"), whole_div(F.col("out_idx"), block).cast("int").alias("ob")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("out_idx") % block).cast("int"), F.col("w").cast(kind)))).alias("m")
    ).select("i", "ob", F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: F.coalesce(F.col("m")[o], F.lit(0).cast(kind))).alias("ws"))
    cells = df.select(*keys, F.posexplode("vec").alias("i", "x"))
    joined = param_join(cells, strips, ["i"], "inner", spread=keys).select(*keys, "ob", F.col("x").cast(kind).alias("x"), "ws")
    none = F.lit(0).cast(kind)
    every = df.select(*keys, F.explode(F.sequence(F.lit(0), F.lit((n_out - 1) // block))).alias("ob"), none.alias("x"), F.array_repeat(none, block).alias("ws"))
    width = min(block, n_out)
    sums = joined.unionByName(every).groupBy(*keys, "ob").agg(*[F.sum(F.col("x") * F.col("ws")[o]).alias(f"a{o}") for o in range(width)])
    flat = sums.select(*keys, F.posexplode(F.array(*[F.col(f"a{o}") for o in range(width)])).alias("o", "acc"), "ob")
    return flat.select(*keys, (F.col("ob") * block + F.col("o")).alias("out_idx"), "acc").where(F.col("out_idx") < n_out)


def agreement(dot: Column, width: int) -> Column:
    """Number of agreeing bits of two bipolar vectors."""
    return ((dot + width) / 2).cast("long")


def xnor_matmul(df: DataFrame, weights: DataFrame, width: int, keys: Sequence[str] = ("row_id",), bipolar: bool = True) -> DataFrame:
    """Binary product by popcount: agreeing bits per output, ``(row, out_idx, acc)``.

    Both sides are packed to words of 63 bits, so a row meets one word array per output.
    """
    def as_bit(c: Column) -> Column:
        return ((c + 1) / 2).cast("int") if bipolar else c.cast("int")

    rows = df.select(*keys, lanes(F.transform("vec", as_bit), width).alias("xa"), F.explode(F.sequence(F.lit(0), F.lit((width + 62) // 63 - 1))).alias("lane"))
    rows = rows.select(*keys, "lane", F.element_at("xa", F.col("lane") + 1).alias("x"))
    packed = weights.select("out_idx", whole_div(F.col("in_idx"), 63).cast("int").alias("lane"),
        F.call_function("shiftleft", as_bit(F.col("w")).cast("long"), (F.col("in_idx") % 63).cast("int")).alias("bit"))
    packed = packed.groupBy("lane", "out_idx").agg(F.bit_or("bit").alias("w"))
    joined = param_join(rows, packed, ["lane"], "inner", spread=keys)
    used = F.least(F.lit(63), F.lit(width) - F.col("lane") * 63)
    differing = F.bit_count(F.col("x").bitwiseXOR(F.col("w")))
    return joined.groupBy(*keys, "out_idx").agg(F.sum(used - differing).cast("long").alias("acc"))


def depthwise(
    cells: DataFrame, weights: DataFrame, bipolar_width: int | None = None, thresholds: DataFrame | None = None, out_scale: float = 1, out_bias: float = 0
) -> DataFrame:
    """Per-channel product on windows ``(row_id, oh, ow, kh, kw, c, val)``; weights ``(c, kh, kw, w)``.

    ``bipolar_width`` is the kernel size when both sides are bipolar: agreements are returned.
    With ``thresholds`` ``(c, step, t)`` the sums, or agreements, pass through them.
    """
    joined = param_join(cells, weights.select("c", "kh", "kw", "w"), ["c", "kh", "kw"], "inner", spread=("row_id", "oh", "ow"))
    out = joined.groupBy("row_id", "oh", "ow", "c").agg(F.sum(F.col("val").cast("long") * F.col("w")).alias("val"))
    out = out.withColumn("val", agreement(F.col("val"), bipolar_width)) if bipolar_width else out
    return out if thresholds is None else multi_threshold(out, thresholds, out_scale, out_bias, spread=("row_id", "oh", "ow"))
