"""Row-local array operators and joins of equal-shaped tensors."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import signed_width, unsigned_width
from ..sizing import BROADCAST_ROWS, param_join
from ..types import QuantType


def fold(vec: Column, pe: int) -> Column:
    """Cut a vector into groups of ``pe`` elements; the length must divide."""
    guard = F.when(F.size(vec) % pe != 0, F.raise_error(F.lit("length does not divide")))
    starts = F.sequence(F.lit(0), (F.size(vec) / pe).cast("int") - 1)
    return guard.otherwise(F.transform(starts, lambda i: F.slice(vec, i * pe + 1, pe)))


def unfold(vec: Column) -> Column:
    return F.flatten(vec)


def pad_vec(vec: Column, width: int) -> Column:
    """Append zeros up to ``width``."""
    return F.concat(vec, F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.size(vec), F.lit(0))))


def _two(a: DataFrame, b: DataFrame, key: Sequence[str], fn: Callable[[Column, Column], Column], vec: str) -> DataFrame:
    key = list(key)
    left = a.select(*key, F.col(vec).alias("_a"))
    right = b.select(*key, F.col(vec).alias("_b"))
    same = F.size("_a") == F.size("_b")
    checked = F.when(F.coalesce(same, F.lit(False)), F.zip_with("_a", "_b", fn)).otherwise(
        F.raise_error(F.lit("rows without a partner, or of different length"))
    )
    return left.join(right, key, "full_outer").select(*key, checked.alias(vec))


def add_streams(a: DataFrame, b: DataFrame, key: Sequence[str] = ("row_id",), vec: str = "vec") -> DataFrame:
    """Element-wise sum of two equal-shaped streams; a row without a partner fails the query."""
    return _two(a, b, key, lambda x, y: x + y, vec)


def eltwise(a: DataFrame, b: DataFrame, op: str, key: Sequence[str] = ("row_id",), vec: str = "vec") -> DataFrame:
    """``sub``: a-b; ``absdiff``: abs(a-b)."""
    if op == "sub":
        return _two(a, b, key, lambda x, y: x - y, vec)
    if op == "absdiff":
        return _two(a, b, key, lambda x, y: F.abs(x - y), vec)
    raise ValueError(f"unknown element-wise operator {op}")


def concat_streams(parts: Sequence[DataFrame], key: Sequence[str] = ("row_id",), vec: str = "vec") -> DataFrame:
    """Join streams on their key and concatenate the vectors in input order."""
    key = list(key)
    named = [p.select(*key, F.col(vec).alias(f"_v{i}")) for i, p in enumerate(parts)]
    joined = reduce(lambda x, y: x.join(y, key, "full_outer"), named)
    cols = [F.col(f"_v{i}") for i in range(len(parts))]
    present = reduce(operator.and_, [c.isNotNull() for c in cols])
    whole = F.when(present, F.concat(*cols)).otherwise(F.raise_error(F.lit("row missing in one input")))
    return joined.select(*key, whole.alias(vec))


def channelwise(cells: DataFrame, params: DataFrame, func: str, channel: str = "c", val: str = "val") -> DataFrame:
    """Combine each cell with the parameter ``p`` of its channel: ``add mul cmp_le cmp_ge``."""
    x, p = F.col(val), F.col("_p")
    table = {
        "add": x + p,
        "mul": x * p,
        "cmp_le": (x <= p).cast("int"),
        "cmp_ge": (x >= p).cast("int"),
    }
    if func not in table:
        raise ValueError(f"unknown channel-wise function {func}")
    small = params.select(F.col(channel), F.col("p").alias("_p"))
    joined = param_join(cells, small, [channel], "left")
    checked = F.when(p.isNull(), F.raise_error(F.lit("channel without parameter"))).otherwise(table[func])
    return joined.withColumn(val, checked).select(*cells.columns)


def tee(df: DataFrame, n: int) -> list[DataFrame]:
    """The same stream for ``n`` consumers; Spark shares the scan, nothing is copied."""
    return [df for _ in range(n)]


def scale_normalize(cells: DataFrame, means: DataFrame, std: float, channel: str = "c", val: str = "val") -> DataFrame:
    """``(x - mean[channel]) / std`` with one std for all channels; ``means(c, mean)``."""
    joined = param_join(cells, means.select(channel, "mean"), [channel], "left")
    return joined.withColumn(val, (F.col(val) - F.col("mean")) / F.lit(std)).select(*cells.columns)


def check_type(df: DataFrame, cols: Sequence[str], q: QuantType) -> DataFrame:
    """Rows, values checked and violations per column."""
    ok = {c: q.allowed(F.col(c)) for c in cols}
    sums = df.agg(*[F.struct(F.count(c).alias("n"), F.count_if(~ok[c]).alias("bad")).alias(f"s{i}") for i, c in enumerate(cols)])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}.n").alias("n_checked"), F.col(f"s{i}.bad").alias("n_bad"))
        for i, c in enumerate(cols)
    ])).alias("r")).select("r.*")


def smallest_type_name(low: Column, high: Column) -> Column:
    """Narrowest type for a range: ``BINARY``, then ``UINTn``, then ``INTn``; 64 bits when nothing narrower fits."""
    u = unsigned_width(high)
    unsigned = F.when(u <= 1, F.lit("BINARY")).otherwise(F.concat(F.lit("UINT"), F.least(u, F.lit(64)).cast("string")))
    s = F.least(signed_width(low, high), F.lit(64))
    return F.when(low >= 0, unsigned).otherwise(F.concat(F.lit("INT"), s.cast("string")))


def smallest_type(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Range and narrowest type of every column, in one aggregate."""
    ranges = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"s{i}") for i, c in enumerate(cols)])
    long = ranges.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}.lo").alias("lo"), F.col(f"s{i}.hi").alias("hi"))
        for i, c in enumerate(cols)
    ])).alias("r")).select("r.*")
    return long.select("column", "lo", "hi", smallest_type_name(F.col("lo"), F.col("hi")).alias("type"))


def lookup(df: DataFrame, idx: str, emb: DataFrame, oob: str = "error", spread: Sequence[str] = ("row_id",)) -> DataFrame:
    """Replace an index by its embedding; ``emb(idx, vec)`` is dense from 0.

    ``error``: an index outside the table fails the query. ``row0``: it reads row 0 and ``oob`` is 1.
    A table of checked size is broadcast. A larger one is joined by shuffle on the index and a
    salt, so one popular index is spread over many tasks.
    """
    if oob not in ("error", "row0"):
        raise ValueError(oob)
    size = emb.agg(F.count("*")).scalar()
    bad = (F.col(idx) < 0) | (F.col(idx) >= size)
    if oob == "error":
        safe = F.when(bad, F.raise_error(F.lit("index outside the table"))).otherwise(F.col(idx))
    else:
        safe = F.when(bad, F.lit(0)).otherwise(F.col(idx))
    named = emb.select(F.col("idx").alias("_idx"), F.col("vec"))
    keyed = df.withColumn("_idx", safe.cast("long")).withColumn("oob", bad.cast("int"))
    return param_join(keyed, named, ["_idx"], "left", spread=spread, max_rows=BROADCAST_ROWS // 10).drop("_idx")


def out_of_range_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("oob").alias("n_out_of_range"), F.count("*").alias("n_rows"))


def name_labels(df: DataFrame, names: DataFrame, col: str = "label") -> DataFrame:
    """Add the readable name of a class id; ``names(label, name)``. Unknown ids get null."""
    small = names.select(F.col("label").alias(col), "name")
    return param_join(df, small, [col], "left", spread=[c for c in df.columns if c != col][:3] or [col])
