"""The two layouts of a tensor: one array per row, or one cell per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_cells(df: DataFrame, vec: str = "vec", idx: str = "i", val: str = "val") -> DataFrame:
    """``(…, vec)`` to ``(…, i, val)``."""
    keep = [c for c in df.columns if c != vec]
    return df.select(*keep, F.posexplode(vec).alias(idx, val))


def to_arrays(df: DataFrame, keys: list[str], idx: str = "i", val: str = "val", vec: str = "vec") -> DataFrame:
    """Cells back to one array per key, ordered by the index and not by arrival.

    A group is one vector, so its size is the vector width.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(val).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(vec))


def to_image(df: DataFrame, width: int, channels: int, vec: str = "vec") -> DataFrame:
    """One array per row to ``(row_id, h, w, c, val)`` with channels innermost."""
    cells = to_cells(df, vec)
    return cells.select(
        *[c for c in cells.columns if c not in ("i", "val")],
        F.expr(f"CAST(i DIV {width * channels} AS INT)").alias("h"),
        F.expr(f"CAST((i DIV {channels}) % {width} AS INT)").alias("w"),
        F.expr(f"CAST(i % {channels} AS INT)").alias("c"),
        "val",
    )


def flat_index(layout: str, height: int, width: int, channels: int):
    """Position of a cell in the flattened image, ``NHWC`` or ``NCHW``."""
    if layout == "NHWC":
        return (F.col("h") * width + F.col("w")) * channels + F.col("c")
    if layout == "NCHW":
        return (F.col("c") * height + F.col("h")) * width + F.col("w")
    raise ValueError(layout)
