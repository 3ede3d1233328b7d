"""Top-k by value, label sampling, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_select(vec: Column, k: int) -> Column:
    """Indices of the k largest elements, largest first; ties go to the lower index."""
    ranked = F.array_sort(F.transform(vec, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda p: p["i"])


def topk_argsort(vec: Column, k: int) -> Column:
    """As ``label_select``, but ties go to the higher index."""
    ranked = F.array_sort(F.transform(vec, lambda v, i: F.struct((-v).alias("v"), (-i).alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda p: -p["i"])


def label_select_cells(cells: DataFrame, k: int, keys: Sequence[str] = ("row_id",), idx: str = "out_idx", val: str = "acc") -> DataFrame:
    """Top k of each row in cell layout; the rank limit is applied before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(val).desc(), F.col(idx).asc())
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def verify_topk(vec: Column, chosen: Column, k: int) -> Column:
    """Whether chosen indices point at the k largest values, whatever the order of ties."""
    top = F.slice(F.sort_array(vec, asc=False), 1, k)
    picked = F.transform(chosen, lambda i: F.element_at(vec, (i + 1).cast("int")))
    return F.sort_array(picked, asc=False) == top


def rank_by(df: DataFrame, col: str, ties: Sequence[str], by: Sequence[str] = (), ascending: bool = True) -> DataFrame:
    """Position by a metric within ``by`` (a small, already aggregated table)."""
    metric = F.col(col).asc() if ascending else F.col(col).desc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(metric, *ties)))


def sample_items(df: DataFrame, n: int, interleave: bool, cls: str = "label", name: str = "name") -> DataFrame:
    """First n items by class, or interleaved over classes.

    By class it is a plain top-n. Interleaved, no class can give more than n items, so the rank
    limit n is applied per class before the shuffle.
    """
    if not interleave:
        return df.orderBy(cls, name).limit(n)
    order = Window.partitionBy(cls).orderBy(name)
    ranked = df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    return ranked.orderBy("_rn", cls).limit(n).drop("_rn")
