"""Accuracy, golden comparison and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import topk_argsort
from .scans import block_scan


def accuracy(df: DataFrame, predicted: str = "predicted", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """OK, NOK and ``100 * ok / scored``."""
    ok = F.count_if(F.col(predicted) == F.col(label))
    total = F.count("*")
    return df.groupBy(*by).agg(ok.alias("ok"), (total - ok).alias("nok"), (ok * 100.0 / total).alias("accuracy"))


def batch_accuracy(df: DataFrame, n: int, order: str, predicted: str = "predicted", label: str = "label", dense: bool = False) -> DataFrame:
    """Accuracy over full batches, with the number of rows left over."""
    from .features import batches

    scored = accuracy(batches(df, n, order, dense), predicted, label)
    total = df.agg(F.count("*")).scalar()
    return scored.withColumn("dropped", total - F.col("ok") - F.col("nok"))


def _hit(df: DataFrame, k: int, scores: str, label: str) -> DataFrame:
    top = topk_argsort(F.col(scores), k)
    return df.withColumn("_top1", (F.element_at(top, 1) == F.col(label)).cast("long")).withColumn(
        "_topk", F.array_contains(top, F.col(label)).cast("long")
    )


def topk_accuracy(df: DataFrame, k: int, scores: str = "scores", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    hits = _hit(df, k, scores, label)
    n = F.count("*")
    return hits.groupBy(*by).agg(
        n.alias("n"), F.sum("_top1").alias("top1"), F.sum("_topk").alias("topk"), (F.sum("_top1") * 100.0 / n).alias("top1_pct"), (F.sum("_topk") * 100.0 / n).alias("topk_pct")
    )


def running_topk_accuracy(df: DataFrame, k: int, order: str, scores: str = "scores", label: str = "label", by: Sequence[str] = (), block_bits: int = 20) -> DataFrame:
    """Top-1 and top-k hits so far after each item, block by block."""
    hits = _hit(df, k, scores, label).select(*by, order, "_top1", "_topk")
    out = block_scan(hits, by, [order], sums={"n": F.lit(1).cast("long"), "top1": F.col("_top1"), "topk": F.col("_topk")}, block_bits=block_bits)
    return out.select(*by, order, "n", "top1", "topk")


def running_accuracy(df: DataFrame, batch: str = "batch_id", predicted: str = "predicted", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """OK and NOK so far after each batch; batches are aggregated before anything is ordered."""
    hit = (F.col(predicted) == F.col(label)).cast("long")
    per = df.groupBy(*by, batch).agg(F.sum(hit).alias("_ok"), F.count("*").alias("_n"))
    out = block_scan(per, by, [batch], sums={"ok": F.col("_ok"), "seen": F.col("_n")})
    return out.select(*by, batch, "ok", (F.col("seen") - F.col("ok")).alias("nok"))


def binary_accuracy(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``sigmoid(score) > 0.5`` against a 0/1 label."""
    return accuracy(df.withColumn("predicted", (F.col(score) > 0).cast("int")), "predicted", label)


def is_close(expected: Column, got: Column, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    return F.abs(expected - got) <= F.lit(atol) + F.lit(rtol) * F.abs(got)


def compare(expected: DataFrame, got: DataFrame, item: str = "row_id", cell: Sequence[str] = ("i",), val: str = "val", atol: float = 1e-3) -> DataFrame:
    """SUCCESS or FAIL per item; a cell missing on either side fails it."""
    key = [item, *cell]
    a = expected.select(*key, F.col(val).alias("_e"))
    b = got.select(*key, F.col(val).alias("_g"))
    close = F.coalesce(is_close(F.col("_e"), F.col("_g"), atol), F.lit(False))
    per = a.join(b, key, "full_outer").groupBy(item).agg(F.count("*").alias("n_cells"), F.count_if(~close).alias("n_bad"))
    return per.withColumn("status", F.when(F.col("n_bad") == 0, "SUCCESS").otherwise("FAIL"))


def flat_cells(df: DataFrame, shape: Mapping[str, int], item: str = "row_id", val: str = "val") -> DataFrame:
    """``(item, at, val)`` with the position of each cell in the flattened array, the last index fastest; null outside the shape."""
    at, inside = F.lit(0).cast("long"), F.lit(True)
    for name, size in shape.items():
        at, inside = at * size + F.col(name), inside & F.col(name).between(0, size - 1)
    return df.select(item, F.when(inside, at).alias("at"), val)


def compare_reshaped(expected: DataFrame, got: DataFrame, expected_shape: Mapping[str, int], got_shape: Mapping[str, int], item: str = "row_id", val: str = "val", atol: float = 1e-3) -> DataFrame:
    """As ``compare`` for arrays of equal size and different shape, such as an image and the vector it was flattened to.

    Shapes name the index columns and their sizes. A cell outside its shape meets nothing and fails its item.
    """
    if prod(expected_shape.values()) != prod(got_shape.values()):
        raise ValueError(f"shapes of different size: {dict(expected_shape)}, {dict(got_shape)}")
    return compare(flat_cells(expected, expected_shape, item, val), flat_cells(got, got_shape, item, val), item, ("at",), val, atol)


def compare_rows(expected: DataFrame, got: DataFrame, item: str = "row_id", vec: str = "vec", atol: float = 1e-3) -> DataFrame:
    """As ``compare`` for one array per item: rows are joined, not elements. A shorter or absent array lacks its cells."""
    none = F.array().cast("array<double>")
    both = expected.select(item, F.col(vec).alias("_e")).join(got.select(item, F.col(vec).alias("_g")), item, "full_outer")
    e, g = [F.coalesce(F.col(c).cast("array<double>"), none) for c in ("_e", "_g")]
    far = F.filter(F.zip_with(e, g, lambda x, y: F.coalesce(is_close(x, y, atol), F.lit(False))), lambda ok: ~ok)
    counted = both.select(item, F.greatest(F.size(e), F.size(g)).cast("long").alias("n_cells"), F.size(far).cast("long").alias("n_bad"))
    return counted.withColumn("status", F.when(F.col("n_bad") == 0, "SUCCESS").otherwise("FAIL"))


def verify_stages(stages: dict[str, tuple[DataFrame, DataFrame]], item: str = "row_id", vec: str = "vec") -> DataFrame:
    """``compare_rows`` for each named stage, as one table."""
    parts = [compare_rows(e, g, item, vec).withColumn("stage", F.lit(name)) for name, (e, g) in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall(report: DataFrame) -> DataFrame:
    """SUCCESS per stage when every item succeeded."""
    return report.groupBy("stage").agg(
        F.when(F.bool_and(F.col("status") == "SUCCESS"), "SUCCESS").otherwise("FAIL").alias("result"), F.count("*").alias("n_items")
    )


def within(df: DataFrame, estimate: str, measured: str, tolerance: float = 0.15, ratio: float | None = None) -> DataFrame:
    """Whether an estimate is near a measurement, by relative error or by a least ratio."""
    m, e = F.col(measured), F.col(estimate)
    ok = m / e > ratio if ratio is not None else F.abs(m - e) < F.abs(m) * tolerance
    return df.withColumn("within", ok)


def report_differences(expected: DataFrame, got: DataFrame, key: Sequence[str], val: str = "value") -> DataFrame:
    """Keys missing on one side, or with different values."""
    a = expected.select(*key, F.col(val).alias("expected"), F.lit(1).alias("_a"))
    b = got.select(*key, F.col(val).alias("got"), F.lit(1).alias("_b"))
    reason = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(~F.col("expected").eqNullSafe(F.col("got")), "different")
    )
    out = a.join(b, list(key), "full_outer").withColumn("reason", reason).where(F.col("reason").isNotNull())
    return out.select(*key, "expected", "got", "reason")


def apply_config(layers: DataFrame, config: DataFrame) -> DataFrame:
    """Write ``config(model_id, layer_id, name, value)`` entries into the layers' attributes."""
    per = config.groupBy("model_id", "layer_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_new"))
    joined = layers.join(per, ["model_id", "layer_id"], "left")
    kept = F.map_filter("attrs", lambda k, v: ~F.coalesce(F.map_contains_key(F.col("_new"), k), F.lit(False)))
    merged = F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(F.map_concat(kept, F.col("_new")))
    return joined.withColumn("attrs", merged).drop("_new").select(*layers.columns)


def unmatched_config(layers: DataFrame, config: DataFrame) -> DataFrame:
    """Configuration entries that match no layer."""
    return config.join(layers.select("model_id", "layer_id"), ["model_id", "layer_id"], "left_anti")
