"""Typed pseudo-random inputs, the same on every run and for any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import QuantType


def typed_value(q: QuantType, *parts: Column) -> Column:
    """A value of the type from a hash of ``parts``."""
    h = F.xxhash64(*parts)
    if q.name == "BIPOLAR":
        return F.pmod(h, F.lit(2)) * 2 - 1
    if q.name == "FLOAT32":
        return (F.pmod(h, F.lit(1 << 24)).cast("double") / float(1 << 24)).cast("float")
    if q.name.startswith("FIXED"):
        return (F.pmod(h, F.lit(1 << q.bits)) - (1 << (q.bits - 1))) * F.lit(q.scale)
    if q.bits >= 63:
        return h if q.signed else F.shiftrightunsigned(h, 1)
    return F.pmod(h, F.lit(int(q.max) - int(q.min) + 1)) + int(q.min)


def gen_typed(spark: SparkSession, q: QuantType, n: int, dim: int, seed: int = 0) -> DataFrame:
    """``(row_id, vec)``: ``n`` vectors of ``dim`` values."""
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    vec = F.transform(at, lambda i: typed_value(q, F.col("row_id"), i, F.lit(seed)))
    return spark.range(n).select(F.col("id").alias("row_id"), vec.alias("vec"))


def gen_like(df: DataFrame, key: str, q: QuantType, dim: int, seed: int = 0) -> DataFrame:
    """One typed vector for each row of an existing table."""
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    return df.select(F.col(key).alias("row_id"), F.transform(at, lambda i: typed_value(q, F.col(key), i, F.lit(seed))).alias("vec"))


def gen_layers(spark: SparkSession, widths: list[int], model_id: str, seed: int = 0, q: QuantType | None = None) -> DataFrame:
    """Weights of a chain of dense layers with the given widths."""
    q = q or QuantType.parse("TERNARY")
    parts = []
    for layer, (a, b) in enumerate(zip(widths, widths[1:])):
        cells = spark.range(a * b).select(
            F.lit(model_id).alias("model_id"),
            F.lit(layer).alias("layer_id"),
            F.expr(f"CAST(id DIV {b} AS INT)").alias("in_idx"),
            (F.col("id") % b).cast("int").alias("out_idx"),
        )
        parts.append(cells.withColumn("w", typed_value(q, F.col("in_idx"), F.col("out_idx"), F.lit(seed + layer)).cast("int")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gen_thresholds(df: DataFrame, keys: list[str], q: QuantType, steps: int, seed: int = 0) -> DataFrame:
    """Ascending pseudo-random thresholds for each key of a table: ``(keys, step, t)``."""
    at = F.sequence(F.lit(0), F.lit(steps - 1))
    drawn = F.array_sort(F.transform(at, lambda i: typed_value(q, *[F.col(k) for k in keys], i, F.lit(seed))))
    return df.select(*keys, F.posexplode(drawn).alias("step", "t"))
