"""Joins against parameter tables whose size is checked before anything is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import cut_lineage

#: most rows, and most bytes, of a parameter table that may be broadcast
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: most weights that may be held by every task as one matrix
MATRIX_ELEMENTS = 4_000_000
#: a key with more rows than this is hot; it gets PIECES salts for each so many rows, since several
#: salts may hash to one task and small pieces even that out
HOT_ROWS = 2_000_000
PIECES = 4


def rows_at_most(df: DataFrame, n: int) -> bool:
    """Whether a table has at most ``n`` rows; reads no more than ``n + 1`` of them."""
    return df.limit(n + 1).count() <= n


def _bytes_of(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType)):
        flat = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)
        return F.greatest(F.size(c), F.lit(0)) * (8 if flat else 64) + 16
    return F.lit(8)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes, by reading it."""
    size = sum((_bytes_of(f) for f in df.schema.fields), F.lit(0))
    n, held = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and held <= BROADCAST_BYTES


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share a small input with all cores; a large one already has enough splits and is left alone.

    A file of one row group is read by one task, whatever the number of cores. Below one split of
    data per core, a hash on ``key`` costs little and lets the row-local work run in parallel.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = 128 << 20
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * split else df


def param_join(
    df: DataFrame,
    params: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = ("row_id",),
    max_rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join data with a parameter table on a key of few values.

    A table proven small is broadcast. A larger one is joined by shuffle. Keys with more than
    ``hot_rows`` rows of data are then shared by as many tasks as their count asks for: their rows
    get a salt from the ``spread`` columns and their parameter rows are copied once per salt. Other
    keys are not copied. Many rows without a key, which meet no parameter, are spread the same way.
    """
    on = list(on)
    if fits_broadcast(params, BROADCAST_ROWS if max_rows is None else max_rows):
        return df.join(F.broadcast(params), on, how)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    # at most one row per ``limit`` rows of data
    counted = df.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    hot = cut_lineage(counted.select(*on, F.ceil(F.col("_n") * PIECES / limit).cast("int").alias("_salts")))
    if hot.isEmpty():
        return df.join(params, on, how)
    keyless = F.lit(False)
    for c in on:
        keyless = keyless | F.col(c).isNull()
    lost = hot.where(keyless).agg(F.coalesce(F.max("_salts"), F.lit(1))).scalar()
    small = fits_broadcast(hot, BROADCAST_ROWS)
    marked = [d.join(F.broadcast(hot) if small else hot, on, "left") for d in (df, params)]
    salts = F.when(keyless, lost).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = marked[0].withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), salts).cast("int")).drop("_salts")
    copies = marked[1].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies, on + ["_salt"], how).drop("_salt")
