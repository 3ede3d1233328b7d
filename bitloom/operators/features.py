"""Tabular feature preparation: encode, scale, quantize, expand to bits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import cut_lineage
from ..sizing import BROADCAST_ROWS, param_join, rows_at_most
from .scans import row_numbers


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def label_vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: position of each value among the sorted distinct values of its column.

    All columns are read in one pass, and the distinct values are stored. A vocabulary too long for
    one sort per column is sorted by range over all tasks.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    distinct = cut_lineage(df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value IS NOT NULL").distinct())
    if rows_at_most(distinct, BROADCAST_ROWS):
        whole = Window.partitionBy("column").orderBy("value")
        return distinct.select("column", "value", (F.row_number().over(whole) - 1).alias("code"))
    return _ranked_by_range(distinct)


def _ranked_by_range(distinct: DataFrame) -> DataFrame:
    """Positions from a range sort: rows of a task are in order, and so are the tasks."""
    ordered = distinct.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    # the id is stored with the rows: task number in the high bits, position in the low 33
    stored = cut_lineage(ordered.select("column", "value", F.monotonically_increasing_id().alias("_id")))
    stored = stored.withColumn("_task", F.shiftright("_id", 33))
    tasks = stored.groupBy("column", "_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("column").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("column", "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = param_join(stored, offsets, ["column", "_task"], spread=["value"])
    return joined.select("column", "value", (F.col("_base") + F.col("_id") - F.col("_first")).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Replace string columns by their sorted-vocabulary index, fitted on the whole input."""
    cols = string_columns(df) if cols is None else list(cols)
    if not cols:
        return df
    vocabulary = label_vocabulary(df, cols) if vocabulary is None else vocabulary
    out = df
    for c in cols:
        one = vocabulary.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"_{c}"))
        spread = [k for k in df.columns if k != c][:4]
        out = param_join(out, one, [c], "left", spread=spread or [c])
        out = out.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out.select(*df.columns)


def one_hot(df: DataFrame, col: str, vocab: Sequence[str], strict: bool = True) -> DataFrame:
    """One 0/1 column per vocabulary entry, placed before the other columns; the source column is dropped."""
    value = F.col(col)
    if strict:
        known = value.isin(list(vocab))
        value = F.when(known, value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {col}: "), F.coalesce(value, F.lit("null")))))
    hot = [(value == v).cast("int").alias(v) for v in vocab]
    return df.select(*hot, *[F.col(f"`{c}`") for c in df.columns if c != col])


def one_hot_vector(col: Column, vocab: Sequence[str]) -> Column:
    """One-hot as one array; an unknown value gives all zeros."""
    return F.array(*[(col == v).cast("int") for v in vocab])


def unknown_values(df: DataFrame, col: str, vocab: Sequence[str]) -> DataFrame:
    """Values outside a vocabulary, with their counts."""
    return df.where(~F.col(col).isin(list(vocab)) | F.col(col).isNull()).groupBy(col).agg(F.count("*").alias("n"))


def min_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest positive value of every column, in one aggregate."""
    return df.agg(*[F.min(F.when(F.col(c) > 0, F.col(c).cast("double"))).alias(c) for c in cols])


def _scaled(c: Column, smallest: Column) -> Column:
    inverse = F.lit(1.0) / smallest
    return F.when(inverse > 1, c.cast("double") * inverse).otherwise(c.cast("double"))


Stats = dict[str, tuple[float | None, int]]


def _width(smallest: float | None, peak: float | None) -> int:
    """Bits of the scaled, unclipped maximum."""
    if peak is None:
        return 0
    scaled = peak * (1.0 / smallest) if smallest is not None and 1.0 / smallest > 1 else peak
    return next((b for b in range(64) if scaled + 1 <= 2.0**b), 64)


def column_stats(df: DataFrame, cols: Sequence[str]) -> Stats:
    """Per column: smallest positive value and bits of the scaled maximum.

    Scaling is monotone, so both follow from one aggregate over the data. The result has the size
    of the schema.
    """
    if not cols:
        return {}
    row = df.agg(
        *[F.min(F.when(F.col(c) > 0, F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.max(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"m{i}"], _width(row[f"m{i}"], row[f"x{i}"])) for i, c in enumerate(cols)}


def code_stats(vocabulary: DataFrame) -> Stats:
    """The same for encoded columns, from their vocabulary alone."""
    rows = vocabulary.groupBy("column").agg(F.max("code").alias("x")).collect()
    return {r["column"]: (1.0 if r["x"] > 0 else None, _width(None, float(r["x"]))) for r in rows}


def scale_by_min_positive(df: DataFrame, cols: Sequence[str], stats: Stats | None = None) -> DataFrame:
    """Multiply a column by ``1/m`` where that is above 1; ``m`` is its smallest positive value."""
    stats = column_stats(df, cols) if stats is None else stats

    def scaled(c: str) -> Column:
        smallest, value = stats[c][0], F.col(c).cast("double")
        return value * F.lit(1.0 / smallest) if smallest is not None and 1.0 / smallest > 1 else value

    return df.select(*[scaled(c).alias(c) if c in stats else F.col(c) for c in df.columns])


def bits_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, min_positive, bits)`` as a table."""
    parts = df.agg(*[
        F.struct(
            F.min(F.when(F.col(c) > 0, F.col(c).cast("double"))).alias("m"), F.max(F.col(c).cast("double")).alias("x")
        ).alias(f"s{i}")
        for i, c in enumerate(cols)
    ])
    long = parts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}.m").alias("min_positive"), F.col(f"s{i}.x").alias("x"))
        for i, c in enumerate(cols)
    ])).alias("r")).select("r.*")
    peak = F.when(F.col("min_positive").isNull(), F.col("x")).otherwise(_scaled(F.col("x"), F.col("min_positive")))
    return long.select("column", "min_positive", S.bits_needed(peak).alias("bits"))


def apply_overrides(df: DataFrame, key: str, col: str, overrides: DataFrame) -> DataFrame:
    """Replace values of one column on known rows; ``overrides(key, value)``."""
    small = overrides.select(F.col(key), F.col("value").alias("_override"))
    out = param_join(df, small, [key], "left", spread=[key])
    return out.withColumn(col, F.coalesce("_override", col)).drop("_override").select(*df.columns)


def quantize_columns(df: DataFrame, cols: Sequence[str], stats: Stats) -> DataFrame:
    """Scale, clip to 32 bits and round half up."""
    scaled = scale_by_min_positive(df, cols, stats)
    return scaled.select(*[S.quantize_u32(F.col(c)).alias(c) if c in stats else F.col(c) for c in df.columns])


def assemble_bit_text(cols: Iterable[tuple[str, int]]) -> Column:
    """All columns in binary, most significant bit first, as one text of 0 and 1."""
    return F.concat(*[S.bit_string(F.col(c), b) for c, b in cols if b > 0])


def assemble_bits(cols: Iterable[tuple[str, int]]) -> Column:
    """All columns in binary as one array of 0 and 1; the label comes last when its column does."""
    return F.transform(F.split(assemble_bit_text(cols), ""), lambda s: s.cast("tinyint"))


def feature_job(
    df: DataFrame,
    cols: Sequence[str],
    keep: Sequence[str] = (),
    overrides: tuple[str, str, DataFrame] | None = None,
    as_text: bool = False,
) -> tuple[DataFrame, int]:
    """Encode, scale, quantize and expand ``cols``; gives ``(keep…, bits)`` and the vector width.

    Two passes over the data: one aggregate for vocabulary and ranges, one projection. The
    projection needs no shuffle.
    """
    text = [c for c in string_columns(df) if c in cols]
    vocabulary = label_vocabulary(df, text) if text else None
    stats = column_stats(df, [c for c in cols if c not in text]) | (code_stats(vocabulary) if text else {})
    encoded = label_encode(df.select(*keep, *cols), text, vocabulary)
    ready = quantize_columns(encoded, cols, stats)
    if overrides is not None:
        key, col, table = overrides
        ready = apply_overrides(ready, key, col, table)
    layout = [(c, stats[c][1]) for c in cols]
    vector = assemble_bit_text(layout) if as_text else assemble_bits(layout)
    return ready.select(*keep, vector.alias("bits")), sum(b for _, b in layout)


def split_by_source(df: DataFrame, part: str, col: str = "split") -> DataFrame:
    return df.where(F.col(col) == part)


def split_by_position(df: DataFrame, row_id: str, first: int) -> DataFrame:
    """Mark the first rows ``train`` and the rest ``test`` by an explicit dense row id."""
    return df.withColumn("split", F.when(F.col(row_id) < first, "train").otherwise("test"))


def batches(df: DataFrame, n: int, order: str, dense: bool = False) -> DataFrame:
    """Number full batches of ``n`` rows; the last, incomplete one is left out.

    ``order`` is a unique integer column; unless it is already dense from 0, positions are counted
    block by block.
    """
    numbered = df.withColumn("_pos", F.col(order)) if dense else row_numbers(df, [], [order], "_pos")
    full = df.agg(S.whole_div(F.count("*"), n)).scalar()
    out = numbered.withColumn("batch_id", S.whole_div(F.col("_pos"), n))
    return out.where(F.col("batch_id") < full).drop("_pos")
