"""Multi-level thresholds: ``y = out_scale * #{T_i <= x} + out_bias``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import whole_div
from ..session import saved
from ..sizing import fits_broadcast, param_join

#: most steps of a channel that are held as one array
MAX_STEPS = 100_000
#: arrays up to this size are counted through, longer ones searched by halves
SHORT = 32


def threshold_arrays(thresholds: DataFrame, keys: tuple[str, ...] = ("c",)) -> DataFrame:
    """``(c, step, t)`` to one ascending array per channel; a group holds the steps of one channel."""
    return thresholds.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))


def count_reached(x: Column, ts: Column) -> Column:
    """How many thresholds of an ascending array are at or below ``x``; 0 for null thresholds, null for null ``x``."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below, open_ = F.coalesce(F.get(ts, middle) <= x, F.lit(False)), acc["lo"] < acc["hi"]
        lo = F.when(open_ & below, middle + 1).otherwise(acc["lo"])
        return F.struct(lo.alias("lo"), F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi"))

    counted = F.size(F.filter(ts, lambda t: t <= x))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ts) + 1)).cast("int"))
    searched = F.reduce(rounds, F.struct(F.lit(0).alias("lo"), F.size(ts).alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(x.isNotNull(), F.coalesce(F.when(F.size(ts) <= SHORT, counted).otherwise(searched), F.lit(0)))


def _longest(thresholds: DataFrame, key: str) -> int:
    return thresholds.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, is_cell, cell, part) in order to the cells, with the steps of their key before them in the task, and one row per key and task with all its steps."""
    key, steps = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode()
        codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        step = ~batch.column(1).to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        total = np.cumsum(step)
        first = batch.column(0)[0].as_py()
        carry = steps if key is not None and key[0] == first else 0
        base = np.repeat(total[runs] - step[runs], np.diff(np.concatenate([runs, [len(codes)]])))
        near = total - base
        near[: runs[1] if len(runs) > 1 else len(codes)] += carry
        if key is not None and key[0] != first:
            yield _totals([key[0]], [steps], batch, key[1])
        ends = np.concatenate([runs[1:], [len(codes)]]) - 1
        part = batch.column(3)[0].as_py()
        done = [batch.column(0)[int(e)].as_py() for e in ends[:-1]]
        if done:
            yield _totals(done, near[ends[:-1]].tolist(), batch, part)
        key, steps = (batch.column(0)[int(ends[-1])].as_py(), part), int(near[-1])
        cells = batch.filter(batch.column(1))
        yield pa.RecordBatch.from_arrays([cells.column(0), cells.column(2), cells.column(3), pc.filter(pa.array(near, pa.int64()), batch.column(1)), pa.array([True] * cells.num_rows, pa.bool_())], ["key", "cell", "part", "near", "is_cell"])
        schema = batch
    if key is not None:
        yield _totals([key[0]], [steps], schema, key[1])


def _totals(keys: list, steps: list[int], batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, batch.schema.field(0).type), pa.nulls(n, batch.schema.field(2).type), pa.array([part] * n, pa.int32()), pa.array(steps, pa.int64()), pa.array([False] * n, pa.bool_())],
        ["key", "cell", "part", "near", "is_cell"],
    )


def range_count(cells: DataFrame, thresholds: DataFrame, channel: str | None = "c", val: str = "val", name: str = "reached") -> DataFrame:
    """Add how many thresholds of its channel are at or below each cell's value, for lists of any length.

    Cells and thresholds are sorted together along sampled ranges of (channel, value); a task counts the thresholds it passes,
    and the totals of the ranges before, one row per channel and range, are added by a join. Cells of one value may lie in
    several ranges. A null value counts nothing and stays null."""
    key = F.lit(0) if channel is None else cells[channel]
    step_key = F.lit(0) if channel is None else thresholds["c"]
    row = F.struct(*[cells[c] for c in cells.columns])
    kind = F.lit(True), F.lit(False)
    have = cells.where(cells[val].isNotNull()).select(key.alias("key"), cells[val].cast("double").alias("v"), kind[0].alias("is_cell"), row.alias("cell"), F.xxhash64(*cells.columns).alias("tie"))
    none = F.lit(None).cast(have.schema["cell"].dataType)
    steps = thresholds.where(thresholds["t"].isNotNull()).select(step_key.cast(have.schema["key"].dataType).alias("key"), thresholds["t"].cast("double").alias("v"), kind[1].alias("is_cell"), none.alias("cell"), F.lit(0).cast("long").alias("tie"))
    order = ["key", "v", "is_cell", "tie"]
    placed = have.unionByName(steps).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("key", "is_cell", "cell", F.spark_partition_id().alias("part"))
    kinds = ", ".join(f"{n} {placed.schema[n].dataType.simpleString()}" for n in ("key", "cell"))
    counted = saved(placed.mapInArrow(_counted, f"{kinds}, part int, near bigint, is_cell boolean"), "range-count")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.where("NOT is_cell").groupBy("key", "part").agg(F.max("near").alias("n"))
    far = totals.select(F.col("key").alias("_key"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("far"))
    met = counted.where("is_cell").join(far, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    out = met.select("cell.*", (F.col("near") + F.col("far")).alias(name))
    return out.unionByName(cells.where(cells[val].isNull()).withColumn(name, F.lit(None).cast("long")))


def multi_threshold(
    cells: DataFrame,
    thresholds: DataFrame,
    out_scale: float = 1,
    out_bias: float = 0,
    channel: str | None = "c",
    val: str = "val",
    spread: tuple[str, ...] = ("row_id",),
) -> DataFrame:
    """Apply per-channel thresholds to cells; ``channel=None`` shares one list with all channels.

    One array per channel is joined by broadcast (checked) or by salted shuffle; rows do not
    multiply. Lists beyond ``MAX_STEPS`` are counted by ``range_count``. Bipolar output is ``out_scale=2, out_bias=-1``.
    """
    key = channel or "_all"
    steps = thresholds.withColumnRenamed("c", key) if channel else thresholds.select(F.lit(0).alias(key), "t")
    if fits_broadcast(steps.select(key, "t"), MAX_STEPS) or _longest(steps, key) <= MAX_STEPS:
        keyed = cells if channel else cells.withColumn(key, F.lit(0))
        joined = param_join(keyed, threshold_arrays(steps, (key,)), [key], "left", spread=spread)
        reached = count_reached(F.col(val), F.col("ts"))
    else:
        joined = range_count(cells, thresholds if channel else steps.select("t"), channel, val, "_reached")
        reached = F.col("_reached")
    return joined.withColumn(val, reached * F.lit(out_scale) + F.lit(out_bias)).select(*cells.columns)


def multi_threshold_wide(
    cells: DataFrame, thresholds: DataFrame, out_scale: float = 1, out_bias: float = 0, chunk: int = 64, spread: tuple[str, ...] = ("row_id",)
) -> DataFrame:
    """For channels with very many steps: thresholds are cut into chunks of ``chunk`` steps.

    Only the chunk that contains ``x`` is read in full: whole chunks below it are counted from
    their sizes. Every cell meets its channel's chunk heads and one chunk, never every step. A channel with
    more than ``MAX_STEPS`` chunks goes to ``range_count``.
    """
    if not fits_broadcast(thresholds.select("c", "t"), MAX_STEPS) and _longest(thresholds, "c") > MAX_STEPS * chunk:
        counted = range_count(cells, thresholds, "c", "val", "_reached")
        return counted.withColumn("val", F.col("_reached") * F.lit(out_scale) + F.lit(out_bias)).select(*cells.columns)
    chunks = thresholds.withColumn("k", whole_div(F.col("step"), chunk)).groupBy("c", "k").agg(
        F.array_sort(F.collect_list("t")).alias("ts"), F.min("t").alias("head"), F.min("step").alias("before")
    )
    heads = chunks.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("head", "k", "before"))).alias("heads"))
    located = param_join(cells, heads, ["c"], "left", spread=spread)
    reached = F.filter("heads", lambda h: h["head"] <= F.col("val"))
    last = F.when(F.size(reached) > 0, F.element_at(reached, -1))
    located = located.withColumn("k", last["k"]).withColumn("_before", last["before"]).drop("heads")
    full = param_join(located, chunks.select("c", "k", "ts"), ["c", "k"], "left", spread=spread)
    count = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(count_reached(F.col("val"), F.col("ts")), F.lit(0))
    y = F.when(F.col("val").isNotNull(), count * F.lit(out_scale) + F.lit(out_bias))
    return full.withColumn("val", y).select(*cells.columns)


def threshold_vector(vec: Column, ts: Column) -> Column:
    """Array form: ``ts`` holds one ascending array per channel, or a single one for all."""
    return F.transform(
        vec,
        lambda x, i: count_reached(x, F.when(F.size(ts) == 1, F.element_at(ts, 1)).otherwise(F.try_element_at(ts, i + 1))),
    )
