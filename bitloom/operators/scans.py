"""Running values over long ordered groups without sorting a whole group in one task.

A group is cut into blocks of its integer order and each block is scanned by its own task. The
block totals are scanned the same way, in groups of blocks, so that order values with any gaps
leave at most 2^20 values, 2^22 blocks or 2^22 groups of blocks to one task. How many levels that takes
follows from the least and the largest order value, which are read first: up to 2^42 values apart it is one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: a block spans 2^20 order values, a group 2^22 blocks
BLOCK_BITS = 20
GROUP_BITS = 22
ORDER_BITS = 64


def _same_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row of ``other`` per key to each row; a null key is a key."""
    named = other.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.join(named, on).drop(*[f"_key_{i}" for i in range(len(keys))])


def _before(totals: DataFrame, keys: Sequence[str], sums: Sequence[str], lasts: Sequence[str], bits: int, order_bits: int) -> DataFrame:
    """``_far_*``: what all blocks of a key before block ``_blk`` add up to; a block spans ``2^bits`` of ``2^order_bits`` order values."""
    top = bits + GROUP_BITS >= order_bits
    work = totals if top else totals.withColumn("_grp", F.shiftright("_blk", GROUP_BITS))
    place = [*keys] if top else [*keys, "_grp"]
    past = Window.partitionBy(*place).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    near = work.select(
        *place,
        "_blk",
        *[F.coalesce(F.sum(f"_tot_{n}").over(past), F.lit(0)).alias(f"_far_{n}") for n in sums],
        *[F.last(f"_tot_{n}", ignorenulls=True).over(past).alias(f"_far_{n}") for n in lasts],
    )
    if top:
        return near
    groups = work.groupBy(*place).agg(
        *[F.sum(f"_tot_{n}").alias(f"_tot_{n}") for n in sums],
        *[F.max_by(F.col(f"_tot_{n}"), F.when(F.col(f"_tot_{n}").isNotNull(), F.struct("_blk"))).alias(f"_tot_{n}") for n in lasts],
    )
    outer = _before(groups.withColumnRenamed("_grp", "_blk"), keys, sums, lasts, bits + GROUP_BITS, order_bits)
    outer = outer.withColumnsRenamed({"_blk": "_grp"} | {f"_far_{n}": f"_out_{n}" for n in [*sums, *lasts]})
    joined = _same_keys(near, outer, place)
    return joined.select(
        *keys,
        "_blk",
        *[(F.col(f"_far_{n}") + F.col(f"_out_{n}")).alias(f"_far_{n}") for n in sums],
        *[F.coalesce(f"_far_{n}", f"_out_{n}").alias(f"_far_{n}") for n in lasts],
    )


def _range_of(df: DataFrame, place: Column) -> tuple[int, int]:
    """Where the order values begin and how many bits their range takes; 0 and all bits where differences might not fit."""
    least, most = df.agg(F.min(place), F.max(place)).first()
    if least is None:
        return 0, 1
    width = (most - least).bit_length()
    return (least, width) if width < ORDER_BITS - 1 else (0, ORDER_BITS)


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = True,
    block_bits: int = BLOCK_BITS,
    order_bits: int | None = None,
) -> DataFrame:
    """Add running sums and last non-null values per key.

    ``order_by[0]`` is an integer column; together the order columns are unique per key. With
    ``inclusive=False`` a row sees only the rows before it. Give ``order_bits`` where the order is known to run from 0 to
    less than ``2^order_bits``; otherwise its range is read.
    """
    sums, lasts, keys = sums or {}, lasts or {}, list(keys)
    place, first = F.col(order_by[0]).cast("long"), 0
    if order_bits is None:
        first, order_bits = _range_of(df, place)
    work = df.withColumn("_blk", F.shiftright(place - F.lit(first), block_bits))
    for name, c in {**sums, **lasts}.items():
        work = work.withColumn(f"_in_{name}", c)
    order = [F.col(c) for c in order_by]
    near = Window.partitionBy(*keys, "_blk").orderBy(*order)
    near = near.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = work
    for name in sums:
        local = local.withColumn(f"_near_{name}", F.sum(f"_in_{name}").over(near))
    for name in lasts:
        local = local.withColumn(f"_near_{name}", F.last(f"_in_{name}", ignorenulls=True).over(near))
    position = F.struct(*order)
    totals = work.groupBy(*keys, "_blk").agg(
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
        *[
            F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_tot_{n}")
            for n in lasts
        ],
    )
    carry = _before(totals, keys, list(sums), list(lasts), block_bits, order_bits)
    joined = _same_keys(local, carry, keys + ["_blk"])
    zero = F.lit(0)
    out = [F.col(c) for c in df.columns]
    out += [(F.coalesce(f"_near_{n}", zero) + F.coalesce(f"_far_{n}", zero)).alias(n) for n in sums]
    out += [F.coalesce(f"_near_{n}", f"_far_{n}").alias(n) for n in lasts]
    return joined.select(*out)


def row_numbers(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str = "seq", **options) -> DataFrame:
    """Dense position from 0 within each key."""
    numbered = block_scan(df, keys, order_by, sums={name: F.lit(1).cast("long")}, **options)
    return numbered.withColumn(name, F.col(name) - 1)
